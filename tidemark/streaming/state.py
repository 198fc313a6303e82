"""The state store that stateful processors need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which processors with timers and lists need; it holds more than memory does."""
    old = spark.conf.get(CONF, None)
    spark.conf.set(CONF, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CONF)
        else:
            spark.conf.set(CONF, old)
