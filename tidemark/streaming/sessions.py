"""Counter deltas and forward fill per session, over a stream whose rows come in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.timeutil import instant
from tidemark.sources.logs import EVENT, NEEDLE, RECORD

#: due is the place at which a row follows, next the one at which its successor does: lines have their byte offset and the next line's.
EVENTS = "session string, seq long, due long, next long, context_model string, input long, cached long, output long, epoch long"
DELTAS = "session string, seq long, epoch long, model string, input long, output long, cache_creation long, cache_read long"
SEEN = "next long, model string, input long, cached long, output long"
HELD = EVENTS.removeprefix("session string, ")
COLUMNS = [c.split()[0] for c in HELD.split(", ")]


def arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns as arrays, numbers as whole ones; ``x?`` tells where x isn't null."""
    out = {}
    for c in COLUMNS:
        values, there = rows[c].to_numpy(), rows[c].notna().to_numpy()
        if c == "context_model":
            out[c] = np.where(there, values, None)
        else:
            out[c] = np.zeros(len(rows), "int64")
            out[c][there] = values[there].astype("int64")
        out[f"{c}?"] = there
    return out


def at(rows: dict[str, np.ndarray], places) -> dict[str, np.ndarray]:
    return {c: a[places] for c, a in rows.items()}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def in_turn(rows: dict[str, np.ndarray], place: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows that follow one another from ``place`` on, and those that are ahead of a gap; rows that were there before are left out."""
    order = np.flatnonzero(rows["due"] >= place)
    order = order[np.argsort(rows["due"][order], kind="stable")]
    order = order[np.diff(rows["due"][order], prepend=-1) != 0]
    due, after = rows["due"][order], rows["next"][order]
    fits = due == np.concatenate([[place], after[:-1]])
    n = len(order) if fits.all() else int(np.argmin(fits))
    return at(rows, order[:n]), at(rows, order[n:])


def log_events(lines: DataFrame) -> DataFrame:
    """Lines of ``sources.growing`` as EVENTS, each file a session: every line is a row, as the chain needs it, most of them without values."""
    about = F.col("value").contains(NEEDLE) | F.col("value").contains("turn_context")
    parsed = lines.withColumn("j", F.when(about, F.from_json("value", EVENT, {"columnNameOfCorruptRecord": "_corrupt"})))
    good, counts = F.col("j").isNotNull() & F.col("j._corrupt").isNull(), F.col("j.payload.info.total_token_usage")
    epoch = instant(F.col("j.timestamp"))
    is_count = good & (F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count") & epoch.isNotNull() & counts["input_tokens"].isNotNull() & counts["output_tokens"].isNotNull()
    return parsed.select(
        F.col("file_path").alias("session"),
        F.col("line_no").alias("seq"),
        F.col("line_no").alias("due"),
        F.col("next_no").alias("next"),
        F.when(good & (F.col("j.type") == "turn_context"), F.col("j.payload.model")).alias("context_model"),
        F.when(is_count, counts["input_tokens"]).alias("input"),
        F.when(is_count, F.coalesce(counts["cached_input_tokens"], F.lit(0).cast("long"))).alias("cached"),
        F.when(is_count, counts["output_tokens"]).alias("output"),
        F.when(good, epoch).alias("epoch"),
    )


def records_of(deltas: DataFrame, tenant: str | None = None) -> DataFrame:
    """DELTAS of log files as usage records."""
    fixed = {"tenant": F.lit(tenant).cast("string"), "provider": F.lit("codex"), "block": F.lit(0).cast("long"), "dedup_key": F.lit(None).cast("string")}
    return deltas.withColumnsRenamed({"session": "file_path", "seq": "line_no"}).withColumns(fixed).select(*RECORD)


class SessionCounters(StatefulProcessor):
    """Value state: the place reached, model and counters as last seen. List state: rows ahead of a gap. A timer ends idle sessions."""

    def __init__(self, idle: float | None = None):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)
        self.ahead = handle.getListState("ahead", HELD)

    def records(self, session: str, rows: dict[str, np.ndarray], model, counts: list[int]) -> tuple[pd.DataFrame, object, list[int]]:
        """The records of rows in their order, and model and counters after them."""
        last = np.maximum.accumulate(np.where(rows["context_model?"], np.arange(len(rows["due"])), -1))
        named = np.where(last < 0, model, rows["context_model"][last])
        some = rows["input?"] & rows["output?"]
        now = np.stack([rows[c][some] for c in ("input", "cached", "output")], axis=1)
        grown = np.maximum(0, np.diff(now, axis=0, prepend=np.array([counts], "int64")))
        out = pd.DataFrame({
            "session": session,
            "seq": rows["seq"][some],
            "epoch": pd.arrays.IntegerArray(rows["epoch"][some], ~rows["epoch?"][some]),
            "model": named[some],
            "input": np.maximum(0, grown[:, 0] - grown[:, 1]),
            "output": grown[:, 2],
            "cache_creation": 0,
            "cache_read": grown[:, 1],
        })
        return out, named[-1], now[-1].tolist() if len(now) else counts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, model, *counts = self.seen.get() if self.seen.exists() else (0, None, 0, 0, 0)
        before = [arrays(pd.DataFrame(list(self.ahead.get()), columns=COLUMNS, dtype=object))] if self.ahead.exists() else []
        held, latest = before, None
        for pdf in rows:
            new = arrays(pdf)
            epochs = new["epoch"][new["epoch?"]]
            latest = max((t for t in (latest, int(epochs.max()) if len(epochs) else None) if t is not None), default=None)
            held = [*held, at(new, new["due"] >= place)]
            if not (new["due"] == place).any():
                continue
            ready, rest = in_turn(joined(held), place)
            held = [rest] if len(rest["due"]) else []
            place = int(ready["next"][-1])
            out, model, counts = self.records(key[0], ready, model, counts)
            yield out
        self.seen.update((place, model, *counts))
        kept = in_turn(joined(held), place)[1] if held else {"due": []}
        if len(kept["due"]):
            columns = [[x if there else None for x, there in zip(kept[c].tolist(), kept[f"{c}?"], strict=True)] for c in COLUMNS]
            self.ahead.put(list(zip(*columns, strict=True)))
        elif before:
            self.ahead.clear()
        if self.idle is not None and latest is not None:
            old = list(self.handle.listTimers())
            for timer in old:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([*old, int((latest + self.idle) * 1000)]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, model, *counts = self.seen.get() if self.seen.exists() else (0, None, 0, 0, 0)
        if self.ahead.exists():
            left = arrays(pd.DataFrame(list(self.ahead.get()), columns=COLUMNS, dtype=object))
            yield self.records(key[0], at(left, np.argsort(left["due"], kind="stable")), model, counts)[0]
        self.ahead.clear()
        self.seen.clear()


def counter_stream(events: DataFrame, idle: float | None = None) -> DataFrame:
    """``events`` (EVENTS) to DELTAS: rows with a context_model set the model, rows with counters give records.

    A session's rows form a chain from due 0 on, each due where the one before has
    its next, and are taken in that order, whatever batches they come in: rows
    ahead of a gap wait in the state, rows that come again are passed over. Without
    ``idle`` state is never dropped, and rows may come however late. With it, in
    seconds, epoch drives a watermark that is ``idle`` behind the newest
    row: rows older than that are dropped, and a session whose last row is ``idle``
    older than that ends. Its rows that still wait are then given out as if nothing
    were missing between them, and its state goes. Start the query within
    ``state.keyed_state``.
    """
    if idle is not None:
        events = events.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", f"{idle} seconds")
    mode = "None" if idle is None else "EventTime"
    return events.groupBy("session").transformWithStateInPandas(SessionCounters(idle), DELTAS, "Append", mode)
