"""Queries that write the tables as logs, price documents or streams, and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import dedup
from tidemark.plans.events import USAGE_SQL, table, usage
from tidemark.plans.queries import MERGED_SQL, merged, query
from tidemark.schema import COUNTERS
from tidemark.sources import days, logs, prices, read_usage, reports, rollups, stage
from tidemark.sources.growing import growing_lines, opened
from tidemark.sources.lines import read_lines
from tidemark.sources.shared import scratch
from tidemark.streaming import dedup as stream_dedup
from tidemark.streaming import deltas, rates, sessions
from tidemark.streaming.state import keyed_state

SESSIONS = 16  # where files are renamed or listed one by one
SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTERS)
USERS = 10  # of a session elsewhere, so that sessions grow in number with the table, not in size


def few_users() -> Column:
    return F.expr(f"user_id div {USERS}")


def shelf() -> Column:
    """Of a thousand parts, so that price documents grow in number with the table, not in size."""
    return F.expr("p_partkey div 1000").alias("shelf")


def turn_lines(spark: SparkSession, sf_dir: str, session: Column | None = None) -> DataFrame:
    """Events as JSON lines with a usage in each turn: (session, event_id, value)."""
    rows = usage(spark, sf_dir)
    body = F.struct(
        F.date_format(F.timestamp_add("SECOND", F.col("epoch"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("dedup_key").isNotNull(), F.col("event_type")).alias("requestId"),
        F.struct(
            F.col("user_id").cast("string").alias("id"),
            "model",
            F.struct(*[F.col(c).alias(n) for c, n in zip(COUNTERS, ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), strict=True)]).alias("usage"),
        ).alias("message"),
    )
    session = F.col("user_id") % SESSIONS if session is None else session
    return rows.select(session.alias("session"), "event_id", F.to_json(body).alias("value"))


def written(lines: DataFrame, name: str, folder: str | None = None) -> str:
    """Lines as text files below a new folder, a file for each session, in the order of event_id."""
    folder = folder or scratch(lines.sparkSession, name)
    ordered = lines.repartition("session").sortWithinPartitions("session", "event_id")
    ordered.select("session", "value").write.partitionBy("session").text(folder)
    return folder


BEST_SQL = f"with {USAGE_SQL} select coalesce(dedup_key, '') as dedup_key, model, cast(max(output) as bigint) as output, 1 as n from usage where dedup_key is not null group by dedup_key, model union all select '', model, output, cast(count(*) as int) from usage where dedup_key is null group by model, output"


def best(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("dedup_key", F.lit("")).alias("dedup_key"), "model", "output").agg(F.count("*").cast("int").alias("n"))


@query(BEST_SQL)
def turn_logs(spark, d):
    lines = read_lines(spark, [written(turn_lines(spark, d, few_users()), "turns")], "*.txt")
    return best(dedup.keep_max(logs.turn_records(lines), order=("file_path", "block", "line_no")))


COUNTER_LOGS_SQL = f"""with {USAGE_SQL}, s as (select *, user_id // {USERS} as session, event_type in ('click', 'purchase') as is_count from usage),
filled as (select *, last_value(case when not is_count then model end ignore nulls) over (partition by session order by event_id rows between unbounded preceding and current row) as context from s),
deltas as (select context, {', '.join(f"greatest(0, {c} - coalesce(lag({c}) over w, 0)) as {c}" for c in ("input", "output", "cache_creation"))} from filled where is_count window w as (partition by session order by event_id))
select coalesce(context, '') as model, cast(count(*) as bigint) as n, cast(sum(greatest(0, input - cache_creation)) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache_creation) as bigint) as cache_read from deltas group by 1"""


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of counters and contexts, of few users a session: (session, event_id, value)."""
    rows, counts = usage(spark, sf_dir), F.col("event_type").isin("click", "purchase")
    info = F.struct(F.struct(F.col("input").alias("input_tokens"), F.col("cache_creation").alias("cached_input_tokens"), F.col("output").alias("output_tokens")).alias("total_token_usage"))
    body = F.struct(
        F.when(counts, "event_msg").otherwise("turn_context").alias("type"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.struct(F.when(counts, "token_count").alias("type"), F.when(~counts, F.col("model")).alias("model"), F.when(counts, info).alias("info")).alias("payload"),
    )
    return rows.select(few_users().alias("session"), "event_id", F.to_json(body).alias("value"))


def by_model(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read")])


@query(COUNTER_LOGS_SQL)
def counter_logs(spark, d):
    return by_model(logs.counter_records(read_lines(spark, [written(counter_lines(spark, d), "counters")], "*.txt")))


FATE_SQL = "case event_id % 12 when 1 then 'not json' when 2 then 'wrong type' when 3 then 'no usage' when 4 then 'no instant' when 5 then 'other' else 'record' end"


@query(f"""with {USAGE_SQL}, f as (select {FATE_SQL} as fate, output from usage)
select fate, cast(count(*) as bigint) as lines, cast(sum(case when fate = 'record' then output else 0 end) as bigint) as output from f group by fate union all select 'lines', count(*), 0 from f""")
def judged_lines(spark, d):
    """Log lines of which some are broken in one of four ways, some about something else: each is counted, and the dropped ones are kept with their reasons."""
    odd = F.col("event_id") % 12
    broken = (
        F.when(odd == 1, F.expr("left(value, length(value) - 1)"))
        .when(odd == 2, F.regexp_replace("value", '"input_tokens":([0-9]+)', '"input_tokens":"$1"'))
        .when(odd == 3, F.regexp_replace("value", '"output_tokens":', '"other_tokens":'))
        .when(odd == 4, F.regexp_replace("value", '("timestamp":"[0-9-]+)T[^"]*"', '$1"'))
        .when(odd == 5, F.lit('{"type":"summary"}'))
        .otherwise(F.col("value"))
    )
    lines = turn_lines(spark, d, few_users()).withColumn("value", broken)
    found = logs.judged_turns(read_lines(spark, [written(lines, "broken")], "*.txt"))
    zero = F.lit(0).cast("long")
    good = found.records.agg(F.lit("record").alias("fate"), F.count("*").alias("lines"), F.sum("output").alias("output"))
    bad = found.dropped.groupBy(F.col("reason").alias("fate")).agg(F.count("*").alias("lines"), zero.alias("output"))
    counted = spark.createDataFrame([(k, found.metrics[k], 0) for k in ("other", "lines")], "fate string, lines long, output long")
    return good.unionByName(bad).unionByName(counted)


def renamed(spark: SparkSession, folder: str, prefix: str) -> None:
    """Give the files of a folder's sessions, one each, names with a prefix and the ending of logs."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{folder}/session=*/part-*")):
        old = part.getPath()
        files.rename(old, path(f"{old.getParent()}/{prefix}{old.getName()}.jsonl"))


@query(f"with {USAGE_SQL} select 'user-' || user_id % {SESSIONS} as tenant, cast(count(*) as bigint) as n, cast(sum(output) as bigint) as output from usage where user_id % {SESSIONS} % 3 > 0 group by 1")
def rollout_scan(spark, d):
    """Files below sessions/ whose names begin with rollout- are logs with counters; others beside them aren't read."""
    body = F.struct(
        F.lit("event_msg").alias("type"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(F.lit(0).alias("input_tokens"), F.col("sum").alias("output_tokens")).alias("total_token_usage")).alias("info")).alias("payload"),
    )
    session = F.col("user_id") % SESSIONS
    growing = F.sum("output").over(Window.partitionBy(session).orderBy("event_id"))
    lines = usage(spark, d).withColumn("sum", growing).select(session.alias("session"), "event_id", F.to_json(body).alias("value"))
    base = scratch(spark, "rollouts")
    for prefix, some in (("rollout-", "session % 3 > 0"), ("other-", "session % 3 = 0")):
        folder = f"{base}/sessions/{prefix}kind"
        written(lines.where(some), "", folder)
        renamed(spark, folder, prefix)
    number = F.regexp_extract("file_path", "session=([0-9]+)", 1)
    return logs.counters(spark, [base]).groupBy(F.concat(F.lit("user-"), number).alias("tenant")).agg(F.count("*").alias("n"), F.sum("output").alias("output"))


@query(f"""with {USAGE_SQL} select 'claude-native' as provider, coalesce(dedup_key, '') as dedup_key, cast(max(output) as bigint) as output, 1 as n from usage where dedup_key is not null group by dedup_key
union all select 'claude-native', '', output, cast(count(*) as int) from usage where dedup_key is null group by output""")
def provider_registry(spark, d):
    """Providers by name: a folder that is named twice counts once, and one that isn't there has no records."""
    base = scratch(spark, "providers")
    folder = f"{base}/projects/all"
    written(turn_lines(spark, d), "", folder)
    renamed(spark, folder, "")
    rows = read_usage(spark, {"claude-native": [base, f"{base}/", f"{base}-absent"], "codex": [f"{base}-absent"]}, "t")
    return rows.where("tenant = 't'").groupBy("provider", F.coalesce("dedup_key", F.lit("")).alias("dedup_key"), "output").agg(F.count("*").cast("int").alias("n"))


@query(f"with {MERGED_SQL} select cast(row_number() over (order by day) as int) as place, day, cast(total_tokens as varchar) as total_tokens from merged")
def daily_series(spark, d):
    """The daily report as a written file's lines, whose places come from the file: days ascend."""
    path = scratch(spark, "daily")
    reports.write_tsv(reports.daily_report(merged(spark, d)), path, ["day"])
    lines = read_lines(spark, [path], "*.csv")
    place = F.row_number().over(Window.orderBy("block", "line_no")).cast("int").alias("place")  # a line a day
    field = F.split("value", "\t")
    return lines.select(place, field[0].alias("day"), field[5].alias("total_tokens"))


@query("select 'm' || p_partkey as model, cast(p_size as double) as input, case when p_partkey % 2 = 0 then p_retailprice else 0 end as output from part where p_partkey % 3 > 0")
def price_files(spark, d):
    """Parts as price entries, some of them without a usable input price, a document for each brand, size and shelf."""
    part, odd = table(spark, d, "part"), F.col("p_partkey") % 3 == 0
    entry = F.to_json(F.struct(F.when(~odd, F.col("p_size").cast("double")).alias("input_cost_per_token"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("output_cost_per_token")))
    pairs = part.select("p_brand", "p_size", shelf(), F.concat(F.lit('"m'), F.col("p_partkey").cast("string"), F.lit('":'), entry).alias("pair"))
    docs = pairs.groupBy("p_brand", "p_size", "shelf").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ","), F.lit("}")).alias("doc"))
    return prices.flat_prices(docs).select("model", "input", "output")


@query("select 'm' || p_partkey as model, cast(p_size as double) / 1e6 as input, case when p_partkey % 2 = 0 then p_retailprice / 1e6 else 0 end as output from part where p_partkey % 3 > 0 and p_brand in ('Brand#1', 'Brand#2')")
def nested_price_files(spark, d):
    """Parts as models of their brand's provider, a document for each brand, size and shelf; two providers are asked for."""
    part, odd = table(spark, d, "part"), F.col("p_partkey") % 3 == 0
    cost = F.struct(F.when(~odd, F.col("p_size").cast("double")).alias("input"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("output"))
    pairs = part.select("p_brand", "p_size", shelf(), F.concat(F.lit('"m'), F.col("p_partkey").cast("string"), F.lit('":'), F.to_json(F.struct(cost.alias("cost")))).alias("pair"))
    models = pairs.groupBy("p_brand", "p_size", "shelf").agg(F.array_join(F.collect_list("pair"), ",").alias("models"))
    docs = models.select(F.concat(F.lit('{"'), "p_brand", F.lit('":{"models":{'), "models", F.lit("}}}")).alias("doc"))
    return prices.nested_prices(docs, ["Brand#1", "Brand#2"]).select("model", "input", "output")


@query(f"with {USAGE_SQL} select user_id % {SESSIONS} as session, cast(count(*) as bigint) as n, cast(sum(output) as bigint) as output from usage where user_id % {SESSIONS} <> 3 group by 1")
def incremental_stage(spark, d):
    """A first scan of half the sessions, then one of all but one: only new and changed files are parsed."""
    lines, home = turn_lines(spark, d), scratch(spark, "stage")
    first = written(lines.where("session % 2 = 1"), "first")
    stage.refresh(spark, home, [first], logs.turn_records, "*.txt")
    rest = written(lines.where("session % 2 = 0"), "second")
    roots = [f"{first}/session={s}" for s in range(1, SESSIONS, 2) if s != 3]
    stage.refresh(spark, home, [*roots, rest], logs.turn_records, "*.txt")
    session = F.regexp_extract("file_path", "session=([0-9]+)", 1).cast("long")
    return stage.load(spark, home).groupBy(session.alias("session")).agg(F.count("*").alias("n"), F.sum("output").alias("output"))


def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn_lines with a file for each day and a thousand users."""
    lines = turn_lines(spark, sf_dir, F.concat_ws("-", "day", F.expr("user_id div 1000")))
    return lines.withColumn("day", F.substring("session", 1, 10))


LAST_DAY, GONE_DAY = "2024-01-30", "2024-01-07"


def two_refreshes(spark: SparkSession, sf_dir: str, name: str, then: Callable[[SparkSession, str], object] | None = None) -> tuple[str, DataFrame]:
    """A stage by dates, first with the last day's files half written, then with them grown and one day's files removed; ``then`` is what follows each refresh."""
    lines, home = day_files(spark, sf_dir), scratch(spark, name)
    rest = written(lines.where(f"day not in ('{LAST_DAY}', '{GONE_DAY}')"), f"{name}-rest")
    gone = written(lines.where(f"day = '{GONE_DAY}'"), f"{name}-gone")
    half = written(lines.where(f"day = '{LAST_DAY}' and event_id % 2 = 0"), f"{name}-half")
    days.refresh(spark, home, [rest, gone, half], logs.turn_records, "*.txt")
    if then:
        then(spark, home)
    whole = written(lines.where(f"day = '{LAST_DAY}'"), f"{name}-whole")
    rewritten = days.refresh(spark, home, [rest, whole], logs.turn_records, "*.txt")
    if set(rewritten) != {LAST_DAY, GONE_DAY}:
        raise AssertionError(f"rewrote {rewritten}")
    if then:
        then(spark, home)
    return home, lines


@query(f"with {USAGE_SQL} select day as date, cast(count(*) as bigint) as n, cast(sum(output) as bigint) as output from usage where day between '2024-01-05' and '2024-01-31' and day <> '{GONE_DAY}' group by day")
def stage_by_date(spark, d):
    """A stage whose second refresh rewrites the two dates that changed, read for a range of dates."""
    home, _ = two_refreshes(spark, d, "dates")
    return days.load(spark, home, logs.turn_records, "2024-01-05", "2024-01-31").groupBy("date").agg(F.count("*").alias("n"), F.sum("output").alias("output"))


@query(f"""with {USAGE_SQL}, there as (select * from usage where day <> '{GONE_DAY}'),
top as (select dedup_key, max(output) as output from there where dedup_key is not null group by 1),
best as (select u.* from there u left join top t on u.dedup_key = t.dedup_key where u.dedup_key is null or u.output = t.output
  qualify u.dedup_key is null or row_number() over (partition by u.dedup_key order by day, cast(user_id // 1000 as varchar), event_id) = 1)
select day, minute, {SUMS}, cast(count(*) as bigint) as records from best group by day, minute""")
def maintained_minutes(spark, d):
    """Sums of minutes that two refreshes have kept up to date: days that grew or went, and keys that move to another day by that."""
    home, lines = two_refreshes(spark, d, "maintained", rollups.refresh)
    return rollups.minutes(spark, home)


def streamed(frame: DataFrame, name: str, order: str = "event_id") -> str:
    """Rows as a few Parquet files, in order, for a file stream to take up."""
    folder = scratch(frame.sparkSession, name)
    frame.repartitionByRange(4, order).sortWithinPartitions(order).write.parquet(folder)
    return folder


def complete(stream: DataFrame, name: str) -> DataFrame:
    """The last result of a streamed aggregation, through the shared folder."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    last = []

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")
        last.append(epoch)

    query = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", scratch(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[-1]}")


STREAM = "event_id long, epoch long, user_id long, model string, dedup_key string, file_path string, line_no long, input long, output long, cache_creation long, cache_read long"


def event_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder = streamed(usage(spark, sf_dir).selectExpr(*[c.split()[0] for c in STREAM.split(", ")]), name)
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 2).parquet(folder)




@query(f"with {USAGE_SQL} select cast(epoch(date_trunc('second', ts)) as bigint) // 300 * 300 as start, {SUMS} from usage group by 1")
def stream_tumbling(spark, d):
    return complete(rates.tumbling(event_stream(spark, d, "events")), "tumbling").select(F.unix_seconds("start").alias("start"), *COUNTERS)


@query(f"with {USAGE_SQL}, t as (select *, cast(epoch(date_trunc('second', ts)) as bigint) // 900 * 900 as last from usage) select last - k * 900 as start, {SUMS} from t, unnest(range(0, 4)) as u(k) group by 1")
def stream_sliding(spark, d):
    rows = complete(rates.sliding(event_stream(spark, d, "events"), "60 minutes", "15 minutes"), "sliding")
    return rows.select(F.unix_seconds("start").alias("start"), *COUNTERS)


@query(f"with {USAGE_SQL}, t as (select *, cast(epoch(date_trunc('second', ts)) as bigint) // 60 * 60 as last from usage) select last - k * 60 as start, {SUMS} from t, unnest(range(0, 60)) as u(k) group by 1")
def stream_sliding_minute(spark, d):
    return complete(rates.sliding(event_stream(spark, d, "events")), "minutes").select(F.unix_seconds("start").alias("start"), *COUNTERS)


@query(f"with {USAGE_SQL} select cast(epoch(date_trunc('second', ts)) as bigint) // 300 * 300 as start, {SUMS} from usage group by 1")
def stream_refresh(spark, d):
    """Log lines taken up by a query that runs on by a timer, until all that was there is in its result; each tick writes the windows that it changed."""
    folder, out = written(turn_lines(spark, d), "lines"), scratch(spark, "refreshed")
    records = logs.turn_records(rates.stream_lines(spark, folder, "*.txt"))
    running = rates.refreshing(rates.tumbling(records), rates.changes_sink(out), scratch(spark, "refreshed-progress"), mode="update", every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return rates.latest(spark.read.parquet(f"{out}/*"), ["start"]).select(F.unix_seconds("start").alias("start"), *COUNTERS)


STEPS = 3


def in_steps(lines: DataFrame, name: str) -> DataFrame:
    """Lines with the step in which each comes, even shares of each session in the order of event_id; written once for all steps."""
    folder = scratch(lines.sparkSession, name)
    per_step = F.ntile(STEPS).over(Window.partitionBy("session").orderBy("event_id"))
    lines.withColumn("step", per_step).write.parquet(folder)
    return lines.sparkSession.read.parquet(folder)


def grown(lines: DataFrame, home: str, step: int) -> None:
    """Let each session's file below ``home`` grow to all lines with a step up to this one.

    Executors write the longer file beside the old one, which it begins like, and give
    it its name, so a task that runs again does no harm.
    """

    def write(batches) -> Iterator:
        files, base = opened(home)
        files.create_dir(base, recursive=True)
        session, out, new = None, None, f"{base}/.{uuid.uuid4().hex}"

        def close() -> None:
            if out is not None:
                out.close()
                files.move(new, f"{base}/session={session}.jsonl")

        for batch in batches:
            for now, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or now != session:
                    close()
                    session, out = now, files.open_output_stream(new)
                out.write(line.encode() + b"\n")
        close()
        return iter(())

    ordered = lines.where(F.col("step") <= step).repartition("session").sortWithinPartitions("session", "event_id")
    ordered.select("session", "value").mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


@query(BEST_SQL)
def stream_growing_logs(spark, d):
    """Log files that grow between the runs of a stream: each run reads what was appended, and goes on from the checkpoint."""
    lines = in_steps(turn_lines(spark, d, few_users()), "growing-lines")
    home, out, progress = scratch(spark, "growing"), scratch(spark, "grown"), scratch(spark, "grown-progress")
    for step in range(1, STEPS + 1):
        grown(lines, home, step)
        records = logs.turn_records(growing_lines(spark, [home]))
        records.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return best(dedup.keep_max(spark.read.parquet(out), order=("file_path", "block", "line_no")))


@query(f"with {USAGE_SQL}, t as (select *, cast(epoch(date_trunc('second', ts)) as bigint) // 60 * 60 as last from usage) select last - k * 60 as start, {SUMS} from t, unnest(range(0, 60)) as u(k) group by 1")
def stream_sliding_panes(spark, d):
    """The windows of stream_sliding_minute from panes of a minute. A row long after all others closes the last window, without being in one that comes out."""
    rows = usage(spark, d).select("event_id", "epoch", *COUNTERS)
    month = 31 * 86_400
    end = rows.agg(F.max("event_id") + 1, F.max("epoch") + 3 * month).withColumns({c: F.lit(0).cast("long") for c in COUNTERS})
    folder, out = streamed(rows.union(end), "panes"), scratch(spark, "closed-panes")
    stream = rates.paned(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder), late=f"{month} seconds")
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "panes-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.unix_seconds("start").alias("start"), *COUNTERS)


@query(COUNTER_LOGS_SQL)
def stream_growing_counters(spark, d):
    """Logs with counters that grow between the runs of a stream, whose state goes on from line to line."""
    lines = in_steps(counter_lines(spark, d), "counting-lines")
    home, out, progress = scratch(spark, "counting"), scratch(spark, "counted"), scratch(spark, "counted-progress")
    for step in range(1, STEPS + 1):
        grown(lines, home, step)
        with keyed_state(spark):
            deltas_now = sessions.counter_stream(sessions.log_events(growing_lines(spark, [home])))
            deltas_now.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return by_model(sessions.records_of(spark.read.parquet(out)))


LATE = 600  # seconds
CLOSED_SQL = f"""{USAGE_SQL}, t as (select *, event_id % 10 = 0 as late, cast(epoch(date_trunc('second', ts)) as bigint) as second from usage),
w as (select max(second) filter (not late) - {LATE} as first_mark, max(second) - {LATE} as last_mark from t)"""


@query(f"with {CLOSED_SQL} select second // 300 * 300 as start, {SUMS} from t, w where (not late or second // 300 * 300 + 300 > first_mark) and second // 300 * 300 + 300 <= last_mark group by 1")
def stream_late_rows(spark, d):
    """Append mode: windows come once, when the watermark has passed them, and a tenth of the rows, which is late, is dropped for those."""
    folder, out, progress = scratch(spark, "late"), scratch(spark, "closed"), scratch(spark, "closed-progress")
    rows = usage(spark, d).select("event_id", "epoch", *COUNTERS)
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        rows.where(part).write.mode("append").parquet(folder)
        stream = rates.tumbling(spark.readStream.schema(rows.schema).parquet(folder), late=f"{LATE} seconds")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.unix_seconds("start").alias("start"), *COUNTERS)


@query(BEST_SQL)
def stream_dedup_keep_max(spark, d):
    stream, folder = event_stream(spark, d, "events"), scratch(spark, "best")
    query = stream.writeStream.foreachBatch(stream_dedup.keep_max_sink(folder)).option("checkpointLocation", scratch(spark, "best-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return best(stream_dedup.best_rows(spark, folder))


@query(f"""with {USAGE_SQL}, s as (select *, user_id // {USERS} as session from usage),
deltas as (select session, event_id, {', '.join(f"greatest(0, {c} - coalesce(lag({c}) over w, 0)) as {c}" for c in ("input", "output", "cache_creation"))} from s window w as (partition by session order by event_id))
select session || '' as session, event_id as seq, greatest(0, input - cache_creation) as input, output, cache_creation as cache_read from deltas""")
def stream_counter_delta(spark, d):
    """Rows of a session come in any order over the batches; each is due where the one before it ends."""
    session = Window.partitionBy("session").orderBy("seq")
    rows = usage(spark, d).select(few_users().cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("context_model"), "input", F.col("cache_creation").alias("cached"), "output")
    chained = rows.withColumns({"next": F.col("seq") + 1, "due": F.coalesce(F.lag(F.col("seq") + 1).over(session), F.lit(0).cast("long")), "mixed": F.xxhash64("seq")})
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 2).parquet(streamed(chained, "sessions", "mixed"))
    out = scratch(spark, "deltas")
    with keyed_state(spark):
        query = sessions.counter_stream(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "deltas-progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).select("session", "seq", "input", "output", "cache_read")


@query(f"""with {USAGE_SQL}, best as (select * from usage qualify dedup_key is null or row_number() over (partition by dedup_key order by output desc, 'user-' || user_id, event_id) = 1)
select day, minute, {SUMS}, cast(count(*) as bigint) as records from best group by day, minute""")
def stream_signed_minutes(spark, d):
    """Sums of minutes over a stream of growing duplicates: a better row takes its predecessor back, on whatever day that was."""
    folder = scratch(spark, "signed")
    with keyed_state(spark):
        signed = deltas.signed_best(event_stream(spark, d, "events"))
        signed.writeStream.outputMode("append").foreachBatch(deltas.minutes_sink(folder)).option("checkpointLocation", scratch(spark, "signed-progress")).trigger(availableNow=True).start().awaitTermination()
    return deltas.minutes(spark, folder)
