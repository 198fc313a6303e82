"""Registered queries: each operator over whole tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import formats
from tidemark.functions.models import fast_tier, hashed_key, short_name, total, vendor_class
from tidemark.functions.timeutil import Now, instant, month_of
from tidemark.operators import breakeven, counters, curve, dashboard, dedup, legend, pricing, rollup, segments, windows
from tidemark.plans.events import NOW, USAGE_SQL, table, usage
from tidemark.schema import COUNTERS, SETTINGS
from tidemark.sources import reports
from tidemark.sources.stage import diff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOTAL = "input + output + cache_creation + cache_read"
SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTERS)
TODAY, MINUTE = NOW.day, NOW.minute
YESTERDAY = "2024-01-29"
EARLY = Now(TODAY, 30)  # a window of an hour then crosses midnight

PRICES_SQL = "prices(model, p_input, p_output, p_cache_creation, p_cache_read) as (values " + ", ".join(f"('{m}', {', '.join(f'{x!r}::double' for x in p)})" for m, *p in pricing.BUNDLED) + ")"


def resolved_sql(models: str) -> str:
    """Price of each distinct model of a relation, as common table expressions ending in ``resolved``."""
    return f"""ids as (select distinct model, cast(length(regexp_extract(model, '((?:-fast)*)$', 1)) // 5 as int) as fasts from {models} where model is not null),
bases as (select model, fasts, cast(o as int) as off, left(model, length(model) - 5 * cast(o as int)) as base from ids, unnest(range(0, fasts + 1)) as t(o)),
resolved as (select b.model, p_input * pow(6, off) as input, p_output * pow(6, off) as output, p_cache_creation * pow(6, off) as cache_creation, p_cache_read * pow(6, off) as cache_read
  from bases b join prices p on starts_with(base, p.model) and p.model <> ''
  qualify row_number() over (partition by b.model order by case when base = p.model then 0 else 1 end, case when base = p.model then off else fasts - off end, -length(p.model)) = 1)"""


COST_SQL = f"""{USAGE_SQL}, {PRICES_SQL}, {resolved_sql('usage')},
costed as (select u.*, coalesce(u.input * r.input + u.output * r.output + u.cache_creation * r.cache_creation + u.cache_read * r.cache_read, 0) as cost
  from usage u left join resolved r using (model))"""
DAILY_SQL = f"""{COST_SQL}, daily as (select provider, day, cast(sum(input) as bigint) as input_tokens, cast(sum(output) as bigint) as output_tokens,
  cast(sum(cache_creation) as bigint) as cache_creation_tokens, cast(sum(cache_read) as bigint) as cache_read_tokens,
  cast(sum({TOTAL}) as bigint) as total_tokens, sum(cost) as total_cost,
  string_agg(distinct case when not (provider = 'claude-native' and model = '<synthetic>') then model end, ', ' order by case when not (provider = 'claude-native' and model = '<synthetic>') then model end) as models
  from costed group by provider, day)"""
MERGED_SQL = f"""{DAILY_SQL}, names as (select day, string_agg(distinct model, ', ' order by model) as models from costed where not (provider = 'claude-native' and model = '<synthetic>') group by day),
sums as (select day, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_creation_tokens) as bigint) as cache_creation_tokens,
  cast(sum(cache_read_tokens) as bigint) as cache_read_tokens, cast(sum(total_tokens) as bigint) as total_tokens, sum(total_cost) as total_cost from daily group by day),
merged as (select sums.*, coalesce(models, '') as models from sums left join names using (day))"""
MATRIX_SQL = f"{USAGE_SQL}, minutes as (select day, minute, {SUMS} from usage group by day, minute)"


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def costed(spark, d):
    return pricing.priced(usage(spark, d), pricing.bundled(spark))


def days_of(spark, d, keys=("provider",)):
    return rollup.daily(costed(spark, d), list(keys))


def merged(spark, d):
    return rollup.merge_daily(days_of(spark, d))


def minutes(spark, d, keys=()):
    return rollup.minute_matrix(usage(spark, d), list(keys))


def shown(days: DataFrame) -> DataFrame:
    return days.withColumns({"models": formats.joined(F.col("models")), "total_cost": F.round("total_cost", 8)})


SHOWN = "input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, round(total_cost, 8) as total_cost, coalesce(models, '') as models"


# --- records


@query(f"with {USAGE_SQL} select event_id, model, provider, input, output, cache_creation, cache_read, {TOTAL} as total_tokens, day, minute from usage")
def usage_projection(spark, d):
    return usage(spark, d).select("event_id", "model", "provider", *COUNTERS, total().alias("total_tokens"), "day", "minute")


@query("select event_id, cast(props::json->>'k' as bigint) as k from events where contains(props, '\"k\"') and (props::json->>'k') is not null and value is not null")
def json_required_filter(spark, d):
    events = table(spark, d, "events").where(F.col("props").contains('"k"'))
    parsed = events.withColumn("j", F.from_json("props", "k long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("j._corrupt is null and j.k is not null and value is not null").select("event_id", F.col("j.k").alias("k"))


@query(f"""with {USAGE_SQL} select event_id, coalesce(dedup_key, '') as dedup_key, output from usage
qualify dedup_key is null or row_number() over (partition by dedup_key order by output desc, 'user-' || user_id, event_id) = 1""")
def dedup_keep_max(spark, d):
    return dedup.keep_max(usage(spark, d)).select("event_id", F.coalesce("dedup_key", F.lit("")).alias("dedup_key"), "output")


@query(f"with {USAGE_SQL} select event_id, input, output from usage where dedup_key is null")
def dedup_null_keys(spark, d):
    return dedup.keep_max(usage(spark, d)).where("dedup_key is null").select("event_id", "input", "output")


DELTA = ", ".join(f"greatest(0, {c} - coalesce(lag({c}) over s, 0)) as {c}" for c in ("input", "output", "cache_read"))


@query(f"with {USAGE_SQL} select event_id, {DELTA} from usage window s as (partition by user_id order by event_id)")
def counter_delta(spark, d):
    return counters.counter_delta(usage(spark, d), ["input", "output", "cache_read"], ["user_id"], ["event_id"]).select("event_id", "input", "output", "cache_read")


def contexts(spark, d):
    """Views and signups say which model a user's session has."""
    return usage(spark, d).withColumn("context", F.when(F.col("event_type").isin("view", "signup"), F.col("model")))


CONTEXT = "case when event_type in ('view', 'signup') then model end"


@query(f"""with {USAGE_SQL} select event_id, coalesce(last_value({CONTEXT} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), '') as model from usage""")
def model_forward_fill(spark, d):
    return counters.forward_fill(contexts(spark, d), "context", ["user_id"], ["event_id"]).select("event_id", F.coalesce("context", F.lit("")).alias("model"))


@query(f"""with {USAGE_SQL}, filled as (select *, last_value({CONTEXT} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as context from usage),
deltas as (select event_id, context, {', '.join(f"greatest(0, {c} - coalesce(lag({c}) over s, 0)) as {c}" for c in ("input", "output", "cache_creation"))} from filled where event_type in ('click', 'purchase') window s as (partition by user_id order by event_id))
select event_id, coalesce(context, '') as model, greatest(0, input - cache_creation) as input, output, cast(0 as bigint) as cache_creation, cache_creation as cache_read from deltas""")
def session_usage(spark, d):
    filled = counters.forward_fill(contexts(spark, d), "context", ["user_id"], ["event_id"])
    events = filled.where(F.col("event_type").isin("click", "purchase")).withColumn("cached", F.col("cache_creation")).drop("cache_creation", "cache_read")
    grown = counters.counter_delta(events, ["input", "cached", "output"], ["user_id"], ["event_id"])
    return counters.normalised(grown).select("event_id", F.coalesce("context", F.lit("")).alias("model"), *COUNTERS)


@query(f"""with {USAGE_SQL} select event_id, coalesce(last_value({CONTEXT} ignore nulls) over (order by event_id rows between unbounded preceding and current row), '') as model,
greatest(0, input - coalesce(lag(input) over (order by event_id), 0)) as grown, cast(sum(output) over (order by event_id rows between unbounded preceding and current row) as bigint) as running from usage""")
def one_huge_session(spark, d):
    """All events as one session, in segments of a thousand."""
    rows = contexts(spark, d).select("event_id", "context", "input", "output", F.lit("all").alias("session"), F.expr("event_id div 1000").alias("segment"))
    seen = segments.carried(rows, ["session"], "segment", ["event_id"], {"model": F.col("context")}, {"previous": F.col("input")}, {"running": F.col("output")})
    zero = F.lit(0).cast("long")
    grown = F.greatest(zero, F.col("input") - F.coalesce("previous", zero))
    return seen.select("event_id", F.coalesce("model", F.lit("")).alias("model"), grown.alias("grown"), "running")


@query(f"""with {USAGE_SQL}, s as (select event_id, case event_type when 'view' then strftime(ts, '%Y-%m-%d') when 'click' then strftime(ts, '%Y-%m-%dT%H:%M:%S')
  when 'purchase' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.123Z' when 'signup' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' else strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' end as t, ts, event_type from usage)
select event_id, t, case event_type when 'view' then -1 when 'click' then -1 when 'signup' then cast(epoch(date_trunc('second', ts)) as bigint) - 7200 else cast(epoch(date_trunc('second', ts)) as bigint) end as epoch from s""")
def iso_parse(spark, d):
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    text = F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd")).when(kind == "click", second).when(kind == "purchase", F.concat(second, F.lit(".123Z"))).when(kind == "signup", F.concat(second, F.lit("+02:00"))).otherwise(F.concat(second, F.lit("Z")))
    return table(spark, d, "events").select("event_id", text.alias("t")).withColumn("epoch", F.coalesce(instant(F.col("t")), F.lit(-1).cast("long")))


@query(f"""with {USAGE_SQL} select event_id, case when cache_creation % 3 = 0 then model || '-fast' else model end as model from usage""")
def fast_tier_suffix(spark, d):
    speed = F.when(F.col("cache_creation") % 3 == 0, "fast")
    return usage(spark, d).select("event_id", fast_tier(F.col("model"), speed).alias("model"))


@query(f"""with {USAGE_SQL} select event_id, coalesce(to_base64(unhex(left(sha256(dedup_key), 24))), '') as hashed from usage""")
def hashed_keys(spark, d):
    return usage(spark, d).select("event_id", F.coalesce(hashed_key(F.col("dedup_key")), F.lit("")).alias("hashed"))


@query("select count(*) as lines, cast(coalesce(sum(strlen(text)), 0) as bigint) as bytes from documents where length(text) > 0")
def scan_totals(spark, d):
    from tidemark.sources.lines import scan_totals as totals

    return totals(table(spark, d, "documents").where(F.length("text") > 0).select(F.col("text").alias("value")))


@query(f"""with {USAGE_SQL}, t as (select nullif(model, '<synthetic>') as model, day, provider, {TOTAL} as tokens from usage)
select coalesce(provider, '') as provider, coalesce(day, '') as day, coalesce(model, '') as model, cast(case grouping_id(provider, day, model) when 0 then 0 when 1 then 1 when 3 then 2 else 3 end as int) as level, cast(sum(tokens) as bigint) as tokens
from t group by grouping sets ((provider, day, model), (provider, day), (provider), ())""")
def subtotals(spark, d):
    """Tokens by provider, day and model, with all subtotals; records without a model aren't taken for one."""
    rows = usage(spark, d).select(F.nullif("model", F.lit("<synthetic>")).alias("model"), "day", "provider", total().alias("tokens"))
    out = rollup.totals(rows, [["provider", "day", "model"], ["provider", "day"], ["provider"], []], ["tokens"])
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("provider", "day", "model")], "level", "tokens")


@query(f"""with {USAGE_SQL}, m as (select day, minute, model, cast(sum({TOTAL}) as bigint) as tokens from usage group by day, minute, model)
select day, minute, string_agg(model || '=' || tokens, ' ' order by model) as by_model from m group by day, minute""")
def minute_maps(spark, d):
    """Maps from model to tokens of each provider's and user's minutes, merged into one a minute as maps."""
    own = rollup.models_map(rollup.minute_by_model(usage(spark, d), ["provider", "user_id"]), ["provider", "user_id"])
    merged = rollup.merge_maps(own)
    pairs = F.transform(F.array_sort(F.map_entries("by_model")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return merged.select("day", "minute", F.array_join(pairs, " ").alias("by_model"))


LISTING = "select page_id, 'p' || page_id as path, page_id % 7 as mtime, length(html) as size from pages where page_id % 5 <> {gone}"


@query(f"""with n as ({LISTING.format(gone=0)}), o as (select page_id, 'p' || page_id as path, case when page_id % 11 = 0 then mtime + 1 else mtime end as mtime, size from ({LISTING.format(gone=1)}))
select coalesce(n.path, o.path) as path, case when o.path is null then 'new' when n.path is null then 'removed' when n.mtime = o.mtime and n.size = o.size then 'unchanged' else 'changed' end as state from n full join o on n.path = o.path""")
def manifest_diff(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 7).alias("mtime"), F.length("html").cast("long").alias("size"))
    older = F.when(F.col("page_id") % 11 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))
    old = pages.where("page_id % 5 <> 1").withColumn("mtime", older).withColumn("run", F.lit(1).cast("long"))
    return diff(pages.where("page_id % 5 <> 0").drop("page_id"), old).select("path", "state")


# --- prices and costs


@query(f"""with {USAGE_SQL}, {PRICES_SQL}, {resolved_sql('usage')} select model, input * 1e6 as input, output * 1e6 as output from resolved""")
def price_resolution(spark, d):
    rows = pricing.resolved(usage(spark, d), pricing.bundled(spark))
    return rows.select("model", (F.col("input") * 1e6).alias("input"), (F.col("output") * 1e6).alias("output"))


@query("""with s as (select p_name as model, p_size * 1.0::double as input, p_retailprice as output, p_partkey % 3 as layer, p_partkey from part),
t as (select 'm' || p_partkey % 500 as model, layer, max(input) as input, arg_max(output, input * 1e6 + output) as output from s join (select p_partkey from part) using (p_partkey) group by 1, 2)
select model, arg_max(input, layer) as input, arg_max(output, layer) as output from t group by model""")
def price_layering(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 500).cast("string")).alias("model"), F.col("p_size").cast("double").alias("input"), F.col("p_retailprice").alias("output"), (F.col("p_partkey") % 3).alias("layer"))
    part = part.withColumns({"cache_creation": F.lit(0.0), "cache_read": F.lit(0.0)})
    return pricing.layered(*[part.where(F.col("layer") == i) for i in range(3)]).select("model", "input", "output")


@query(f"with {COST_SQL} select event_id, round(cost, 9) as cost from costed")
def event_cost(spark, d):
    return costed(spark, d).select("event_id", F.round("cost", 9).alias("cost"))


@query(f"with {DAILY_SQL} select provider, day, {SHOWN} from daily")
def daily_by_provider(spark, d):
    return shown(days_of(spark, d))


@query(f"with {DAILY_SQL} select provider, day, total_tokens, round(total_cost, 8) as total_cost from daily")
def daily_cost(spark, d):
    return days_of(spark, d).select("provider", "day", "total_tokens", F.round("total_cost", 8).alias("total_cost"))


@query(f"with {MERGED_SQL} select day, {SHOWN} from merged")
def daily_merged(spark, d):
    return shown(merged(spark, d))


@query(f"with {MERGED_SQL} select day, models from merged")
def models_per_day(spark, d):
    return merged(spark, d).select("day", formats.joined(F.col("models")).alias("models"))


@query(f"with {MERGED_SQL} select day, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, cast(cast(round(cast(round(total_cost, 9) as decimal(18, 9)), 6) as decimal(18, 6)) as varchar) as cost from merged")
def daily_tsv(spark, d):
    return reports.daily_report(merged(spark, d))


@query(f"with {DAILY_SQL} select day, provider, cast(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens as bigint) as total_tokens from daily")
def daily_counts_recomputed(spark, d):
    return rollup.counts(days_of(spark, d).withColumn("total_tokens", F.lit(0).cast("long"))).select("day", "provider", "total_tokens")


# --- minutes


@query(f"with {MATRIX_SQL} select * from minutes")
def minute_matrix(spark, d):
    return minutes(spark, d)


@query(f"with {USAGE_SQL} select day, minute, model, cast(sum({TOTAL}) as bigint) as tokens from usage group by day, minute, model")
def minute_by_model(spark, d):
    return rollup.minute_by_model(usage(spark, d))


@query(f"with {MATRIX_SQL} select * from minutes")
def matrix_merge_providers(spark, d):
    rows = usage(spark, d)
    parts = [rollup.minute_matrix(rows.where(F.col("provider") == p)) for p in ("claude-native", "codex")]
    return rollup.merge_minutes(parts[0].unionByName(parts[1]))


@query(f"""with {MATRIX_SQL}, s as (select cast(i * 5 as int) as id from range(0, {MINUTE // 5 + 1}) t(i))
select id, case when id + 5 > {MINUTE} then {MINUTE} else id end / 60.0::double as x, {', '.join(f'cast(coalesce(sum({c}), 0) as bigint) as {c}' for c in COUNTERS)}
from s left join minutes on day = '{TODAY}' and minute - minute % 5 = id group by id""")
def rate_5min(spark, d):
    return windows.rate_points(minutes(spark, d), NOW)


@query(f"""with {MATRIX_SQL}, b as (select minute - minute % 5 as bucket, cast(sum({TOTAL}) as bigint) as tokens from minutes where day = '{TODAY}' group by 1 having sum({TOTAL}) > 0)
select printf('%02d:%02d', bucket // 60, bucket % 60) as label, tokens from b union all select 'TOTAL', cast(coalesce(sum(tokens), 0) as bigint) from b""")
def intraday_dump_total(spark, d):
    return reports.intraday_report(minutes(spark, d), NOW)


def live_sql(minute: int) -> str:
    first = minute - 59
    return f"""with {MATRIX_SQL}, s as (select cast(i as int) as i, i + {first} as pos from range(0, 60) t(i)), p as (select i, case when pos >= 0 then '{TODAY}' else '{YESTERDAY}' end as day, cast((pos + 1440) % 1440 as int) as minute from s)
select i, day, minute, i - 59.0::double as x, {', '.join(f'coalesce({c}, 0) as {c}' for c in COUNTERS)} from p left join minutes using (day, minute)"""


@query(live_sql(MINUTE))
def live_60min(spark, d):
    return windows.last_minutes(minutes(spark, d), NOW, 60).select("i", "day", "minute", "x", *COUNTERS)


@query(live_sql(EARLY.minute))
def live_60min_midnight(spark, d):
    return windows.last_minutes(minutes(spark, d), EARLY, 60).select("i", "day", "minute", "x", *COUNTERS)


@query(f"""with {USAGE_SQL} select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d') as day, cast(extract(hour from ts + interval 8 hour) * 60 + extract(minute from ts) as int) as minute from usage""")
def tz_rebucket(spark, d):
    return rollup.with_local_time(usage(spark, d), "+08:00").select("event_id", "day", "minute")


# Summer time in central Europe, by UTC.
SUMMERS = [("2024-03-31 01:00", "2024-10-27 01:00"), ("2025-03-30 01:00", "2025-10-26 01:00")]
SUMMER_SQL = " or ".join(f"(t >= timestamp '{a}:00' and t < timestamp '{b}:00')" for a, b in SUMMERS)


@query(f"""with {USAGE_SQL}, s as (select event_id, ts + to_days(cast(event_id % 700 as int)) as t from usage), l as (select event_id, t + case when {SUMMER_SQL} then interval 2 hour else interval 1 hour end as t from s)
select event_id, strftime(t, '%Y-%m-%d') as day, cast(extract(hour from t) * 60 + extract(minute from t) as int) as minute from l""")
def zone_daylight_saving(spark, d):
    """Events spread over two years, by the days and minutes of a zone that changes its clocks."""
    spread = usage(spark, d).withColumn("epoch", F.col("epoch") + F.col("event_id") % 700 * 86_400)
    return rollup.with_local_time(spread, "Europe/Berlin").select("event_id", "day", "minute")


RECENT = "with {m}, r as (select day, dense_rank() over (order by day desc) as k from (select distinct day from minutes where day <= '{today}'{but}))  select m.day, m.minute, m.input from minutes m join r using (day) where k <= {n}{but2}"


@query(RECENT.format(m=MATRIX_SQL, today=TODAY, but="", but2="", n=15))
def recent_days(spark, d):
    return windows.recent_days(minutes(spark, d), NOW, 14).select("day", "minute", "input")


@query(RECENT.format(m=MATRIX_SQL, today=TODAY, but=f" and day <> '{TODAY}'", but2="", n=6))
def recent_days_today_missing(spark, d):
    return windows.recent_days(minutes(spark, d).where(F.col("day") != TODAY), NOW, 5).select("day", "minute", "input")


# --- the intraday curve


def curve_sql(keys: str = "", minute: int = MINUTE) -> str:
    """Dense form of the curve, with the parts of all series in ``parts``."""
    k, on, by = (f"{keys}, ", f"{keys}, ", f"partition by {keys} ") if keys else ("", "", "")
    every = f"(select distinct {keys} from mt)" if keys else "(select 1 as one)"
    using = f"{keys}, id" if keys else "id"
    return f"""{USAGE_SQL}, mt as (select {k}day, minute, sum({TOTAL}) as tokens from usage where day <= '{TODAY}' group by {k}day, minute),
points as (select distinct cast(i as int) as id from (select unnest(range(0, 1440, 5)) as i union all select {minute} union all select 1439)),
dt as (select {k}day, sum(tokens) as day_total from mt group by {k}day),
c as (select {k}dt.day, id, any_value(day_total) as day_total, coalesce(sum(mt.tokens), 0) as cum from dt cross join points left join mt on mt.day = dt.day and mt.minute <= id{f' and mt.{keys} = dt.{keys}' if keys else ''} group by {f'dt.{keys}, ' if keys else ''}dt.day, id),
ty as (select {k}id, list_reduce(list(cast(cum as double) order by day), lambda a, b: a + b) / count(*) as typical_cum, list_reduce(list(cast(cum as double) / cast(day_total as double) order by day), lambda a, b: a + b) / count(*) as share, count(*) as prior_days
  from c where day < '{TODAY}' and day_total > 0 group by {k}id),
td as (select {k}id, cum from c where day = '{TODAY}'),
j as (select {k}id, coalesce(cum, 0) as cum, typical_cum, share, prior_days from (select * from {every} cross join points) left join ty using ({using}) left join td using ({using})),
w as (select *, max(case when id = {minute} then cum end) over ({by}) as now_cum, max(case when id = {minute} then share end) over ({by}) as now_share from j),
parts as (select *, case when now_share >= 0.05 and now_cum > 0 then now_cum / now_share end as projected from w)""".replace(f"select {k}dt.day", f"select {f'dt.{keys}, ' if keys else ''}dt.day")


PREDICTED = f"""select id, id / 60.0::double as hour, cast(trunc(projected * share) as bigint) as tokens from parts where projected is not null and id % 5 = 0 and id between {MINUTE} and 1435
union all select 1440, 24.0::double, cast(trunc(projected) as bigint) from parts where projected is not null and id = 1439"""


@query(f"with {curve_sql()} select id, id / 60.0::double as hour, cast(cum as bigint) as tokens from parts where id <= {MINUTE}")
def curve_today(spark, d):
    return curve.curve(minutes(spark, d), NOW).where("series = 'today'").drop("series")


@query(f"with {curve_sql()} select id, id / 60.0::double as hour, cast(trunc(typical_cum) as bigint) as tokens from parts where id % 5 = 0 and id <= 1435 and typical_cum is not null union all select 1440, 24.0::double, cast(trunc(typical_cum) as bigint) from parts where id = 1439 and typical_cum is not null")
def curve_typical(spark, d):
    return curve.curve(minutes(spark, d), NOW).where("series = 'typical'").drop("series")


@query(f"with {curve_sql()} {PREDICTED}")
def curve_predicted(spark, d):
    return curve.curve(minutes(spark, d), NOW).where("series = 'predicted'").drop("series")


ODD = Now(TODAY, 872)  # no sample point's minute


@query(f"""with {curve_sql(minute=ODD.minute)}, s as (select 'today' as series, id, cum as v from parts where id <= {ODD.minute}
union all select 'typical', id, typical_cum from parts where id % 5 = 0 and id <= 1435 union all select 'typical', 1440, typical_cum from parts where id = 1439
union all select 'predicted', id, case when id = {ODD.minute} then now_cum else projected * share end from parts where projected is not null and (id % 5 = 0 or id = {ODD.minute}) and id between {ODD.minute} and 1435
union all select 'predicted', 1440, projected from parts where id = 1439)
select series, id, id / 60.0::double as hour, cast(trunc(v) as bigint) as tokens from s where v is not null""")
def curve_odd_minute(spark, d):
    return curve.curve(minutes(spark, d), ODD)


@query(f"with {curve_sql()} select (select count(distinct day) - 1 from usage) as prior_days, cast(now_cum as bigint) as today_tokens, cast(trunc(typical_cum) as bigint) as typical_total, coalesce(cast(cast(trunc(projected) as bigint) as varchar), 'n/a') as projection from parts where id = 1439")
def curve_summary(spark, d):
    rows = minutes(spark, d)
    return reports.curve_report(curve.projection(rows, NOW), rows)


@query(f"with {curve_sql('user_id')} select user_id, cast(now_cum as bigint) as today_tokens, cast(trunc(typical_cum) as bigint) as typical_total, coalesce(prior_days, 0) as prior_days, coalesce(cast(trunc(projected) as bigint), -1) as projected_total from parts where id = 1439")
def curve_by_user(spark, d):
    rows = curve.projection(minutes(spark, d, ["user_id"]), NOW, ["user_id"])
    return rows.select("user_id", "today_tokens", "typical_total", F.col("prior_days").cast("long").alias("prior_days"), F.coalesce("projected_total", F.lit(-1).cast("long")).alias("projected_total"))


# --- headline

HEAD_SQL = f"""{MERGED_SQL}, h as (select * from merged order by (day = '{TODAY}') desc, day desc limit 1),
a as (select cast(sum(total_tokens) // count(*) as bigint) as avg_tokens from (select total_tokens from merged where day <> (select day from h) order by day desc limit 7))"""


@query(f"with {HEAD_SQL} select day, total_tokens, round(total_cost, 8) as total_cost, models, day = '{TODAY}' as is_today from h")
def headline(spark, d):
    return dashboard.headline(merged(spark, d), NOW).select("day", "total_tokens", F.round("total_cost", 8).alias("total_cost"), formats.joined(F.col("models")).alias("models"), "is_today")


@query(f"with {HEAD_SQL} select avg_tokens from a where avg_tokens is not null")
def avg_7d(spark, d):
    return dashboard.recent_average(merged(spark, d), NOW)


def board(spark, d):
    return dashboard.dashboard(merged(spark, d), curve.projection(minutes(spark, d), NOW), NOW)


BOARD_SQL = f"""{HEAD_SQL}, {curve_sql().replace(USAGE_SQL + ',', '', 1)}, f as (select cast(trunc(projected) as bigint) as pt from parts where id = 1439)"""


@query(f"with {BOARD_SQL} select day, round(case when day = '{TODAY}' and total_tokens > 0 then total_cost * pt / total_tokens end, 4) as projected_cost, avg_tokens, pt as projected_total from h, a, f")
def subtitle_fields(spark, d):
    return board(spark, d).select("day", F.round("projected_cost", 4).alias("projected_cost"), "avg_tokens", "projected_total")


@query(f"with {BOARD_SQL} select day, case when day = '{TODAY}' and avg_tokens > 0 and pt is not null then case when pt >= avg_tokens then '▲' else '▼' end else '' end as trend from h, a, f")
def trend_flag(spark, d):
    return board(spark, d).select("day", F.coalesce("trend", F.lit("")).alias("trend"))


def short_sql(n: str) -> str:
    """tokens_short with ties to even, through exact integers."""
    even = "case when {n} % {u} * 2 = {u} then ({n} // {u}) + ({n} // {u}) % 2 else ({n} + {u} // 2) // {u} end"
    tenth = lambda u: even.format(n=n, u=u // 10)
    b, m, k = tenth(10**9), tenth(10**6), even.format(n=n, u=1000)
    return f"case when {n} >= 1000000000 then ({b}) // 10 || '.' || ({b}) % 10 || 'B' when {n} >= 1000000 then ({m}) // 10 || '.' || ({m}) % 10 || 'M' when {n} >= 1000 then ({k}) || 'k' else cast({n} as varchar) end"


@query(f"with {HEAD_SQL} select day, {short_sql('total_tokens')} || ' · ' || printf('$%.2f', total_cost) as headline from h")
def headline_text(spark, d):
    return board(spark, d).select("day", "headline")


@query(f"""with {BOARD_SQL}, shown as (select day, day = '{TODAY}' as is_today, total_tokens, total_cost * pt / case when total_tokens > 0 then total_tokens end as cost, avg_tokens, pt,
  (pt - avg_tokens)::double / case when avg_tokens > 0 then avg_tokens end * 100 as percent from h, a, f)
select day, case when not is_today then 'Showing ' || day when pt is null or total_tokens <= 0 then 'Projected — warming up'
  else 'Projected ~' || {short_sql('pt')} || ' · ~' || printf('$%.2f', cost) || coalesce('   vs 7d ' || case when percent >= 0 then '▲ ' else '▼ ' end || cast(cast(round_even(abs(percent), 0) as bigint) as varchar) || '%', '') end as subtitle from shown""")
def subtitle_text(spark, d):
    return board(spark, d).select("day", "subtitle")


# --- fees

SETTING_ROWS = [(v, p, c) for v, p, c in (("claude", "max5x", None), ("claude", "custom", 0.0), ("claude", "custom", 80.0), ("gpt", "pro", None), ("gpt", "api", 50.0), ("gpt", "unknown", 9.0), ("gpt", None, None))]


def user_settings(spark, d):
    """A plan for each user and vendor, by the user's number."""
    users = table(spark, d, "events").select("user_id").distinct()
    n = F.col("user_id") % len(SETTING_ROWS)
    rows = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(p).cast("string").alias("plan"), F.lit(c).cast("double").alias("custom_fee")) for v, p, c in SETTING_ROWS])
    return users.select("user_id", F.element_at(rows, (n + 1).cast("int")).alias("s")).select("user_id", "s.*")


SETTINGS_SQL = "settings as (select user_id, " + ", ".join(f"case user_id % {len(SETTING_ROWS)} " + " ".join(f"when {i} then {'null' if r[j] is None else repr(r[j])}" for i, r in enumerate(SETTING_ROWS)) + f" end as {name}" for j, name in enumerate(("vendor", "plan", "custom_fee"))) + " from (select distinct user_id from events))"
FEE_SQL = "case when vendor = 'claude' and plan = 'pro' then 20 when vendor = 'claude' and plan = 'max5x' then 100 when vendor = 'claude' and plan = 'max20x' then 200 when vendor = 'gpt' and plan = 'plus' then 20 when vendor = 'gpt' and plan = 'pro' then 200 when plan = 'custom' and custom_fee > 0 then custom_fee end"


@query(f"with {SETTINGS_SQL} select user_id, vendor, coalesce(plan, '') as plan, coalesce(cast({FEE_SQL} as double), -1) as monthly_fee from settings")
def plan_resolution(spark, d):
    rows = breakeven.plan_fees(user_settings(spark, d), breakeven.plans(spark))
    return rows.select("user_id", "vendor", F.coalesce("plan", F.lit("")).alias("plan"), F.coalesce("monthly_fee", F.lit(-1.0)).alias("monthly_fee"))


FEES = [("claude", "max5x", None), ("gpt", "plus", None)]


def events_break_even(spark, d):
    settings = spark.createDataFrame([("all", *r) for r in FEES], SETTINGS)
    fees = breakeven.plan_fees(settings, breakeven.plans(spark)).join(breakeven.vendors(spark), "vendor")
    return breakeven.break_even(days_of(spark, d), fees, NOW)


EVEN_SQL = f"""{DAILY_SQL}, fees(vendor, provider, monthly_fee) as (values ('claude', 'claude-native', 100.0::double), ('gpt', 'codex', 20.0::double)),
r as (select vendor, monthly_fee, day, coalesce(total_cost, 0) as total_cost, sum(total_cost) over (partition by vendor order by day) as running from fees left join (select * from daily where day like '2024-01-%') using (provider)),
even as (select vendor, monthly_fee, coalesce(sum(total_cost), 0) as month_to_date_cost, min(case when running >= monthly_fee then day end) as broke_even_on from r group by vendor, monthly_fee)"""


@query(f"with {EVEN_SQL} select vendor, monthly_fee, round(month_to_date_cost, 8) as month_to_date_cost, coalesce(broke_even_on, '') as broke_even_on, round(month_to_date_cost / monthly_fee, 10) as multiple, round(least(1.0, month_to_date_cost / monthly_fee), 10) as progress from even")
def break_even(spark, d):
    return events_break_even(spark, d).select("vendor", "monthly_fee", F.round("month_to_date_cost", 8).alias("month_to_date_cost"), F.coalesce("broke_even_on", F.lit("")).alias("broke_even_on"), F.round("multiple", 10).alias("multiple"), F.round("progress", 10).alias("progress"))


@query(f"with {EVEN_SQL} select vendor from even where monthly_fee is not null or month_to_date_cost > 0")
def visible_payback(spark, d):
    return breakeven.visible(events_break_even(spark, d)).select("vendor")


@query(f"""with {EVEN_SQL}, t as (select *, month_to_date_cost / monthly_fee as times from even where monthly_fee is not null or month_to_date_cost > 0)
select vendor, printf('$%.2f', month_to_date_cost) || ' of ' || printf('$%.2f', monthly_fee) || ' · ' || case when times >= 10 then cast(cast(round_even(times, 0) as bigint) as varchar) else printf('%.1f', round_even(times, 1)) end || '×'
  || coalesce(' · broke even ' || strftime(cast(broke_even_on as date), '%b ') || extract(day from cast(broke_even_on as date)), '') as detail from t""")
def payback_detail(spark, d):
    return breakeven.visible(events_break_even(spark, d)).select("vendor", "detail")


@query(f"with {DAILY_SQL} select provider, day, round(sum(total_cost) over (partition by provider order by day), 8) as running from daily where day like '2024-01-%'")
def month_running_cost(spark, d):
    month = days_of(spark, d).where(month_of(F.col("day")) == NOW.month)
    running = F.sum("total_cost").over(Window.partitionBy("provider").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return month.select("provider", "day", F.round(running, 8).alias("running"))


@query("""with o as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, sum(o_totalprice) as total_cost from orders group by 1, 2),
r as (select *, sum(total_cost) over (partition by o_custkey order by day) as running from o)
select o_custkey, round(sum(total_cost), 2) as cost, coalesce(min(case when running >= 500000 then day end), '') as broke_even_on from r group by o_custkey""")
def break_even_by_customer(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("o_totalprice").alias("total_cost"))
    rows = breakeven.paid_off(orders.withColumn("monthly_fee", F.lit(500_000.0)), ["o_custkey"])
    return rows.select("o_custkey", F.round("month_to_date_cost", 2).alias("cost"), F.coalesce("broke_even_on", F.lit("")).alias("broke_even_on"))


# --- bars, bands, legends, texts


@query(f"with {MATRIX_SQL} select day, minute, band, band_order, tokens from (" + " union all ".join(f"select day, minute, '{b}' as band, {i} as band_order, {c} as tokens from minutes" for i, (b, c) in enumerate(legend.BANDS)) + ")")
def bands_unpivot(spark, d):
    return legend.bands(minutes(spark, d), ["day", "minute"])


@query(f"""with {USAGE_SQL}, v as (select day, model, sum({TOTAL}) as tokens from usage group by day, model)
select day, model, cast(coalesce(tokens, 0) as bigint) as tokens from (select distinct day from v) cross join (select distinct model from v) left join v using (day, model)""")
def by_model_dense(spark, d):
    values = rollup.minute_by_model(usage(spark, d)).groupBy("day", "model").agg(F.sum("tokens").alias("tokens"))
    return legend.dense_by_model(values, "day")


@query(f"with {MERGED_SQL} select day, total_tokens from merged order by day desc limit 14")
def daily_bars_14(spark, d):
    return windows.last_days(merged(spark, d), 14).select("day", "total_tokens")


@query(f"with {MERGED_SQL} select day from (select day, row_number() over (order by day) as i, count(*) over () as n from merged) where (i - 1) % greatest(1, n // 4) = 0")
def sparse_labels(spark, d):
    return windows.sparse_labels(merged(spark, d)).select("day")


CLASS_SQL = "case when starts_with(model, 'claude') then 'claude' when starts_with(model, 'gpt') or contains(model, 'codex') then 'gpt' else 'other' end"


@query(f"""with {USAGE_SQL}, {PRICES_SQL}, {resolved_sql('usage')}, m as (select distinct u.model, {CLASS_SQL.replace('model', 'u.model')} as vendor, coalesce(r.input, 0) as price from usage u left join resolved r on u.model = r.model),
k as (select *, row_number() over (partition by vendor order by price desc, model desc) as rank, count(*) over (partition by vendor) as n from m)
select model, vendor, cast(rank as int) as rank, round(case when n <= 1 then 0.82::double else 0.92::double - 0.46::double * ((rank - 1)::double / (n - 1)) end, 9) as brightness from k""")
def model_legend(spark, d):
    return legend.legend(usage(spark, d), pricing.bundled(spark)).select("model", "vendor", "rank", F.round("brightness", 9).alias("brightness"))


@query(f"with {USAGE_SQL} select event_id, regexp_replace(regexp_replace(model, '^claude-', ''), '-20[0-9]{{6}}$', '') as short_name from usage")
def short_names(spark, d):
    return usage(spark, d).select("event_id", short_name(F.col("model")).alias("short_name"))


@query(f"with {USAGE_SQL} select event_id, {CLASS_SQL} as vendor from usage")
def vendor_classes(spark, d):
    return usage(spark, d).select("event_id", vendor_class(F.col("model")).alias("vendor"))


@query(f"""with n as (select l_orderkey, cast(sum(cast(floor(l_extendedprice + 0.5) as bigint)) * (case l_orderkey % 3 when 0 then 1 when 1 then 100 else 10000 end) as bigint) as n from lineitem group by l_orderkey) select l_orderkey, {short_sql('n')} as tokens from n""")
def fmt_tokens(spark, d):
    n = F.sum(F.floor(F.col("l_extendedprice") + 0.5).cast("long"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(n.alias("s"))
    scale = F.when(F.col("l_orderkey") % 3 == 0, 1).when(F.col("l_orderkey") % 3 == 1, 100).otherwise(10000)
    return rows.select("l_orderkey", formats.tokens_short((F.col("s") * scale).cast("long")).alias("tokens"))


@query("""with n as (select l_orderkey, sum(cast(l_quantity as bigint)) as q, count(*) as c from lineitem group by l_orderkey)
select l_orderkey, printf('$%.2f', q / 8.0::double + 0.001) as cost, case when q >= 80 then cast(cast(round_even(q / 8.0::double, 0) as bigint) as varchar) || '×' else printf('%.1f', round_even(q / 8.0::double, 1)) || '×' end as multiple,
  case when q >= 100 then '▲ ' else '▼ ' end || cast(cast(abs(q - 100) as bigint) as varchar) || '%' as change from n""")
def fmt_cost_multiple_delta(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    eighth = F.col("q") / 8.0
    return rows.select("l_orderkey", formats.cost(eighth + 0.001).alias("cost"), formats.multiple(eighth).alias("multiple"), formats.change(F.col("q"), F.lit(100)).alias("change"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then 'day ' || o_orderkey else strftime(o_orderdate, '%b ') || extract(day from o_orderdate) end as label from orders")
def fmt_month_day(spark, d):
    day = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("day "), F.col("o_orderkey").cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", formats.month_day(day).alias("label"))


@query(f"with {USAGE_SQL} select user_id, least(24, greatest(0.5, max(minute / 60.0::double) + 0.04)) as bound from usage where day = '{TODAY}' group by user_id")
def axis_bound(spark, d):
    points = usage(spark, d).where(F.col("day") == TODAY).select("user_id", (F.col("minute") / 60.0).alias("x"))
    return legend.axis_bound(points, ["user_id"])
