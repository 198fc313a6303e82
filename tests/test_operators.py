import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats
from tidemark.functions.models import short_name
from tidemark.functions.timeutil import Now, day_key, minute_of_day
from tidemark.operators import breakeven, curve, dashboard, dedup, legend, pricing, rollup, windows
from tidemark.schema import PRICES, SETTINGS

TOKENS = "input long, output long, cache_creation long, cache_read long"
DAYS = "day string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long, total_cost double, models array<string>"
NOW = Now("2026-06-07", 720)


def minutes(spark, rows, keys=""):
    return spark.createDataFrame([(*r[:-1], r[-1], 0, 0, 0) for r in rows], f"{keys}day string, minute int, {TOKENS}")


def days(spark, rows):
    """(day, tokens, cost)"""
    return spark.createDataFrame([(d, n, 0, 0, 0, n, float(c), ["m"]) for d, n, c in rows], DAYS)


def series(frame, name):
    return [(r.id, r.hour, r.tokens) for r in frame.where(F.col("series") == name).orderBy("id").collect()]


def dense(rows, now):
    """The curve over all 1440 minutes, in plain Python."""

    def cum(day):
        out, at = [], 0
        values = {m: n for d, m, n in rows if d == day}
        for m in range(1440):
            at += values.get(m, 0)
            out.append(at)
        return out

    prior = [c for d in sorted({r[0] for r in rows}) if d < now.day and (c := cum(d))[-1] > 0]
    today = cum(now.day)
    share = [sum(c[m] / c[-1] for c in prior) / len(prior) for m in range(1440)] if prior else None
    typical = [sum(c[m] for c in prior) / len(prior) for m in range(1440)] if prior else None
    total = today[now.minute] / share[now.minute] if prior and share[now.minute] >= 0.05 and today[now.minute] > 0 else None
    steps = range(0, 1440, 5)
    out = {"today": [(m, today[m]) for m in steps if m <= now.minute]}
    if now.minute % 5:
        out["today"].append((now.minute, today[now.minute]))
    out["typical"] = [*((m, int(typical[m])) for m in steps), (1440, int(typical[1439]))] if prior else []
    out["predicted"] = []
    if total is not None:
        head = [(now.minute, today[now.minute])] if now.minute % 5 else []
        out["predicted"] = [*head, *((m, int(total * share[m])) for m in steps if m >= now.minute), (1440, int(total))]
    return out, int(total) if total is not None else None


@pytest.mark.parametrize("minute", [720, 722, 1437, 1439, 0, 3])
def test_curve_equals_dense_form(spark, minute):
    import random

    rng = random.Random(minute)
    rows = sorted({(f"2026-06-{d:02d}", m): rng.randrange(0, 5000) for d in (3, 4, 5, 7, 8) for m in rng.sample(range(1440), 40)}.items())
    rows = [(d, m, n) for (d, m), n in rows]
    now = Now("2026-06-07", minute)
    frame = curve.curve(minutes(spark, rows), now).cache()
    want, total = dense(rows, now)
    for name, points in want.items():
        assert [(i, n) for i, _, n in series(frame, name)] == points, name
    assert curve.projection(minutes(spark, rows), now).first().projected_total == total


def test_projection_examples(spark):
    rows = [("2026-06-06", 600, 1000), ("2026-06-06", 800, 1000), ("2026-06-07", 600, 400), ("2026-06-07", 900, 999)]
    frame = curve.curve(minutes(spark, rows), NOW)
    assert series(frame, "predicted")[-1] == (1440, 24.0, 800) and series(frame, "typical")[-1][2] == 2000
    assert series(frame, "today")[-1] == (720, 12.0, 400)
    gate = [("2026-06-06", 1400, 10000), ("2026-06-07", 1, 50)]
    row = curve.projection(minutes(spark, gate), Now("2026-06-07", 5)).first()
    assert row.projected_total is None and row.typical_total == 10000
    only = curve.curve(minutes(spark, [("2026-06-07", 1, 5)]), NOW)
    assert not series(only, "typical") and not series(only, "predicted")
    even = [(d, m, n) for d, n in (("2026-06-04", 10**6), ("2026-06-05", 10)) for m in (600, 800) for n in (n,)]
    assert curve.projection(minutes(spark, [*even, ("2026-06-07", 600, 400)]), NOW).first().projected_total == 800


def test_tenants_dont_change_each_other(spark):
    rows = [("2026-06-06", 600, 1000), ("2026-06-06", 800, 1000), ("2026-06-07", 600, 400)]
    both = minutes(spark, [("a", *r) for r in rows] + [("b", "2026-06-07", 3, 7)], "tenant string, ")
    got = {r.tenant: r.projected_total for r in curve.projection(both, NOW, ["tenant"]).collect()}
    assert got == {"a": 800, "b": None}


def values(frame):
    return [r.input for r in frame.orderBy("i").collect()]


def test_last_minutes(spark):
    day = minutes(spark, [("2026-06-07", m, m) for m in range(1440)])
    got = values(windows.last_minutes(day, Now("2026-06-07", 870), 60))
    assert got == list(range(811, 871))
    both = day.unionByName(minutes(spark, [("2026-06-06", m, 10000 + m) for m in range(1440)]))
    got = values(windows.last_minutes(both, Now("2026-06-07", 30), 60))
    assert got == [*range(11411, 11440), *range(31)]
    assert values(windows.last_minutes(day, Now("2026-06-07", 5), 60)) == [0] * 54 + list(range(6))
    assert values(windows.last_minutes(day, NOW, 0)) == []
    keyed = minutes(spark, [("a", "2026-06-07", 720, 5), ("b", "2026-06-07", 719, 6)], "tenant string, ")
    assert windows.last_minutes(keyed, NOW, 10, ["tenant"]).count() == 20
    assert windows.last_minutes(keyed, NOW, 0, ["tenant"]).count() == 0


def test_recent_days(spark):
    def kept(first, last, n, day="2026-06-07"):
        rows = minutes(spark, [(f"2026-06-{d:02d}", 1, 1) for d in range(first, last + 1)])
        return sorted(r.day[-2:] for r in windows.recent_days(rows, Now(day, 1), n).collect())

    assert kept(3, 7, 2) == ["05", "06", "07"] and kept(4, 6, 2) == ["04", "05", "06"] and kept(6, 9, 5) == ["06", "07"]


def test_rate_points(spark):
    rows = minutes(spark, [("2026-06-07", m, 1) for m in range(0, 13)])
    got = [(r.id, round(r.x * 60), r.input) for r in windows.rate_points(rows, Now("2026-06-07", 11)).orderBy("id").collect()]
    assert got == [(0, 0, 5), (5, 5, 5), (10, 11, 3)]
    bound = legend.axis_bound(windows.rate_points(rows, Now("2026-06-07", 11))).first().bound
    assert bound == 0.5
    assert legend.axis_bound(spark.createDataFrame([], "x double")).first().bound == 1.0


def test_zones(spark):
    row = spark.range(1).select(day_key(F.lit(1780849800), "+08:00").alias("d"), minute_of_day(F.lit(1780849800), "+08:00").alias("m")).first()
    assert tuple(row) == ("2026-06-08", 30)


def test_headline_and_average(spark):
    rows = days(spark, [("2026-06-05", 100, 1), ("2026-06-06", 200, 1), ("2026-06-07", 300, 1)])
    h = dashboard.headline(rows, NOW).first()
    assert (h.day, h.total_tokens, h.is_today) == ("2026-06-07", 300, True)
    ten = days(spark, [(f"2026-06-{d:02d}", d * 200, 1) for d in range(1, 10)] + [("2026-06-10", 5000, 1)])
    assert dashboard.recent_average(ten, Now("2026-06-10", 1)).first().avg_tokens == 1200
    fallback = days(spark, [("2026-06-04", 100, 1), ("2026-06-05", 300, 1), ("2026-06-06", 5000, 1)])
    assert dashboard.headline(fallback, NOW).first().day == "2026-06-06"
    assert dashboard.recent_average(fallback, NOW).first().avg_tokens == 200
    forecast = spark.createDataFrame([(None,)], "projected_total long")
    board = dashboard.dashboard(fallback, forecast, NOW).first()
    assert board.subtitle == "Showing 2026-06-06" and board.trend is None and board.headline == "5k · $1.00"
    board = dashboard.dashboard(rows, spark.createDataFrame([(600,)], "projected_total long"), NOW).first()
    assert board.subtitle == "Projected ~600 · ~$2.00   vs 7d ▲ 300%" and board.trend == "▲"
    assert dashboard.headline(rows.limit(0), NOW).count() == 0


def even(spark, rows, fee, month="2026-06"):
    fees = spark.createDataFrame([("claude", "claude-native", fee)], "vendor string, provider string, monthly_fee double")
    table = days(spark, [(d, 1, c) for d, c in rows]).withColumn("provider", F.lit("claude-native"))
    return breakeven.break_even(table, fees, Now(f"{month}-20", 1)).first()


def test_break_even(spark):
    r = even(spark, [("2026-05-31", 100), ("2026-06-01", 10), ("2026-06-10", 5), ("2026-06-15", 2.5), ("2026-07-01", 50)], None)
    assert r.month_to_date_cost == 17.5 and r.multiple is None
    r = even(spark, [("2026-06-09", 8), ("2026-06-02", 8), ("2026-06-05", 8)], 20.0)
    assert (r.broke_even_on, r.month_to_date_cost) == ("2026-06-09", 24.0)
    assert even(spark, [("2026-06-02", 12), ("2026-06-04", 8)], 20.0).broke_even_on == "2026-06-04"
    r = even(spark, [("2026-06-02", 100)], 20.0)
    assert (r.multiple, r.progress) == (5.0, 1.0)
    r = even(spark, [("2026-06-02", 5)], 0.0)
    assert (r.multiple, r.progress, r.broke_even_on, r.month_to_date_cost) == (None, None, None, 5.0)
    r = even(spark, [], 20.0)
    assert r.month_to_date_cost == 0.0 and breakeven.visible(spark.createDataFrame([r])).count() == 1 if r.broke_even_on else True


def test_plans(spark):
    settings = spark.createDataFrame([("t", "claude", "max5x", None), ("t", "claude", "custom", 0.0), ("t", "claude", "custom", 7.0), ("t", "gpt", "nope", 9.0), ("t", "gpt", "api", 9.0), ("t", "gpt", None, None)], SETTINGS)
    got = sorted(((r.plan, r.custom_fee, r.monthly_fee) for r in breakeven.plan_fees(settings, breakeven.plans(spark)).collect()), key=str)
    assert got == sorted([("max5x", None, 100.0), ("custom", 0.0, None), ("custom", 7.0, 7.0), ("nope", 9.0, None), ("api", 9.0, None), (None, None, None)], key=str)


def test_merge(spark):
    schema = DAYS
    rows = spark.createDataFrame([("d", 100, 200, 300, 400, 1000, 2.5, ["sonnet", "opus"]), ("d", 1, 2, 3, 4, 10, 0.25, ["sonnet", "haiku", "codex"])], schema)
    assert tuple(rollup.merge_daily(rows).first()) == ("d", 101, 202, 303, 404, 1010, 2.75, ["codex", "haiku", "opus", "sonnet"])


def test_prices(spark):
    def table(*rows):
        return spark.createDataFrame(rows, PRICES)

    top = pricing.layered(table(("m", 1.0, 1.0, 1.0, 1.0), ("a", 1.0, 0.0, 0.0, 0.0)), table(("m", 2.0, 2.0, 2.0, 2.0)), table(("m", 3.0, 3.0, 0.0, 3.0)))
    assert {tuple(r) for r in top.collect()} == {("m", 3.0, 3.0, 0.0, 3.0), ("a", 1.0, 0.0, 0.0, 0.0)}
    prices = table(("claude-fable-5", 0.00001, 0.0, 0.0, 0.0), ("x", 1.0, 0.0, 0.0, 0.0), ("x-fast", 5.0, 0.0, 0.0, 0.0), ("xy", 2.0, 0.0, 0.0, 0.0))
    models = ["claude-fable-5-fast", "claude-fable-5-20260601", "x-fast", "x-fast-fast", "xyz", "xyz-fast", "none", None, "", "claude-fable-5-2026-fast"]
    got = {r.model: r.input for r in pricing.resolved(spark.createDataFrame([(m,) for m in models], "model string"), prices).collect()}
    assert got == {"claude-fable-5-fast": 0.00001 * 6, "claude-fable-5-20260601": 0.00001, "x-fast": 5.0, "x-fast-fast": 30.0, "xyz": 2.0, "xyz-fast": 12.0, "claude-fable-5-2026-fast": 0.00001 * 6}


def test_legend(spark):
    models = ["claude-sonnet-4-6", "claude-fable-5", "claude-opus-4-7", "claude-opus-4-8", "gpt-5.5", "my-codex", "zzz", None]
    rows = legend.legend(spark.createDataFrame([(m,) for m in models], "model string"), pricing.bundled(spark)).orderBy("vendor_order", "rank").collect()
    assert [r.model for r in rows] == ["claude-fable-5", "claude-opus-4-8", "claude-opus-4-7", "claude-sonnet-4-6", "gpt-5.5", "my-codex", "zzz"]
    assert [round(r.brightness, 4) for r in rows if r.vendor == "gpt"] == [0.92, 0.46] and rows[-1].brightness == 0.82
    assert spark.range(1).select(short_name(F.lit("claude-haiku-4-5-20251001")).alias("n")).first().n == "haiku-4-5"


def test_formats(spark):
    def show(column):
        return spark.range(1).select(column.alias("x")).first().x

    for n, text in ((999, "999"), (1500, "2k"), (2500, "2k"), (999_999, "1000k"), (72_900_000, "72.9M"), (1_200_000_000, "1.2B")):
        assert show(formats.tokens_short(F.lit(n).cast("long"))) == text
    assert show(formats.cost(F.lit(12.345))) == "$12.35"
    assert [show(formats.multiple(F.lit(x))) for x in (9.94, 12.7, 2.25)] == ["9.9×", "13×", "2.2×"]
    assert [show(formats.change(F.lit(a), F.lit(b))) for a, b in ((118, 100), (95, 100), (100, 100), (1, 0))] == ["▲ 18%", "▼ 5%", "▲ 0%", None]
    assert [show(formats.month_day(F.lit(x))) for x in ("2026-06-04", "not-a-date")] == ["Jun 4", "not-a-date"]


def test_keep_max_and_partitions(spark):
    rows = [("k", 5, "a", 1), ("k", 42, "b", 9), ("k", 42, "b", 2), (None, 7, "a", 3), (None, 7, "a", 4)]
    df = spark.createDataFrame(rows, "dedup_key string, output long, file_path string, line_no long")
    want = {("k", 42, "b", 2), (None, 7, "a", 3), (None, 7, "a", 4)}
    for n in (1, 5):
        assert {tuple(r) for r in dedup.keep_max(df.repartition(n)).collect()} == want
    assert dedup.keep_max(df.limit(0)).count() == 0


def test_models_map_and_labels(spark):
    mm = spark.createDataFrame([("d", 1, "a", 5), ("d", 1, "b", 6)], "day string, minute int, model string, tokens long")
    assert rollup.models_map(mm).first().by_model == {"a": 5, "b": 6}
    got = [r.day for r in windows.sparse_labels(days(spark, [(f"2026-06-{d:02d}", 1, 1) for d in range(1, 15)])).orderBy("day").collect()]
    assert got == ["2026-06-01", "2026-06-04", "2026-06-07", "2026-06-10", "2026-06-13"]


def test_totals_in_one_aggregation(spark):
    """Null buckets are told apart from subtotals; one shuffle of rows; the whole is there for no rows too."""
    rows = spark.createDataFrame([("t", 1, 5), ("t", None, 7), ("u", 1, 1), (None, 2, 3)], "tenant string, bucket int, tokens long")
    out = rollup.totals(rows, [["tenant", "bucket"], ["tenant"], []], ["tokens"])
    want = [("t", 1, 5, 0), ("t", None, 7, 0), ("u", 1, 1, 0), (None, 2, 3, 0), ("t", None, 12, 1), ("u", None, 1, 1), (None, None, 3, 1), (None, None, 16, 2)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = rollup.totals(rows, [["tenant", "bucket"], ["tenant"], []], ["tokens"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    whole = rollup.with_total(rows, "bucket", "tokens")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted([(1, 6), (None, 7), (2, 3), (None, 16)], key=str)
    assert rollup.with_total(rows.limit(0), "bucket", "tokens").collect() == [(None, None)]
    by_tenant = rollup.with_total(rows, "bucket", "tokens", ["tenant"])
    assert sorted(map(tuple, by_tenant.collect()), key=str) == sorted([w[:3] for w in want if w[3] < 2], key=str)


@pytest.mark.parametrize("fan", [2, 64])
def test_maps_merge_key_by_key(spark, fan):
    rows = [("t", "d", i % 3, {"a": i, "b": 1} if i % 2 else {"c": 5}) for i in range(40)] + [("t", "d", 0, None), ("u", "d", 0, {})]
    merged = rollup.merge_maps(spark.createDataFrame(rows, "tenant string, day string, minute int, by_model map<string,bigint>"), keys=["tenant"], fan=fan)
    want = {}
    for tenant, _, minute, by in rows:
        slot = want.setdefault((tenant, minute), {})
        for k, v in (by or {}).items():
            slot[k] = slot.get(k, 0) + v
    assert {(r.tenant, r.minute): r.by_model for r in merged.collect()} == want
