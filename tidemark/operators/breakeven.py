"""Subscriptions against pay-as-you-go: fees, and the day on which a fee has paid for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import formats
from tidemark.functions.timeutil import Now, month_of
from tidemark.schema import PLAN_ROWS, PLANS, VENDOR_ROWS, VENDORS


def vendors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENDOR_ROWS, VENDORS)


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAN_ROWS, PLANS)


def plan_fees(settings: DataFrame, plans: DataFrame) -> DataFrame:
    """``settings(..., vendor, plan, custom_fee)`` with monthly_fee: the plan's, or the user's own if it is above 0.

    Null means pay-as-you-go: no plan, an unknown one, or a custom one without a fee.
    """
    own = F.when((F.col("plan") == "custom") & (F.col("custom_fee") > 0), F.col("custom_fee"))
    fees = settings.join(plans.select("vendor", "plan", "preset_fee"), ["vendor", "plan"], "left")
    return fees.withColumn("monthly_fee", F.coalesce("preset_fee", own)).select(*settings.columns, "monthly_fee")


def paid_off(costs: DataFrame, group: list[str], fee: str = "monthly_fee") -> DataFrame:
    """``costs(group, day, total_cost, fee)`` to (group, month_to_date_cost, broke_even_on): the first day on which costs reach the fee."""
    running = F.sum("total_cost").over(Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.when((F.col(fee) > 0) & (F.col("_running") >= F.col(fee)), F.col("day"))
    return costs.withColumn("_running", running).groupBy(*group).agg(F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("month_to_date_cost"), F.min(reached).alias("broke_even_on"))


def break_even(days: DataFrame, fees: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """A row for each row of ``fees(keys, vendor, provider, monthly_fee)``: this month's cost, multiple and progress.

    ``days`` are daily rows with a provider. A vendor without any has cost 0. The
    month is that of now, later days included.
    """
    keys = keys or []
    month = days.where(month_of(F.col("day")) == now.month).select(*keys, "provider", "day", "total_cost")
    rows = fees.join(month, [*keys, "provider"], "left").withColumn("total_cost", F.coalesce("total_cost", F.lit(0.0)))
    out = paid_off(rows, [*keys, "vendor", "monthly_fee"])
    multiple = F.when(F.col("monthly_fee") > 0, F.col("month_to_date_cost") / F.col("monthly_fee"))
    return out.withColumn("multiple", multiple).withColumn("progress", F.when(F.col("multiple").isNotNull(), F.least(F.lit(1.0), F.col("multiple"))))


def visible(rows: DataFrame) -> DataFrame:
    """What is worth showing: a fee, or a cost; with the line of text under it."""
    fee, cost = F.col("monthly_fee"), F.col("month_to_date_cost")
    paid = F.coalesce(F.concat(F.lit(" · broke even "), formats.month_day(F.col("broke_even_on"))), F.lit(""))
    detail = F.when(fee.isNull(), formats.cost(cost)).otherwise(F.concat(formats.cost(cost), F.lit(" of "), formats.cost(fee), F.coalesce(F.concat(F.lit(" · "), formats.multiple(F.col("multiple"))), F.lit("")), paid))
    return rows.where(fee.isNotNull() | (cost > 0)).withColumn("detail", detail)
