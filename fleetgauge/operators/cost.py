"""Cost analytics over cost items: ts, amount and the dimensions of a charge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.common import interval, percent, ratio, same_keys, with_total

# Days of history per report timeframe; any other name gives 7.
TIMEFRAME_DAYS = {"hourly": 1, "daily": 7, "weekly": 30, "monthly": 90}

# Size of the report periods; weekly reports keep daily periods.
TIMEFRAME_PERIOD = {"hourly": "hour", "monthly": "month"}

# Words that put a service into a category, first match wins.
CATEGORY_WORDS = {
    "compute": ("ec2", "eks", "lambda"),
    "storage": ("s3", "ebs", "rds"),
    "network": ("vpc", "transfer", "api gateway"),
}


def _newest(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.max(ts).alias("__now"))


def cost_report(df: DataFrame, timeframe: str, tag: Column | None = None, now: Column | None = None, times: DataFrame | None = None) -> DataFrame:
    """Total, per service and per period cost of the timeframe before `now` (the newest item by default).

    One scan; the three levels are grouping sets of one aggregate. A literal `now` reaches the scan as a
    pushed filter. Without one the newest `ts` is looked up in `times`: give the fact table's own time
    column, so that the joins of `df` aren't planned once more for it.
    """
    days = TIMEFRAME_DAYS.get(timeframe, 7)
    data = df if tag is None else df.where(tag)
    if now is None:
        now = _newest(df if times is None else times, "ts").scalar()
    recent = data.where((F.col("ts") > now - interval(days * 86400)) & (F.col("ts") <= now))
    period = F.date_trunc(TIMEFRAME_PERIOD.get(timeframe, "day"), F.col("ts")).cast("timestamp_ntz")
    sets = [[F.col("period")], [F.col("service")], []]
    level = F.when(F.grouping("period") == 0, "period").when(F.grouping("service") == 0, "service").otherwise("total")
    return recent.withColumn("period", period).groupingSets(sets, F.col("period"), F.col("service")).agg(
        level.alias("level"), F.sum("amount").alias("cost")
    ).select("level", "period", "service", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def category(service: str) -> Column:
    """Category of a service name; null where no word matches."""
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORY_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(service).contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def cost_categories(df: DataFrame, service: str = "service") -> DataFrame:
    """One row: compute, storage, network and total cost; unmatched services count in the total only."""
    data = df.withColumn("__cat", category(service))
    return data.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("__cat") == c, F.col("amount"))), F.lit(0.0)).alias(f"{c}_cost")
            for c in CATEGORY_WORDS
        ],
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_cost"),
    )


def cost_by_provider(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Mean daily cost, days and total per provider; 0 for one without items."""
    daily = df.groupBy("provider", F.to_date("ts").alias("day")).agg(F.sum("amount").alias("cost"))
    sums = daily.groupBy("provider").agg(F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("days"))
    return same_keys(providers.select("provider"), sums, ["provider"]).select(
        "provider", F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("days", F.lit(0)).alias("days"), ratio("total_cost", "days").alias("mean_daily_cost"),
    )


def cost_today_month(df: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Cost of the newest day and its month for every combination of provider and model; `times` as in `cost_report`."""
    now = _newest(df if times is None else times, "ts").scalar()
    today = F.to_date("ts") == F.to_date(now)
    begin = F.date_trunc("month", now).cast(df.schema["ts"].dataType)
    return df.where((F.col("ts") >= begin) & (F.col("ts") <= now)).cube("provider", "model").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.coalesce(F.sum(F.when(today, F.col("amount"))), F.lit(0.0)).alias("today"),
        F.sum("amount").alias("month"),
    )


def daily_cost_pivot(df: DataFrame, providers: list[str]) -> DataFrame:
    """Daily cost, one column per provider."""
    return (
        df.groupBy(F.to_date("ts").alias("day")).pivot("provider", providers)
        .agg(F.sum("amount")).fillna(0.0, subset=providers)
    )


def cost_breakdown(df: DataFrame, component: str) -> DataFrame:
    """Cost per component and its share of the total."""
    sums = df.groupBy(component).agg(F.sum("amount").alias("cost"))
    return with_total(sums, sums.agg(F.sum("cost").alias("__all"))).select(
        component, "cost", percent("cost", "__all").alias("share_pct")
    )


def _daily(df: DataFrame) -> DataFrame:
    """Cost per day with its month; one row per calendar day."""
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.sum("amount").alias("cost")).withColumn(
        "month", F.trunc("day", "month")
    )


def budget_status(df: DataFrame, budget: float, alert_pct: float = 80.0, alarm_pct: float = 90.0) -> DataFrame:
    """Running budget use per day of each month: percent, remaining, band and alert flags."""
    w = Window.partitionBy("month").orderBy("day")
    used = F.col("used_pct")
    return (
        _daily(df).withColumn("spent", F.sum("cost").over(w))
        .withColumn("used_pct", F.col("spent") / F.lit(float(budget)) * 100)
        .select(
            "day", "spent", "used_pct", (F.lit(float(budget)) - F.col("spent")).alias("remaining"),
            ((F.lit(float(budget)) - F.col("spent")) / F.lit(float(budget))).alias("remaining_ratio"),
            F.when(used < 50, "0-50").when(used < 80, "50-80").when(used <= 100, "80-100").otherwise("over").alias("band"),
            (used >= alert_pct).alias("alert"), (used >= alarm_pct).alias("alarm"),
        )
    )


def cost_trend(df: DataFrame) -> DataFrame:
    """Month to date per month, change from the month before and projection to the month's end.

    Projection = month to date / days elapsed up to the newest day * days in the month.
    """
    months = _daily(df).groupBy("month").agg(F.sum("cost").alias("month_to_date"), F.max("day").alias("last_day"))
    w = Window.orderBy("month")
    before = F.lag("month_to_date").over(w)
    elapsed = F.when(F.lead("month").over(w).isNull(), F.dayofmonth("last_day")).otherwise(F.dayofmonth(F.last_day("month")))
    return months.select(
        "month", "month_to_date",
        (F.try_divide(F.col("month_to_date") - before, before) * 100).alias("change_pct"),
        (F.col("month_to_date") / elapsed * F.dayofmonth(F.last_day("month"))).alias("projected_month"),
    )


def cost_spikes(df: DataFrame, daily_budget: float, budget_pct: float = 120.0, step: float = 200.0) -> DataFrame:
    """Days over a percentage of the daily budget, or more than `step` above the day before."""
    w = Window.orderBy("day")
    over = F.col("cost") > daily_budget * budget_pct / 100
    jump = F.col("cost") - F.lag("cost").over(w)
    return _daily(df).select(
        "day", "cost", jump.alias("jump"), over.alias("over_budget"), F.coalesce(jump > step, F.lit(False)).alias("spike")
    ).where(F.col("over_budget") | F.col("spike"))


def cost_allocation(df: DataFrame, tags: str, tag_keys: list[str]) -> DataFrame:
    """Cost rolled up over tag values, outermost key first. `tags` is a MAP column."""
    named = df.select("amount", *[F.coalesce(F.col(tags)[k], F.lit("untagged")).alias(k) for k in tag_keys])
    return named.rollup(*tag_keys).agg(F.grouping_id().cast("bigint").alias("level"), F.sum("amount").alias("cost"))
