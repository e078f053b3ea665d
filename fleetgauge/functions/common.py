"""Small expressions used everywhere."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """num / den * scale; 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(col(num) * F.lit(float(scale)), col(den)), F.lit(0.0))


def percent(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den, 100.0)


def count_if(cond: Column) -> Column:
    """Number of rows meeting `cond`, 0 on an empty group."""
    return F.count(F.when(cond, F.lit(1)))


def truncated(c: Column) -> Column:
    """Whole part, cut towards zero."""
    return c.cast("bigint")


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(col(c).cast("timestamp"))


def uniform(key: str | Column) -> Column:
    """Repeatable number in [0, 1) from the text of a key."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interval(seconds: float) -> Column:
    """Day-time interval of that many seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))


def bucket_start(ts: str | Column, width: str) -> Column:
    """Start of the tumbling window of `width` that holds `ts`."""
    return F.window(col(ts), width).getField("start")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on `keys` where null equals null; the right copy of the keys is dropped."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as an uncorrelated scalar subquery.

    The subquery runs once and its row becomes a constant of the plan, so `df`
    is neither joined nor shuffled.
    """
    row = total.select(F.struct(*[F.col(f"`{c}`") for c in total.columns]).alias("__total_row")).scalar()
    return df.withColumn("__total_row", row).select("*", *[
        F.col("__total_row").getField(c).alias(c) for c in total.columns
    ]).drop("__total_row")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir. Only a
    local session that names none gets a temporary folder.
    """
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
