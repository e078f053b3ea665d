"""Feature preprocessing: imputation, scaling, encoding and splitting.

`fit` makes one aggregate over all numeric columns and one count of category
values; `transform` is a projection without any action. The fitted state is a
small table: one row per step and column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.common import cut, ratio, same_keys, uniform, with_total

STATE_SCHEMA = "step int, kind string, column string, params map<string,double>, categories array<string>"


@dataclass(frozen=True)
class Step:
    """One fitted step on one column."""

    kind: str
    column: str
    params: dict[str, float] = field(default_factory=dict)
    categories: tuple[str | None, ...] = ()


def infer_feature_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns; booleans, dates and nested columns are neither."""
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if isinstance(f.dataType, T.StringType)]


def _numeric_stats(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population variance, minimum, maximum and share of known values, in one pass."""
    if not columns:
        return {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [
            F.count(x).alias(f"k{i}"), F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        c: {"known": row[f"k{i}"], "rows": row["n"], **{s: row[f"{s}{i}"] for s in ("mean", "var", "min", "max")}}
        for i, c in enumerate(columns)
    }


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value, n) for all categorical columns from one scan."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]))
    return df.select(pairs).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _categories(df: DataFrame, columns: list[str]) -> dict[str, list[str | None]]:
    """Distinct values per column in order, null last. They become columns, so they are the driver's to know."""
    if not columns:
        return {}
    out: dict[str, list[str | None]] = {c: [] for c in columns}
    for row in category_counts(df, columns).select("column", "value").toLocalIterator():
        out[row["column"]].append(row["value"])
    return {c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in out.items()}


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent known value per column, of equally frequent ones the smallest; found with partial aggregation."""
    if not columns:
        return {}
    known = category_counts(df, columns).where(F.col("value").isNotNull())
    top = known.groupBy("column").agg(F.max("n").alias("n"))
    best = known.join(top, ["column", "n"]).groupBy("column").agg(F.min("value").alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def fit(
    df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
    scaling: str | None = "standard", handle_missing: bool = True, encode: bool = True,
) -> list[Step]:
    """Fit the steps in order: impute numeric, impute categorical, scale, encode.

    Every category gets a column of its own. For columns with very many, leave `encode` out and
    take `encode_wide`, which gives one vector.
    """
    if scaling not in ("standard", "minmax", None):
        raise ValueError(f"unknown scaling: {scaling}")
    inferred = infer_feature_types(df)
    numeric = inferred[0] if numeric is None else numeric
    categorical = inferred[1] if categorical is None else categorical
    stats = _numeric_stats(df, numeric)
    values = _categories(df, categorical) if encode else {}
    modes = _modes(df, categorical) if handle_missing else {}
    steps: list[Step] = []
    if handle_missing:
        for c in numeric:
            if not stats[c]["known"]:
                raise ValueError(f"column {c} has no known value")
            steps.append(Step("impute_mean", c, {"value": stats[c]["mean"]}))
        for c in categorical:
            if c not in modes:
                raise ValueError(f"column {c} has no known value")
            steps.append(Step("impute_mode", c, categories=(modes[c],)))
    if scaling:
        for c in numeric:
            s = stats[c]
            # Filling with the mean keeps the mean and shrinks the variance by the known share.
            share = s["known"] / s["rows"] if handle_missing else 1.0
            low, high = s["min"], s["max"]
            params = (
                {"shift": s["mean"], "scale": (s["var"] * share) ** 0.5} if scaling == "standard"
                else {"shift": low, "scale": high - low}
            )
            steps.append(Step(f"scale_{scaling}", c, params))
    for c in categorical if encode else ():
        steps.append(Step("one_hot", c, categories=tuple(v for v in values[c] if not (handle_missing and v is None))))
    return steps


def _scaled(x: Column, params: dict[str, float]) -> Column:
    """(x - shift) / scale; 0 for a constant column."""
    if not params["scale"]:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - params["shift"]) / params["scale"]


def transform(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Apply fitted steps; encoded columns replace their sources at the end of the row."""
    values = {c: F.col(f"`{c}`") for c in df.columns}
    encoded: list[Column] = []
    for s in steps:
        x = values[s.column]
        if s.kind == "impute_mean":
            d = x.cast("double")
            values[s.column] = F.coalesce(F.when(~F.isnan(d), d), F.lit(s.params["value"]))
        elif s.kind == "impute_mode":
            values[s.column] = F.coalesce(x, F.lit(s.categories[0]))
        elif s.kind == "one_hot":
            for c in s.categories:
                name = f"{s.column}_{'nan' if c is None else c}"
                encoded.append(x.eqNullSafe(F.lit(c)).cast("double").alias(name))
        else:
            values[s.column] = _scaled(x.cast("double"), s.params)
    gone = {s.column for s in steps if s.kind == "one_hot"}
    return df.select(*[v.alias(c) for c, v in values.items() if c not in gone], *encoded)


def preprocess(df: DataFrame, **options) -> tuple[DataFrame, list[Step]]:
    """Fit and transform; returns the frame and the fitted steps."""
    steps = fit(df, **options)
    return transform(df, steps), steps


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): the distinct known values of each column with their alphabetical codes from 0.

    Distinct values are dealt out by ranges of (column, value) and numbered within each; the counts of the column's
    ranges before are added. No column's values come together in one task or on the driver.
    """
    values = category_counts(df, columns).where(F.col("value").isNotNull()).select("column", "value")
    ranged = cut(values.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per column and range.
    counts = ranged.groupBy("column", "range").agg(F.count("*").alias("n"))
    offsets = counts.select("column", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("column", "range").orderBy("value")) - 1
    return ranged.withColumn("number", number).join(offsets, ["column", "range"]).select("column", "value", (F.col("number") + F.col("offset")).cast("int").alias("code"))


@dataclass(frozen=True)
class WideEncoder:
    """One-hot vectors by a dictionary that stays a table; only the number of values of each column is known here."""

    columns: tuple[str, ...]
    codes: DataFrame
    sizes: dict[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with a sparse vector {column}_vector in place of each column; null and unknown values give all zeros.

        Each column is joined with its part of the dictionary. A value that many rows have is a skewed join key, which
        adaptive execution splits.
        """
        at = [f"{c}__code" for c in self.columns]
        for c, code in zip(self.columns, at, strict=True):
            own = self.codes.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias(code))
            joined = df.join(own, F.col(f"`{c}`") == F.col("__value"), "left").drop("__value", F.col(f"`{c}`"))
            df = joined.withColumn(code, F.coalesce(F.col(f"`{code}`"), F.lit(self.sizes[c])))
        # The index after the last value is that of unknown ones, which dropLast leaves out.
        known = df.sparkSession.createDataFrame([tuple(self.sizes[c] for c in self.columns)], at)
        hot = OneHotEncoder(inputCols=at, outputCols=[f"{c}_vector" for c in self.columns], dropLast=True).fit(known)
        return hot.transform(df).drop(*at)

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> WideEncoder:
        codes = spark.read.parquet(path)
        return WideEncoder._of(codes)

    @staticmethod
    def _of(codes: DataFrame, columns: list[str] | None = None) -> WideEncoder:
        sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
        names = columns if columns is not None else sorted(sizes)
        return WideEncoder(tuple(names), codes, {c: sizes.get(c, 0) for c in names})


def encode_wide(df: DataFrame, columns: list[str]) -> tuple[DataFrame, WideEncoder]:
    """One-hot vectors for columns with many categories: the frame, and the encoder for other frames.

    Values are coded in alphabetical order. Unknown values at transform give an all-zero vector.
    """
    encoder = WideEncoder._of(cut(dictionary(df, columns)), columns)
    return encoder.transform(df), encoder


# Single steps ------------------------------------------------------------------------

def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return transform(df, fit(df, columns, [], scaling=None))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column; ties give the smallest value."""
    return transform(df, fit(df, [], columns, scaling=None, encode=False))


def scale(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    return transform(df, fit(df, columns, [], scaling=method, handle_missing=False))


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    return transform(df, fit(df, [], columns, scaling=None, handle_missing=False))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Zero-based alphabetical code.

    Only distinct values are ordered, not rows: they are dealt out by ranges, numbered within each, and
    the counts of the ranges before are added. The ranges are checkpointed, since they come from a sample.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = cut(values.repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as there are shuffle partitions.
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    codes = ranged.withColumn("__number", number).join(offsets, "__range").select(
        column, (F.col("__number") + F.col("__offset")).cast("bigint").alias(out)
    )
    return same_keys(df, codes, [column])


def target_encode(df: DataFrame, train: Column, column: str, target: str, smoothing: float, out: str) -> DataFrame:
    """Smoothed mean of the target per category from the training rows; unseen categories get the overall mean."""
    fitted = df.where(train)
    prior = fitted.agg(F.avg(target).alias("__prior"))
    sums = fitted.groupBy(column).agg(F.sum(target).alias("__sum"), F.count(target).alias("__n"))
    joined = with_total(same_keys(df, sums, [column]), prior)
    value = ratio(F.col("__sum") + F.col("__prior") * smoothing, F.col("__n") + smoothing)
    return joined.withColumn(out, F.when(F.col("__n").isNull(), F.col("__prior")).otherwise(value)).drop(
        "__sum", "__n", "__prior"
    )


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a hash of the row key; it does not depend on partitioning. The hash is MD5, which every engine has."""
    part = uniform(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))) < F.lit(test_share)
    return df.where(~part), df.where(part)


# State ---------------------------------------------------------------------------------

def state_table(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """Fitted steps as a table, to be written with any format."""
    rows = [
        (i, s.kind, s.column, {k: float(v) for k, v in s.params.items()}, list(s.categories)) for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(rows, STATE_SCHEMA)


def save_state(spark: SparkSession, steps: list[Step], path: str) -> None:
    state_table(spark, steps).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> list[Step]:
    rows = spark.read.schema(STATE_SCHEMA).parquet(path).orderBy("step").collect()
    return [Step(r["kind"], r["column"], dict(r["params"]), tuple(r["categories"])) for r in rows]
