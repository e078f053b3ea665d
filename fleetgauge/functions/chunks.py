"""Ordered work on keys of any size.

A window `PARTITION BY key ORDER BY ts` puts a whole key in one task. A key may
hold a third of all rows, so everything here that runs over an ordered key first
cuts the ordering column at equi-depth points. A (key, chunk) pair then never
holds more than one chunk of rows, windows run inside the chunk, and only one
summary row per (key, chunk) is carried from chunk to chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.common import col, micros, same_keys

CHUNK = "__chunk"
# Rows that a chunk has at most, equal values of the ordering column aside. A chunk's rows
# of a few columns fit in the memory of a Python task.
CHUNK_ROWS = 1_000_000
# Size of the quantile sketch, whose ranks are then right to about an eighth of a percent, and the ranks that are asked of it.
SKETCH_SIZE = 4096
SKETCH_POINTS = 1024
# Chunks up to which the sketch's error is an eighth of a chunk.
SKETCH_CHUNKS = 100
# Sampled rows per chunk; the depth of a chunk then varies by a few percent.
SAMPLE_ROWS = 2_000


def _position(df: DataFrame, by: str) -> Column:
    if isinstance(df.schema[by].dataType, (T.TimestampType, T.TimestampNTZType)):
        return micros(by).cast("double")
    if isinstance(df.schema[by].dataType, T.DateType):
        return F.unix_date(F.col(by)).cast("double")
    return F.col(by).cast("double")


@dataclass(frozen=True)
class Chunks:
    """Cut points over one ordering column, low to high."""

    by: str
    splits: tuple[float, ...] = ()

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the chunk number of every row."""
        if not self.splits:
            return df.withColumn(CHUNK, F.lit(0))
        edges = [float("-inf"), *self.splits, float("inf")]
        cutter = Bucketizer(splits=edges, inputCol="__pos", outputCol="__cut", handleInvalid="keep")
        tagged = cutter.transform(df.withColumn("__pos", _position(df, self.by)))
        return tagged.withColumn(CHUNK, F.col("__cut").cast("int")).drop("__pos", "__cut")


def plan_chunks(df: DataFrame, by: str, n: int | None = None, rows: int = CHUNK_ROWS) -> Chunks:
    """Choose equi-depth cut points so that a chunk has at most about `rows` rows.

    This runs when it is called: one pass over one pruned column, which counts the rows and sketches the column's
    quantiles. Only where more than SKETCH_CHUNKS chunks are needed, finer than the sketch tells, a second pass over a sample
    follows. Over a derived frame the pass runs what it is derived from; give the operators the
    chunks of the source table's column instead. The number of chunks follows the rows and
    nothing else; `n` sets it outright.
    """
    pos = df.select(_position(df, by).alias("__pos"))
    known = F.when(~F.isnan("__pos"), F.col("__pos"))
    at = F.array(*[F.lit(i / SKETCH_POINTS) for i in range(1, SKETCH_POINTS)])
    sketch = F.kll_sketch_agg_double(known, F.lit(SKETCH_SIZE))
    found = pos.agg(
        F.count(F.lit(1)).alias("total"), F.when(F.count(known) > 0, F.kll_sketch_get_quantile_double(sketch, at)).alias("points")
    ).first()
    total, points = found["total"], found["points"]
    if n is None:
        n = -(-total * 5 // (4 * rows))  # a quarter more, for the error of the sketch or sample
    if n <= 1 or points is None:
        return Chunks(by)
    if n <= SKETCH_CHUNKS:
        return Chunks(by, tuple(sorted({points[max(1, round(i * SKETCH_POINTS / n)) - 1] for i in range(1, n)})))
    share = min(1.0, SAMPLE_ROWS * n / total)
    sample = pos if share > 0.5 else pos.sample(share, seed=1)
    probs = [i / n for i in range(1, n)]
    return Chunks(by, tuple(sorted(set(sample.approxQuantile("__pos", probs, 1 / (8 * n))))))


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunks: Chunks,
    scans: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates per key, from the first row up to the current one.

    scans      output name -> (sum | max | min, column)
    exclusive  leave the current row out
    reverse    run from the last row backwards
    `order` must start with the chunked column and be a total order per key.

    What earlier chunks add up to enters each chunk as a seed row ahead of its
    first row, so the rows are shuffled once, by key and chunk, and never joined.
    """
    parts = [*keys, CHUNK]
    data = chunks.tag(df).withColumn("__seed", F.lit(False))
    for name, (_, c) in scans.items():
        data = data.withColumn(f"__in_{name}", c)
    if chunks.splits:
        chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        before = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
        sums = data.groupBy(*parts).agg(*[_AGG[k](f"__in_{n}").alias(f"__in_{n}") for n, (k, _) in scans.items()])
        seeds = sums.select(
            *parts, F.lit(True).alias("__seed"),
            *[_AGG[k](f"__in_{n}").over(before).alias(f"__in_{n}") for n, (k, _) in scans.items()],
        )
        data = data.unionByName(seeds, allowMissingColumns=True)
    ordering = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
    w = Window.partitionBy(*parts).orderBy(F.col("__seed").desc(), *ordering).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    for name, (kind, _) in scans.items():
        running = _AGG[kind](f"__in_{name}").over(w)
        data = data.withColumn(name, F.coalesce(running, F.lit(0)) if kind == "sum" else running)
    return data.where(~F.col("__seed")).drop("__seed", CHUNK, *[f"__in_{n}" for n in scans])


def previous(df: DataFrame, keys: list[str], order: list[str], chunks: Chunks, cols: dict[str, str]) -> DataFrame:
    """Value of other columns on the row before, per key: {output: column}."""
    packed = F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"__p_{n}") for n, c in cols.items()])
    out = prefix(df, keys, order, chunks, {"__prev": ("max", packed)}, exclusive=True)
    for name in cols:
        out = out.withColumn(name, F.col(f"__prev.__p_{name}"))
    return out.drop("__prev")


def following(df: DataFrame, keys: list[str], order: list[str], chunks: Chunks, cols: dict[str, str]) -> DataFrame:
    """Value of other columns on the row after, per key: {output: column}."""
    packed = F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"__p_{n}") for n, c in cols.items()])
    out = prefix(df, keys, order, chunks, {"__next": ("min", packed)}, exclusive=True, reverse=True)
    for name in cols:
        out = out.withColumn(name, F.col(f"__next.__p_{name}"))
    return out.drop("__next")


def streak(df: DataFrame, keys: list[str], order: list[str], chunks: Chunks, flag: Column, out: str) -> DataFrame:
    """Length of the unbroken run of `flag` that ends on each row (0 where it is false).

    Within a chunk it is the count of hits less the count at the last miss. A
    chunk that has had no miss so far adds the run it was entered with.
    """
    parts = [*keys, CHUNK]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(F.col("__hit"), 1).otherwise(0).cast("bigint")
    local = (
        chunks.tag(df.withColumn("__hit", F.coalesce(flag, F.lit(False))))
        .withColumn("__hits", F.sum(one).over(w))
        .withColumn("__base", F.max(F.when(~F.col("__hit"), F.col("__hits"))).over(w))
    )
    if not chunks.splits:
        run = F.col("__hits") - F.coalesce(F.col("__base"), F.lit(0))
        return local.withColumn(out, run).drop("__hit", "__hits", "__base", CHUNK)
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    tails = (
        local.groupBy(*parts).agg(F.max("__hits").alias("__all"), F.max("__base").alias("__last"))
        .withColumn("__group", F.count("__last").over(by_chunk))
        .withColumn("__run", F.sum(F.col("__all") - F.coalesce("__last", F.lit(0))).over(
            Window.partitionBy(*keys, "__group").orderBy(CHUNK)))
        .select(*parts, F.lag("__run", 1, 0).over(by_chunk).alias("__entry"))
    )
    run = F.col("__hits") - F.coalesce(F.col("__base"), -F.col("__entry"))
    return same_keys(local, tails, parts).withColumn(out, run).drop("__hit", "__hits", "__base", "__entry", CHUNK)


def runs(df: DataFrame, keys: list[str], order: list[str], chunks: Chunks, flag: Column) -> DataFrame:
    """One row per maximal run of `flag`: run_start, run_end, run_length and run_stop.

    Rows are grouped by the last miss before them. Such a group is one run and
    the miss that ends it, so run_stop, the time of that miss, is null for a run
    that is still going on. The grouping combines map-side, whatever the length
    of a run.
    """
    ts = order[0]
    marked = df.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("__hit"))
    miss = F.when(~F.col("__hit"), F.struct(*[F.col(o) for o in order]))
    named = prefix(marked, keys, order, chunks, {"__anchor": ("max", miss)}, exclusive=True)
    hit = F.when(F.col("__hit"), F.col(ts))
    return (
        named.groupBy(*keys, "__anchor")
        .agg(
            F.min(hit).alias("run_start"), F.max(hit).alias("run_end"), F.count(hit).alias("run_length"),
            F.min(F.when(~F.col("__hit"), F.col(ts))).alias("run_stop"),
        )
        .where("run_length > 0").drop("__anchor")
    )


def latest_n(df: DataFrame, keys: list[str], order: list[str], n: int, chunks: Chunks | None = None) -> DataFrame:
    """The newest `n` rows per key, in two steps for any n.

    Counts per (key, chunk) tell in which chunks the newest `n` rows of each key lie; only rows of those
    are ranked, so a key brings at most n rows and one chunk to the ranking task.
    """
    chunks = chunks or plan_chunks(df, order[0])
    data = df
    if chunks.splits:
        tagged = chunks.tag(df)
        newer = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = tagged.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        held = counts.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0))).where(F.col("__newer") < n)
        data = same_keys(tagged, held.select(*keys, CHUNK), [*keys, CHUNK], "left_semi").drop(CHUNK)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return data.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, float], chunks: Chunks | None = None,
    mean: str | None = None, rows: str | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per key, without holding a key in one task.

    With `mean` and `rows` (names) the mean of the known values and the number of rows are given too, from the counts that the
    percentiles are found by, and keys without a known value are in the result, with nulls.

    Rows are counted per (key, value chunk); the counts tell which chunk holds
    each wanted rank, and only those chunks are ordered, as (value, count) pairs
    so that many equal values cost one row.
    """
    data = df.select(*keys, col(value).cast("double").alias("__v"))
    chunks = chunks or plan_chunks(data, "__v")
    # Rows without a value only count; the last chunk is theirs where there are several.
    tagged = Chunks("__v", chunks.splits).tag(data)
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    grouped = tagged.groupBy(*keys, CHUNK).agg(
        F.count("__v").alias("__n"), F.count(F.lit(1)).alias("__rows"), F.sum("__v").alias("__sum")
    )
    tagged = tagged.where(F.col("__v").isNotNull())
    counts = (
        grouped.where(F.col("__n") > 0)
        .withColumn("__upto", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys)))
        .withColumn("__from", F.col("__upto") - F.col("__n"))
    )
    points = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in wanted.items()
    ]))
    at = F.col("__pt.p") * (F.col("__total") - 1)
    ranks = (
        counts.withColumn("__pt", points)
        .withColumn("__at", at).withColumn("__lo", F.floor(at)).withColumn("__hi", F.ceil(at))
        .where("(__lo >= __from AND __lo < __upto) OR (__hi >= __from AND __hi < __upto)")
        .select(*keys, CHUNK, "__from", F.col("__pt.name").alias("__name"), "__at", "__lo", "__hi")
    )
    parts = [*keys, CHUNK]
    cum = Window.partitionBy(*parts).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        same_keys(tagged, ranks.select(*parts), parts, "left_semi")
        .groupBy(*parts, "__v").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__end", F.sum("__n").over(cum))
    )
    hit = same_keys(ordered, ranks, parts, "inner").withColumn("__stop", F.col("__from") + F.col("__end"))
    hit = hit.withColumn("__start", F.col("__stop") - F.col("__n"))

    def at_rank(name: str, rank: str) -> Column:
        inside = (F.col("__name") == name) & (F.col(rank) >= F.col("__start")) & (F.col(rank) < F.col("__stop"))
        return F.max(F.when(inside, F.col("__v")))

    def interpolated(name: str) -> Column:
        low, high = at_rank(name, "__lo"), at_rank(name, "__hi")
        part = F.max(F.when(F.col("__name") == name, F.col("__at") - F.col("__lo")))
        return (low + (high - low) * part).alias(name)

    out = hit.groupBy(*keys).agg(*[interpolated(n) for n in wanted])
    if mean is None and rows is None:
        return out
    totals = grouped.groupBy(*keys).agg(
        *([F.try_divide(F.sum("__sum"), F.sum("__n")).alias(mean)] if mean else []), *([F.sum("__rows").alias(rows)] if rows else [])
    )
    return same_keys(totals, out, keys)
