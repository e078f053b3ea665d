"""Chunked scans against pandas, on many chunks with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import Chunks, exact_percentiles, following, latest_n, plan_chunks, prefix, previous, runs, streak

ORDER = ["ts", "id"]


@pytest.fixture(params=[1, 7, 40])
def case(request, events):
    df, pdf = events
    return df, pdf.sort_values(ORDER), plan_chunks(df, "ts", request.param)


def test_plan_is_balanced(events):
    df, _ = events
    sizes = [r["count"] for r in plan_chunks(df, "ts", 10).tag(df).groupBy("__chunk").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 300


def test_prefix(case):
    df, pdf, chunks = case
    got = prefix(df, ["key"], ORDER, chunks, {"s": ("sum", F.col("value")), "m": ("max", F.col("value"))}).toPandas().sort_values(ORDER)
    assert np.allclose(got["s"], pdf.groupby("key")["value"].cumsum())
    assert np.allclose(got["m"], pdf.groupby("key")["value"].cummax())


def test_prefix_exclusive_reverse(case):
    df, pdf, chunks = case
    got = prefix(df, ["key"], ORDER, chunks, {"s": ("sum", F.col("value"))}, exclusive=True, reverse=True).toPandas().sort_values(ORDER)
    back = pdf[::-1].groupby("key")["value"].cumsum()[::-1] - pdf["value"]
    assert np.allclose(got["s"], back)


def test_null_keys_are_one_group(spark):
    df = spark.range(100).select(F.lit(None).cast("string").alias("key"), F.col("id").alias("ts"), "id")
    got = prefix(df, ["key"], ["ts"], plan_chunks(df, "ts", 5), {"n": ("sum", F.lit(1))})
    assert [r["n"] for r in got.orderBy("ts").collect()] == list(range(1, 101))


def test_neighbours(case):
    df, pdf, chunks = case
    got = following(previous(df, ["key"], ORDER, chunks, {"before": "id"}), ["key"], ORDER, chunks, {"after": "id"})
    got = got.toPandas().sort_values(ORDER)
    g = pdf.groupby("key")["id"]
    assert got["before"].astype(float).equals(g.shift(1).set_axis(got.index)) or np.array_equal(
        got["before"].to_numpy(float), g.shift(1).to_numpy(float), equal_nan=True)
    assert np.array_equal(got["after"].to_numpy(float), g.shift(-1).to_numpy(float), equal_nan=True)


def test_streak_and_runs(case):
    df, pdf, chunks = case
    want, lengths = [], []
    for _, g in pdf.groupby("key"):
        n = 0
        for i, f in zip(g["id"], g["failed"]):
            if not f and n:
                lengths.append(n)
            n = n + 1 if f else 0
            want.append((i, n))
        if n:
            lengths.append(n)
    got = streak(df, ["key"], ORDER, chunks, F.col("failed"), "n").select("id", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    found = [r["run_length"] for r in runs(df, ["key"], ORDER, chunks, F.col("failed")).collect()]
    assert sorted(found) == sorted(lengths)


def test_latest_n_limits_before_the_shuffle(events):
    df, pdf = events
    out = latest_n(df, ["key"], ORDER, 5)
    want = pdf.sort_values(ORDER).groupby("key").tail(5)["id"]
    assert sorted(r["id"] for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("n", [1, 5, 500, 5000])
def test_latest_n_over_chunks(case, n):
    df, pdf, chunks = case
    want = pdf.groupby("key").tail(n)["id"]
    assert sorted(r["id"] for r in latest_n(df, ["key"], ORDER, n, chunks).collect()) == sorted(want)


def test_chunks_follow_the_rows(spark):
    """Ten times the rows with the same cores: the largest chunk keeps its bound."""
    for rows in (5_000, 50_000):
        df = spark.range(rows).select((F.col("id") * 7919 % 104729).cast("double").alias("ts"))
        plan = plan_chunks(df, "ts", rows=1_000)
        sizes = [r["count"] for r in plan.tag(df).groupBy("__chunk").count().collect()]
        assert max(sizes) <= 1_000 and len(sizes) >= rows // 1_000
    assert plan_chunks(spark.range(100).withColumnRenamed("id", "ts"), "ts").splits == ()


@pytest.mark.parametrize("n", [1, 3, 25])
def test_exact_percentiles(events, n):
    df, pdf = events
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(df, ["key"], "value", wanted, plan_chunks(df, "value", n)).toPandas().set_index("key")
    for name, p in wanted.items():
        want = pdf.groupby("key")["value"].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index())


def test_percentiles_of_one_value(spark):
    df = spark.range(1000).select(F.lit(4.0).alias("value"))
    row = exact_percentiles(df, [], "value", {"p50": 0.5}).collect()
    assert [tuple(r) for r in row] == [(4.0,)]


def test_no_chunks_on_constant_order(spark):
    df = spark.range(10).select(F.lit(1.0).alias("x"), "id")
    got = prefix(df, [], ["x", "id"], plan_chunks(df, "x", 4), {"n": ("sum", F.lit(1))})
    assert max(r["n"] for r in got.collect()) == 10
    assert Chunks("x").splits == ()
    assert pd.notna(got.count())


@pytest.mark.parametrize("n", [1, 2, 33])
def test_mean_and_rows_from_the_counts_of_percentiles(spark, n):
    data = [("a", float(i % 13)) for i in range(200)] + [("a", None)] * 3 + [("none", None)] * 2 + [(None, 5.0)]
    df = spark.createDataFrame(data, "key string, v double").repartition(3)
    chunks = plan_chunks(df, "v", n)
    out = exact_percentiles(df, ["key"], "v", {"p50": 0.5}, chunks, mean="m", rows="n")
    got = {r["key"]: (None if r["m"] is None else round(r["m"], 9), r["n"], r["p50"]) for r in out.collect()}
    known = [v for k, v in data if k == "a" and v is not None]
    assert got == {"a": (round(sum(known) / 200, 9), 203, float(np.median(known))), "none": (None, 2, None), None: (5.0, 1, 5.0)}
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan ExistingRDD") <= 2 and "ReusedExchange" in final  # counts, and the values of the chunks that hold the ranks


def test_a_plan_is_one_job(spark):
    df = spark.range(50_000).select((F.col("id") * 7 % 50_000).alias("x"))
    spark.sparkContext.setJobGroup("plan-of-chunks", "")
    try:
        chunks = plan_chunks(df, "x", 50)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = sum(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("plan-of-chunks"))
    assert stages <= 3  # partial sketches, and their merge
    sizes = [r["count"] for r in chunks.tag(df).groupBy("__chunk").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 1500
    assert plan_chunks(df.limit(0), "x", 5).splits == () == plan_chunks(df.select(F.lit(None).cast("double").alias("x")), "x", 5).splits
    many = plan_chunks(df, "x", 400)
    assert 380 <= len(many.splits) <= 399
