"""User aggregates and table functions against plain Python over any partitions."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions import user
from fleetgauge.functions.user import Aggregate, TableFunction, aggregate, table_function


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Workers load the classes of this file from it."""
    spark.sparkContext.addPyFile(__file__)


class Summary(Aggregate):
    """Rows, sum and the two largest distinct values."""

    state = "n bigint, total double, top array<double>"
    result = "n bigint, total double, top array<double>, mean double"

    def partial(self, rows):
        v = rows["v"].dropna()
        return len(rows), float(v.sum()), sorted({float(x) for x in v}, reverse=True)[:2]

    def merge(self, one, other):
        return one[0] + other[0], one[1] + other[1], sorted({*one[2], *other[2]}, reverse=True)[:2]

    def finish(self, state):
        return (*state, state[1] / state[0])


def brute(rows):
    held = collections.defaultdict(list)
    for *key, v in rows:
        held[tuple("nan" if k != k else k for k in key)].append(v)
    out = {}
    for key, values in held.items():
        some = [v for v in values if v is not None]
        out[key] = (len(values), sum(some), sorted(set(some), reverse=True)[:2], sum(some) / len(values))
    return out


@pytest.mark.parametrize("held", [1, 100_000])
def test_aggregate(spark, monkeypatch, held):
    """A third of the rows on one key, null and NaN keys, few and many partitions, states handed on early."""
    monkeypatch.setattr(user, "HELD_STATES", held)
    keys = [("hot", 1.0)] * 300 + [(None, 2.0), ("a", float("nan")), ("b", None)] * 40 + [(f"k{i % 90}", float(i % 3)) for i in range(400)]
    rows = [(*k, None if i % 11 == 0 else float(i % 17)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "`the key` string, d double, v double")
    for parts in (1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        try:
            out = aggregate(df.repartition(parts), ["the key", "d"], Summary())
            assert out.columns == ["the key", "d", "n", "total", "top", "mean"]
            got = {tuple("nan" if k is not None and k != k else k for k in r[:2]): tuple(r[2:]) for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == brute(rows)


def test_aggregate_of_everything_and_nothing(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 4.0)], "k string, v double")
    assert [tuple(r) for r in aggregate(df, [], Summary()).collect()] == [(2, 5.0, [4.0, 1.0], 2.5)]
    assert aggregate(df.limit(0), ["k"], Summary()).collect() == [] == aggregate(df.limit(0), [], Summary()).collect()


def test_rows_stay_where_they_are(spark):
    """One shuffle, after the partial states."""
    plan = aggregate(spark.range(10).withColumn("v", F.lit(1.0)), ["id"], Summary())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


class Bursts(TableFunction):
    """Runs of rows with at most `gap` seconds between neighbours: first and last time, rows."""

    def __init__(self, gap):
        self.gap, self.first, self.last, self.n = gap, None, None, 0

    @staticmethod
    def returns(schema, gap):
        if gap is None or gap <= 0:
            raise ValueError("gap must be positive")
        kind = schema["ts"].dataType
        return T.StructType().add("first", kind).add("last", kind).add("n", T.LongType())

    def row(self, row):
        if self.n and (row["ts"] - self.last).total_seconds() > self.gap:
            yield self.first, self.last, self.n
            self.n = 0
        self.first, self.last, self.n = (row["ts"] if self.n == 0 else self.first), row["ts"], self.n + 1

    def end(self):
        yield self.first, self.last, self.n


def test_table_function(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=s)) for k, times in {"a": [0, 5, 9, 40, 41], "b": [3], None: [1, 100]}.items() for s in times]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"k string, ts {kind}").repartition(4)
        bursts = table_function(Bursts, ["k"], ["ts"])
        got = bursts(df.asTable(), gap=F.lit(10))
        assert got.schema["first"].dataType.simpleString() == kind and got.columns == ["k", "first", "last", "n"]
        at = lambda s: t0 + dt.timedelta(seconds=s)
        want = {("a", at(0), at(9), 3), ("a", at(40), at(41), 2), ("b", at(3), at(3), 1), (None, at(1), at(1), 1), (None, at(100), at(100), 1)}
        assert {tuple(r) for r in got.collect()} == want
    user.register_table_function(spark, "bursts_of_test", bursts)
    df.createOrReplaceTempView("calls_of_test")
    assert {tuple(r) for r in spark.sql("SELECT * FROM bursts_of_test(TABLE(calls_of_test), gap => 10)").collect()} == want
    assert bursts(df.limit(0).asTable(), gap=F.lit(10)).collect() == []


def test_table_function_checks_its_call(spark):
    bursts = table_function(Bursts, ["k"], ["ts"])
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "k string, ts timestamp")
    with pytest.raises(Exception, match="gap must be positive"):
        bursts(df.asTable(), gap=F.lit(0)).collect()
    with pytest.raises(Exception, match="has no column ts"):
        bursts(df.withColumnRenamed("ts", "x").asTable(), gap=F.lit(1)).collect()
    assert isinstance(bursts(df.asTable(), gap=F.lit(1)).schema["n"].dataType, T.LongType)
