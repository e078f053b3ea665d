"""Transfer functions, their tree, and paths marked with arrays: each against the row-by-row rule."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import plan_chunks
from fleetgauge.functions.replay import NEVER, BreakerRule, Transfer, _entries, _path, breaker
from fleetgauge.operators import resilience


def walked(rule, ts, fail, code, until):
    out, code, until = rule.walk(ts.tolist(), fail.tolist(), code, until)
    return out, code, until


def stretch(draw, begin, n):
    ts = begin + np.sort(draw.integers(0, 40, n))
    return ts, draw.random(n) < 0.6


def function_of(rule, ts, fail):
    """The transfer function of some calls, by walking them from every state that can occur."""
    codes = [walked(rule, ts, fail, c, NEVER)[1:] for c in range(rule.open)]
    within = np.unique(ts) <= ts[0] + rule.recovery_us
    bounds = np.unique(ts)[: within.sum() + 1].tolist()  # and the first one beyond
    ends = [walked(rule, ts, fail, rule.open, b)[1:] for b in bounds]
    as_array = lambda pairs, k: np.array([p[k] for p in pairs], np.int64)
    return Transfer(int(ts[0]), as_array(codes, 0), as_array(codes, 1), np.array(bounds, np.int64), as_array(ends, 0), as_array(ends, 1))


@pytest.mark.parametrize("seed", range(30))
def test_composed_functions_do_what_the_rows_do(seed):
    draw = np.random.default_rng(seed)
    rule = BreakerRule(int(draw.integers(1, 4)), int(draw.integers(1, 120)), int(draw.integers(1, 3)))
    parts, begin = [], 0
    for _ in range(int(draw.integers(2, 7))):
        parts.append(stretch(draw, begin, int(draw.integers(1, 12))))
        begin = int(parts[-1][0][-1]) + 1
    functions = [function_of(rule, *p) for p in parts]
    while len(functions) > 1:  # pairwise, as the tree does; an odd one is left over
        functions = [a.then(b, rule.recovery_us) for a, b in zip(functions[::2], functions[1::2])] + functions[len(functions) // 2 * 2 :]
    whole = functions[0]
    ts, fail = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    entered = [(c, NEVER) for c in range(rule.open)] + [(rule.open, int(u)) for u in range(int(ts[0]) - 3, int(ts[0]) + rule.recovery_us)]
    for code, until in entered:
        c, u = whole.apply(np.array([code]), np.array([until]))
        want = walked(rule, ts, fail, code, until)[1:]
        assert c[0] == want[0] and (c[0] != rule.open or u[0] == want[1])
    # No more steps than times of rows within one hold time, and one beyond.
    assert len(whole.upto) <= len(np.unique(ts[ts < ts[0] + rule.recovery_us])) + 1
    assert len(whole.upto) < 2 or ((np.diff(whole.code) != 0) | (np.diff(whole.until) != 0)).all()


def test_paths():
    draw = np.random.default_rng(4)
    for n in (1, 2, 7, 100, 1000):
        step = np.append(np.minimum(np.arange(n) + draw.integers(1, 5, n), n), n)
        for start in (0, n // 2, n - 1, n):
            want, i = [], start
            while i < n:
                want.append(i)
                i = step[i]
            assert _path(step, start, n).tolist() == want


@pytest.mark.parametrize("rule", [BreakerRule(3, 50, 1), BreakerRule(1, 7, 3), BreakerRule(4, 90, 2, reset_on_success=False), BreakerRule(2, 0, 1)])
def test_marks_equal_the_walk(spark, rule):
    """From every entry state that a chunk can have: the rows' marks are those of the row-by-row rule."""
    draw = np.random.default_rng(9)
    ts = np.sort(draw.integers(0, 600, 300))
    pdf = pd.DataFrame({"k": "a", "ts": pd.to_datetime(ts, unit="us"), "id": np.arange(300), "failed": draw.random(300) < 0.5})
    df = spark.createDataFrame(pdf, "k string, ts timestamp_ntz, id bigint, failed boolean")
    got = breaker(df, ["k"], ["ts", "id"], "failed", plan_chunks(df, "ts", 1), rule).orderBy("id").toPandas()
    want, _, _ = rule.walk(ts.tolist(), pdf["failed"].tolist(), 0, NEVER)
    for name, values in want.items():
        assert got[name].tolist() == values
    many = breaker(df, ["k"], ["ts", "id"], "failed", plan_chunks(df, "ts", 23), rule).orderBy("id").toPandas()
    assert many.equals(got)


def dense(spark, n=4000):
    """One key with a row a second, and a few others."""
    key = F.when(F.col("id") % 40 == 0, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("hot")
    return spark.range(n).select(key.alias("key"), F.timestamp_seconds("id").alias("ts"), "id", (F.col("id") % 3 == 0).alias("failed"))


def test_hold_time_longer_than_chunks_on_a_hot_key(spark):
    df = dense(spark)
    plan = plan_chunks(df, "ts", 33)  # a chunk lasts two minutes, an entry twenty
    got = {r["id"]: r["hit"] for r in resilience.ttl_cache_hits(df, ["key"], ["ts", "id"], 1200, plan).collect()}
    want, stored = {}, {}
    for r in df.orderBy("id").collect():
        hit = r["key"] in stored and r["id"] - stored[r["key"]] < 1200
        stored.setdefault(r["key"], r["id"]) if hit else stored.update({r["key"]: r["id"]})
        want[r["id"]] = hit
    assert got == want


def test_a_task_gets_two_functions(spark):
    """Groups of the tree have at most two rows, at every height."""
    rows = [("a", c, c, [], [], [c], [0], [c + 5]) for c in range(37)] + [("b", 36, 36, [], [], [36], [0], [41])]
    ddl = "key string, __chunk int, begins bigint, discrete array<bigint>, discrete_until array<bigint>, upto array<bigint>, code array<bigint>, until array<bigint>"
    entry = _entries(spark.createDataFrame(rows, ddl), ["key"], 37, (0, NEVER), 5)
    got = {(r["key"], r["__chunk"]): r["__until"] for r in entry.collect()}
    until, want = NEVER, {}
    for c in range(37):
        want["a", c] = until
        until = c + 5 if until <= c else until
    assert got == want | {("b", 36): NEVER}
    plan = entry._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("compose(") >= 6 and plan.count("halve(") == 6


def test_rows_are_read_and_shuffled_once(spark):
    """The passes up and down share shuffles: the rows' own and one of each height's functions."""
    df = dense(spark)
    out = resilience.ttl_cache_hits(df, ["key"], ["ts", "id"], 300, plan_chunks(df, "ts", 16))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Range \(", final)) == 1 and final.count("ReusedExchange") == 5
