"""Stateful rules: hand-made cases, and brute force over many chunks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.chunks import plan_chunks
from fleetgauge.operators import capacity, resilience
from fleetgauge.operators.capacity import Scaling

ORDER = ["ts", "id"]
T0 = dt.datetime(2024, 1, 1)


def calls(spark, seconds, outcomes=None, key="k"):
    outcomes = outcomes or ["S"] * len(seconds)
    data = [(key, T0 + dt.timedelta(seconds=s), i, o == "F") for i, (s, o) in enumerate(zip(seconds, outcomes))]
    return spark.createDataFrame(data, "key string, ts timestamp_ntz, id bigint, failed boolean")


def replay(df, chunks=None, **options):
    out = resilience.circuit_breaker(df, ["key"], ORDER, F.col("failed"), chunks=chunks, **options)
    return [(r["state_before"], r["rejected"], r["state_after"], r["failure_count"]) for r in out.orderBy(*ORDER).collect()]


def test_breaker_opens_rejects_and_recovers(spark):
    # Opens at the sixth call; 59 s later it rejects, 60 s later it tests and closes.
    df = calls(spark, [0, 1, 2, 3, 4, 5, 64, 65, 66], "F F S F F F S S F".split())
    got = replay(df, failure_threshold=3)
    assert [g[2] for g in got] == ["CLOSED"] * 5 + ["OPEN", "OPEN", "CLOSED", "CLOSED"]
    assert [g[1] for g in got] == [False] * 6 + [True, False, False]
    assert got[7][0] == "HALF_OPEN" and got[8][3] == 1


def test_breaker_reopens_on_half_open_failure(spark):
    got = replay(calls(spark, [0, 1, 70, 71, 131], "F F F S S".split()), failure_threshold=2)
    assert [g[2] for g in got] == ["CLOSED", "OPEN", "OPEN", "OPEN", "CLOSED"]


def test_breaker_needs_several_half_open_successes(spark):
    got = replay(calls(spark, [0, 60, 61], "F S S".split()), failure_threshold=1, half_open_max_calls=2)
    assert [g[2] for g in got] == ["OPEN", "HALF_OPEN", "CLOSED"]


def test_breaker_can_keep_count_over_successes(spark):
    df = calls(spark, [0, 1, 2], "F S F".split())
    assert replay(df, failure_threshold=2)[-1][2] == "CLOSED"
    assert replay(df, failure_threshold=2, reset_on_success=False)[-1][2] == "OPEN"


def brute_breaker(pdf, threshold, timeout, half, reset):
    out = {}
    for _, g in pdf.sort_values(ORDER).groupby("key"):
        state, fails, good, last = "CLOSED", 0, 0, None
        for ts, i, failed in zip(g["ts"], g["id"], g["failed"]):
            if state == "OPEN" and (ts - last).total_seconds() >= timeout:
                state, good = "HALF_OPEN", 0
            before, rejected = state, state == "OPEN"
            if not rejected:
                if failed:
                    last = ts
                    if state == "HALF_OPEN":
                        state = "OPEN"
                    else:
                        fails += 1
                        if fails >= threshold:
                            state = "OPEN"
                elif state == "HALF_OPEN":
                    good += 1
                    if good >= half:
                        state, fails = "CLOSED", 0
                elif reset:
                    fails = 0
            out[i] = (before, rejected, state, fails)
    return out


@pytest.mark.parametrize("n", [1, 6, 60])
@pytest.mark.parametrize(("threshold", "timeout", "half", "reset"), [(3, 60, 1, True), (2, 200, 3, True), (4, 30, 2, False)])
def test_breaker_brute_force(events, n, threshold, timeout, half, reset):
    df, pdf = events
    out = resilience.circuit_breaker(
        df, ["key"], ORDER, F.col("failed"), threshold, timeout, half, reset, plan_chunks(df, "ts", n)
    ).collect()
    want = brute_breaker(pdf, threshold, timeout, half, reset)
    assert {r["id"]: (r["state_before"], r["rejected"], r["state_after"], r["failure_count"]) for r in out} == want


def test_breaker_on_a_dead_key(spark):
    """All calls fail, so every chunk is entered while the circuit is open."""
    seconds = list(range(0, 400))
    df = calls(spark, seconds, ["F"] * 400)
    pdf = df.toPandas()
    for n in (1, 20):
        out = resilience.circuit_breaker(df, ["key"], ORDER, F.col("failed"), 3, 7, chunks=plan_chunks(df, "ts", n)).collect()
        want = brute_breaker(pdf, 3, 7, 1, True)
        assert {r["id"]: (r["state_before"], r["rejected"], r["state_after"], r["failure_count"]) for r in out} == want


@pytest.mark.parametrize("n", [1, 6, 60])
@pytest.mark.parametrize("ttl", [3, 60, 1000])
def test_ttl_brute_force(events, n, ttl):
    df, pdf = events
    want = {}
    for _, g in pdf.sort_values(ORDER).groupby("key"):
        stored = None
        for ts, i in zip(g["ts"], g["id"]):
            hit = stored is not None and (ts - stored).total_seconds() < ttl
            stored = stored if hit else ts
            want[i] = hit
    out = resilience.ttl_cache_hits(df, ["key"], ORDER, ttl, plan_chunks(df, "ts", n)).collect()
    assert {r["id"]: r["hit"] for r in out} == want


def test_ttl_edges(spark):
    got = resilience.ttl_cache_hits(calls(spark, [0, 59, 60, 119]), ["key"], ORDER, 60).orderBy("id").collect()
    assert [r["hit"] for r in got] == [False, True, False, True]


def test_rate_limit_window_is_inclusive(spark):
    got = resilience.rate_limit_flags(calls(spark, [0, 30, 60, 61]), ["key"], ORDER, 2, 60).orderBy("id").collect()
    assert [r["calls_in_period"] for r in got] == [1, 2, 3, 3]
    assert [r["exceeded"] for r in got] == [False, False, True, True]


@pytest.mark.parametrize("n", [1, 50])
def test_rate_limit_brute_force(events, n):
    df, pdf = events
    got = resilience.rate_limit_flags(df, ["key"], ORDER, 4, 120, plan_chunks(df, "ts", n)).collect()
    want = {}
    for _, g in pdf.groupby("key"):
        t = g["ts"].to_numpy()
        for ts, i in zip(t, g["id"]):
            want[i] = int(((t <= ts) & (t >= ts - np.timedelta64(120, "s"))).sum())
    assert {r["id"]: r["calls_in_period"] for r in got} == want


@pytest.mark.parametrize("n", [1, 50])
def test_rate_limit_admission(events, n):
    df, pdf = events
    got = resilience.rate_limit_admission(df, ["key"], ORDER, 3, 40, plan_chunks(df, "ts", n)).collect()
    want = {}
    for _, g in pdf.sort_values(ORDER).groupby("key"):
        admitted = []
        for ts, i in zip(g["ts"], g["id"]):
            at = ts if len(admitted) < 3 else max(ts, admitted[-3] + dt.timedelta(seconds=40))
            admitted.append(at)
            want[i] = (at - ts).total_seconds()
    assert {r["id"]: r["wait_seconds"] for r in got} == want


@pytest.mark.parametrize("n", [1, 30])
def test_debounce(events, n):
    df, pdf = events
    got = {r["id"] for r in resilience.debounce(df, ["key"], ORDER, 15, plan_chunks(df, "ts", n)).collect()}
    ordered = pdf.sort_values(ORDER)
    gap = ordered.groupby("key")["ts"].shift(-1) - ordered["ts"]
    assert got == set(ordered["id"][gap.isna() | (gap.dt.total_seconds() >= 15)])


def test_retry_schedule_and_matching(spark):
    ops = spark.createDataFrame([(1, T0)], "op bigint, started timestamp_ntz")
    plan = resilience.retry_schedule(ops, "op", "started", 3, 1.0, 2.0)
    assert [r["delay_seconds"] for r in plan.orderBy("attempt").collect()] == [0.0, 1.0, 3.0, 7.0]
    log = calls(spark, [0, 1.5, 20]).withColumn("op", F.lit(1).cast("bigint"))
    got = resilience.match_attempts(plan, log, "op", ["attempt"], "ts", "id", 2.0).orderBy("attempt").collect()
    assert [r["matched_id"] for r in got] == [0, 1, None, None]


def test_cooldown_modes(spark):
    data = [("p", T0, "up", True), ("p", T0, "up", True), ("p", T0 + dt.timedelta(seconds=30), "down", True),
            ("p", T0 + dt.timedelta(seconds=61), "down", False), ("p", T0 + dt.timedelta(seconds=62), "up", True)]
    df = spark.createDataFrame(data, "provider string, ts timestamp_ntz, direction string, ok boolean")
    either = capacity.cooldown_filter(df, "provider", "ts", "direction", "ok").orderBy("ts", "direction").collect()
    assert [r["accepted"] for r in either] == [True, True, False, True, True]
    same = capacity.cooldown_filter(df, "provider", "ts", "direction", "ok", True, Scaling(window_up=90)).orderBy("ts").collect()
    assert [r["accepted"] for r in same] == [True, True, True, False, False]


def test_failure_stats_and_map(spark):
    df = calls(spark, [0, 5]).withColumn("err", F.when(F.col("id") == 1, "E"))
    assert [tuple(r) for r in resilience.failure_stats(df, "err", "ts").collect()] == [("E", 1, T0 + dt.timedelta(seconds=5))]
    doubled = resilience.map_partitions(spark.range(10), lambda b: b.assign(y=b["id"] * 2), "id bigint, y bigint")
    assert [tuple(r) for r in doubled.orderBy("id").collect()] == [(i, 2 * i) for i in range(10)]
