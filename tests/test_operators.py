"""Edge rules of the declarative operators on hand-made rows."""

import datetime as dt
import json
import random
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetgauge.functions import crypto, redact
from fleetgauge.functions.common import cut, percent
from fleetgauge.operators import alerts, capacity, catalog, cost, dashboards, observability, routing, telemetry
from fleetgauge.operators.alerts import Rule
from fleetgauge.operators.capacity import Scaling

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_ratio_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(percent("a", "b")).collect()] == [0.0, 25.0]


def test_cut_uses_the_named_folder(spark):
    assert cut(spark.range(3)).count() == 3
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


# Telemetry and routing ------------------------------------------------------------


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 7.0), ("a", None)], "k string, v double")
    got = telemetry.histogram_rollup(df, ["k"], "v", (1.0, 5.0)).collect()
    assert [(r["le"], r["bucket_count"]) for r in got] == [("1", 1), ("5", 2), ("+Inf", 3)]
    assert (got[0]["sum"], got[0]["count"]) == (13.0, 3)


def test_gauge_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 6.0), ("a", 0, 9, 7.0)], "k string, t int, id int, v double")
    assert rows(telemetry.gauge_latest(df, ["k"], "v", ["t", "id"])) == [("a", 6.0, 1)]


def test_component_uptime(spark):
    df = spark.createDataFrame(
        [("a", at(0), False), ("a", at(10), True), ("a", at(20), True), ("b", at(5), True), ("b", at(30), False), ("c", at(3), True)],
        "k string, ts timestamp, up boolean")
    got = {r["k"]: (r["status"], r["uptime_seconds"]) for r in telemetry.component_status(df, ["k"], ["ts"], F.col("up")).collect()}
    assert got == {"a": (1, 20.0), "b": (0, 0.0), "c": (1, 27.0)}


def calls(spark, data):
    return spark.createDataFrame([(p, at(i), i, c, float(v)) for i, (p, c, v) in enumerate(data)],
                                 "provider string, ts timestamp, call_id int, status_code int, latency_ms double")


def test_recent_latency_counts_successes_only(spark):
    df = calls(spark, [("a", 200, 10), ("a", 200, 20), ("a", 500, 900), ("b", 500, 1)])
    bad = F.col("status_code") >= 500
    got = routing.provider_recent_latency(df, bad, ["ts", "call_id"], "latency_ms", n=1)
    assert rows(got) == [("a", 20.0), ("b", 0.0)]


def test_route_by_latency_ties_and_unknown(spark):
    routes = spark.createDataFrame([("/x", "b", 1), ("/x", "a", 2), ("/y", "c", 1), ("/y", "a", 2)], "path string, provider string, registration int")
    lat = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "provider string, avg_latency double")
    assert rows(routing.route_by_latency(routes, lat)) == [("/x", "b"), ("/y", "a")]


def test_route_by_weight_shares(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "provider string, weight double")
    got = dict(map(tuple, routing.route_by_weight(spark.range(20000), weights, "id").groupBy("routed_to").count().collect()))
    assert abs(got["a"] / 20000 - 0.25) < 0.02 and set(got) == {"a", "b"}


def test_request_outcome_precedence(spark):
    req = spark.createDataFrame([("/no", "a", 500), ("/x", "a", 500), ("/x", "b", 200), ("/y", "a", 200)], "path string, provider string, s int")
    routes = spark.createDataFrame([("/x",), ("/y",)], "path string")
    avail = spark.createDataFrame([("/x",)], "path string")
    opened = spark.createDataFrame([("b",)], "provider string")
    got = routing.request_outcome(req, routes, avail, opened, F.col("s") >= 500)
    assert {(r["path"], r["provider"]): r["outcome"] for r in got.collect()} == {
        ("/no", "a"): 404, ("/x", "a"): 500, ("/x", "b"): 503, ("/y", "a"): 503}


def test_health_reset(spark):
    df = calls(spark, [("a", 500, 1)] * 3 + [("a", 200, 1), ("a", 500, 1)])
    bad = F.col("status_code") >= 500
    got = routing.health_state(df, ["provider"], ["ts", "call_id"], bad).orderBy("call_id").collect()
    assert [r["consecutive_failures"] for r in got] == [1, 2, 3, 0, 1]
    assert [r["health"] for r in got][2:4] == ["unhealthy", "healthy"]
    assert routing.health_now(df, ["provider"], ["ts", "call_id"], bad).first()["healthy"]
    assert not routing.health_now(df.where("call_id < 3"), ["provider"], ["ts", "call_id"], bad).first()["healthy"]


def test_time_range_points(spark):
    df = calls(spark, [("a", 200, 1)] * 3)
    for name, (n, step) in dashboards.TIME_RANGES.items():
        got = dashboards.time_range_series(df, "ts", name, {"n": F.count(F.lit(1))}).orderBy("point").collect()
        assert len(got) == n and got[-1]["n"] == 3 and (got[-1]["point_ts"] - got[-2]["point_ts"]).total_seconds() == step


# Capacity ---------------------------------------------------------------------------


def test_gpu_rules(spark):
    ddl = "n int, is_gpu boolean, instance_type string, machine_type string, labels map<string,string>, accelerators array<string>, config_accelerators array<string>"
    df = spark.createDataFrame([
        (1, False, "g4dn.xlarge", None, {}, [], []), (2, None, "G4DN.xlarge", None, None, None, None), (3, None, "m5", "n1-t4", {}, [], []),
        (4, None, "m5", None, {"node-type": "gpu"}, [], []), (5, None, "m5", None, {}, ["x"], []), (6, None, "m5", None, {}, [], ["y"]),
        (7, None, None, None, None, None, None), (8, None, "m5", None, {"accelerator": "gpu"}, [], []),
    ], ddl)
    got = {r["n"]: r["gpu"] for r in capacity.gpu_node_groups(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True}


def test_group_size(spark):
    ddl = "desired_capacity int, min_node_count int, current_node_count int, initial_node_count int"
    df = spark.createDataFrame([(2, 1, 5, 6), (None, 1, 5, 6), (None, 1, None, 6), (None, None, 5, 6), (None, None, None, None)], ddl)
    assert [r["size"] for r in capacity.node_group_size(df).collect()] == [2, 5, 6, 6, 0]


def test_node_mean(spark):
    df = spark.createDataFrame([({"gpu_utilization": {"n1": 75.0, "n2": 85.0}, "empty": {}},)], "m map<string,map<string,double>>")
    got = df.select(*[capacity.avg_node_metric("m", k) for k in ("gpu_utilization", "empty", "none")]).first()
    assert list(got) == [80.0, 0.0, 0.0]


def test_thresholds(spark):
    got = capacity.threshold_table(spark, {"g": [{"name": "a", "threshold": 1}, {"name": "b"}, {"threshold": 2}]})
    assert rows(got) == [("g", "a", 1.0)]


SNAP = "ts int, provider string, gpu_node_count bigint, gpu_utilization double, queue_length bigint, latency_p95 bigint, cost_per_hour double, weight double"


def test_reactive_size_and_reason(spark):
    df = spark.createDataFrame([
        (1, "up", 3, 95.0, 0, 0, 1.0, 1.0), (1, "down", 10, 7.0, 0, 0, 1.0, 1.0), (1, "queue", 4, 60.0, 120, 1500, 1.0, 1.0),
        (1, "max", 15, 99.0, 900, 9000, 1.0, 1.0), (1, "calm", 4, 60.0, 50, 10, 1.0, 1.0),
    ], SNAP)
    got = {r["provider"]: r for r in capacity.scaling_reason(capacity.reactive_size(df)).collect()}
    assert {k: r["desired_size"] for k, r in got.items()} == {"up": 4, "down": 10, "queue": 8, "max": 20, "calm": 4}
    assert got["up"]["reason"] == "Scale up: GPU utilization 95.0% > threshold 80%"
    assert got["queue"]["reason"] == "Scale up: Queue length 120 > threshold 100, P95 latency 1500ms > threshold 1000ms"
    assert got["calm"]["reason"] == "No change needed"
    forced = capacity.scaling_reason(df.withColumn("desired_size", F.lit(1))).where("provider = 'down'").first()["reason"]
    assert forced == "Scale down: GPU utilization 7.0% < target 49.0%, Queue length 0 < target 15.0"


def test_cost_cap(spark):
    df = spark.createDataFrame([(1, "a", 4, 0.0, 0, 0, 60.0, 1.0), (1, "b", 4, 0.0, 0, 0, 10.0, 1.0), (1, "c", 4, 0.0, 0, 0, 300.0, 1.0)], SNAP)
    got = capacity.cost_cap(df.withColumn("desired_size", F.lit(8).cast("bigint")))
    assert {r["provider"]: r["capped_size"] for r in got.collect()} == {"a": 6, "b": 8, "c": 4}


def test_allocate_down_lowest_weight_first(spark):
    df = spark.createDataFrame([(1, "a", 2, 0.0, 0, 0, 1.0, 0.8), (1, "b", 9, 0.0, 0, 0, 1.0, 1.2)], SNAP)
    needs = df.withColumn("total_gpu_nodes", F.lit(11)).withColumn("desired_total_nodes", F.lit(6)).withColumn("role", F.lit("stable"))
    got = {r["provider"]: r["desired_nodes"] for r in capacity.allocate_down(needs, ["ts"]).collect()}
    assert got == {"a": 1, "b": 5}
    loose = {r["provider"]: r["desired_nodes"] for r in capacity.allocate_down(needs, ["ts"], Scaling(min_replicas=0)).collect()}
    assert loose == {"a": 0, "b": 6}


def test_allocate_up_leaves_the_remainder(spark):
    df = spark.createDataFrame([(1, p, 2, 90.0, 0, 0, 1.0, w) for p, w in (("a", 1.0), ("b", 1.0), ("c", 1.0))], SNAP)
    needs = df.withColumn("total_gpu_nodes", F.lit(6)).withColumn("desired_total_nodes", F.lit(10)).withColumn("role", F.lit("scale_up"))
    assert [r["delta"] for r in capacity.allocate_up(needs, ["ts"]).collect()] == [1, 1, 1]


def test_distribute(spark):
    df = spark.createDataFrame([("p", "a", 1, 5), ("p", "b", 3, 5), ("q", "a", 0, 3), ("q", "b", 0, 3), ("r", "a", 2, -9), ("r", "b", 5, -9)],
                               "provider string, node_group string, size bigint, delta bigint")
    got = {(r["provider"], r["node_group"]): r["desired_size"] for r in capacity.distribute_groups(df, ["provider"]).collect()}
    assert got == {("p", "a"): 2, ("p", "b"): 7, ("q", "a"): 2, ("q", "b"): 1, ("r", "a"): 1, ("r", "b"): 1}


def series(spark, values):
    return spark.createDataFrame([("k", at(i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp, v double")


def test_cycle(spark):
    import math

    def cycle(values, **kw):
        return [r["cycle_length"] for r in capacity.detect_cycle(series(spark, values), ["k"], "ts", "v", **kw).collect()]

    wave = [50 + 40 * math.sin(2 * math.pi * i / 12) for i in range(60)]
    assert cycle(wave[:40]) == [12] and cycle(wave) == [12]
    assert cycle([5.0] * 60) == [] and cycle(wave[:23]) == []


def test_forecast_and_predictive_size(spark):
    values = [90.0 if i % 12 == 6 else 20.0 for i in range(60)]
    df = series(spark, values)
    cycles = spark.createDataFrame([("k", 12)], "k string, cycle_length bigint")
    got = capacity.forecast_cyclic(df, cycles, ["k"], "ts", "v", forecast_minutes=18, interval_seconds=60).first()
    assert (got["forecast"], got["samples"], got["confidence"]) == (90.0, 5, 0.8)
    assert capacity.forecast_cyclic(df, cycles, ["k"], "ts", "v", forecast_minutes=5, interval_seconds=60).count() == 0
    sized = spark.createDataFrame([("k", 4, 4)], "k string, gpu_node_count bigint, desired_size bigint")
    f = spark.createDataFrame([("k", 90.0)], "k string, forecast double")
    assert capacity.predictive_size(sized, f, ["k"]).first()["planned_size"] == 5
    assert capacity.predictive_size(sized, f.withColumn("forecast", F.lit(60.0)), ["k"]).first()["planned_size"] == 4


def test_weights(spark):
    df = spark.createDataFrame([(1, p, 1, 0.0, 0, 100, c, 1.0) for p, c in (("aws", 2.0), ("gcp", 1.0), ("x", 1.0))], SNAP)
    assert rows(capacity.provider_weights(df, "fixed")) == [("aws", 0.8), ("gcp", 1.2), ("x", 1.0)]
    assert rows(capacity.provider_weights(df, "cost")) == [("aws", 0.6), ("gcp", 1.2), ("x", 1.2)]
    assert rows(capacity.provider_weights(df, "other")) == [("aws", 1.0), ("gcp", 1.0), ("x", 1.0)]


# Cost and alerts -----------------------------------------------------------------------


def test_categories_first_match(spark):
    df = spark.createDataFrame([("EC2 data transfer", 1.0), ("Amazon S3", 2.0), ("API Gateway", 4.0), ("Other", 8.0)], "service string, amount double")
    assert tuple(cost.cost_categories(df).first()) == (1.0, 2.0, 4.0, 15.0)


def test_budget_bands(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), a) for d, a in ((1, 2500.0), (2, 1696.63), (3, 900.0), (4, 2000.0))], "ts timestamp, amount double")
    got = cost.budget_status(df, 6000).orderBy("day").collect()
    assert [r["band"] for r in got] == ["0-50", "50-80", "80-100", "over"]
    assert round(got[1]["used_pct"], 2) == 69.94 and round(got[1]["remaining"], 2) == 1803.37
    assert [r["alert"] for r in got] == [False, False, True, True]


def test_timeframes(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 3, d), 1.0) for d in range(1, 31)], "service string, ts timestamp, amount double")
    for frame, n in (("hourly", 1), ("daily", 7), ("weekly", 30), ("monthly", 30), ("odd", 7)):
        assert cost.cost_report(df, frame).where("level = 'total'").first()["cost"] == n


def test_alert_fires_resolves_and_stays_active(spark):
    df = spark.createDataFrame([("a", at(60 * i), i, v) for i, v in enumerate([95, 95, 95, 10, 95, 10, 95, 95, 95])], "k string, ts timestamp, id int, u int")
    rule = Rule("hot", "u", 90, 120, "warning")
    got = alerts.alert_for_duration(df, ["k"], ["ts", "id"], rule).orderBy("run_start").collect()
    assert [(r["run_start"], r["fired_at"], r["resolved_at"]) for r in got] == [(at(0), at(120), at(180)), (at(360), at(480), None)]


def test_auto_close(spark):
    day = 86400
    df = spark.createDataFrame([("a", at(day * i), i, 95) for i in range(10)], "k string, ts timestamp, id int, u int")
    got = alerts.alert_for_duration(df, ["k"], ["ts", "id"], Rule("hot", "u", 90, 60, "w"), auto_close=alerts.AUTO_CLOSE_SECONDS).collect()
    assert [r["resolved_at"] for r in got] == [at(7 * day)]


def test_missing_period_breaks_the_run(spark):
    df = spark.createDataFrame([("a", at(300 * i), 95.0) for i in (0, 1, 3, 4, 5)], "k string, ts timestamp, u double")
    got = alerts.alarm_m_periods(df, ["k"], "ts", "u", 90).orderBy("period_start").collect()
    assert [r["period_start"] for r in got] == [at(300), at(1200), at(1500)]
    assert alerts.alarm_m_periods(df, ["k"], "ts", "u", 95).count() == 0


def test_node_status(spark):
    df = spark.createDataFrame([(92, 87, 95), (65, 72, 82), (80, 85, 90), (None, 99, None)], "c int, m int, g int")
    assert [r["status"] for r in alerts.node_status(df, "c", "m", "g").collect()] == ["Warning", "Running", "Running", "Warning"]


# Logs, traces, redaction, crypto ------------------------------------------------------------


def test_redaction(spark):
    mask = '"[REDACTED]"'
    cases = {
        '{"api_key":"x","auth":{"user":"u","token":"t"},"emails":["a"],"Phone":1}':
            f'{{"api_key":{mask},"auth":{{"user":"u","token":{mask}}},"emails":["a"],"Phone":{mask}}}',
        '[{"zip": 5, "n": 1e400}, 12345678901234567890.10]': f'[{{"zip": {mask}, "n": 1e400}}, 12345678901234567890.10]',
        '{"a": "\\ud800", "\\u0070assword": null}': f'{{"a": "\\ud800", "\\u0070assword": {mask}}}',
        '{"rows": [[{"ssn": 1}], {"ssn": 2}], "ssn": 3, "keys": [1]}': f'{{"rows": [[{{"ssn": 1}}], {{"ssn": {mask}}}], "ssn": {mask}, "keys": [1]}}',
        '"text"': '"text"', " 5 ": " 5 ", "{}": "{}", "[]": "[]",
        "{": mask, "": mask, '{"a" 1}': mask, "[1,]": mask, '{"a":1}}': mask, "[1 2]": mask, "plain": mask, "01": mask, '{"a":}': mask,
    }
    deep = '{"a":' * 50_000 + '{"secret":1}' + "}" * 50_000
    cases[deep] = '{"a":' * 50_000 + f'{{"secret":{mask}}}' + "}" * 50_000
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(-1, None)], "i int, b string")
    got = {r["i"]: r["b"] for r in df.select("i", redact.redact_json("b").alias("b")).collect()}
    assert got == {-1: None, **dict(enumerate(cases.values()))}
    for text, masked in cases.items():
        if masked != mask and text != deep:
            json.loads(masked)


def invented_json(draw, depth=0):
    """A value of random shape, as the text a careless writer makes of it."""
    blank = lambda: draw.choice(["", "", " ", "\n", " \t"])
    word = lambda: draw.choice(["a", "token", "My Key", "Zip code", "x,[", "né", "toKen", r"\"q\"", r"api_key", r"\\", "pass: word", "{cc}", ""])
    kind = draw.random()
    if depth > 3 or kind < 0.45:
        return draw.choice([f'"{word()}"', f'"{word()}"', "1", "-0.5e+3", "true", "null", "12345678901234567890.10"])
    inner = [invented_json(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    if kind < 0.6:
        return "[" + blank() + f"{blank()},{blank()}".join(inner) + blank() + "]"
    pairs = [f'"{word()}"{blank()}:{blank()}{v}' for v in inner]
    return "{" + blank() + f"{blank()},{blank()}".join(pairs) + blank() + "}"


def test_redaction_in_the_jvm_equals_the_token_walk(spark):
    draw = random.Random(12)
    texts = [invented_json(draw) for _ in range(1500)] + [t[:-1] for t in (invented_json(draw) for _ in range(100))]
    texts += ['{"a": 1, "a": 2}', '{"a":1}}', '{"a":1} x', '{"token": NaN}', "{'token': 1}", '{"token": 01}', '{"token": "a\tb"}', '{"x":"' + "y" * 300_000 + '","key":1}',
              r'{"note": "\"token\": 5", "k": ["token", ": 1"]}', '﻿{"token":1}', '{"token":1}\x0b', '{"token"\x0b:1}', '{"a": +1}', '{"a": .5}', '{"key": 1.}', "[1] [2]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, b string").repartition(4)
    got = {r["i"]: r["b"] for r in df.select("i", redact.redact_json("b").alias("b")).collect()}
    want = {i: redact.mask_text(t) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    easy = [i for i, t in enumerate(texts) if want[i] != '"[REDACTED]"' and "\\" not in t and "\u212a" not in t]
    assert len(easy) > 500 and sum("[REDACTED]" in want[i] for i in easy) > 50


def test_redaction_by_schema(spark):
    df = spark.createDataFrame([('{"user":"u","token":"t","items":[{"zip":"1","n":2}]}',), ("{",), (None,)], "b string")
    found = df.select(redact.redact_json("b", "user string, token string, items array<struct<zip: string, n: int>>").alias("b"))
    assert [r["b"] for r in found.collect()] == ['{"user":"u","token":"[REDACTED]","items":[{"zip":"[REDACTED]","n":2}]}', '"[REDACTED]"', None]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_typed_redaction(spark):
    df = spark.sql("SELECT 'p' AS password, named_struct('user', 'u', 'pin_key', 5) AS auth, array('a') AS emails, "
                   "map('token', 't', 'x', 'y') AS headers, array(named_struct('zip', '1', 'n', 2)) AS items")
    got = redact.redact_columns(df).first().asDict(recursive=True)
    assert got == {"password": "[REDACTED]", "auth": {"user": "u", "pin_key": None}, "emails": ["a"],
                   "headers": {"token": "[REDACTED]", "x": "y"}, "items": [{"zip": "[REDACTED]", "n": 2}]}


def test_keys_out_of_the_plan(spark):
    """Signing and encryption with a key column: the results of the bytes, and no plan shows the key in any spelling."""
    df = spark.createDataFrame([("m1",), ("",), (None,), ("ünï",)], "m string")
    for key in (b"k", b"0123456789abcdef", b"x" * 64, bytes(range(100))):
        hidden = crypto.secret(spark, key)
        both = df.select(crypto.hmac_sha256("m", key).alias("a"), crypto.hmac_sha256("m", hidden).alias("b"))
        assert all(r["a"] == r["b"] for r in both.collect())
    key = b"0123456789abcdef"
    hidden = crypto.secret(spark, key)
    tokens = df.select("m", crypto.encrypt_column("m", hidden).alias("t"), crypto.hmac_sha256("m", hidden).alias("s"))
    back = tokens.select("m", crypto.decrypt_column("t", hidden).alias("p"), crypto.hmac_matches("m", "s", hidden).alias("ok"))
    assert all(r["m"] == r["p"] and r["ok"] == (r["m"] is not None) for r in back.collect())
    for frame in (tokens, back):
        shown = frame._jdf.queryExecution().toString()
        assert not any(x in shown for x in ("0123456789abcdef", key.hex(), key.hex().upper(), "MDEyMzQ1Njc4OWFiY2RlZg", "48, 49, 50"))


def test_log_search_is_literal(spark):
    df = spark.createDataFrame([(1, at(0), "INFO", "api", "a.b"), (2, at(1), "INFO", "api", "aXb"), (3, at(2), "DEBUG", "api", "A.B")],
                               "id int, ts timestamp, level string, component string, message string")
    assert [r["id"] for r in observability.log_search(df, "id", term="A.b").collect()] == [3, 1]
    assert [r["id"] for r in observability.log_search(df, "id", levels=["INFO"], limit=1).collect()] == [2]
    assert observability.log_count(df, term="").first()[0] == 3
    plan = observability.log_search(df, "id", limit=1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_deep_trace_and_orphans(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(200)] + [(2, 0, 77), (2, 1, 0)]
    df = spark.createDataFrame(chain, "t int, s int, p int")
    got = {(r["t"], r["s"]): (r["root_id"], r["depth"], r["children"]) for r in observability.trace_tree(df, "t", "s", "p").collect()}
    assert got[(1, 199)] == (0, 199, 0) and got[(1, 0)] == (0, 0, 1) and got[(2, 1)] == (0, 1, 0) and got[(2, 0)] == (0, 0, 1)


def test_traces_with_cycles_and_repeats(spark):
    links = [(1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 3, None), (1, 4, 3), (2, 0, None), (2, 1, 0), (2, 1, 0), (3, 5, 5)]
    df = spark.createDataFrame(links, "t int, s int, p int")
    got = {(r["t"], r["s"]): (r["root_id"], r["depth"], r["children"]) for r in observability.trace_tree(df, "t", "s", "p").collect()}
    assert got == {
        (1, 0): (None, None, 1), (1, 1): (None, None, 2), (1, 2): (None, None, 0), (1, 3): (3, 0, 1), (1, 4): (3, 1, 0),
        (2, 0): (0, 0, 1), (2, 1): (0, 1, 0), (3, 5): (None, None, 1),
    }


def test_trace_headers(spark):
    df = spark.createDataFrame([({"X-Trace-ID": "t", "h": "1"}, "c", "s"), ({}, "c", None)], "h map<string,string>, ct string, cs string")
    got = observability.trace_context(df, "h", "ct", "cs").collect()
    assert (got[0]["trace_id"], got[0]["span_id"]) == ("t", None)
    assert got[0]["outgoing"] == {"h": "1", "X-Trace-ID": "c", "X-Span-ID": "s"} and got[1]["outgoing"] == {}


@pytest.mark.parametrize("key", [b"short", b"k" * 100])
def test_hmac(spark, key):
    df = spark.createDataFrame([("héllo",), ("",)], "m string")
    got = [r[0] for r in df.select(crypto.hmac_sha256("m", key)).collect()]
    assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("héllo", "")]
    signed = df.select("m", crypto.hmac_sha256("m", key).alias("s"))
    assert not any(r[0] for r in signed.select(crypto.hmac_matches("m", "s", b"other")).collect())


def test_encryption(spark):
    key = b"0123456789abcdef"
    df = spark.createDataFrame([("a", 1)], "t string, n int")
    token = df.select(crypto.encrypt_record(["t", "n"], key).alias("e")).cache()
    assert token.select(crypto.decrypt_column("e", key)).first()[0] == '{"t":"a","n":1}'
    assert token.select(crypto.decrypt_column("e", b"x" * 16, strict=False)).first()[0] is None
    with pytest.raises(Exception):
        token.select(crypto.decrypt_column("e", b"x" * 16)).collect()
    with pytest.raises(ValueError, match="unsupported"):
        crypto.checksum("t", "crc32")


# Catalog ---------------------------------------------------------------------------------------


REG = "model_name string, version string, registered_at timestamp, seq int, checksum string, size_bytes bigint, encrypted boolean, overrides map<string,string>"


def test_registry(spark):
    new = spark.createDataFrame([
        ("Test Model", "v1", at(0), 1, "c1", 10, True, None), ("test_model", "v1", at(5), 2, "c2", 11, True, None),
        ("test_model", "v2", at(5), 3, "c3", 12, True, {"registered_at": "2020-01-01 00:00:00"}), ("m", None, at(0), 4, "c", 1, False, None),
    ], REG)
    cat = catalog.register_versions(None, new)
    assert {(r["model_name"], r["version"]): r["checksum"] for r in cat.collect()} == {
        ("test_model", "v1"): "c2", ("test_model", "v2"): "c3", ("m", "v_1704067200"): "c"}
    assert {r["model_name"]: r["version"] for r in catalog.latest_version(cat).collect()} == {"test_model": "v1", "m": "v_1704067200"}
    assert {r["version_count"] for r in catalog.weights_info(cat).where("model_name = 'test_model'").collect()} == {2}
    left, report = catalog.delete_versions(cat, spark.createDataFrame([("M", None), ("test_model", "v9")], "model_name string, version string"))
    assert {r["model_name"] for r in left.collect()} == {"test_model"}
    assert {r["model_name"]: r["found"] for r in report.collect()} == {"m": True, "test_model": False}


def test_latest_tie_goes_to_the_first(spark):
    cat = spark.createDataFrame([("m", "b", at(0), 1), ("m", "a", at(0), 2)], "model_name string, version string, registered_at timestamp, seq int")
    assert catalog.latest_version(cat).first()["version"] == "b"


def test_replicas(spark):
    cat = spark.createDataFrame([("m", "1", "h"), ("m", "2", "h2")], "model_name string, version string, checksum string")
    loc = spark.createDataFrame([("m", "1", "s3", 0), ("m", "1", "gcs", 1), ("m", "2", "s3", 0)], "model_name string, version string, provider string, pos int")
    act = spark.createDataFrame([("m", "1", "s3", "bad"), ("m", "1", "gcs", "h")], "model_name string, version string, provider string, actual_checksum string")
    assert rows(catalog.verify_integrity(loc, cat, act)) == [("m", "1", "gcs", True), ("m", "1", "s3", False), ("m", "2", "s3", False)]
    assert rows(catalog.pick_replica(loc, cat, act)) == [("m", "1", "gcs", False), ("m", "2", None, True)]
    assert rows(catalog.missing_replicas(cat, loc, ["s3", "gcs"])) == [("m", "2", "gcs")]
    assert rows(catalog.replication_diff(loc, "s3", "gcs").select("version", "action")) == [("2", "copy")]


@pytest.mark.parametrize(("limit", "gone"), [(12, []), (10, ["a"]), (5, ["a", "b"]), (1, ["a", "b", "c"])])
def test_eviction(spark, limit, gone):
    df = spark.createDataFrame([(1, "a", 4), (2, "b", 4), (3, "c", 4)], "atime int, path string, size int")
    assert sorted(r["path"] for r in catalog.cache_eviction(df, ["atime", "path"], "size", limit).collect()) == gone


def test_compare(spark):
    listed = spark.createDataFrame([
        ("m", "a", dt.datetime(2023, 5, 12), 13500, ["gcs", "s3"]), ("m", "b", dt.datetime(2023, 7, 12), 13505, ["s3"]),
    ], "model_name string, version string, registered_at timestamp, size_bytes bigint, providers array<string>")
    pairs = spark.createDataFrame([("m", "a", "b")], "model_name string, version_a string, version_b string")
    got = catalog.compare_versions(listed, pairs).first()
    assert (got["size_change"], got["days_apart"], got["in_both"], got["only_in_a"], got["only_in_b"]) == (5, 61, "s3", "gcs", "")


def test_prefix(spark):
    pre = spark.createDataFrame([("a/",), ("a/b",), ("x",), ("toolong",)], "prefix string")
    obj = spark.createDataFrame([("a/bc",), ("tool",)], "name string")
    assert rows(catalog.exists_by_prefix(pre, obj)) == [("a/", True), ("a/b", True), ("toolong", False), ("x", False)]
