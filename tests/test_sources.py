import gzip
import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from fleetgauge.sources import loglines, npy, sinks, tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b,c", None)], "n int, s string, x double")
    path = str(tmp_path / "deep" / "er" / "t.csv")
    sinks.write_csv(df, path)
    back = tables.read_csv(spark, path)
    assert back.columns == ["n", "s", "x"] and rows(back) == rows(df)
    with pytest.raises(AnalysisException):
        tables.read_csv(spark, str(tmp_path / "missing.csv"))


def test_json_both_forms(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}))
    want = [(1, "x"), (2, "y")]
    assert rows(tables.read_json(spark, str(tmp_path / "r.json"), orient="array")) == want
    assert rows(tables.read_by_extension(spark, str(tmp_path / "r.json"), orient="array")) == want
    with pytest.raises(ValueError, match="orient"):
        tables.read_json(spark, str(tmp_path / "r.json"), orient="guess")
    columns = tables.read_json(spark, str(tmp_path / "c.json"), "a int, b string", orient="columns")
    assert rows(columns.select("a", "b")) == want


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n{"a": 3}\n')
    want = [(1, "x"), (2, "y"), (3, None)]
    assert rows(tables.read_json(spark, str(tmp_path / "l.json"))) == want
    assert rows(tables.read_by_extension(spark, str(tmp_path / "l.json"), schema="a long, b string")) == want
    (tmp_path / "big.json").write_text('{"a": 1}\n' * 20000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        split = tables.read_json(spark, str(tmp_path / "big.json"), "a long")
        assert split.rdd.getNumPartitions() > 2 and split.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parquet_round_trip(spark, tmp_path):
    sinks.write_parquet(spark.range(5), str(tmp_path / "x" / "p.parquet"))
    assert tables.read_parquet(spark, str(tmp_path / "x" / "p.parquet")).count() == 5


def test_npy(spark, tmp_path):
    two, one = np.arange(20.0).reshape(10, 2), np.arange(3)
    sinks.write_npy(two, str(tmp_path / "two.npy"))
    np.save(tmp_path / "one.npy", one)
    got = npy.read_npy(spark, str(tmp_path / "two.npy"), rowsPerSplit=3)
    assert got.rdd.getNumPartitions() == 4
    assert [(r["row_id"], r["values"]) for r in got.orderBy("row_id").collect()] == [(i, list(v)) for i, v in enumerate(two)]
    assert npy.read_npy(spark, str(tmp_path)).count() == 13
    flat = tables.read_target(spark, str(tmp_path / "two.npy")).orderBy("row_key", "pos")
    assert [r["value"] for r in flat.collect()] == list(two.ravel())
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.arange(12, dtype="int16").reshape(4, 3)))
    turned = npy.read_npy(spark, f"file://{tmp_path}/turn*.npy", rowsPerSplit=3).orderBy("row_id").collect()
    assert [r["values"] for r in turned] == np.arange(12.0).reshape(4, 3).tolist()
    np.save(tmp_path / "objects.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="(?i)pickle|object"):
        npy.read_npy(spark, str(tmp_path / "objects.npy")).collect()
    with pytest.raises(ValueError, match="objects"):
        sinks.write_npy(np.array([{}], dtype=object), str(tmp_path / "o.npy"))


def test_many_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x,y\n5,6\n7,oops\n")
    (tmp_path / "empty.csv").write_text("")
    good, bad = tables.read_many_csv(spark, str(tmp_path / "*.csv"), "x int, y int")
    assert rows(good.select("file_name", "x", "y")) == [("a.csv", 1, 2), ("a.csv", 3, 4)]
    assert sorted((r["file_path"].rsplit("/", 1)[1], r["bad_rows"]) for r in bad.collect()) == [("b.csv", 1), ("empty.csv", 0)]


def test_many_csv_headers_and_damage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "swapped one.csv").write_text("y,x\n4,3\n")
    (tmp_path / "missing.csv").write_text("x\n5\n")
    (tmp_path / "extra.csv").write_text("z,y,x\nq,7,6\n")
    (tmp_path / "other.csv").write_text("p,q\n1,2\n")
    packed = gzip.compress(b"x,y\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(50000)))
    (tmp_path / "whole.csv.gz").write_bytes(packed)
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    good, bad = tables.read_many_csv(spark, str(tmp_path / "*.csv*"), "x int, y int")
    small = good.where("file_name not like '%.gz'")
    assert rows(small.select("x", "y")) == sorted([(1, 2), (3, 4), (5, None), (6, 7)], key=repr)
    assert good.where("file_name = 'whole.csv.gz'").count() == 50000 and good.where("file_name = 'cut.csv.gz'").count() == 0
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in bad.collect()) == ["cut.csv.gz", "other.csv"]
    assert tables.read_many_csv(spark, str(tmp_path / "other.csv"), "x int")[0].count() == 0


def test_by_extension(spark, tmp_path):
    (tmp_path / "t.csv").write_text("y,z\n1,2\n3,4\n")
    assert tables.read_by_extension(spark, str(tmp_path / "t.csv")).count() == 2
    target = tables.read_target(spark, str(tmp_path / "t.csv")).orderBy("row_key", "pos")
    assert [r["value"] for r in target.collect()] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_by_extension(spark, "t.xlsx")


def test_parse_records_errors(spark):
    bodies = [None, "5", '"x"', "null", '{"a": [1]}', "[]", '[{"a": 1}]', "{nope", '{"zzz": [1]}', '{"a": [], "b": []}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {(r["i"], r["a"], r["b"], r["_error"]) for r in tables.parse_records(df, "body", "a int, b string", ["i"]).collect()}
    assert got == {
        (0, None, None, "the body is empty"), (1, None, None, "the body is neither a list nor an object"), (2, None, None, "the body is neither a list nor an object"),
        (3, None, None, "the body is empty"), (4, 1, None, None), (6, 1, None, None),
        (7, None, None, "no known column"), (8, None, None, "no known column"),
    }


def test_log_lines(spark, tmp_path):
    text = "2024-01-02 03:04:05,678 - app.api - WARNING - a - b\nplain text\n"
    (tmp_path / "app.log").write_text(text)
    got = loglines.read_log_lines(spark, str(tmp_path / "app.log")).orderBy(F.col("name").desc_nulls_last()).collect()
    assert (got[0]["name"], got[0]["level"], got[0]["message"]) == ("app.api", "WARNING", "a - b")
    assert got[0]["ts"].microsecond == 678000 and got[1]["value"] == "plain text" and got[1]["ts"] is None


def test_metric_lines(spark, tmp_path):
    at = "2024-01-02 03:04:05,678 - "
    lines = ["loss=0.125000 (step=3)", "acc=-1.500000", "PARAMETERS: lr=0.1, depth=3", "MODEL: net (MLP)", "other"]
    (tmp_path / "m.log").write_text("".join(f"{at}{x}\n" for x in lines))
    got = {r["value"][len(at):]: r for r in loglines.read_metric_lines(spark, str(tmp_path / "m.log")).collect()}
    assert (got[lines[0]]["metric"], got[lines[0]]["metric_value"], got[lines[0]]["step"]) == ("loss", 0.125, 3)
    assert (got[lines[1]]["metric_value"], got[lines[1]]["step"]) == (-1.5, None)
    assert got[lines[2]]["params"] == {"lr": "0.1", "depth": "3"}
    assert (got[lines[3]]["model"], got[lines[3]]["model_type"]) == ("net", "MLP")
    assert got["other"]["metric"] is None


def test_history_and_export(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'aws' AS provider, 1 AS v UNION ALL SELECT timestamp'2024-01-01 11:05:00', 'aws', 2")
    path = str(tmp_path / "history")
    sinks.snapshot_history(df, path)
    sinks.snapshot_history(df.where("v = 2").withColumn("v", F.lit(3)), path)
    assert rows(spark.read.parquet(path).select("hour", "v")) == [("2024-01-01-10", 1), ("2024-01-01-11", 3)]
    logs = df.select("ts", F.lit("api").alias("component"), F.lit("hello").alias("message"))
    for fmt in ("json", "csv", "text"):
        sinks.export_logs(logs, str(tmp_path / fmt), fmt)
    assert "2024-01-01 10:05:00 [api] hello" in [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()]
    with pytest.raises(ValueError, match="unknown"):
        sinks.export_logs(logs, str(tmp_path / "x"), "xml")
    for _ in range(2):
        sinks.write_spans_jsonl(df, str(tmp_path / "spans"))
    assert spark.read.json(str(tmp_path / "spans")).count() == 4
