import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows
from fleetgauge.operators import evaluation, features, models
from fleetgauge.plans.pipeline import Pipeline, PipelineError, declared_pipeline


@pytest.fixture(scope="module")
def frame(spark):
    data = [(1, 1.0, 5, "b", True), (2, None, 5, "a", True), (3, 3.0, 5, None, False), (4, 8.0, 5, "b", False), (5, 0.0, 5, "a", True)]
    return spark.createDataFrame(data, "id bigint, x double, flat int, c string, flag boolean")


def test_types(frame):
    assert features.infer_feature_types(frame) == (["id", "x", "flat"], ["c"])


def test_impute(frame):
    assert features.impute_mean(frame, ["x"]).where("id = 2").first()["x"] == 3.0
    assert features.impute_mode(frame, ["c"]).where("id = 3").first()["c"] == "a"  # tie: smallest


def test_scaling(frame):
    out = features.scale(frame, ["x", "flat"], "standard").orderBy("id").toPandas()
    x = np.array([1.0, np.nan, 3.0, 8.0, 0.0])
    assert np.allclose(out["x"], (x - np.nanmean(x)) / np.nanstd(x), equal_nan=True) and set(out["flat"]) == {0.0}
    out = features.scale(frame, ["x", "flat"], "minmax").orderBy("id").toPandas()
    assert np.allclose(out["x"], x / 8, equal_nan=True) and set(out["flat"]) == {0.0}
    with pytest.raises(ValueError, match="unknown scaling"):
        features.scale(frame, ["x"], "robust")


def test_all_null_is_rejected(frame):
    with pytest.raises(ValueError, match="no known value"):
        features.impute_mean(frame.withColumn("y", F.lit(None).cast("double")), ["y"])


def test_one_hot_and_unseen(spark, frame):
    steps = features.fit(frame, [], ["c"], scaling=None, handle_missing=False)
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert features.transform(new, steps).columns == ["c_a", "c_b", "c_nan"]
    assert rows(features.transform(new, steps)) == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]


def test_preprocess_equals_separate_passes(frame):
    out, _ = features.preprocess(frame.drop("flag"), numeric=["x", "flat"], categorical=["c"])
    x = np.array([1.0, 3.0, 3.0, 8.0, 0.0])
    got = out.orderBy("id").toPandas()
    assert list(got.columns) == ["id", "x", "flat", "c_a", "c_b"] and np.allclose(got["x"], (x - x.mean()) / x.std())


def test_many_categories(spark):
    df = spark.range(10_000).select("id", F.format_string("v%05d", F.col("id") % 5000).alias("c"))
    steps = features.fit(df, [], ["c"])
    assert len(steps[-1].categories) == 5000 and steps[0].categories == ("v00000",)
    few = features.transform(df.where("id < 3"), [steps[0], features.Step("one_hot", "c", categories=steps[-1].categories[:300])])
    assert len(few.columns) == 301
    codes = {r["c"]: r["code"] for r in features.label_encode(df, "c", "code").collect()}
    assert codes == {f"v{i:05d}": i for i in range(5000)}


def test_wide_encoding(spark):
    df = spark.range(150).select(F.concat(F.lit("v"), "id").alias("c"))
    out, model = features.encode_wide(df, ["c"])
    assert len(out.select(vector_to_array("c_vector").alias("v")).first()["v"]) == 150
    unseen = model.transform(spark.createDataFrame([("new",)], "c string")).select(vector_to_array("c_vector").alias("v"))
    assert sum(unseen.first()["v"]) == 0


def test_wide_encoding_of_several_columns(spark, tmp_path, monkeypatch):
    """Many values over many ranges; nulls, values of one column that are unknown in the other; nothing but sizes on the driver."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("v%06d", F.col("id") % 20_011))
    df = spark.range(60_000).select("id", key.alias("a"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("w"), F.col("id") % 5)).alias("the b"))
    monkeypatch.setattr(features, "_categories", None)
    out, encoder = features.encode_wide(df, ["a", "the b"])
    names = sorted({r["a"] for r in df.select("a").distinct().collect()})
    assert encoder.sizes == {"a": len(names), "the b": 5} and out.columns == ["id", "a_vector", "the b_vector"]
    want = {r["id"]: (names.index(r["a"]), None if r["the b"] is None else int(r["the b"][1:])) for r in df.where("id % 977 = 0").collect()}
    got = out.where("id % 977 = 0").collect()
    assert all(r["a_vector"].size == len(names) and list(r["a_vector"].indices) == [want[r["id"]][0]] and list(r["a_vector"].values) == [1.0] for r in got)
    assert all(list(r["the b_vector"].indices) == ([] if want[r["id"]][1] is None else [want[r["id"]][1]]) for r in got) and len(got) == len(want)
    encoder.save(str(tmp_path / "codes"))
    again = features.WideEncoder.load(spark, str(tmp_path / "codes"))
    other = again.transform(spark.createDataFrame([("hot", "w3"), ("new", None), (None, "hot")], "a string, `the b` string"))
    assert sorted((list(r["a_vector"].indices), list(r["the b_vector"].indices)) for r in other.collect()) == sorted([([names.index("hot")], [3]), ([], []), ([], [])])


def test_state_round_trip(spark, frame, tmp_path):
    steps = features.fit(frame, ["x"], ["c"])
    features.save_state(spark, steps, str(tmp_path / "state"))
    again = features.load_state(spark, str(tmp_path / "state"))
    assert again == steps and rows(features.transform(frame, again)) == rows(features.transform(frame, steps))


def test_transform_runs_no_job(spark, frame):
    steps = features.fit(frame, ["x"], ["c"])
    spark.sparkContext.setJobGroup("lazy", "lazy")
    features.transform(frame, steps)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("rest", "rest")


def test_split_is_a_partition(spark):
    df = spark.range(5000)
    train, test = features.train_test_split(df, "id")
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 5000 and 850 < len(b) < 1150
    assert {r[0] for r in features.train_test_split(df.repartition(13), "id")[1].collect()} == b


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 0), (3, "c", 1), (4, None, 0)], "id int, c string, y int")
    assert rows(features.label_encode(df, "c", "k").select("id", "k")) == [(1, 1), (2, 0), (3, 2), (4, None)]
    out = features.target_encode(df, F.col("id") < 3, "c", "y", 1.0, "t").select("id", "t")
    assert rows(out) == [(1, 0.75), (2, 0.25), (3, 0.5), (4, 0.5)]


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (2, 2), (2, 3)], "l int, p int")
    got = evaluation.classification_metrics(df, "l", "p").first()
    # class: support, precision, recall, f1 = 0: 2, 1/2, 1/2, 1/2; 1: 1, 1/2, 1, 2/3; 2: 3, 1, 1/3, 1/2; 3: 0
    assert np.allclose(list(got), [0.5, (1 + 0.5 + 3) / 6, (1 + 1 + 1) / 6, (1 + 2 / 3 + 1.5) / 6])


def test_binary_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.51), (0, 0.6), (0, 0.1)], "y int, s double")
    assert np.allclose(list(evaluation.binary_metrics(df, "y", "s").first()), [0.5, 0.5, 0.5, 0.5])
    nothing = evaluation.binary_metrics(df.where("s < 0.4"), "y", "s").first()
    assert list(nothing) == [1.0, 0.0, 0.0, 0.0]


def test_regression_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert evaluation.regression_metrics(df, "y", "p").first()["r2"] == 1.0
    assert evaluation.regression_metrics(df.withColumn("p", F.col("p") + 1), "y", "p").first()["r2"] == 0.0


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    assert df.select(evaluation.argmax_class("v")).first()[0] == 1


def test_task(spark):
    def task(values):
        return evaluation.infer_task(spark.createDataFrame([(float(v),) for v in values], "y double"), "y").first()["task"]

    assert [task([0, 1, 1]), task([0, 1, 2]), task(range(10)), task([0.5, 1])] == ["binary", "multiclass", "regression", "regression"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 300)
    x = rng.normal(y[:, None] * 2.0, 1.0, (300, 3))
    return spark.createDataFrame([(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double").cache()


def test_train_score_store(spark, blobs, tmp_path):
    train, test = features.train_test_split(blobs, "id")
    fitted = models.train_model(train, ["a", "b", "c"], "label", params={"numTrees": 10, "maxDepth": 4}, eval_data=test)
    assert fitted.metrics["val_accuracy"] > 0.8 and fitted.metrics["train_time_seconds"] > 0
    assert models.score_batch(fitted, test, ["id"]).count() == test.count()
    proba = models.score_proba(fitted, test, ["id"]).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in proba)
    models.save_model(fitted, str(tmp_path / "m"))
    back = models.load_model(spark, str(tmp_path / "m"))
    assert back.metrics == fitted.metrics and back.features == ["a", "b", "c"]
    assert rows(models.score_batch(back, test, ["id"])) == rows(models.score_batch(fitted, test, ["id"]))
    again = models.train_model(train, ["a", "b", "c"], "label", params={"numTrees": 10, "maxDepth": 4})
    assert again.metrics["train_accuracy"] == fitted.metrics["train_accuracy"]
    with pytest.raises(Exception):
        models.load_model(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError, match="unknown model"):
        models.train_model(train, ["a"], "label", "magic")


def test_no_probabilities_for_regression(blobs):
    fitted = models.train_model(blobs, ["a", "b"], "c", "linear_regression")
    assert "train_r2" in fitted.metrics
    with pytest.raises(ValueError, match="no probabilities"):
        models.score_proba(fitted, blobs, ["id"])


def test_cross_validation(blobs):
    got = models.cross_validate(blobs, ["a", "b", "c"], "label", "logistic_regression", "id", 3, {"maxIter": 10})
    assert got["mean"] > 0.8 and got["std"] >= 0
    sizes = models.fold_column(blobs, "label", "id", 3).groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)


def test_mlp_and_custom(blobs):
    fitted = models.train_mlp(blobs, ["a", "b", "c"], "label", 2, hidden=(4,), max_iter=15)
    assert fitted.metrics["train_accuracy"] > 0.7
    out = models.score_custom(blobs, lambda: 1.0, lambda m, x: x["a"] + m, ["id"], ["a"])
    assert out.count() == 300 and out.columns == ["id", "prediction"]


def test_pipeline(spark, frame, tmp_path):
    def load(start):
        return {"data": frame, "n": start}

    def count(data, extra):
        return data.count() + extra

    flow = Pipeline("p").add_step("load", load).add_step("count", count, extra=2).add_step("arr", lambda: np.arange(3))
    out = flow.run({"start": 1, "unused": 5})
    assert out["count"] == 7 and out["n"] == 1
    row = flow.manifest(spark).first()
    assert row["steps"] == ["load", "count", "arr"] and row["metrics"]["steps_count"] == 3
    flow.results["other"] = object()
    flow.save_results(spark, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "data.parquet")).count() == 5
    assert np.array_equal(np.load(tmp_path / "out" / "arr.npy"), np.arange(3))
    manifest = spark.read.schema("results map<string,string>").json(str(tmp_path / "out" / "manifest.json")).first()["results"]
    assert manifest["data"] == "data.parquet" and manifest["count"] == "7" and manifest["other"] == "object"


def test_pipeline_errors():
    def boom():
        raise RuntimeError("no")

    with pytest.raises(PipelineError, match="step bad failed"):
        Pipeline("p").add_step("bad", boom).run()
    with pytest.raises(KeyError, match="unknown step"):
        declared_pipeline("t", {"t": ["nope"]}, {})
    with pytest.raises(KeyError, match="unknown pipeline"):
        declared_pipeline("x", {}, {})
    assert declared_pipeline("t", {"t": ["one"]}, {"one": lambda: 1}).run() == {"one": 1}
