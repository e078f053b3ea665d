"""Networks: gradients against finite differences, sums against one task, and functions that are found again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import networks


@pytest.mark.parametrize("activation", networks.ACTIVATIONS)
@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_is_that_of_finite_differences(activation, classes, dropout):
    draw = np.random.default_rng(5)
    net = networks.initial([4, 6, 5, classes or 1], activation, classes, 3)
    net = net.with_flat(net.flat() + draw.normal(0, 0.1, net.flat().size))
    x, y = draw.normal(size=(20, 4)), draw.integers(0, 3, 20).astype(float)
    _, gradient = net.loss(x, y, dropout, np.random.default_rng(1))
    at, step = net.flat(), 1e-6
    for i in draw.choice(at.size, 25, replace=False):
        up, down = at.copy(), at.copy()
        up[i] += step
        down[i] -= step
        slope = (net.with_flat(up).loss(x, y, dropout, np.random.default_rng(1))[0] - net.with_flat(down).loss(x, y, dropout, np.random.default_rng(1))[0]) / (2 * step)
        assert abs(slope - gradient[i]) < 1e-4 * max(1, abs(slope))


def frame(spark, n=2000):
    u = lambda k: F.rand(k) * 2 - 1
    df = spark.range(0, n, 1, 9).select("id", u(1).alias("a"), u(2).alias("b"))
    return df.withColumn("y", F.sin(F.col("a") * 2) + F.col("b") * F.col("b") * 3 + 10).withColumn("inside", (F.col("a") * F.col("a") + F.col("b") * F.col("b") < 0.5).cast("double"))


def test_sums_over_tasks_equal_one_pass(spark):
    df = frame(spark).select("a", "b", "y").persist()
    net = networks.initial([2, 5, 1], "tanh", 0, 1)
    pdf = df.toPandas()
    loss, gradient = net.loss(pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy())
    got = networks.gradient_sums(df, net, 2)
    assert got[1] == len(pdf) and np.isclose(got[0], loss) and np.allclose(got[2], gradient)
    assert networks.gradient_sums(df, net, 2)[2].tobytes() == got[2].tobytes()  # the same to the last bit
    df.unpersist()


def test_regression_finds_a_known_function(spark):
    df = frame(spark)
    fitted = networks.train_network(df, ["a", "b"], "y", hidden=(16, 8), activation="tanh", dropout=0.0, learning_rate=0.05, max_iter=80, eval_data=df.where("id < 100"))
    assert fitted.metrics["train_r2"] > 0.97 and fitted.metrics["val_r2"] > 0.95 and fitted.losses[-1] < 0.05 * fitted.losses[0]
    again = networks.TrainedNetwork.from_json(fitted.to_json())
    one, two = (networks.predict(t, df, ["id"]).orderBy("id").toPandas()["prediction"] for t in (fitted, again))
    assert np.allclose(one, two)


def test_classes_with_dropout(spark):
    df = frame(spark)
    fitted = networks.train_network(df, ["a", "b"], "inside", classes=2, hidden=(16,), dropout=0.1, learning_rate=0.1, max_iter=50)
    assert fitted.metrics["train_accuracy"] > 0.93
    out = networks.predict(fitted, df.limit(5), ["id"]).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["probability"])) for r in out)


def test_edges(spark):
    rows = [(1, 1.0, 2.0), (2, None, 3.0), (3, 2.0, None), (4, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, `x.y` double, z double")
    fitted = networks.train_network(df, ["x.y"], "z", hidden=(), dropout=0.0, learning_rate=0.1, max_iter=150)
    got = {r["id"]: r["prediction"] for r in networks.predict(fitted, df, ["id"]).collect()}
    assert got[2] is None and abs(got[1] - 2) < 0.1 and abs(got[3] - 3) < 0.1
    for bad in ({"activation": "step"}, {"dropout": 1.0}):
        with pytest.raises(ValueError):
            networks.train_network(df, ["x.y"], "z", **bad)
    with pytest.raises(ValueError, match="no rows"):
        networks.train_network(df.limit(0), ["x.y"], "z")
