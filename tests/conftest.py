import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from fleetgauge import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Random calls, a third of them on one key, with equal times and long gaps."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 3000
    gaps = rng.choice([0, 0, 1, 5, 20, 90], n)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(gaps.cumsum(), unit="s")
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({
        "key": key, "ts": ts, "id": np.arange(n), "failed": rng.random(n) < 0.45, "value": rng.integers(0, 50, n).astype(float),
    })
    ddl = "key string, ts timestamp_ntz, id bigint, failed boolean, value double"
    return spark.createDataFrame(pdf, ddl).repartition(4), pdf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
