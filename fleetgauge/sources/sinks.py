"""Writers."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(header=True, **options).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def write_npy(array: np.ndarray, path: str) -> None:
    """Write a driver-side array through the cluster's file system."""
    if array.dtype.hasobject:
        raise ValueError("arrays of objects are not written")
    buffer = io.BytesIO()
    np.save(buffer, array, allow_pickle=False)
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    conf = SparkSession.getActiveSession().sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    try:
        stream.write(bytearray(buffer.getvalue()))
    finally:
        stream.close()


def write_spans_jsonl(spans: DataFrame, path: str) -> None:
    """Append finished spans as JSON lines."""
    spans.write.mode("append").json(path)


#: Rows of one file of a snapshot.
FILE_ROWS = 5_000_000


def snapshot_history(history: DataFrame, path: str, ts: str = "ts", provider: str = "provider") -> None:
    """Write history by provider and clock hour; an hour that is written again is replaced as a whole.

    Rows are rebalanced by their target partition first, so a task writes few files; adaptive execution
    splits a large hour over several tasks, and a file has FILE_ROWS rows at most.
    """
    hour = F.date_format(F.date_trunc("hour", F.col(ts)), "yyyy-MM-dd-HH")
    out = history.withColumn("hour", hour).hint("rebalance", provider, "hour")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy(provider, "hour").parquet(path)


def export_logs(logs: DataFrame, path: str, fmt: str) -> None:
    """Export log rows as json, csv or text (`ts [component] message`)."""
    if fmt == "json":
        logs.write.mode("overwrite").json(path)
    elif fmt == "csv":
        write_csv(logs, path)
    elif fmt == "text":
        line = F.format_string("%s [%s] %s", F.col("ts").cast("string"), "component", "message")
        logs.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
