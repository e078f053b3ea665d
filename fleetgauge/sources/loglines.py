"""Text logs to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line formats of the application, metric, parameter and model logs.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:,\d{3})?) - (\S+) - ([A-Z]+) - (.*)$"
METRIC_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:,\d{3})?) - (.*)$"
METRIC = r"^([^=\s:]+)=(-?(?:\d+\.\d+|nan|inf))(?: \(step=(-?\d+)\))?$"
PARAMETERS = r"^PARAMETERS: (.*)$"
MODEL = r"^MODEL: (.*) \((.*)\)$"


def _part(c: str | Column, pattern: str, group: int) -> Column:
    """A group of a full match, or null where the line does not match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _time(c: Column) -> Column:
    return F.to_timestamp_ntz(F.replace(c, F.lit(","), F.lit(".")))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`ts - name - LEVEL - message`; lines that do not match keep their text and null fields."""
    return lines.withColumns({
        "ts": _time(_part(value, LOG_LINE, 1)), "name": _part(value, LOG_LINE, 2),
        "level": _part(value, LOG_LINE, 3), "message": _part(value, LOG_LINE, 4),
    })


def parse_metric_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`ts - name=value (step=n)`, `ts - PARAMETERS: k=v, ...` and `ts - MODEL: name (type)`."""
    body = _part(value, METRIC_LINE, 2)
    params = _part("__body", PARAMETERS, 1)
    return (
        lines.withColumn("__body", body)
        .withColumns({
            "ts": _time(_part(value, METRIC_LINE, 1)), "metric": _part("__body", METRIC, 1),
            "metric_value": _part("__body", METRIC, 2).cast("double"), "step": _part("__body", METRIC, 3).cast("bigint"),
            "params": F.when(params.isNotNull(), F.str_to_map(params, F.lit(", "), F.lit("="))),
            "model": _part("__body", MODEL, 1), "model_type": _part("__body", MODEL, 2),
        })
        .drop("__body")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_metric_lines(spark.read.text(path))
