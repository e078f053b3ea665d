"""Readers of tabular files."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources.jsonarray import RANGE_BYTES, read_json_array
from fleetgauge.sources.npy import read_npy

CORRUPT = "_corrupt_record"
#: Ends of names of compressed files.
PACKED = (".gz", ".bz2", ".zst")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred, which reads the data once more."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, orient: str = "lines", range_bytes: int = RANGE_BYTES, **options
) -> DataFrame:
    """JSON: "lines" (one object per line), "array" (a file is one array of objects), "columns" (one object of columns).

    Files of lines are split, and so are arrays with a schema, into ranges of `range_bytes`. Arrays that are
    compressed or whose schema is to be inferred, and columns, are parsed by one task a file, in memory.

    The column form {"a": {"0": 1, "1": 2}} is turned by exploding every column
    into (row, column, value) and gathering the cells by row; `schema` names and
    types the columns.
    """
    if orient not in ("lines", "array", "columns"):
        raise ValueError(f"orient must be lines, array or columns, not {orient}")
    if orient == "array" and schema is not None and not path.lower().endswith(PACKED):
        return read_json_array(spark, path, schema, range_bytes, **options)
    if orient != "columns":
        reader = spark.read.options(multiLine=orient == "array", **options)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if schema is None:
        raise ValueError("the column form needs a schema")
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    nested = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), T.StringType())) for f in kinds.fields])
    whole = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("__file"), F.from_json("value", nested).alias("d")
    )
    cells = whole.select("__file", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("__c"), F.col(f"d.`{f.name}`").alias("__m")) for f in kinds.fields
    ]))).select("__file", "__c", F.explode("__m").alias("__row", "__v"))
    rows = cells.groupBy("__file", "__row").agg(*[
        F.max(F.when(F.col("__c") == f.name, F.col("__v"))).cast(f.dataType).alias(f.name) for f in kinds.fields
    ])
    return rows.select(F.col("__row").alias("row_key"), *[f.name for f in kinds.fields])


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def _damaged(spark: SparkSession, files: list[str]) -> list[str]:
    """Compressed files that don't decompress to their end; each is streamed through by a task."""
    packed = [f for f in files if f.lower().endswith(PACKED)]
    if not packed:
        return []

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            bad = []
            for path in batch["file_path"]:
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
                try:
                    with store.open_input_stream(name, compression="detect") as stream:
                        while stream.read(1 << 20):
                            pass
                except OSError:
                    bad.append(path)
            yield pd.DataFrame({"file_path": pd.Series(bad, dtype=object)})

    paths = spark.createDataFrame([(f,) for f in packed], "file_path string").repartition(min(len(packed), 1000))
    return [r["file_path"] for r in paths.mapInPandas(check, "file_path string").collect()]


def _headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First line of each file. A file's first block is read by one task, in order."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    return {r["file_path"]: r["header"] for r in first.collect()}


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", unquote(path))


def read_many_csv(spark: SparkSession, pattern: str, schema: T.StructType | str, **options) -> tuple[DataFrame, DataFrame]:
    """All CSV files of a glob as one frame with file_path and file_name, and a table of bad files.

    Columns are found by the names in each file's header, in any order; a column that a file
    lacks is null there, and columns outside the schema are left out. A bad file gives no rows at
    all: one that has no header or none of the columns, that has a row that doesn't fit, that gives no
    row, or that is compressed and damaged. An unreadable disk is an error, never a shorter result.

    Files with the same header are read together. The driver holds the file names and headers; the first
    block of every file is read once more for its header.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = [_plain(f) for f in spark.read.text(pattern).inputFiles()]
    damaged = set(_damaged(spark, files))
    whole = [f for f in files if f not in damaged]
    headers = {_plain(f): h for f, h in (_headers(spark, whole) if whole else {}).items()}
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in whole:
        line = headers.get(f) or ""
        names = tuple(next(csv.reader([line], delimiter=options.get("sep", ",")), []))
        if any(k.name in names for k in kinds.fields):
            groups.setdefault(names, []).append(f)
    parts = []
    for names, own in groups.items():
        # The reader binds by position, so it gets a schema in the order of this header.
        known = {k.name: k.dataType for k in kinds.fields}
        fields = [
            T.StructField(n if n in known and n not in names[:i] else f"__extra_{i}", known[n] if n in known and n not in names[:i] else T.StringType())
            for i, n in enumerate(names)
        ]
        raw = spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])).options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options
        ).csv(own)
        given = [F.col(f"`{k.name}`") if k.name in names else F.lit(None).cast(k.dataType).alias(k.name) for k in kinds.fields]
        parts.append(raw.select(*given, CORRUPT, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")))
    listed = spark.createDataFrame([(f,) for f in files], "file_path string")
    if not parts:
        nothing = T.StructType([*kinds.fields, T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType())])
        zero = F.lit(0).cast("bigint")
        return spark.createDataFrame([], nothing), listed.select("file_path", zero.alias("rows"), zero.alias("bad_rows"), zero.alias("known_cells"))
    every = functools.reduce(DataFrame.unionByName, parts)
    every = every.withColumn("file_path", F.regexp_replace(F.url_decode("file_path"), "^file:/+", "file:/"))
    # Every column is looked at, or the reader would skip the cells that do not fit.
    cells = sum((F.col(f"`{f.name}`").isNotNull().cast("bigint") for f in kinds.fields), F.lit(0).cast("bigint"))
    seen = every.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(CORRUPT).isNotNull(), 1)).alias("bad_rows"),
        F.sum(cells).alias("known_cells"),
    )
    bad = listed.join(seen, "file_path", "left").where(
        F.col("rows").isNull() | (F.col("bad_rows") > 0) | (F.col("known_cells") < 0)
    )
    good = every.join(bad.select("file_path"), "file_path", "left_anti")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "bad_rows", "known_cells")]
    return good.select(*[f"`{k.name}`" for k in kinds.fields], "file_path", "file_name"), bad.select("file_path", *counts)


def read_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by the file extension; any other extension is an error."""
    for ending, reader in ((".csv", read_csv), (".json", read_json), (".parquet", read_parquet)):
        if path.lower().endswith(ending):
            return reader(spark, path, **options)
    raise ValueError(f"unsupported file format: {path}")


def read_target(spark: SparkSession, path: str, **options) -> DataFrame:
    """Target values (value) flattened row by row, with the key (row_key, pos) that keeps their order."""
    if path.lower().endswith(".npy"):
        rows = read_npy(spark, path)
        return rows.select(F.col("row_id").alias("row_key"), F.posexplode("values").alias("pos", "value"))
    frame = read_by_extension(spark, path, **options)
    if path.lower().endswith(".parquet"):
        raise ValueError(f"unsupported target format: {path}")
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in frame.columns]))
    return frame.select(F.monotonically_increasing_id().alias("row_key"), cells.alias("pos", "value"))


def parse_records(df: DataFrame, body: str, schema: T.StructType | str, keep: list[str]) -> DataFrame:
    """JSON bodies to rows: a list of records or an object of arrays.

    Bodies that are missing, scalar, not JSON or have arrays of different length
    give one row with null fields and the reason in `_error`.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kinds.fields]
    records = T.ArrayType(kinds)
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in kinds.fields])
    text = F.trim(body)
    is_list, is_object = text.startswith("["), text.startswith("{")
    parsed = df.select(
        *keep, text.alias("__t"),
        F.when(is_list, F.from_json(text, records)).alias("__r"),
        F.when(is_object, F.from_json(text, arrays)).alias("__a"),
    )
    sizes = F.array_distinct(F.filter(F.array(*[F.size(F.col(f"__a.`{n}`")) for n in names]), lambda s: s >= 0))
    zipped = F.transform(
        F.sequence(F.lit(0), F.array_max(sizes) - 1),
        lambda i: F.struct(*[F.get(F.col(f"__a.`{n}`"), i).alias(n) for n in names]),
    )
    zipped = F.when(F.array_max(sizes) > 0, zipped).otherwise(F.array().cast(records))
    error = (
        F.when(F.col("__t").isNull() | (F.col("__t") == "null"), "the body is empty")
        .when(~F.col("__t").startswith("[") & ~F.col("__t").startswith("{"), "the body is neither a list nor an object")
        .when(F.col("__r").isNull() & F.col("__a").isNull(), "body is not valid JSON")
        .when(F.col("__a").isNotNull() & (F.size(sizes) == 0), "no known column")
        .when(F.col("__a").isNotNull() & (F.size(sizes) > 1), "arrays have different lengths")
    )
    rows = F.when(error.isNull(), F.coalesce("__r", zipped))
    flat = parsed.select(*keep, error.alias("_error"), rows.alias("__rows"))
    opened = flat.select(*keep, "_error", F.explode_outer("__rows").alias("__row")).where(
        F.col("_error").isNotNull() | F.col("__row").isNotNull()
    )
    return opened.select(*keep, *[F.col(f"__row.`{n}`").alias(n) for n in names], "_error")
