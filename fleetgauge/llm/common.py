"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import ship

#: Bytes of text that a task holds in numpy arrays at a time.
SLICE_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that the contracts take as white space: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes of a batch that Spark hands to a Python worker; its own default, 64 MB, is held several times over per core.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Hand the package to the Python workers of the session and bound their batches.

    The registered queries and the pipeline's stages call it; users of the operators may.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table of a session made ready."""
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    Only a local session that names none gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet and read it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are.

    The built-in lower() does just that for text without other characters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{column}`")


def others(columns: list[str], results: Iterable[str]) -> list[str]:
    """Columns that aren't named like the results, in any case of letters: Spark takes those for the same name."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def packed(columns: list[str]) -> Column:
    """The columns as one, so that their names meet no others on the way; `unpacked` has them back."""
    return F.struct(*[named(c) for c in columns]) if columns else F.lit(0)


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(df: DataFrame, number: str) -> DataFrame:
    """`df` with the integer column computed anew.

    An aggregate that is joined back on its own keys would bring its partitions into the join, and
    adaptive execution splits a hot key only where the join shuffles both sides. Of a key that
    is computed anew Spark doesn't know the partitions, so it does.
    """
    return df.withColumn(number, F.col(f"`{number}`").bitwiseXOR(F.lit(0)))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sha_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts have about `limit` bytes together; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_map(
    df: DataFrame, text: str, keep: list[str], fields: str, function: Callable[[pa.Array], list[pa.Array]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`keep` columns of `df` and what `function` makes of the texts, slice by slice in Arrow batches.

    `function` gets a string array and returns one array per field of the DDL text `fields`.
    Null texts arrive as null.
    """
    from pyspark.sql.types import StringType, StructType

    source = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text) if text in keep and source.schema[text].dataType == StringType() else len(keep)
    added = StructType.fromDDL(fields)
    schema = StructType(source.schema.fields + added.fields)
    names = schema.names
    if at == len(keep):
        source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string"))
    source = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # the columns' own names may be any

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts, limit):
                part = batch.slice(a, b - a)
                made = function(part.column(at))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=names)
        # Workers are used again by later tasks: they shouldn't keep what this one held at its peak.
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
