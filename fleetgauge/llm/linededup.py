"""Lines that occur in several documents: built-in functions only.

Lines are exploded and hashed by their normalised form; a hash that enough documents
hold is dropped everywhere but in the document with the smallest id. The positions to
drop go back to the documents, whose lines are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import BLANKS, apart, ascii_lower, let, named, others, packed, unpacked

#: Normalised lines with fewer code points are never dropped.
MIN_CHARS = 10
#: Documents that must hold a line for it to be dropped.
MIN_DOCS = 2


def split_lines(text: Column) -> Column:
    """Lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough: document, digest of its text, position, and 128 bits of its key."""
    exploded = docs.where(named(key).isNotNull()).select(
        named(key).alias("__id"), F.xxhash64(named(text)).alias("__of"), F.posexplode(split_lines(named(text))).alias("__pos", "__line")
    )
    keyed = exploded.select("__id", "__of", "__pos", line_key(F.col("__line")).alias("__key"))
    return keyed.where(F.char_length("__key") >= min_chars).select(
        "__id", "__of", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("second"), "__key").alias("__h2")
    )


def _without(lines: Column, drop: Column) -> Column:
    """`lines` without the positions in the sorted array `drop`: the runs between them, one slice each."""
    ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return let(ends, lambda at: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(at) - 1),
        lambda i: F.slice(lines, F.get(at, i - 1) + 2, F.get(at, i) - F.get(at, i - 1) - 1),
    )))


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of `docs` and n_lines, n_dropped, kept_text.

    A line's key is the line with blanks (space, \\x09 to \\x0D) stripped at both ends and A-Z
    lower-cased. Keys of at least `min_chars` code points that at least `min_docs` documents hold
    lose all their lines except those of the smallest id; the other lines stay as they are, joined
    by newlines, so a document may end up empty.

    Null or empty text is one empty line. Rows without an id neither lose lines nor count as
    documents. Rows that repeat an id are one document for the counts and keep their own texts.
    Columns of `docs` named like the results are replaced.

    Keys are compared by 128 bits of hash. The lines are shuffled as hashes, counted with partial
    sums before the shuffle, and the texts are shuffled once, by id. A line that a third of all
    documents hold is a skewed join key, which adaptive execution splits.
    """
    lines = _lines(docs, text, key, min_chars)
    # For two documents the extremes of the ids tell; more need the ids of a key counted distinctly.
    enough = F.min("__id") < F.max("__id") if min_docs == 2 else F.count_distinct("__id") >= min_docs
    shared = lines.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), enough.alias("__shared")).where("__shared").drop("__shared")
    drops = (
        lines.join(apart(shared, "__h1"), ["__h1", "__h2"]).where(F.col("__id") != F.col("__first"))
        .groupBy("__id", "__of").agg(F.sort_array(F.collect_set("__pos")).alias("__drop"))
    )
    plain = others(docs.columns, ("n_lines", "n_dropped", "kept_text"))
    # The text is carried once, beside the other columns.
    rest = [c for c in plain if c != text]
    rows = docs.select(packed(rest).alias("row"), named(key).alias("id"), F.xxhash64(named(text)).alias("of"), named(text).alias("text"))
    joined = rows.join(drops, (F.col("id") == F.col("__id")) & (F.col("of") == F.col("__of")), "left")
    cut = joined.select("row", "text", "__drop", split_lines(F.col("text")).alias("lines"))
    made = cut.select(
        "row", "text", F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("bigint").alias("n_dropped"),
        F.when(F.col("__drop").isNull(), F.coalesce(F.col("text"), F.lit("")))
        .otherwise(F.array_join(_without(F.col("lines"), F.col("__drop")), "\n")).alias("kept_text"),
    )
    back = dict(zip(rest, unpacked("row", rest), strict=True)) | {text: F.col("text").alias(text)}
    return made.select(*[back[c] for c in plain], "n_lines", "n_dropped", "kept_text")
