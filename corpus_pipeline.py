"""Corpus pipeline: five stages from raw documents to token ids.

Each stage reads what the one before it wrote. All but the last return the columns
of `documents`; the last returns one row per document that stays, with its ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontam, langid, linededup, neardup, pieces
from fleetgauge.llm.common import crc_mod, named, others, packed, ready, stored, table, unpacked

#: Near copies share this percentage of their shingles; op3's own limit is another.
PERCENT = 80


class Kept:
    """A stage's documents with the columns it works on by name and all others in one, so that no name meets a result's."""

    def __init__(self, docs: DataFrame, used: list[str]):
        self.columns, self.used = docs.columns, used
        self.rest = others(docs.columns, used)
        self.docs = docs.select(*[named(c) for c in used], packed(self.rest).alias("rest"))

    def back(self, df: DataFrame) -> DataFrame:
        """`df` with the columns of the stage's documents."""
        order = {c.lower(): i for i, c in enumerate(self.columns)}
        found = [named(c) for c in self.used] + unpacked("rest", self.rest)
        at = [order[c.lower()] for c in (*self.used, *self.rest)]
        return df.select(*[found[at.index(i)] for i in range(len(self.columns))])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, letterless and undecided texts go."""
    ready(spark)
    own = Kept(docs, ["doc_id", "text", "lang"])
    model = langid.fit(own.docs, crc_mod(F.col("doc_id"), 4) != 2)
    return own.back(langid.identify(own.docs, model).where(~F.col("rejected")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has; n_chars follows the text."""
    ready(spark)
    own = Kept(docs, ["doc_id", "text", "n_chars"])
    found = linededup.drop_repeated_lines(own.docs).withColumn("text", F.col("kept_text"))
    return own.back(found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (PERCENT): the one with the smallest id."""
    ready(spark)
    return neardup.drop_near_copies(docs, percent=PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    own = Kept(docs, ["doc_id", "text"])
    return own.back(decontam.contamination(own.docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    ready(spark)
    found = pieces.encode(docs, pieces.model_path(), keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark),
    ("sentencepiece", token_ids),
]

#: Language by compressed size and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
