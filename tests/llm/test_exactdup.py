"""Exact dedup by block naming against plain grouping, with small blocks so that rounds matter."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import exactdup
from test_documents import ODD, invented

DDL = "doc_id bigint, text string"


def brute(docs):
    groups = collections.defaultdict(list)
    for n, (i, t) in enumerate(docs):
        groups[t or ""].append((i is not None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(docs):
        same = groups[t or ""]
        top = max(same)
        out.append((i, top[1] if top[0] else None, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=repr)


def family():
    draw = random.Random(5)
    texts = invented(41, 25, 30) + ["a" * k for k in range(12)] + ["abcd" * k for k in range(1, 6)] + [f"{'abcd' * 5}{c}" for c in "xyz"]
    return [(i, draw.choice(texts)) for i in range(200)]


@pytest.mark.parametrize("size", [5, exactdup.BLOCK_BYTES])
def test_equals_grouping(spark, size):
    docs = family()
    got = exactdup.exact_copies(spark.createDataFrame(docs, DDL).repartition(5), size=size)
    assert result(got) == brute(docs)
    assert got.where("kept").count() == len({t for _, t in docs})
    assert got.where("kept != (doc_id = keep_id)").count() == 0


def test_edges(spark):
    docs = [(i, t) for i, t in enumerate([*ODD, *ODD])] + [(3, None), (3, ""), (None, "x"), (None, "only without an id"), (None, "only without an id"), (9, "twin"), (9, "twin")]
    got = exactdup.exact_copies(spark.createDataFrame(docs, DDL).repartition(3), size=4096)
    assert result(got) == brute(docs)
    # Exactly one row of every group stays, also where the largest id is repeated or missing.
    kept = got.where("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len({t or "" for _, t in docs}) and {r["count"] for r in kept} == {1}
    empty = exactdup.exact_copies(spark.createDataFrame([], DDL))
    assert empty.count() == 0 and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_clashing_addresses_are_drawn_anew(spark):
    """Blocks that share an address in the first draws still get names of their own."""
    drawn = []

    def poor(block, draw):
        drawn.append(draw)
        return F.substring(block, 1, 1) if draw == 0 else F.substring(exactdup.address(block, draw), 1, 1) if draw == 1 else exactdup.address(block, draw)

    docs = family()
    got = exactdup.exact_copies(spark.createDataFrame(docs, DDL), size=4, addressed=poor)
    assert result(got) == brute(docs) and max(drawn) == 2


def test_identities_differ_for_different_texts(spark):
    texts = ["", "ab", "abab", "ababab", "abababab", "ab" * 5, "ba", "abba", "a"]
    rows, names = exactdup.identities(spark.createDataFrame(list(enumerate(texts)), DDL), size=2)
    assert names.select("level", "name").distinct().count() == len(texts) == names.select("row").distinct().count() == rows.count()


def test_drop_keeps_all_columns(spark):
    ddl = "doc_id bigint, text string, row string, at string, name int, kept string, `a.b` int, KEEP_ID string, carried int"
    data = [(1, "same", "r", "a", 1, "k", 5, "x", 0), (2, "same", "s", "b", 2, "l", None, "y", 1), (3, "other", None, "c", None, None, 7, None, 2)]
    df = spark.createDataFrame(data, ddl)
    got = exactdup.drop_copies(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == data[1:]


def test_texts_are_shuffled_only_as_distinct_blocks(spark):
    """No exchange carries the text column; blocks go through one, after a partial aggregate."""
    docs = spark.createDataFrame(family(), DDL)
    plan = docs.select(F.explode(exactdup.blocks(F.col("text"), 16)).alias("block")).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
