"""Collocations against plain counting, and the guarantee of the summaries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import collocations
from test_documents import ODD, lower

DDL = "doc_id bigint, text string, lang string"


def brute(docs, least=10, longest=3, top=2000, inside=50):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    often = {g: a for g, a in count.items() if a >= least and len(g[1]) > 1}
    gone = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= inside * count[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = []
    for lang in {lang for lang, _ in often}:
        rows = []
        for (own, w), a in often.items():
            if own == lang and (lang, w) not in gone:
                cuts = [(10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(w).encode(), " ".join(w), left, right))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, total[lang], -score))
    return sorted(out)


def invented(n=150, seed=2):
    draw = random.Random(seed)
    words = ["on", "THE", "of", "été", "x-ray", "日本", "new", "York", "a", "b"]
    docs = []
    for i in range(n):
        text = "".join(draw.choices(words, weights=[9, 9, 9, 3, 3, 3, 4, 4, 2, 2])[0] + draw.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "; "]) for _ in range(draw.randint(0, 60)))
        docs.append((i, text + draw.choice(["", "new york city", "new york city hall"]), draw.choice(["en", "en", "fr", None])))
    return docs


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("how", [
    {}, {"least": 3, "longest": 4, "top": 7}, {"least": 2, "longest": 2, "inside_percent": 100, "top": None}, {"mass": 500, "filter_bits": 256}, {"mass": 2000},
])
def test_equals_counting(spark, monkeypatch, how):
    """Small blocks, many hash partitions and a filter that is nearly full change nothing."""
    monkeypatch.setattr(collocations, "BLOCK", 37)
    docs = invented()
    own = {k: v for k, v in how.items() if k in ("least", "longest", "top")} | ({"inside": how["inside_percent"]} if "inside_percent" in how else {})
    own = own | {"top": 10**9} if own.get("top", 0) is None else own
    want = brute(docs, **own)
    assert result(collocations.collocations(spark.createDataFrame(docs, DDL).repartition(4), **how)) == want and len(want) > 10


def test_edges(spark):
    """Nulls, blank and long texts, repeated rows, ties, words of odd characters, columns of any name; nothing at all."""
    docs = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)] + [(7, "same thing here", "xx")] * 12 + [(None, "ba da! ab ad", "tie")] * 10 + [(8, "\x1c z\xa0z\x1c z", "")] * 10
    df = spark.createDataFrame(docs, DDL).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("__text", F.lit(0))
    got = collocations.collocations(df)
    assert result(got) == brute(docs)
    assert [r[2] for r in result(got) if r[0] == "tie"] == ["ab ad", "ba da"]
    for few in (docs[:0], [(1, None, None)], [(1, "one two", "en")]):
        assert result(collocations.collocations(spark.createDataFrame(few, DDL))) == []


def test_long_numbers_are_exact(spark):
    """Scores whose products pass 64 bits: checked on counts, without as many texts."""
    rows = [("en", 0, "", 10**13), ("en", 1, "x", 4 * 10**12 + 1), ("en", 1, "y", 3 * 10**12 + 7), ("en", 2, "x y", 2 * 10**12 + 3)]
    counted = spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")
    old = collocations.frequent_phrases
    try:
        collocations.frequent_phrases = lambda *a: counted
        got = collocations.collocations(counted).collect()
    finally:
        collocations.frequent_phrases = old
    a, left, right = 2 * 10**12 + 3, 4 * 10**12 + 1, 3 * 10**12 + 7
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, 10**13, 10**6 * a * a // (left * right))]


@pytest.mark.parametrize("seed", range(6))
def test_merged_summaries_keep_every_frequent_key(seed):
    draw = np.random.default_rng(seed)
    least = 10
    stream = np.minimum(draw.zipf(1.3, 20_000), 60_000).astype(np.uint32)
    parts = []
    for piece in np.array_split(stream, 7):
        key, count = np.unique(piece, return_counts=True)
        parts.append((key, count.astype(np.int64)))
    capacity = len(stream) // least
    key, count, taken = collocations.merge_summaries(parts, capacity)
    true = dict(zip(*np.unique(stream, return_counts=True), strict=True))
    held = dict(zip(key.tolist(), count.tolist(), strict=True))
    assert len(key) <= capacity and taken * (capacity + 1) <= len(stream) and taken < least
    assert all(k in held for k, n in true.items() if n >= least)
    assert all(n <= true[k] <= n + taken for k, n in held.items())


def test_a_tight_summary_takes_away():
    """Distinct keys beyond the capacity: all are lowered, and the frequent one is left with its bound."""
    parts = [(np.arange(1, 101, dtype=np.uint32), np.ones(100, np.int64)), (np.array([7], np.uint32), np.array([30], np.int64))]
    key, count, taken = collocations.merge_summaries(parts, 13)
    assert key.tolist() == [7] and taken == 1 and count.tolist() == [30]


def test_phrases_of_a_slice_are_numbered_exactly():
    texts = pa.array(["A a b. a b", "b", "", None, "a  b\tc"])
    found = collocations.tokens(texts, np.array([0, 0, 0, 0, 1]))
    words = [found.words[int(k)].as_py() for k in found.number]
    assert words == ["a", "a", "b", "a", "b", "b", "a", "b", "c"]
    assert found.joined.tolist() == [True, True, False, True, False, False, True, True, False]
    hashes = np.array([1, 2], np.uint64)
    two = [g for g in collocations.grams(found, hashes, 3) if g.words.shape[1] == 2]
    pairs = {(int(lang), *[found.words[int(k)].as_py() for k in w]): int(n) for g in two for lang, w, n in zip(g.lang, g.words, g.count, strict=True)}
    assert pairs == {(0, "a", "a"): 1, (0, "a", "b"): 2, (1, "a", "b"): 1, (1, "b", "c"): 1}
