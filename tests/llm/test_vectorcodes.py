"""Vector codes against a plain scan of all entries, and the search's own promises."""

import math

import numpy as np
import pytest

from fleetgauge.llm import vectorcodes
from fleetgauge.llm.common import stored

DDL = "vec_id bigint, embedding array<float>, label int"


def usual(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and entries by scanning every entry with Python's integers."""
    kept = [(i, [math.floor(float(np.float32(x)) * 256) for x in v], lab) for i, v, lab in rows if usual(v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), lab) for i, v, lab in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in start] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda v, p: min((dist(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(best(v, p)[1], []).append(cut(v, p))
            fresh.append([[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = fresh
    out = []
    for i, v, lab in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    return out, books


@pytest.mark.parametrize("spread", [3, 400])
def test_search_finds_the_nearest_with_ties(spread):
    """Coarse grids make equal distances and repeated entries; the lower index must win."""
    draw = np.random.default_rng(spread)
    entries = draw.integers(-spread, spread, (64, 4))
    queries = draw.integers(-spread, spread, (3000, 4))
    index, far, measured = vectorcodes.nearest(queries, entries, vectorcodes.neighbour_lists(entries))
    every = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert measured < every.size  # lists are left before their ends


def test_search_measures_few_entries_of_a_clustered_codebook():
    draw = np.random.default_rng(1)
    centres = draw.integers(-10_000, 10_000, (256, 4))
    queries = centres[draw.integers(0, 256, 2000)] + draw.integers(-20, 20, (2000, 4))
    index, _, measured = vectorcodes.nearest(queries, centres, vectorcodes.neighbour_lists(centres))
    assert (index == ((queries[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert measured < 0.5 * 2000 * 256


def vectors(n, size, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (12, size))
    rows = [(int(i), [float(x) for x in np.float32(centres[draw.integers(12)] + draw.normal(0, 0.05, size))], int(draw.integers(4))) for i in draw.permutation(n)]
    return [(i, v, None if lab == 3 else lab) for i, v, lab in rows]


def coded(spark, rows, **how):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    books = vectorcodes.fit(df, **how)
    found = vectorcodes.with_group_error(stored(vectorcodes.encode(df, books), "codes"))
    return books, found


def check(spark, rows, **how):
    books, found = coded(spark, rows, **how)
    want, entries = brute(rows, **how)
    assert [b.tolist() for b in books.entries] == entries
    sums = {}
    for _, _, e, lab in want:
        sums[lab] = sums.get(lab, 0) + e
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label"], r["label_error"]) for r in found.collect()), key=repr)
    assert got == sorted(((*w, sums[w[3]]) for w in want), key=repr)


def test_equals_a_plain_scan(spark):
    check(spark, vectors(300, 64))


def test_other_shapes(spark):
    check(spark, vectors(90, 10), parts=4, entries=8, rounds=3)


def test_edges(spark):
    """Nulls, non-finite components, few rows, repeated ids and rows, equal vectors, uneven lengths, rows without an id."""
    inf, nan = float("inf"), float("nan")
    rows = vectors(20, 16) + [
        (3, None, 1), (4, [1.0] * 15 + [nan], 1), (5, [inf] * 16, 2), (6, [None] * 16, 2), (1, [0.5] * 16, 1), (1, [0.5] * 16, 1),
        (2, [0.25] * 16, None), (None, [-0.5] * 16, 0), (None, [0.5] * 16, 0), (30, [], 0), (31, [1.0, 2.0, 3.0], 0),
    ]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [(1, [-0.001] * 32, None)])  # floors go down: -1


def test_nothing_to_code(spark):
    empty = spark.createDataFrame([(1, None, 2)], DDL)
    assert vectorcodes.fit(empty) is None and vectorcodes.fit(empty.limit(0)) is None


def test_clashing_names(spark):
    ddl = "vec_id bigint, embedding array<float>, label int, code string, error string, v int, id int, `a.b` int, __v int"
    df = spark.createDataFrame([(i, [float(i)] * 16, i % 2, "x", "y", 1, 2, i, 7) for i in range(5)], ddl)
    books = vectorcodes.fit(df)
    got = vectorcodes.with_group_error(stored(vectorcodes.encode(df, books), "codes"))
    assert got.columns == ["vec_id", "label", "v", "id", "a.b", "__v", "code", "error", "label_error"]
    assert {(r["a.b"], r["__v"]) for r in got.collect()} == {(i, 7) for i in range(5)}


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="exact distances"):
        vectorcodes.fit(spark.createDataFrame([(1, [3e6] * 16, 0)], DDL))
