"""Near copies by MinHash: bands of minima, verified links, connected components.

1. Each text becomes its set of word shingles, with the minima of many universal hashes
   over it. Texts with equal sets form one class; only its smallest id goes on.
2. Bands of minima give buckets. In a bucket nothing but links to one pivot is made, so a
   bucket of any size gives as many candidates as it has members. Signatures discard
   most candidates, and the full sets decide on the rest.
3. Alternating large-star and small-star steps turn links into components.
4. Members of a bucket that are linked in the end, but not through its pivot, are found by a
   second family of many narrow bands over the documents whose buckets are still divided.
5. What lies in buckets that are divided even then is compared by an exact join on prefixes of
   the shingle sets, between components only; bounds that no linked pair breaks thin the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm import bytescan
from fleetgauge.llm.common import apart, slices, stored, text_map

WORDS = 5
#: Two documents are linked if they share this percentage of the union of their shingles.
PERCENT = 85
HASHES = 192
#: Bands and minima in each, for PERCENT. A pair at 0.85 shares none of the first with a chance of 5e-6.
FIRST = (32, 7)
SECOND = (240, 16)
#: What a pair's sizes and signatures are compared by.
SKETCH = ["n", "s1", "s2", "s3"]
#: 64-bit words of the bitmap by which the exact join bounds how much two sets differ.
BITMAP = 8
#: Ids up to this number select texts by a broadcast (some 300 bytes each at its peak), without a shuffle of the others.
BROADCAST_IDS = 200_000
#: Bytes of text hashed at a time, so that the arrays stay in the processor's cache.
SLICE = 1 << 20

_A = bytescan.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = bytescan.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted in each, and where each text's begin (one more at the end).

    A text with fewer than `width` words has its whole sequence as the only shingle; one without words has none.
    """
    found = bytescan.words(texts, bytescan.blank_separated())
    count = np.diff(found.first)
    h, whole = bytescan.shingles(found, width)
    values, owners = [h[whole]], [found.owner()[whole]]
    for w in range(1, width):
        own = np.flatnonzero(count == w)
        if len(own):
            short, _ = bytescan.shingles(found, w)
            values.append(bytescan.mix(short[found.first[own]] + np.uint64(w)))
            owners.append(own)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def _signatures(texts: pa.Array, width: int) -> list[pa.Array]:
    value, first = shingle_sets(texts, width)
    n = np.diff(first)
    full = np.flatnonzero(n)
    begin = first[:-1][full]
    d1, d2, s = (np.zeros((len(n), k), np.int64) for k in (1, 1, 3))
    minima = np.zeros((len(full), HASHES), np.uint32)
    if len(full):
        d1[full, 0] = np.add.reduceat(bytescan.mix(value), begin).view(np.int64)
        d2[full, 0] = np.add.reduceat(bytescan.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin).view(np.int64)
        for k in range(HASHES):
            low = np.minimum.reduceat(value * _A[k] + _B[k], begin)
            minima[:, k] = bytescan.mix(low) >> np.uint64(32)
        s[full] = np.packbits((minima & 1).astype(bool), axis=1).view(np.int64).reshape(len(full), 3)
    raw: list[bytes | None] = [None] * len(n)
    for i, row in zip(full.tolist(), minima, strict=True):
        raw[i] = row.tobytes()
    return [
        pa.array(n, pa.int64()), pa.array(d1[:, 0], pa.int64()), pa.array(d2[:, 0], pa.int64()),
        *[pa.array(s[:, k], pa.int64()) for k in range(3)], pa.array(raw, pa.binary()),
    ]


def _bands(count: int, rows: int, seed: int) -> np.ndarray:
    """The minima of each band: drawn so that all minima are used equally often."""
    draw = np.random.default_rng(seed)
    need = -(-count * rows // HASHES)
    many = np.concatenate([draw.permutation(HASHES) for _ in range(need)])
    return many[: count * rows].reshape(count, rows)


def _shape(shape: tuple[int, int], percent: int) -> tuple[int, int]:
    """Bands with as many minima as give a pair at `percent` the chance that one at PERCENT has with `shape`."""
    bands, rows = shape
    if percent >= 100:
        return bands, max(rows, HASHES // bands)
    return bands, max(1, math.floor(rows * math.log(PERCENT / 100) / math.log(percent / 100)))


def _buckets(signatures: DataFrame, shape: tuple[int, int], seed: int, carry: list[str] | None = None) -> DataFrame:
    """(key, id) and the integers to `carry`: the bucket of each document in each band."""
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(*shape, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                minima = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
                keys = np.empty((len(minima), len(bands)), np.uint64)
                for b, at in enumerate(bands):
                    acc = np.full(len(minima), seed * 1000 + b, np.uint64)
                    for k in at:
                        acc = bytescan.mix(acc * np.uint64(0x9E3779B97F4A7C15) + minima[:, k])
                    keys[:, b] = acc
                own = [np.repeat(part.column(i).to_numpy(), len(bands)) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *map(pa.array, own)], names=["key", "id", *carry])

    return signatures.select("sig", "id", *carry).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["key", "id", *carry]))


def _pivots(buckets: DataFrame) -> DataFrame:
    """(key, id, members, low): buckets of two or more, with one of their members as pivot.

    The pivot of a bucket is the least id under an order of its own, id XOR key, so that a
    document meets other pivots in other bands; a plain minimum of numbers, it is found
    with partial aggregation.
    """
    mixed = F.col("id").bitwiseXOR(F.col("key"))
    found = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min(mixed).alias("a")).where("members > 1")
    return buckets.join(apart(found, "key"), "key").select("key", "id", "members", F.col("a").bitwiseXOR(F.col("key")).alias("low"))


def _between(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket and its two pivots that have different roots and may be linked.

    `buckets` carry sizes, signatures and roots, so that what can't be linked, or already is, is
    left out where member and pivot meet. Buckets of one root give nothing.
    """
    own = F.struct(F.col("id").bitwiseXOR(F.col("key")).alias("at"), "id", *SKETCH, "root")
    ends = buckets.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min("root").alias("r"), F.max("root").alias("s"))
    ends = ends.where("r < s").select("key", F.explode(F.array("low", "high")).alias("y"))
    met = buckets.join(apart(ends, "key"), "key").where(
        (F.col("root") != F.col("y.root")) & _may_link(lambda c: F.col(c), lambda c: F.col("y")[c], percent)
    )
    return met.select(*_pairs("id", "y.id")).distinct()


def _pairs(left: Column | str, right: Column | str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _may_link(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether two sets may be linked: by their sizes, and by signatures that agree as much as those of linked sets do, up to four deviations.

    One bit of each minimum is compared: it agrees with a chance of (1 + similarity) / 2.
    """
    q = (1 + percent / 100) / 2
    least = math.floor(HASHES * q - 4 * math.sqrt(HASHES * q * (1 - q)))
    differ = sum((F.bit_count(x(f"s{k}").bitwiseXOR(y(f"s{k}"))) for k in (1, 2, 3)), F.lit(0))
    return (F.lit(100) * F.least(x("n"), y("n")) >= F.lit(percent) * F.greatest(x("n"), y("n"))) & (differ <= HASHES - least)


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be linked by what `sketches` (id and SKETCH) say."""
    side = lambda s: sketches.select(F.col("id").alias(s), F.struct(*SKETCH).alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_may_link(lambda c: F.col("s_a")[c], lambda c: F.col("s_b")[c], percent)).select("a", "b").distinct()


def with_ids(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows of `df` whose key is (left_semi) or isn't (left_anti) among the distinct ids.

    The ids are counted first: up to BROADCAST_IDS go to the tasks, more are joined by a shuffle.
    """
    free = "__id"
    while free.lower() in map(str.lower, df.columns):
        free += "_"
    own = ids.toDF(free)
    few = own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(own) if few else own, F.col(f"`{key}`") == F.col(free), how)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have the similarity. `pairs` must be stored; `docs`: id, text."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")  # counted and joined
    texts = with_ids(docs, "id", ids, "left_semi")
    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                sets = [shingle_sets(part.column(k), width) for k in (2, 3)]
                linked = []
                for r in range(part.num_rows):
                    x, y = (v[f[r] : f[r + 1]] for v, f in sets)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * same >= percent * (len(x) + len(y) - same))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have links (a, b), but for the roots: the smallest node of each component.

    Large-star and small-star steps alternate until the links don't change; both join the links
    with one minimum per node, and no step gathers a component. Links are cut from their
    lineage in the shared folder after each round; rounds follow the logarithm of the longest path.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low, "u"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, "u"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _divided(bucket: DataFrame, label: DataFrame) -> DataFrame:
    """(id, root): members of the buckets of three or more that hold several components."""
    wide = bucket.where("members > 2").select("key", "id").join(label, F.col("id") == F.col("node"), "left")
    wide = wide.select("key", "id", F.coalesce("root", "id").alias("root"))
    divided = wide.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return stored(wide.join(apart(divided, "key"), "key", "left_semi").select("id", "root").distinct(), "open")


def _bitmaps(texts: pa.Array, width: int) -> list[pa.Array]:
    """The shingle hashes, a digest of them, and bits of a bitmap in which each shingle flips one."""
    value, first = shingle_sets(texts, width)
    n = np.diff(first)
    bits = np.zeros((len(n), 64 * BITMAP), np.uint8)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(n)), n), (bytescan.mix(value) % np.uint64(64 * BITMAP)).astype(np.int64)), 1)
    words = np.packbits(bits, axis=1).view(np.int64)
    digest = np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        digest[full] = np.add.reduceat(bytescan.mix(value), first[:-1][full]).view(np.int64)
    hashes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))
    return [hashes, pa.array(digest), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP)]]


def _across(texts: DataFrame, still: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids in `still` (id, root) with different roots: all that may be linked, and few others.

    Linked sets share a shingle among the first of each, under any order common to all, and what
    follows it must suffice for the overlap. The order begins with shingles that only one
    component has, as they can't be shared here, and goes on with the rarest. Of the components that share a
    shingle the largest isn't joined with itself, so rows follow the pairs between components. A pair
    whose bitmaps differ in more bits than linked sets may differ in shingles isn't a link.
    """
    words = [f"w{k}" for k in range(BITMAP)]
    fields = ", ".join(["hashes array<bigint>", "digest bigint", *[f"{w} bigint" for w in words]])
    sets = text_map(texts.join(still, "id"), "text", ["id", "root"], fields, lambda t: _bitmaps(t, width), SLICE)
    sets = stored(sets.withColumn("n", F.size("hashes").cast("bigint")), "sets")
    # An id that is repeated with another text is another row: its set has another digest.
    row = ["id", "digest"]
    held = sets.select(*row, "root", F.explode("hashes").alias("h"))
    common = held.groupBy("h").agg(F.count("*").alias("docs"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h", "docs")
    ordered = (
        held.select(*row, "h").distinct().join(apart(common, "h"), "h")
        .groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("docs", "h"))).alias("shared"))
    )
    # Of n shingles the first n - least + 1 make the prefix; those of one component come before the shared ones.
    least = F.ceil(F.col("n") * percent / 100)
    own = F.col("n") - F.size("shared")
    length = (F.col("n") - least + 1 - own).cast("int")
    prefix = (
        sets.select(*row, "root", "n", *words).dropDuplicates(row).join(ordered, row).where(length > 0)
        .select("id", "root", "n", *words, own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "s"))
        .select(F.col("s.h").alias("h"), "id", "root", "n", (F.col("own") + F.col("at")).alias("at"), *words)
    )
    prefix = stored(prefix, "prefixes")
    counts = prefix.groupBy("h", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    # Both sides of the next join are tables of their own: a shingle that many have is split over tasks.
    left = stored(prefix.join(apart(largest.select("h", "main"), "h"), "h").where("root != main").drop("main"), "prefixes")
    x, y = left.alias("x"), prefix.alias("y")
    total = F.col("x.n") + F.col("y.n")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    pairs = x.join(
        y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & (rest * (100 + percent) >= percent * total)
        & (differ * (100 + percent) <= (100 - percent) * total),
    )
    return pairs.select(*_pairs("x.id", "y.id")).distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id (the name of `key`), n_shingles, component_id and kept of every row of `docs`.

    Words are runs of characters other than space and \\x09 to \\x0D, A-Z lower-cased. Rows whose
    sets of distinct `width`-word shingles have 100 * intersection >= percent * union are linked;
    with fewer words the whole sequence is the only shingle. component_id is the smallest id
    reachable over links, kept says that it is the row's own. The key must be an integer.

    Null or empty texts and texts without words have no shingles and no links: component_id is their own
    id. Rows without an id get a null component and stay (kept). Equal rows are linked like any
    copies; rows that repeat an id are judged by their own texts. An empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = "n_shingles bigint, d1 bigint, d2 bigint, s1 bigint, s2 bigint, s3 bigint, sig binary"
    every = stored(text_map(rows, "text", ["id"], fields, lambda t: _signatures(t, width), SLICE), "signatures")
    a_set = ["n_shingles", "d1", "d2"]
    classes = every.where("n_shingles > 0 and id is not null").groupBy(*a_set).agg(F.min("id").alias("rep"))
    member = every.select("id", *a_set).join(apart(classes, "n_shingles"), a_set, "left").select("id", "n_shingles", "rep")
    member = stored(member, "classes")
    copies = member.where("rep != id").select("id").distinct()
    # One document of each class of equal sets.
    one = with_ids(every.where("n_shingles > 0 and id is not null").withColumnRenamed("n_shingles", "n"), "id", copies, "left_anti")
    if not every.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        # Rows that repeat an id take part once for each text; joins by id would multiply them.
        rows, one = rows.dropDuplicates(["id", "text"]), one.dropDuplicates(["id", "d1", "d2"])

    bucket = stored(_pivots(_buckets(one, _shape(FIRST, percent), 1)), "buckets")
    first = stored(_alike(bucket.where("id != low").select(*_pairs("id", "low")).distinct(), one.select("id", *SKETCH), percent), "pairs")
    links = stored(_verified(first, rows, width, percent), "links")
    label = components(links)

    # Buckets that hold several components: pairs other than with the pivot are open.
    still = _divided(bucket, label)
    open_ones = with_ids(one, "id", still.select("id").distinct(), "left_semi").join(still, "id")
    again = _buckets(open_ones, _shape(SECOND, percent), 2, [*SKETCH, "root"])
    second = stored(_between(again, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    more = _verified(second, rows, width, percent)
    known = lambda found: label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found)
    label = components(known(more))

    still = _divided(bucket, label)
    texts = with_ids(rows, "id", still.select("id"), "left_semi")
    third = stored(_across(texts, still, width, percent), "pairs")
    label = components(known(_verified(third, rows, width, percent)))

    done = member.join(label, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("root", "rep", "id").alias("component_id")
    )
    return done.withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` that `near_copies` keeps: of each group of near copies the one with the smallest id.

    Rows that repeat a kept id with another text of the group go too, if the id itself isn't kept for them.
    """
    gone = near_copies(docs, text, key, width, percent).where(~F.col("kept")).select(key).distinct()
    return with_ids(docs, key, stored(gone, "copies"), "left_anti")
