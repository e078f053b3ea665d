"""Collocations: phrases whose words occur together more often than apart.

Two passes over the texts count the phrases that occur at least `least` times.

1. Occurrences are hashed, and a phrase's hash tells its hash partition. Each partition has a
   Misra-Gries summary: counters for at most `capacity` phrases. Tasks summarise what they read, summaries
   of a partition are merged, and where a merge holds too many, the count of the first beyond capacity is taken from
   all. What was taken in total stays under mass / (capacity + 1). As the capacity is at least the mass divided by
   the threshold, whole part, each phrase that reaches the threshold is still there, and
   a phrase whose count and all that was taken don't reach it is not frequent.
2. What survived sets bits in a filter of fixed size. The second pass counts the phrases
   that pass the filter, by their text, exactly.

A task numbers the words of a slice of text exactly, so phrases are rows of integers until one passes the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm import bytescan
from fleetgauge.llm.common import slices, stored

LEAST = 10
MAX_WORDS = 3
TOP = 2000
#: A phrase goes if a longer one that holds it has at least this percentage of its occurrences.
INSIDE_PERCENT = 50
#: Occurrences of a hash partition at most, by the number of bytes of the texts: what one merging task holds.
MASS = 8 << 20
#: A summary's capacity as a multiple of the mass divided by the threshold. One suffices; more leave less to be taken
#: from the counters, so that fewer phrases survive which aren't frequent.
SPARE = 4
#: Bits of the filter between the passes, whatever the size of the data: it is sent to all tasks.
FILTER_BITS = 1 << 28
#: Bits that a phrase sets: with few of them filled, three let next to nothing else through.
PROBES = 3
#: Bytes of text read at a time, words whose phrases are counted at a time, and phrases that a task gathers before it sends them.
SLICE = 1 << 20
BLOCK = 1 << 18
GATHER = 1 << 21

_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(_BLANKS)] = 1
    kind[list(_BREAKS)] = 2
    return kind


@dataclass
class Tokens:
    """Words of a slice of texts: exact number of each, its language, and whether the next word is in the same piece."""

    words: pa.Array
    number: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def tokens(texts: pa.Array, langs: np.ndarray) -> Tokens:
    """A-Z lower-cased; words are runs of characters other than blanks, within pieces between `.,;:!?` and line ends."""
    data, offsets = bytescan.string_bytes(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    kind = _kinds()[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    first = np.searchsorted(starts, offsets)
    # A piece ends at a break or with its text: number the pieces by the breaks and texts before each byte.
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 2, out=before[1:])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = before[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (place[1:] == place[:-1]) & (owner[1:] == owner[:-1])
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    raw = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[kind == 0])])
    coded = raw.dictionary_encode()
    return Tokens(coded.dictionary, coded.indices.to_numpy().astype(np.int64), langs[owner], joined)


@dataclass
class Grams:
    """Distinct phrases of one length: the numbers of their words, a language each, counts and 64-bit hashes."""

    words: np.ndarray
    lang: np.ndarray
    count: np.ndarray
    hash: np.ndarray


def grams(found: Tokens, lang_hash: np.ndarray, longest: int) -> Iterator[Grams]:
    """Distinct phrases of one to `longest` words with their counts, counted from a block of starting words at a time."""
    n, vocabulary = len(found.number), len(found.words)
    if n == 0:
        return
    data, offsets = bytescan.string_bytes(found.words)
    word_hash = bytescan._hashes(data, offsets[:-1], offsets[1:])
    for a in range(0, n, BLOCK):
        at = np.arange(a, min(a + BLOCK, n))
        key = found.lang[at] * vocabulary + found.number[at]
        code, distinct = pd.factorize(key)
        lang, last = distinct // vocabulary, distinct % vocabulary
        rows, hashed = last[:, None], bytescan.mix(lang_hash[lang] + word_hash[last] * _STEP)
        yield Grams(rows, lang, np.bincount(code), hashed)
        for size in range(2, longest + 1):
            within = (at + size - 1 < n) & found.joined[np.minimum(at + size - 2, n - 1)]
            at, code = at[within], code[within]
            if not len(at):
                break
            code, distinct = pd.factorize(code * vocabulary + found.number[at + size - 1])
            head, last = distinct // vocabulary, distinct % vocabulary
            rows, lang = np.column_stack([rows[head], last]), lang[head]
            hashed = bytescan.mix(hashed[head] * _STEP + word_hash[last])
            yield Grams(rows, lang, np.bincount(code), hashed)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
    )


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Tokens, pa.Array, np.ndarray]]:
    """Tokens of slices of a batch, with its languages and their hashes."""
    coded = batch.column(1).dictionary_encode()
    data, offsets = bytescan.string_bytes(coded.dictionary)
    hashed = bytescan._hashes(data, offsets[:-1], offsets[1:])
    number = coded.indices.to_numpy().astype(np.int64)
    for a, b in slices(batch.column(0), SLICE):
        yield tokens(batch.column(0).slice(a, b - a), number[a:b]), coded.dictionary, hashed


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _pack(key: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, lowest bytes first, so that the shuffle's compression finds the zeros above."""
    return np.diff(key, prepend=key.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1), dtype=np.uint32)


# First pass: summaries ----------------------------------------------------------------------------------------


def _task_summaries(partitions: int, longest: int):
    """Rows (p, mass, once, more, counts): what a task read of partition p, as packed 32-bit hashes.

    `once` are phrases met once, `more` the others, with their counts. A summary of a task never holds more phrases than
    their occurrences, which is less than a whole partition's capacity needs, so nothing is taken from it.
    """

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, count = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
        held.clear()
        key, count = _merged(key, count)
        # The upper half of a hash, spread over the partitions, grows with it: partitions are ranges of the sorted keys.
        part = ((key >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
        rest = key.astype(np.uint32)
        edges = np.searchsorted(part, np.arange(partitions + 1, dtype=np.uint64))
        columns: list[list] = [[], [], [], [], []]
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own, many = rest[edges[p] : edges[p + 1]], count[edges[p] : edges[p + 1]]
            own, many = _merged(own, many)  # the lower halves may repeat
            one = many == 1
            for column, value in zip(columns, (p, int(many.sum()), _pack(own[one]), _pack(own[~one]), many[~one].tobytes()), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p", "mass", "once", "more", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found, _, lang_hash in _slices(batch):
                for g in grams(found, lang_hash, longest):
                    held.append((g.hash, g.count))
                    size += len(g.hash)
                if size >= GATHER:
                    yield send(held)
                    size = 0
        if held:
            yield send(held)
        pa.default_memory_pool().release_unused()

    return run


def merge_summaries(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of at most `capacity` keys from several: keys, counters, and how much was taken from each."""
    key, count, taken = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for n, part in enumerate(parts, 1):
        held.append(part)
        if sum(len(k) for k, _ in held) < max(capacity, 1) and n < len(parts):
            continue
        key, count = _merged(np.concatenate([key, *[k for k, _ in held]]), np.concatenate([count, *[c for _, c in held]]))
        held = []
        if len(key) > capacity:
            cut = int(np.partition(count, len(count) - capacity - 1)[len(count) - capacity - 1])
            taken += cut
            key, count = key[count > cut], count[count > cut] - cut
    return key, count, taken


def _filter_bits(rest: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The place of each phrase among the filter's bits of its partition, for one of its probes."""
    mixed = bytescan.mix(rest.astype(np.uint64) + np.uint64(probe << 32))
    return ((mixed >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def _survivors(least: int, bits: int):
    """The filter's slice of a partition: bits of the phrases that may occur `least` times."""

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for once, more, counts in zip(*[rows.column(c).to_pylist() for c in ("once", "more", "counts")], strict=True):
            one = _unpack(once)
            parts.append((np.concatenate([one, _unpack(more)]), np.concatenate([np.ones(len(one), np.int64), np.frombuffer(counts, np.int64)])))
        mass = sum(rows.column("mass").to_pylist())
        key, count, taken = merge_summaries(parts, SPARE * (mass // least))
        key = key[count + taken >= least]
        held = np.zeros(bits, np.uint8)
        for probe in range(PROBES):
            held[_filter_bits(key, bits, probe).astype(np.int64)] = 1
        return pa.table({
            "p": pa.array([rows.column("p")[0].as_py()], pa.int64()), "mass": pa.array([mass], pa.int64()),
            "survivors": pa.array([len(key)], pa.int64()), "taken": pa.array([taken], pa.int64()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary()),
        })

    return run


def summaries(docs: DataFrame, text: str, lang: str, least: int, longest: int, partitions: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(p, mass, survivors, taken, bits) of every hash partition that has phrases; all bits together are at most `filter_bits`."""
    sent = _texts(docs, text, lang).mapInArrow(_task_summaries(partitions, longest), "p bigint, mass bigint, once binary, more binary, counts binary")
    share = max(8, filter_bits // partitions // 8 * 8)
    return sent.groupBy("p").applyInArrow(_survivors(least, share), "p bigint, mass bigint, survivors bigint, taken bigint, bits binary")


# Second pass: exact counts ------------------------------------------------------------------------------------


def _counts(partitions: int, longest: int, shared):
    """Rows (lang, size, phrase, n) of the phrases that pass the filter; size 0 has all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, raw = shared.value
        filled = np.frombuffer(raw, np.uint8)
        for batch in batches:
            for found, langs, lang_hash in _slices(batch):
                for g in grams(found, lang_hash, longest):
                    size = g.words.shape[1]
                    part = ((g.hash >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
                    hit = np.arange(len(part))
                    for probe in range(PROBES):
                        bit = part[hit] * np.uint64(share) + _filter_bits(g.hash[hit].astype(np.uint32), share, probe)
                        hit = hit[((filled[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)]
                    phrase = pc.binary_join_element_wise(*[found.words.take(pa.array(g.words[hit, k])) for k in range(size)], pa.scalar(" ", pa.large_string()))
                    yield _rows(langs.take(pa.array(g.lang[hit])), size, phrase, g.count[hit])
                    if size == 1:
                        per = np.bincount(g.lang, weights=g.count, minlength=len(langs)).astype(np.int64)
                        some = np.flatnonzero(per)
                        yield _rows(langs.take(pa.array(some)), 0, pa.array([""] * len(some)), per[some])

    return run


def _rows(lang: pa.Array, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [lang.cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = MAX_WORDS,
    mass: int = MASS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, size, phrase, n): phrases of one to `longest` words that occur `least` times or more, with exact counts.

    Rows of size 0 hold the number of all words of a language; a null language is `und`, a null text is empty. A phrase
    lies within one piece of text, and overlapping occurrences count.

    `mass` bounds what a merging task holds; the number of hash partitions follows from the bytes of the texts.
    Summaries are shuffled as 4 bytes a distinct phrase of a task, before compression. The filter has a fixed size; if so many phrases survive that
    it fills up, it lets more through that the second pass counts in vain, but loses none.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("bigint"))).first()[0] or 0
    partitions = max(1, -(-size * longest // 2 // mass))  # a word has two bytes at least, with its blank
    share = max(8, filter_bits // partitions // 8 * 8)
    filled = np.zeros(share * partitions // 8, np.uint8)
    for row in summaries(docs, text, lang, least, longest, partitions, filter_bits).select("p", "bits").toLocalIterator():
        filled[row["p"] * share // 8 : (row["p"] + 1) * share // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast((share, filled.tobytes()))
    found = _texts(docs, text, lang).mapInArrow(_counts(partitions, longest, shared), "lang string, size int, phrase string, n bigint")
    found = found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return found.where((F.col("size") == 0) | (F.col("n") >= least))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = MAX_WORDS,
    top: int | None = TOP, inside_percent: int = INSIDE_PERCENT, mass: int = MASS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the phrases of 2 to `longest` words that occur `least` times or more.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces, those at spaces and tabs into words. a is
    the number of occurrences, n that of all words of the language. Of the ways to cut a phrase in two, the one with the
    lowest score counts, of equal ones that with the shortest first part; l and r are the occurrences of its
    parts and the score is floor(1000000 * a * a / (l * r)), in 38-digit arithmetic. Phrases that
    lie in a longer one which occurs at least `inside_percent` percent as often go, whether the longer one stays or not. The first `top`
    of each language stay (all with None), by score, occurrences (both descending) and phrase in byte order; rank says which.

    Null text is empty, a null language is `und`. Repeated rows count again. Without frequent phrases, or for an empty table, the
    result is empty. Other columns of `docs` aren't read.
    """
    counted = stored(frequent_phrases(docs, text, lang, least, longest, mass, filter_bits), "phrases")
    part = counted.where("size > 0").select("lang", "phrase", "n")
    phrases = counted.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # Each contiguous part of a phrase of two words or more, with the phrase's count.
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    inner = [
        F.when(F.size("w") == size, F.array(*[cut(i, k) for k in range(2, size) for i in range(1, size - k + 2)]))
        for size in range(3, longest + 1)
    ]
    over = None
    if inner:
        over = phrases.select("lang", F.explode(F.coalesce(*inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
        phrases = phrases.join(over, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("over") < F.lit(inside_percent) * F.col("a"), F.lit(True)))
    cuts = phrases.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w",
    ).select("lang", "phrase", "a", "k", cut(1, F.col("k")).alias("left"), cut(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, n: part.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("x", F.lit(1_000_000).cast("decimal(38,0)") * _exact("a") * _exact("a")).withColumn("y", _exact("l") * _exact("r"))
    scored = cuts.withColumn("score", F.expr("x div y")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("lowest")
    ).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")
    if top is not None:
        # Counts per band of the score, a hundredth wide, tell where the last of the top lies: what is below isn't ranked. Phrases
        # whose words never occur apart all have the highest score; they go by bands of their occurrences.
        always = F.when(F.col("score") == 1_000_000, F.floor(F.log2("a") * 64)).otherwise(0)
        scored = stored(scored.withColumn("band", F.floor(F.log2(F.col("score") + 1) * 64) * 4096 + always), "scored")
        above = Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        bands = scored.groupBy("lang", "band").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(above), F.lit(0)))
        lowest = bands.where(F.col("before") < top).groupBy("lang").agg(F.min("band").alias("lowest"))
        scored = scored.join(lowest, "lang").where(F.col("band") >= F.col("lowest"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.col("rank").cast("bigint"))
    words = counted.where("size = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
