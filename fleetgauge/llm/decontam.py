"""Passages of benchmark items in documents: a prefix-filtered join of word shingles.

A document contains a window of an item only if it contains each of its shingles,
so the rarest one, its prefix, is enough to find every candidate. The join gives
positions; a candidate's place follows from the position of its prefix, must lie
within the document (positional and length bound), and is then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetgauge.llm import bytescan
from fleetgauge.llm.common import named, others, packed, slices, stored, text_map, unpacked

WINDOW = 13
#: Words of a shingle; of a window with fewer words, all.
SHINGLE = 4
#: Bound of what is broadcast at a time: benchmark words. More items are matched in further passes.
BLOCK_WORDS = 1_000_000


@dataclass
class Block:
    """Some benchmark items: the hashes of their words one after another, and their distinct windows."""

    ids: list[str]
    hashes: np.ndarray  # of all words
    texts: list[bytes]  # of all words
    at: np.ndarray  # first word of each window
    length: np.ndarray  # its words
    item: np.ndarray  # number of its item in ids


_EMPTY = Block([], np.zeros(0, np.uint64), [], *[np.zeros(0, np.int64)] * 3)


def _blocks(items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """Items in bounded blocks, as they come; items without words are left out. An item longer than a block is a block."""
    ids: list[str] = []
    hashes, texts, at, length, item = [], [], [], [], []
    held = 0

    def done() -> Block:
        return Block(list(ids), np.concatenate(hashes), list(texts), np.concatenate(at), np.concatenate(length), np.concatenate(item))

    source = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for row in source.distinct().toLocalIterator():
        found = bytescan.words(pa.array([row["text"]], pa.string()), bytescan.letters_and_digits())
        n = len(found.hashes)
        if n == 0:
            continue
        if held and held + n > block_words:
            yield done()
            ids, hashes, texts, at, length, item, held = [], [], [], [], [], [], 0
        own = min(window, n)
        first = np.arange(n - own + 1)
        ids.append(row["id"])
        hashes.append(found.hashes)
        texts.extend(found.text(i, i + 1) for i in range(n))
        at.append(first + held)
        length.append(np.full(len(first), own))
        item.append(np.full(len(first), len(ids) - 1))
        held += n
    if ids:
        yield done()


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    one = bytescan.Words(np.zeros(0, np.uint8), hashes, hashes, hashes, np.array([0, len(hashes)]))
    return bytescan.shingles(one, width)[0][:m]


def _widths(block: Block, shingle: int) -> list[int]:
    return sorted({int(min(shingle, n)) for n in np.unique(block.length)})


def _tokens(block: Block, shingle: int) -> dict[int, np.ndarray]:
    """Per width the sorted distinct shingles that occur in windows."""
    out = {}
    for w in _widths(block, shingle):
        rolled = _rolled(block.hashes, w)
        own = np.minimum(block.length, shingle) == w
        at, more = block.at[own], block.length[own] - w
        out[w] = np.unique(rolled[np.concatenate([at[more >= k] + k for k in range(int(more.max()) + 1)])])
    return out


def _find(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in `sorted_values`, -1 where it isn't."""
    if len(sorted_values) == 0:
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def rarity(docs: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each token occurs in all documents; counted in the tasks, summed by Spark.

    The result has a row for each benchmark token of the block, which is what bounds it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        seen = {w: np.zeros(len(t), np.int64) for w, t in own.items()}
        for batch in batches:
            for a, b in slices(batch.column(0)):
                found = bytescan.words(batch.column(0).slice(a, b - a), bytescan.letters_and_digits())
                for w, t in own.items():
                    h, whole = bytescan.shingles(found, w)
                    at = _find(t, h[whole])
                    seen[w] += np.bincount(at[at >= 0], minlength=len(t))
        for w, n in seen.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["w", "at", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "w int, at int, n bigint")
    out = {w: np.zeros(len(t), np.int64) for w, t in tokens.items()}
    for r in counts.groupBy("w", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["w"]][r["at"]] = r["n"]
    return out


@dataclass
class Index:
    """Postings of the prefixes of a block: per width the sorted tokens, and their (window, offset) pairs."""

    block: Block
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _index(block: Block, tokens: dict[int, np.ndarray], seen: dict[int, np.ndarray], shingle: int) -> Index:
    postings = {}
    for w, t in tokens.items():
        rolled = _rolled(block.hashes, w)
        own = np.flatnonzero(np.minimum(block.length, shingle) == w)
        best, offset = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
        for k in range(int((block.length[own] - w).max()) + 1):
            fits = block.length[own] - w >= k
            n = best.copy()
            n[fits] = seen[w][_find(t, rolled[block.at[own[fits]] + k])]
            offset[n < best] = k
            best = np.minimum(n, best)
        prefix = rolled[block.at[own] + offset]
        order = np.argsort(prefix, kind="stable")
        keys, begin = np.unique(prefix[order], return_index=True)
        postings[w] = (keys, np.append(begin, len(order)), own[order], offset[order])
    return Index(block, postings)


def _matches(found: bytescan.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """First words of occurrences, and their windows."""
    block, places, windows = index.block, [], []
    last = np.repeat(found.first[1:], np.diff(found.first))
    begin = np.repeat(found.first[:-1], np.diff(found.first))
    for w, (keys, start, window, offset) in index.postings.items():
        h, whole = bytescan.shingles(found, w)
        hit = np.flatnonzero(whole)
        at = _find(keys, h[hit])
        hit, at = hit[at >= 0], at[at >= 0]
        # Every posting of a hit's token is a candidate; they are compared in bounded portions.
        n = start[at + 1] - start[at]
        ends = np.cumsum(n)
        i = 0
        while i < len(hit):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 200_000)))
            each = np.repeat(np.arange(i, j), n[i:j])
            inner = np.arange(len(each)) - np.repeat(ends[i:j] - n[i:j] - (ends[i - 1] if i else 0), n[i:j])
            post = start[at[each]] + inner
            win, place = window[post], hit[each] - offset[post]
            ok = (place >= begin[hit[each]]) & (place + block.length[win] <= last[hit[each]])
            win, place = win[ok], place[ok]
            for k in range(int(block.length[win].max()) if len(win) else 0):
                need = block.length[win] > k
                same = ~need
                same[need] = found.hashes[place[need] + k] == block.hashes[block.at[win[need]] + k]
                win, place = win[same], place[same]
            places.append(place)
            windows.append(win)
            i = j
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, win = np.concatenate(places), np.concatenate(windows)
    # Equal hashes are no proof: compare the words themselves.
    exact = [
        found.text(p, p + block.length[v]) == b" ".join(block.texts[block.at[v] : block.at[v] + block.length[v]])
        for p, v in zip(place.tolist(), win.tolist(), strict=True)
    ]
    keep = np.array(exact, bool)
    return place[keep], win[keep]


def _scan(docs: DataFrame, text: str, keep: list[str], index: Index) -> DataFrame:
    """Adds the words of each text, the ranges of words inside occurrences, and the items that occur."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def function(texts: pa.Array) -> list[pa.Array]:
        own = sent.value
        found = bytescan.words(texts, bytescan.letters_and_digits())
        place, win = _matches(found, own)
        text_of = np.searchsorted(found.first, place, side="right") - 1
        ranges: list[list[dict]] = [[] for _ in range(len(texts))]
        items: list[set] = [set() for _ in range(len(texts))]
        order = np.argsort(place, kind="stable")
        for p, v, t in zip(place[order].tolist(), win[order].tolist(), text_of[order].tolist(), strict=True):
            a = p - int(found.first[t])
            b = a + int(own.block.length[v])
            if ranges[t] and a <= ranges[t][-1]["b"]:
                ranges[t][-1]["b"] = max(b, ranges[t][-1]["b"])
            else:
                ranges[t].append({"a": a, "b": b})
            items[t].add(own.block.ids[own.block.item[v]])
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return [
            pa.array(np.diff(found.first), pa.int64()), pa.array(ranges, kind),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]

    return text_map(docs, text, keep, "__n bigint, __ranges array<struct<a: bigint, b: bigint>>, __items array<string>", function)


def _union_length(ranges: Column) -> Column:
    """Positions covered by sorted ranges."""
    step = lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["end"], r["a"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(ranges, zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns `keep` (default: all) and n_words, n_hit, n_items, items, ranges, contaminated.

    Words are runs of ASCII letters and digits and characters outside ASCII, A-Z lower-cased.
    A word is hit if it lies in an occurrence of a window: `window` consecutive words of an item,
    or all words of a shorter one. `items` has the ids (as text, sorted) with a window in the text,
    each once; `ranges` the hit words as [a, b). contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Null and empty texts have no words; items without words match nothing; a null item id is
    the empty id; repeated items count once by id. Repeated documents are judged each.
    Items go to the tasks in blocks of at most `block_words` words: one pass each over the documents.
    """
    names = {"n_words", "n_hit", "n_items", "items", "ranges", "contaminated"}
    keep = others(docs.columns, names) if keep is None else keep
    # The text is carried once, beside the other columns.
    once = text in keep and docs.schema[text].dataType == StringType()
    rest = [c for c in keep if not (once and c == text)]
    whole = docs.select(packed(rest).alias("row"), named(text).cast("string").alias("text"))
    source, ranges, found = whole, [], []
    blocks = _blocks(items, item, item_text, window, block_words)
    block = next(blocks, _EMPTY)
    while block is not None:
        later = next(blocks, None)
        tokens = _tokens(block, shingle)
        index = _index(block, tokens, rarity(whole, "text", tokens), shingle)
        n = len(ranges)
        source = _scan(source, "text", ["row", *(["text"] if later or once else []), *ranges, *found], index)
        ranges, found = [*ranges, f"__ranges{n}"], [*found, f"__items{n}"]
        source = source.withColumnsRenamed({"__ranges": ranges[-1], "__items": found[-1]})
        if later:
            source = stored(source.drop("__n"), "decontamination")
        block = later
    merged = F.sort_array(F.concat(*ranges)) if len(ranges) > 1 else F.col(ranges[0])
    every = F.sort_array(F.array_distinct(F.concat(*found)))
    back = dict(zip(rest, unpacked("row", rest), strict=True)) | ({text: F.col("text").alias(text)} if once else {})
    hit = source.select("row", *(["text"] if once else []), "__n", merged.alias("__merged"), every.alias("__every")).withColumn("__hit", _union_length(F.col("__merged")))
    return hit.select(
        *[back[c] for c in keep], F.col("__n").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__every").cast("bigint").alias("n_items"),
        F.col("__every").alias("items"), F.col("__merged").alias("ranges"),
        ((F.col("__hit") > 0) & (F.lit(20) * F.col("__hit") >= F.col("__n"))).alias("contaminated"),
    )
