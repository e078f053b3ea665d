"""Tokens of a text attributed to its sections.

The whole text is encoded once, since tokens depend on what stands around them. In byte-level BPE the
bytes of the tokens are those of the text, so running sums of their lengths give the span of each
token; spans meet the sections in an interval join of two sorted lists. A token that crosses a
boundary is given away by an explicit rule.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import slices, others

#: Who gets a token that crosses a boundary: the section of its first byte, of its last byte, the one
#: with most of its bytes (of equal ones the first), or each its share of the bytes.
RULES = ("first", "last", "most", "share")
#: White space runs of this many characters are matched here: the library's pattern matcher gives up
#: on those of several times the length. It has no such limit for other characters.
LONG_RUN = 100_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(path: str, splits: str):
    """The library's encoder, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=splits, mergeable_ranks=ranks, special_tokens={}), lengths


#: White space as the library's patterns know it; Python's \s has four control characters more.
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def encode(text: str, path: str, splits: str) -> list[int]:
    """Ids of a text, those of the library for the whole.

    The pattern takes a run of white space, but for its last character if more text follows, as one match. So
    a long run is cut out where the pattern splits anyway and goes to the merges as one piece.
    Another pattern than `pattern()` may split elsewhere; with it the library gets every text whole.
    """
    own, _ = encoder(path, splits)
    if len(text) < LONG_RUN or splits != pattern():
        return own.encode_ordinary(text)
    out, done = [], 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += own.encode_ordinary(text[done : m.start()])
        out += own._encode_single_piece(text[m.start() : end])
        done = end
    return out + own.encode_ordinary(text[done:])


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [bounds[i], bounds[i + 1]), and how many tokens cross a boundary.

    `lengths`: bytes of the tokens, one after another; `bounds`: increasing byte positions, from 0 to
    the end of the text. Empty sections get nothing. With "share" the counts are fractions.
    """
    n = len(bounds) - 1
    if len(lengths) == 0 or n <= 0:
        return np.zeros(max(n, 0), float if rule == "share" else np.int64), 0
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    if rule in ("first", "last"):
        return np.bincount(first if rule == "first" else last, minlength=n)[:n], len(crossing)
    out = np.bincount(first[first == last], minlength=n)[:n].astype(float)
    for t in crossing:
        own = np.arange(first[t], last[t] + 1)
        share = np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], starts[t])
        if rule == "share":
            out[own] += share / lengths[t]
        else:
            out[own[np.argmax(share)]] += 1
    return (out if rule == "share" else out.astype(np.int64)), len(crossing)


def field_document(*fields: Column, separator: str = "\n") -> tuple[Column, Column]:
    """One text of several fields (null: empty) with the separator after each, and where each field begins."""
    whole = [F.concat(F.coalesce(f.cast("string"), F.lit("")), F.lit(separator)) for f in fields]
    starts = [sum((F.char_length(w) for w in whole[:i]), F.lit(0)) for i in range(len(whole))]
    return F.concat(*whole), F.array(*starts)


def attribute(docs: DataFrame, text: str = "text", starts: str | None = None, rule: str = "first", keep: list[str] | None = None,
              vocabulary: str | None = None, splits: str | None = None) -> DataFrame:
    """Columns `keep` (default: all) and n_tokens, section_tokens, crossing.

    `starts` names a column with the sorted code point positions at which sections begin (array of
    int); none: the text's lines are its sections, each with its newline. A section ends where the
    next begins, the last at the end of the text; what is before the first start is a section of
    its own in front only if there is any. Equal starts make empty sections, which get no tokens;
    positions beyond the end count as the end. section_tokens has a number per section, in order, and
    they add up to n_tokens; crossing counts the tokens that cross a boundary, which `rule` gives away (RULES).

    Null or empty text has no tokens: its sections get 0 each. Null starts: the whole text is one section.
    Repeated rows are counted each. `vocabulary`: a file of ranks that every executor can read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    taken = {"n_tokens", "section_tokens", "crossing"}
    keep = others(docs.columns, taken) if keep is None else keep
    path, split = vocabulary or vocabulary_path(), splits or pattern()
    from pyspark.sql.types import StructType

    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"), *(
        [F.coalesce(F.col(f"`{starts}`").cast("array<int>"), F.array(F.lit(0))).alias("__starts")] if starts else []))
    number = "double" if rule == "share" else "bigint"
    schema = StructType(own.schema.fields[: len(keep)] + StructType.fromDDL(f"n_tokens bigint, section_tokens array<{number}>, crossing bigint").fields)

    def bounds(data: np.ndarray, given: list[int] | None) -> np.ndarray:
        if given is None:
            return np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1, [len(data)]])
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = points[np.minimum(np.array(given, np.int64), len(points) - 1)] if given else np.zeros(0, np.int64)
        front = [0] if len(at) == 0 or at[0] > 0 else []
        return np.concatenate([front, at, [len(data)]]).astype(np.int64)

    def run(batches):
        _, size = encoder(path, split)
        kind = pa.list_(pa.float64() if rule == "share" else pa.int64())
        for batch in batches:
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                given = part.column(len(keep) + 1).to_pylist() if starts else [None] * part.num_rows
                counts, sections, crossing = [], [], []
                for t, g in zip(part.column(len(keep)).to_pylist(), given, strict=True):
                    ids = np.array(encode(t or "", path, split), np.int64)
                    found, crossed = allocate(size[ids], bounds(np.frombuffer((t or "").encode(), np.uint8), g), rule)
                    counts.append(len(ids))
                    sections.append(found)
                    crossing.append(crossed)
                made = [pa.array(counts, pa.int64()), pa.array(sections, kind), pa.array(crossing, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=schema.names)

    return own.toDF(*[f"c{i}" for i in range(len(own.columns))]).mapInArrow(run, schema)  # the columns' own names may be any
