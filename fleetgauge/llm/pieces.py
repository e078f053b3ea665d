"""SentencePiece ids by a table of distinct chunks.

No piece of the model continues across a white-space marker, and none holds a
newline beside another character. A text therefore splits, before each run of
markers and before each newline, into chunks that the model segments
independently. Each distinct chunk is segmented once and its ids are joined back
at every position where it stands. The table is local to a task: a table of the
whole corpus would need all chunk positions in a shuffle, many times the input.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from fleetgauge.llm.common import others, text_map

MARK = "▁"
#: Entries of a task's table of chunks; when full, it keeps those that the texts at hand hold.
TABLE_ENTRIES = 100_000
#: Bytes of text whose chunks are looked up together.
SLICE = 1 << 20
#: Longer chunks are segmented each time, so that the table stays small in bytes.
TABLE_CHARS = 64


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Segmenter:
    """Ids of texts, equal to those of the library, from distinct chunks."""

    def __init__(self, path: str):
        self.model = _library(path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        bad = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1)]
        self.mark = self.model.piece_to_id(MARK)
        if bad or self.mark == self.model.unk_id() or not self._keeps(f"a ⅣＡ  b\n{MARK}"):
            raise ValueError("the model has pieces across markers or changes its input; its chunks are not independent")
        self.table: dict[str, bytes] = {}

    def _keeps(self, text: str) -> bool:
        """The pieces spell the marked text, byte pieces included, without normalisation."""
        pieces = self.model.encode(text, out_type=str)
        data = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode() for p in pieces)
        return data.decode() == MARK + text.replace(" ", MARK)

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        # The library puts a marker in front of what it gets: it stands for the first blank of a
        # chunk, and is taken off again from a chunk that begins with a newline.
        found = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids[1:] if c[0] == "\n" else ids or [self.mark] for c, ids in zip(chunks, found, strict=True)]

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, with blanks for markers, and the number of the first chunk of each text and of the end."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.if_else(pc.equal(plain, none), none, pc.binary_join_element_wise(space, plain, none))
        begin = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        blank = data == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= data == 10
        start[begin[:-1][np.diff(begin) > 0]] = True
        at = np.append(np.flatnonzero(start), len(data))
        found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        return found, np.searchsorted(at, begin)

    def look_up(self, distinct: list[str]) -> list[bytes]:
        """The ids of each chunk, as the bytes of 32-bit numbers."""
        new = [c for c in distinct if c not in self.table]
        found = {c: array("i", ids).tobytes() for c, ids in zip(new, self._segment(new), strict=True)}
        known = [found[c] if c in found else self.table[c] for c in distinct]
        if len(self.table) + len(new) > TABLE_ENTRIES:
            self.table = {c: ids for c, ids in zip(distinct, known, strict=True) if c in self.table}
        if len(self.table) + len(new) <= TABLE_ENTRIES:
            self.table |= {c: ids for c, ids in found.items() if len(c) <= TABLE_CHARS}
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin and the last ones end."""
        chunks, first = self.chunks(texts)
        coded = chunks.dictionary_encode()
        known = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum([0, *map(len, known)]) // 4
        joined = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(known), np.int32)).take(coded.indices)
        return joined.values.to_numpy(), joined.offsets.to_numpy()[first]


@functools.lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but the text) and the array of ids of each whole text.

    A null or empty text has no ids. No begin or end ids, no sampling. Repeated rows
    are encoded each. `model` is the path of a model file that every executor can read.
    """
    keep = others(docs.columns, (text, ids)) if keep is None else keep

    def function(texts: pa.Array) -> list[pa.Array]:
        found, begin = segmenter(model).encode(texts)
        return [pa.ListArray.from_arrays(begin.astype(np.int32), found)]

    return text_map(docs, text, keep, f"`{ids}` array<int>", function, SLICE)


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `docs` and the text that the library's decode gives for the array of ids; null ids give empty text.

    A column named like the text is replaced.
    """
    docs = docs.drop(text)
    schema = StructType(docs.schema.fields + [StructField(text, StringType())])
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [_library(model).decode(x) if x else "" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)  # the columns' own names may be any


def round_trip(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8).

    The same work as `encode` and then `decode`, in one Python pass: ids are made, decoded and
    digested where they are, instead of passing through the JVM twice.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = others(docs.columns, (text, *made)) if keep is None else keep

    def function(texts: pa.Array) -> list[pa.Array]:
        own = segmenter(model)
        ids, begin = own.encode(texts)
        numbers = pa.LargeListArray.from_arrays(begin, pa.array(ids).cast(pa.large_string()))
        joined = pc.binary_join(numbers, pa.scalar(",", pa.large_string()))
        ids_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
        text_sha = []
        for a, b in pairwise(begin.tolist()):
            text_sha.append(hashlib.sha256((own.model.decode(ids[a:b].tolist()) if a < b else "").encode()).hexdigest())
        return [pa.array(np.diff(begin), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return text_map(docs, text, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", function, SLICE)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
