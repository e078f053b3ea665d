"""JSON files that are one array, read in byte ranges.

Where a range begins, nothing tells whether it is inside a string or how deep in brackets. Tasks therefore first reduce their
range to a small function: for each state in which it may be entered (outside strings, inside one, after a
backslash) the state in which it is left and by how much the depth changes. These functions, a row per range, applied
one after another give the state in which every range is entered. A second pass finds the commas at depth
one, and a task reads the elements that begin in its range, the last of them beyond its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources.files import open_store, sized_files

RANGE_BYTES = 64 << 20
READ = 4 << 20
BATCH_BYTES = 4 << 20
_BACKSLASH, _QUOTE, _COMMA, _OPEN, _CLOSE = 0x5C, 0x22, 0x2C, 0x5B, 0x5D
_BLANKS = b" \t\r\n"
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[0x5B, 0x7B]], _DEPTH[[0x5D, 0x7D]] = 1, -1


@dataclass(frozen=True)
class State:
    """Inside a string, after a backslash in one, and the number of open brackets."""

    inside: bool = False
    escaped: bool = False
    depth: int = 0


STARTS = (State(), State(inside=True), State(inside=True, escaped=True))


def scan(data: np.ndarray, state: State) -> tuple[State, np.ndarray, np.ndarray]:
    """The state after `data`; positions of brackets and commas outside strings, and the depth after each."""
    n = len(data)
    if n == 0:
        return state, np.zeros(0, np.int64), np.zeros(0, np.int64)
    quotes = np.flatnonzero(data == _QUOTE)
    slash = data == _BACKSLASH
    # A character is escaped if an odd number of backslashes stands right before it.
    plain = np.flatnonzero(~slash)
    front = -2 if state.escaped else -1  # an open escape is one more backslash in front
    before = np.append(front, plain)
    last = lambda at: before[np.searchsorted(plain, at)]  # noqa: E731  the last other byte before each place
    quotes = quotes[(quotes - 1 - last(quotes)) % 2 == 0]
    escaped = bool((n - 1 - int(last(np.array([n]))[0])) % 2)
    marks = np.flatnonzero((_DEPTH[data] != 0) | (data == _COMMA))
    outside = (np.searchsorted(quotes, marks) + state.inside) % 2 == 0
    marks = marks[outside]
    depth = state.depth + np.cumsum(_DEPTH[data[marks]])
    inside = bool((len(quotes) + state.inside) % 2)
    return State(inside, escaped and inside, int(depth[-1]) if len(depth) else state.depth), marks, depth


def _pieces(file, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(start, stop, READ):
        piece = file.read_at(min(READ, stop - at), at)
        if len(piece) < min(READ, stop - at):
            raise OSError("the file is shorter than when it was listed")
        yield at, np.frombuffer(piece, np.uint8)


def _functions(file, start: int, stop: int) -> list[State]:
    """State after a range for each of STARTS, depths counted from its beginning."""
    states = list(STARTS)
    for _, data in _pieces(file, start, stop):
        states = [scan(data, s)[0] for s in states]
    return states


def _is_array(file, size: int) -> bool:
    for _, data in _pieces(file, 0, size):
        text = data.tobytes().lstrip(_BLANKS)
        if text:
            return text[0] == _OPEN
    return False


def _elements(file, start: int, stop: int, size: int, state: State) -> Iterator[tuple[int, bytes]]:
    """(position, text) of the elements whose bracket or comma lies in [start, stop)."""
    begin, held = -1, []
    for at, data in _pieces(file, start, size):
        if at >= stop and begin < 0:
            return
        state, marks, depth = scan(data, state)
        bytes_of = data[marks]
        # The only bracket that leads to depth one is the array's own: it opens at the file's first sign.
        own = ((bytes_of == _COMMA) | (bytes_of == _OPEN)) & (depth == 1)
        ends = own | ((bytes_of == _CLOSE) & (depth == 0))
        done = 0
        for m, opens in zip(marks[ends].tolist(), own[ends].tolist(), strict=True):
            if begin >= 0:
                held.append(data[done:m].tobytes())
                yield begin, b"".join(held).strip(_BLANKS)
            begin, held, done = -1, [], m + 1
            if opens and at + m < stop:
                begin = at + m + 1
            elif at + m >= stop:
                return
        if begin >= 0:
            held.append(data[done:].tobytes())
    if begin >= 0:
        raise ValueError("the array is not closed")


def array_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, element): the text of every element of JSON array files, with its position.

    `path` is a file, a glob or a folder (*.json). A file that isn't an array is one element; an empty file has none. A
    file whose brackets don't close, or with an empty element, is an error that names it. What reaches the driver is a row per
    range of `range_bytes` bytes.
    """
    files = sized_files(path, "*.json")
    ranges = [(name, size, a, min(a + range_bytes, size)) for name, size in files for a in range(0, size, range_bytes)]
    ddl = "file string, size bigint, start bigint, stop bigint"
    if not ranges:
        return spark.createDataFrame([], "file string, at bigint, element string")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = open_store(path)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                with store.open_input_file(r.file) as file:
                    states = _functions(file, r.start, r.stop)
                out.append((r.file, r.start, *[x for s in states for x in (s.inside, s.escaped, s.depth)]))
            yield pd.DataFrame(out, columns=names)

    names = ["file", "start", *[f"{x}{i}" for i in range(3) for x in ("inside", "escaped", "depth")]]
    reduced = "file string, start bigint, " + ", ".join(f"inside{i} boolean, escaped{i} boolean, depth{i} bigint" for i in range(3))
    dealt = spark.createDataFrame(ranges, ddl).repartition(len(ranges))
    found = {(r["file"], r["start"]): r for r in dealt.mapInPandas(reduce, reduced).collect()}
    entered, state = [], State()
    for name, size, start, stop in ranges:
        if start == 0:
            state = State()
        entered.append((name, size, start, stop, state.inside, state.escaped, state.depth))
        row, kind = found[name, start], STARTS.index(replace(state, depth=0))
        state = State(row[f"inside{kind}"], row[f"escaped{kind}"], state.depth + row[f"depth{kind}"])
        if stop == size and state != State():
            raise ValueError(f"{name} is not whole: {'a string is' if state.inside else 'brackets are'} open at its end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for batch in batches:
            for r in batch.to_pylist():
                at, text, held = [], [], 0
                with store.open_input_file(r["file"]) as file:
                    if _is_array(file, r["size"]):
                        elements = _elements(file, r["start"], r["stop"], r["size"], State(r["inside"], r["escaped"], r["depth"]))
                    else:
                        whole = file.read_at(r["size"], 0).strip(_BLANKS) if r["start"] == 0 else b""
                        elements = iter([(0, whole)] if whole else [])
                    for pos, one in elements:
                        if not one:
                            # Between the brackets of an empty array there is nothing; after a comma there must be an element.
                            if file.read_at(1, pos - 1) == b"[" and file.read_at(READ, pos).lstrip(_BLANKS)[:1] in (b"]", b""):
                                continue
                            raise ValueError(f"{r['file']} has an empty element at {pos}")
                        at.append(pos)
                        text.append(one.decode("utf-8"))
                        held += len(one)
                        if held >= BATCH_BYTES:
                            yield _rows(r["file"], at, text)
                            at, text, held = [], [], 0
                yield _rows(r["file"], at, text)

    starts = spark.createDataFrame(entered, f"{ddl}, inside boolean, escaped boolean, depth bigint").repartition(len(entered))
    return starts.mapInArrow(read, "file string, at bigint, element string")


def _rows(name: str, at: list[int], text: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["file", "at", "element"])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """Elements of JSON array files as rows of `schema`; `options` are those of Spark's JSON parser."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return array_elements(spark, path, range_bytes).select(F.from_json("element", kind, options).alias("d")).select("d.*")
