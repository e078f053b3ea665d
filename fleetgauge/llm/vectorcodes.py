"""Product codes of vectors: a codebook per part, nearest entries found by Orchard's search.

Components become integers, so every distance and mean is exact and the result doesn't depend on how
rows are dealt out. Each part of a vector is replaced by the nearest entry of the codebook of its
place. The search keeps, for every entry, all entries sorted by distance from it. It walks the list of the best
entry so far and jumps to the list of a better one as soon as it meets it; entries once
measured are marked and not measured again; and it stops where the list is farther than twice
the current distance away, as nothing beyond can be nearer. Many queries take their steps side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetgauge.llm.common import stored

#: A component x becomes floor(SCALE * x).
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors searched at a time.
SLICE_ROWS = 2048
#: Group sums up to this number of groups are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance from it (ties by index), and these squared distances."""
    gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    return order, np.take_along_axis(gap, order, axis=1)


def nearest(queries: np.ndarray, entries: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of every query, ties to the lower one, its squared distance, and how many were measured."""
    order, gap = lists
    n, k = len(queries), len(entries)
    now = np.zeros(n, np.int64)
    best = ((queries - entries[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    at = np.zeros(n, np.int64)
    measured = n
    live = np.arange(n)
    while True:
        # A list ends at its last entry, or where it is farther than twice the distance (four times, as squares).
        live = live[at[live] < k]
        live = live[gap[now[live], at[live]] <= 4 * best[live]]
        if not len(live):
            return now, best, measured
        met = order[now[live], at[live]]
        at[live] += 1
        new = ~seen[live, met]
        row, entry = live[new], met[new]
        seen[row, entry] = True
        measured += len(row)
        far = ((queries[row] - entries[entry]) ** 2).sum(axis=1)
        better = (far < best[row]) | ((far == best[row]) & (entry < now[row]))
        row, entry = row[better], entry[better]
        now[row], best[row], at[row] = entry, far[better], 0


@dataclass(frozen=True)
class Codebooks:
    """One array (entries, width) of integers per part."""

    entries: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def digest(self) -> str:
        """sha256 of all components as decimals joined by commas: by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.reshape(-1).tolist()).encode()).hexdigest()

    def lists(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [neighbour_lists(book) for book in self.entries]

    def encode(self, vectors: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Index per part of every vector (rows of parts * width integers), and the squared distances summed over parts."""
        codes = np.zeros((len(vectors), len(self.entries)), np.int64)
        error = np.zeros(len(vectors), np.int64)
        for p, book in enumerate(self.entries):
            codes[:, p], far, _ = nearest(vectors[:, p * self.width : (p + 1) * self.width], book, lists[p])
            error += far
        return codes, error


def whole_vectors(df: DataFrame, vector: str = "embedding") -> Column:
    """Whether the vector is there and all its components are there and finite."""
    v = F.col(f"`{vector}`")
    usual = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v.cast("array<double>"), usual)


def _integers(vector: str) -> Column:
    return F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("bigint"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `width`."""
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) and int(np.abs(values).max()) >= 1 << 28:
        raise ValueError(f"a component of 2^28 / {SCALE} or more doesn't fit the exact distances")
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def fit(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks of the vectors of `df`; None if there is no vector.

    A codebook starts as the parts of the `entries` vectors with the smallest ids (fewer if there are fewer). Each round
    assigns every part of every vector to the nearest entry and replaces the entry by the floor of their mean;
    an entry that nothing was assigned to stays. Tasks send sums per part and entry only.

    Rows without a vector or with a null, NaN or infinite component are left out. Ids that are null come last among
    the starting vectors, and rows that repeat an id are ordered by their components. Vectors are cut into
    equal parts; where lengths differ or aren't a multiple of `parts`, zeros fill up to the next multiple that holds the longest.
    """
    kept = df.where(whole_vectors(df, vector)).select(F.col(f"`{key}`").alias("id"), _integers(vector).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    first = _matrix(pa.array([r["v"] for r in start], pa.list_(pa.int64())), width * parts)
    books = Codebooks(tuple(first[:, p * width : (p + 1) * width] for p in range(parts)))
    sums = [f"s{k}" for k in range(width)]
    schema = StructType.fromDDL(", ".join(["part int", "entry int", "n bigint", *[f"{s} bigint" for s in sums]]))
    for _ in range(rounds):
        total = kept.select("v").mapInArrow(_sums(books), schema).groupBy("part", "entry")
        total = total.agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
        fresh = [book.copy() for book in books.entries]
        for r in total.collect():  # a row per part and entry
            fresh[r["part"]][r["entry"]] = [r[s] // r["n"] for s in sums]
        books = Codebooks(tuple(fresh))
    return books


def _sums(books: Codebooks):
    width, parts, k = books.width, len(books.entries), len(books.entries[0])
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = books.lists()
        count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                vectors = _matrix(batch.column(0).slice(a, SLICE_ROWS), parts * width)
                codes, _ = books.encode(vectors, lists)
                slot = (codes + np.arange(parts) * k).reshape(-1)
                count += np.bincount(slot, minlength=parts * k)
                np.add.at(total, slot, vectors.reshape(-1, width))
        used = np.flatnonzero(count)
        part, entry = (used // k).astype(np.int32), (used % k).astype(np.int32)
        columns = [pa.array(part), pa.array(entry), pa.array(count[used]), *[pa.array(total[used, i]) for i in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all but the vector by default), code and error of every row with a whole vector.

    `code` has two hex digits per part, the index of the nearest entry (more digits for codebooks of over 256); `error` is the
    sum of the squared distances to them. Rows without a whole vector are left out. A vector longer than the
    codebooks were made for is an error. Columns of `df` named like the results are replaced.
    """
    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("code", "error") and (keep is not None or c != vector)]
    kept = df.where(whole_vectors(df, vector)).select(*[F.col(f"`{c}`") for c in columns], _integers(vector))
    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL("code string, error bigint").fields])
    source = kept.toDF(*[f"c{i}" for i in range(len(columns) + 1)])  # the columns' own names may be any
    width, at = books.width * len(books.entries), len(columns)
    digits = max(2, len(f"{len(books.entries[0]) - 1:x}"))
    hexed = np.array([f"{i:0{digits}x}" for i in range(len(books.entries[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = books.lists()
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                codes, error = books.encode(_matrix(part.column(at), width), lists)
                text = ["".join(row) for row in hexed[codes].tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(text, pa.string()), pa.array(error)], names=schema.names)

    return source.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, by: str = "label", name: str = "label_error") -> DataFrame:
    """`coded` (stored) and the sum of `error` over the rows with an equal value in `by`, nulls together.

    Sums are made before the shuffle and joined back; a value that a third of the rows have is a skewed key of a join,
    not a group in one task.
    """
    group = F.col(f"`{by}`")
    sums = stored(coded.groupBy(group.alias("__by")).agg(F.sum("error").alias("__sum")), "groups")
    few = sums.count() <= BROADCAST_GROUPS
    right = F.broadcast(sums) if few else sums
    joined = coded.join(right, group.eqNullSafe(F.col("__by")))
    return joined.select(*[F.col(f"`{c}`") for c in coded.columns if c != name], F.col("__sum").alias(name))
