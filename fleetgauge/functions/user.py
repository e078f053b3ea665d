"""User code as Spark functions: aggregates with partial states, and table functions over partitions.

An aggregate is three small functions: the state of some rows, the state of two states, and the result of a
state. Tasks make one state per key of what they read, so the rows stay where they are; a key's states
are sorted together and folded one at a time, so a key that a third of all rows have is as many states as tasks.

A table function gets the rows of one partition in order, one at a time, and gives any number of rows at each and at the end.
It is a class with a few methods; what it returns may depend on the schema of the table it is called on.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: States that a task holds before it hands them on; a key may then have several from one task.
HELD_STATES = 100_000
_NAN = float("nan")


class Aggregate(ABC):
    """A user's aggregate: `state` and `result` are DDL texts of the values that the methods give as tuples.

    merge must give the same for any order and grouping of states.
    """

    state: str
    result: str

    @abstractmethod
    def partial(self, rows: pd.DataFrame) -> tuple:
        """State of some rows of one key, at least one."""

    @abstractmethod
    def merge(self, one: tuple, other: tuple) -> tuple:
        """State of the rows of both."""

    @abstractmethod
    def finish(self, state: tuple) -> tuple:
        """Result of all rows of a key."""


def _keys_of(batch: pa.RecordBatch, n: int) -> list[tuple]:
    """The first n values of every row; all NaN are one object, which tuples take for equal."""
    columns = [[_NAN if x != x else x for x in batch.column(i).to_pylist()] for i in range(n)]
    return list(zip(*columns, strict=True)) if n else [()] * batch.num_rows


def aggregate(df: DataFrame, keys: list[str], spec: Aggregate) -> DataFrame:
    """`keys` and the results of `spec`, one row per key of `df`. Null keys are a key; no rows give no rows.

    The user's `partial` sees the rows of one key in one Arrow batch, with all columns. Keys must be of types
    that Spark can sort.
    """
    head = [df.schema[k] for k in keys]
    state, result = T.StructType.fromDDL(spec.state), T.StructType.fromDDL(spec.result)
    names = [f"k{i}" for i in range(len(keys))]
    middle = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, head, strict=True)], *[T.StructField(f"s{i}", f.dataType) for i, f in enumerate(state)]])
    final = T.StructType([*head, *result.fields])
    width, columns = len(keys), df.columns

    def rows_of(found: Iterable[tuple], schema: T.StructType) -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        values = list(zip(*found, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in _keys_of(batch, width)], np.int64)
            pdf = pa.RecordBatch.from_arrays(batch.columns[width:], names=columns).to_pandas()
            order = np.argsort(code, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
            for key, part in zip(number, parts, strict=True):
                own = tuple(spec.partial(pdf.iloc[part]))
                held[key] = tuple(spec.merge(held[key], own)) if key in held else own
            if len(held) >= HELD_STATES:
                yield rows_of([(*k, *s) for k, s in held.items()], middle)
                held = {}
        yield rows_of([(*k, *s) for k, s in held.items()], middle)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            done = []
            states = zip(*[batch.column(i).to_pylist() for i in range(width, batch.num_columns)], strict=True)
            for own, one in zip(_keys_of(batch, width), states, strict=True):
                if now is not None and own == key:
                    now = tuple(spec.merge(now, one))
                    continue
                if now is not None:
                    done.append((*key, *spec.finish(now)))
                key, now = own, one
            if done:
                yield rows_of(done, final)
        if now is not None:
            yield rows_of([(*key, *spec.finish(now))], final)

    # Keys in front under names of their own, the rows' columns after them under theirs.
    source = df.select(*[df[f"`{k}`"].alias(n) for k, n in zip(keys, names, strict=True)], *[df[f"`{c}`"] for c in columns])
    states = source.toDF(*names, *[f"c{i}" for i in range(len(columns))]).mapInArrow(partial, middle)
    together = states.repartition(*names).sortWithinPartitions(*names) if keys else states.coalesce(1)
    return together.mapInArrow(fold, final)


class TableFunction(ABC):
    """A user's function over the ordered rows of a partition; one object per partition, made with the call's options."""

    @staticmethod
    @abstractmethod
    def returns(schema: T.StructType, **options: Any) -> T.StructType:
        """The rows it gives, for a table of this schema. Raise ValueError for a table or options it can't take."""

    @abstractmethod
    def row(self, row: Row) -> Iterable[tuple]:
        """Rows to give at the next row of the partition."""

    def end(self) -> Iterable[tuple]:
        """Rows to give after the last row of the partition."""
        return ()


def table_function(kind: type[TableFunction], partition_by: list[str], order_by: list[str]) -> Callable:
    """`kind` as a Spark table function that is called on a table: `f(df.asTable(), name=lit(option))`.

    It asks Spark itself for the partitioning and the order, so a call can't forget them. Its rows are the partition
    columns and those of `kind`. A partition is one task's work, streamed: choose columns that bound it, such as a key and a day.
    """

    class Function:
        def __init__(self, analyzed: AnalyzeResult):
            self.key: tuple = ()
            self.own: TableFunction | None = None

        @staticmethod
        def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument must be a table")
            missing = [c for c in (*partition_by, *order_by) if c not in table.dataType.fieldNames()]
            if missing:
                raise ValueError(f"the table has no column {', '.join(missing)}")
            own = kind.returns(table.dataType, **{k: v.value for k, v in options.items()})
            return AnalyzeResult(
                T.StructType([*[table.dataType[c] for c in partition_by], *own.fields]),
                partitionBy=[PartitioningColumn(c) for c in partition_by], orderBy=[OrderingColumn(c) for c in order_by],
            )

        def eval(self, table: Row, **options: Any) -> Iterator[tuple]:
            if self.own is None:
                self.own, self.key = kind(**options), tuple(table[c] for c in partition_by)
            for found in self.own.row(table):
                yield (*self.key, *found)

        def terminate(self) -> Iterator[tuple]:
            for found in self.own.end() if self.own is not None else ():
                yield (*self.key, *found)

    return udtf(Function)


def register_table_function(spark: SparkSession, name: str, function: Callable) -> None:
    """Make a table function known to SQL: `SELECT * FROM name(TABLE(t), option => 5)`."""
    spark.udtf.register(name, function)
