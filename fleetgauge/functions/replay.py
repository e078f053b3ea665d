"""Replay of stateful rules over keys of any size.

A rule such as a circuit breaker is sequential per key, but one key may be too
large for one task. Each (key, chunk) is first reduced to a transfer function,
"entering in this state, the chunk is left in that state". Functions of neighbours are
composed pairwise, pairs of pairs again, up to one per key; on the way back down the
state in which a pair is entered gives those of its two halves. A task has two functions at a
time, whatever the number of chunks. The chunks are then replayed side by side.

A state is a small number, or "waiting until a time". For waiting states the
transfer function is a step function of that time. Only times up to one hold
time past the first row can occur, and neighbouring times that end alike are one
step, so a function has at most as many steps as there are times of rows within one
hold time, for chunks and for pairs of any height.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.chunks import CHUNK, Chunks
from fleetgauge.functions.common import micros

NEVER = -(2**62)


def _follow(step: np.ndarray) -> np.ndarray:
    """End of the path from every node; end nodes point to themselves."""
    while True:
        twice = step[step]
        if np.array_equal(twice, step):
            return step
        step = twice


def _steps(ts: np.ndarray, ends: np.ndarray, max_hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper time bound and row index of each step with one result."""
    reach = int(np.searchsorted(ts, ts[0] + max_hold, "left")) + 1
    ends = ends[:reach]
    last = np.append(ends[1:] != ends[:-1], True)
    at = np.flatnonzero(last)
    return ts[at], at


def _path(step: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Nodes below `stop` on the path from `start`, in order; nodes from `stop` on are ends.

    The first 2^k nodes and a table of jumps over 2^k give as many more, so the rounds follow
    the logarithm of the path.
    """
    found = np.array([start] if start < stop else [], np.int64)
    while True:
        ahead = step[found]
        ahead = ahead[ahead < stop]
        if not len(ahead):
            return np.sort(found)
        found = np.concatenate([found, ahead])
        step = step[step]


def _wake(ts: np.ndarray, hold: np.ndarray) -> np.ndarray:
    """Index of the first later row at or after ts + hold."""
    later = np.searchsorted(ts, ts + hold, "left")
    return np.maximum(later, np.arange(1, len(ts) + 1))


_SUMMARY = (
    "begins bigint, discrete array<bigint>, discrete_until array<bigint>, upto array<bigint>, code array<bigint>, until array<bigint>"
)
_NODE = "__node"


@dataclass
class Transfer:
    """Exit state by entry state: of each discrete code, and of waiting until a time up to each bound of `upto`.

    Beyond the last bound nothing happens and the state is left as it was entered. `begins` is the time of the first row.
    """

    begins: int
    discrete: np.ndarray
    discrete_until: np.ndarray
    upto: np.ndarray
    code: np.ndarray
    until: np.ndarray

    @staticmethod
    def of(row) -> Transfer:
        return Transfer(int(row.begins), *[np.asarray(getattr(row, f.name), np.int64) for f in fields(Transfer)[1:]])

    def columns(self) -> dict[str, list]:
        return {f.name: [getattr(self, f.name)] for f in fields(Transfer)}

    def apply(self, code: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states of the entry states."""
        code, until = code.copy(), until.copy()
        small = code < len(self.discrete)
        at = np.searchsorted(self.upto, until, "left")
        waits = ~small & (at < len(self.upto))
        own, step = code[small], at[waits]
        code[small], until[small] = self.discrete[own], self.discrete_until[own]
        code[waits], until[waits] = self.code[step], self.until[step]
        return code, until

    def then(self, later: Transfer, max_hold: int) -> Transfer:
        """The function of this stretch of rows and the one after it."""
        discrete, discrete_until = later.apply(self.discrete, self.discrete_until)
        code, until = later.apply(self.code, self.until)
        # Waiting longer than this stretch lasts, a state meets only the later one.
        rest = len(later.upto) - (np.searchsorted(later.upto, self.upto[-1], "right") if len(self.upto) else 0)
        tail = slice(len(later.upto) - rest, None)
        upto = np.concatenate([self.upto, later.upto[tail]])
        code, until = np.concatenate([code, later.code[tail]]), np.concatenate([until, later.until[tail]])
        # No state is entered that waits longer than one hold time from the first row on.
        reach = int(np.searchsorted(upto, self.begins + max_hold, "left")) + 1
        upto, code, until = upto[:reach], code[:reach], until[:reach]
        last = np.append((code[1:] != code[:-1]) | (until[1:] != until[:-1]), True) if len(upto) else np.zeros(0, bool)
        return Transfer(self.begins, discrete, discrete_until, upto[last], code[last], until[last])


def _entries(summary: DataFrame, keys: list[str], chunks: int, start: tuple[int, int], max_hold: int) -> DataFrame:
    """(keys, chunk, __code, __until): the state in which every chunk of every key is entered.

    Up a binary tree pairs of functions are composed; down again a node's entry state is that of its left child, and
    what the left child makes of it is that of the right one. Each level is a shuffle of one row per key and node.
    """
    parts = [*keys, CHUNK]
    key_ddl = T.StructType([summary.schema[k] for k in parts]).toDDL()
    levels = max(1, (chunks - 1).bit_length())

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = pdf.sort_values(CHUNK)
        one = Transfer.of(pair.iloc[0])
        if len(pair) > 1:
            one = one.then(Transfer.of(pair.iloc[1]), max_hold)
        return pd.DataFrame({**{k: [pair[k].iloc[0]] for k in keys}, CHUNK: [pair[_NODE].iloc[0]], **one.columns()})

    def halve(entered: pd.DataFrame, pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values(CHUNK)
        code, until = np.array(entered["__code"]), np.array(entered["__until"])
        codes, untils = [code[0]], [until[0]]
        if len(pair) > 1:
            code, until = Transfer.of(pair.iloc[0]).apply(code, until)
            codes, untils = [*codes, code[0]], [*untils, until[0]]
        return pair[parts].assign(__code=codes, __until=untils)

    node = F.shiftright(F.col(CHUNK), 1).alias(_NODE)
    pairs = []
    level = summary
    for _ in range(levels):
        # Composing and coming back down group alike, so one shuffle of the functions serves both.
        pairs.append(level.select("*", node))
        level = pairs[-1].groupBy(*keys, _NODE).applyInPandas(compose, f"{key_ddl}, {_SUMMARY}")
    entry = level.select(*keys, F.col(CHUNK).alias(_NODE), F.lit(start[0]).cast("bigint").alias("__code"), F.lit(start[1]).cast("bigint").alias("__until"))
    for pair in reversed(pairs):
        by = [*keys, _NODE]
        down = entry.groupBy(*by).cogroup(pair.groupBy(*by)).applyInPandas(halve, f"{key_ddl}, __code bigint, __until bigint")
        entry = down.withColumnRenamed(CHUNK, _NODE)
    return entry.withColumnRenamed(_NODE, CHUNK)


def _replay(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunks: Chunks,
    summarise: Callable[[pd.DataFrame], Transfer],
    mark: Callable[[pd.DataFrame, int, int], pd.DataFrame],
    start: tuple[int, int],
    max_hold: int,
    out_schema: str,
) -> DataFrame:
    tagged = chunks.tag(df).withColumn("__us", micros(order[0]))
    parts = [*keys, CHUNK]
    key_ddl = T.StructType([tagged.schema[k] for k in parts]).toDDL()
    sort_by = ["__us", *order[1:]]

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: [pdf[k].iloc[0]] for k in parts}
        return pd.DataFrame({**head, **summarise(pdf.sort_values(sort_by)).columns()})

    def apply(pdf: pd.DataFrame, code: int = start[0], until: int = start[1]) -> pd.DataFrame:
        return mark(pdf.sort_values(sort_by), code, until)

    if not chunks.splits:
        return tagged.groupBy(*parts).applyInPandas(lambda pdf: apply(pdf), out_schema)

    def resume(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        return apply(pdf, int(entered["__code"].iloc[0]), int(entered["__until"].iloc[0]))

    summary = tagged.groupBy(*parts).applyInPandas(transfer, f"{key_ddl}, {_SUMMARY}")
    entry = _entries(summary, keys, len(chunks.splits) + 1, start, max_hold)
    # Both passes group by key and chunk, so Spark can reuse one shuffle of the rows.
    return tagged.groupBy(*parts).cogroup(entry.groupBy(*parts)).applyInPandas(resume, out_schema)


def hold_off(
    df: DataFrame, keys: list[str], order: list[str], hold_us: str, max_hold_us: int, chunks: Chunks, out: str
) -> DataFrame:
    """Mark the rows that are let through.

    A row goes through when at least the hold time of the last row that went
    through has passed; rows in between neither go through nor extend the wait.
    Returns keys, order, `hold_us` and the boolean `out`.
    """
    cols = [*keys, *order, hold_us]
    data = df.select(*cols)
    schema = T.StructType([data.schema[c] for c in cols]).toDDL() + f", `{out}` boolean"

    def summarise(pdf: pd.DataFrame) -> Transfer:
        ts, hold = pdf["__us"].to_numpy(), pdf[hold_us].to_numpy()
        n = len(ts)
        nxt = _wake(ts, hold)
        ends = _follow(np.where(nxt < n, nxt, np.arange(n)))
        upto, at = _steps(ts, ends, max_hold_us)
        until = ts[ends[at]] + hold[ends[at]]
        none = np.zeros(0, np.int64)
        return Transfer(int(ts[0]), none, none, upto, np.zeros(len(at), np.int64), until)

    def mark(pdf: pd.DataFrame, _: int, until: int) -> pd.DataFrame:
        ts, hold = pdf["__us"].to_numpy(), pdf[hold_us].to_numpy()
        n = len(ts)
        through = np.zeros(n, dtype=bool)
        through[_path(np.append(_wake(ts, hold), n), int(np.searchsorted(ts, until, "left")), n)] = True
        return pdf[cols].assign(**{out: through})

    return _replay(data, keys, order, chunks, summarise, mark, (0, NEVER), max_hold_us, schema)


@dataclass(frozen=True)
class BreakerRule:
    """Circuit-breaker transitions.

    Codes 0..T-1 are CLOSED with that many failures, T..T+H-1 HALF_OPEN with that
    many successes, T+H is OPEN until a time.
    """

    failure_threshold: int
    recovery_us: int
    half_open_max_calls: int
    reset_on_success: bool = True

    @property
    def open(self) -> int:
        return self.failure_threshold + self.half_open_max_calls

    def after(self, code: int, fail: bool) -> int:
        """State after a call that was let through."""
        closed = self.failure_threshold
        if fail:
            return code + 1 if code + 1 < closed else self.open
        if code < closed:
            return 0 if self.reset_on_success else code
        return 0 if code + 1 >= self.open else code + 1

    def name(self, code: int) -> str:
        return "CLOSED" if code < self.failure_threshold else "HALF_OPEN" if code < self.open else "OPEN"

    def walk(self, times: list[int], fails: list[bool], code: int, until: int) -> tuple[dict[str, list], int, int]:
        """Outputs per call, and the state that is left, from a starting state: row by row, for the few rows of a micro-batch."""
        out: dict[str, list] = {"state_before": [], "rejected": [], "state_after": [], "failure_count": []}
        for ts, fail in zip(times, fails, strict=True):
            if code == self.open and ts >= until:
                code = self.failure_threshold
            out["state_before"].append(self.name(code))
            out["rejected"].append(code == self.open)
            if code != self.open:
                code = self.after(code, fail)
                if code == self.open:
                    until = ts + self.recovery_us
            out["state_after"].append(self.name(code))
            out["failure_count"].append(min(code, self.failure_threshold))
        return out, code, until


BREAKER_COLUMNS = "state_before string, rejected boolean, state_after string, failure_count bigint"


def breaker(df: DataFrame, keys: list[str], order: list[str], failed: str, chunks: Chunks, rule: BreakerRule) -> DataFrame:
    """Circuit-breaker state around every call.

    Returns keys, order, `failed` and state_before, rejected, state_after, failure_count.
    """
    cols = [*keys, *order, failed]
    data = df.select(*cols)
    schema = f"{T.StructType([data.schema[c] for c in cols]).toDDL()}, {BREAKER_COLUMNS}"
    closed, n_codes = rule.failure_threshold, rule.open
    after = np.array([[rule.after(c, fails) for c in range(n_codes)] for fails in (False, True)])
    names = np.array([rule.name(c) for c in range(n_codes + 1)], object)

    def nodes(ts: np.ndarray, fail: np.ndarray) -> np.ndarray:
        """The next node of each: (row, code) is row * n_codes + code; then one end node per code, then one per tripping row."""
        n = len(ts)
        wake = _wake(ts, np.full(n, rule.recovery_us))
        end, trip = n * n_codes, n * n_codes + n_codes
        step = np.arange(trip + n)
        rows = np.arange(n)
        tripped = np.where(wake < n, wake * n_codes + closed, trip + rows)
        for c in range(n_codes):
            ok_to = (rows + 1) * n_codes + after[0, c]
            fail_to = tripped if after[1, c] == n_codes else (rows + 1) * n_codes + after[1, c]
            step[c:end:n_codes] = np.where(fail, fail_to, ok_to)
        return step

    def summarise(pdf: pd.DataFrame) -> Transfer:
        ts, fail = pdf["__us"].to_numpy(), pdf[failed].to_numpy(dtype=bool)
        n = len(ts)
        end = n * n_codes
        ends = _follow(nodes(ts, fail))
        until_of = np.concatenate([np.full(n_codes, NEVER), ts + rule.recovery_us])
        code_of = np.concatenate([np.arange(n_codes), np.full(n, n_codes)])
        first = ends[:n_codes] - end
        upto, at = _steps(ts, ends[closed:end:n_codes], rule.recovery_us)
        woken = ends[at * n_codes + closed] - end
        return Transfer(int(ts[0]), code_of[first], until_of[first], upto, code_of[woken], until_of[woken])

    def mark(pdf: pd.DataFrame, code: int, until: int) -> pd.DataFrame:
        ts, fail = pdf["__us"].to_numpy(), pdf[failed].to_numpy(dtype=bool)
        n = len(ts)
        begin = int(np.searchsorted(ts, until, "left")) * n_codes + closed if code == n_codes else code
        path = _path(nodes(ts, fail), begin, n * n_codes) if begin < n * n_codes else np.zeros(0, np.int64)
        # Rows that the path leaves out come while the circuit is open.
        before = np.full(n, n_codes)
        before[path // n_codes] = path % n_codes
        through = before < n_codes
        left = before.copy()
        left[through] = after[fail[through].astype(int), before[through]]
        return pdf[cols].assign(
            state_before=names[before], rejected=~through, state_after=names[left], failure_count=np.minimum(left, closed)
        )

    return _replay(data, keys, order, chunks, summarise, mark, (0, NEVER), rule.recovery_us, schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a pandas function batch by batch; rows keep their own order key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
