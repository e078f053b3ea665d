"""Chat templates at token level.

Roles and texts are encoded one by one and joined with reserved ids that no text can
produce, so nothing a user writes can pass for a turn. Where the result is shown as a string, control
strings inside texts are escaped. Loss masks follow from running sums of the segments' lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetgauge.llm import tokencount
from fleetgauge.llm.common import slices

#: Control strings of the template, and the ids behind the vocabulary reserved for them.
BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"
RESERVED = {BEGIN: 50256, TURN: 50257, TEXT: 50258, END: 50259}
#: Control strings of common templates (fixed values); in texts these are escaped too.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
ESCAPE = "\\"


def escape(text: str) -> str:
    """Reversible: the escape sign is doubled, and put behind the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in (*RESERVED, *FOREIGN):
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _segments(turns: DataFrame, role: Column, text: Column, vocabulary: str, splits: str) -> DataFrame:
    """Turns with the ids of role and text, and the length of the turn as a string."""
    own = turns.select("__conv", "__turn", role.alias("role"), text.alias("text"))
    added = "role_ids array<int>, text_ids array<int>, chars bigint, learn boolean"
    schema = StructType(own.schema.fields[:2] + StructType.fromDDL(added).fields)
    fixed = len(TURN) + len(TEXT) + len(END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                roles = part.column(2).to_pylist()
                safe = [[escape(x) for x in column] for column in (roles, part.column(3).to_pylist())]
                ids = [pa.array([tokencount.encode(x, vocabulary, splits) for x in column], kind) for column in safe]
                chars = pa.array([len(r) + len(t) + fixed for r, t in zip(*safe, strict=True)], pa.int64())
                learn = pa.array([r == "assistant" for r in roles], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ids, chars, learn], names=schema.names)

    return own.mapInArrow(run, schema)


def assemble(segments: list[tuple[list[int], list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation from (role ids, text ids, learned) of its turns.

    The pieces are laid out one after another; running sums of their lengths give where each
    begins, +1 at the beginning and -1 at the end of a learned one, and the running sum of these is the mask.
    """
    pieces: list[list[int]] = [[RESERVED[BEGIN]]]
    learned = [False]
    for role, text, learn in segments:
        pieces += [[RESERVED[TURN]], role, [RESERVED[TEXT]], text, [RESERVED[END]]]
        learned += [False, False, False, learn, learn]
    ends = np.cumsum([len(p) for p in pieces])
    change = np.zeros(ends[-1] + 1, np.int64)
    mark = np.array(learned)
    starts = np.concatenate([[0], ends[:-1]])
    np.add.at(change, starts[mark], 1)
    np.add.at(change, ends[mark], -1)
    return np.concatenate([np.array(p, np.int32) for p in pieces]), np.cumsum(change)[:-1] > 0


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         vocabulary: str | None = None, splits: str | None = None) -> DataFrame:
    """One row per conversation: its id, ids, loss_mask (per id) and formatted_chars.

    Turns are ordered by `turn` (null first), equal ones by the ids of role and text, so the result is
    the same for any order of rows; repeated rows are turns of their own. Null role or text is
    empty. Rows without a conversation id form one conversation. The mask covers the text and the end
    mark of turns whose role is `assistant`. formatted_chars is the length, in code points, of the
    conversation as a string, with control strings in roles and texts escaped.

    Turns are encoded before they are brought together, so only ids are shuffled and a long
    conversation is encoded by many tasks. A conversation is one row of the result.
    """
    path, split = vocabulary or tokencount.vocabulary_path(), splits or tokencount.pattern()
    named = turns.select(F.col(f"`{conversation}`").alias("__conv"), F.col(f"`{turn}`").alias("__turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = _segments(named, some("role"), some("text"), path, split)
    each = F.struct("__turn", "role_ids", "text_ids", "learn")
    together = parts.groupBy("__conv").agg(F.sort_array(F.collect_list(each)).alias("turns"), (F.sum("chars") + len(BEGIN)).alias("chars"))
    own = together.select("__conv", "turns", "chars")
    schema = StructType([StructField(conversation, own.schema["__conv"].dataType), *StructType.fromDDL("ids array<int>, loss_mask array<boolean>, formatted_chars bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                made = [assemble([(t["role_ids"], t["text_ids"], t["learn"]) for t in x]) for x in part.column(1).to_pylist()]
                arrays = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, part.column(2)], names=schema.names)

    return own.mapInArrow(run, schema)


def read_back(formatted: DataFrame, vocabulary: str | None = None, splits: str | None = None) -> DataFrame:
    """All columns and turns (role, text) and loss_texts, recovered from ids and loss_mask alone.

    Reserved ids part the segments, whose bytes are decoded and unescaped. loss_texts has the text of
    each run of masked ids, reserved ids aside.
    """
    path, split = vocabulary or tokencount.vocabulary_path(), splits or tokencount.pattern()
    added = StructType.fromDDL("turns array<struct<role: string, text: string>>, loss_texts array<string>").fields
    schema = StructType(formatted.schema.fields + added)
    at, mask_at = formatted.columns.index("ids"), formatted.columns.index("loss_mask")

    def turns_of(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[list[dict], list[str]]:
        marks = np.flatnonzero(ids >= min(RESERVED.values()))
        text = lambda a, b: unescape(decode(ids[a:b].tolist()))
        found, learned = [], []
        for i in np.flatnonzero(ids[marks] == RESERVED[TURN]):
            a, b, c = marks[i : i + 3]
            found.append({"role": text(a + 1, b), "text": text(b + 1, c)})
        change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        for a, b in zip(change[::2], change[1::2], strict=True):
            # Learned turns may touch: their end marks part them.
            for own in np.split(np.arange(a, b), np.flatnonzero(ids[a:b] == RESERVED[END]) + 1):
                plain = own[ids[own] < min(RESERVED.values())] if len(own) else own
                if len(own):
                    learned.append(unescape(decode(ids[plain].tolist())))
        return found, learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = tokencount.encoder(path, split)
        decode = lambda ids: own.decode_bytes(ids).decode()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                both = zip(part.column(at).to_pylist(), part.column(mask_at).to_pylist(), strict=True)
                made = [turns_of(np.array(i, np.int64), np.array(m, bool), decode) for i, m in both]
                arrays = [pa.array([m[k] for m in made], t) for k, t in ((0, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), (1, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    return formatted.mapInArrow(run, schema)
