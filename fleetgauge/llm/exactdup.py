"""Equal texts by naming blocks with integers: built-in functions only.

1. A text is cut into blocks of fixed size. The distinct blocks of all texts are sorted and numbered:
   a number is the name of one block and of no other.
2. Adjacent names are paired, and the distinct pairs sorted and numbered in the same way. A text has half as
   many names after each round, and in the end a single one, which texts of the same length in
   blocks share if they are equal and only then.
3. Rows with the same name are one group.

A block's name goes back to the texts by an address, a short digest of the block, so the blocks are shuffled
once, without their copies. That no two blocks have the same address is checked over all of them, and
other addresses are drawn if they do: names are never a matter of chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import apart, stored

#: Bytes of a block.
BLOCK_BYTES = 2048


def address(block: Column, draw: int) -> Column:
    """16 bytes that tell blocks apart but for rare chances; each draw has its own."""
    return F.unhex(F.md5(F.concat(F.lit(f"{draw}:").cast("binary"), block)))


def blocks(text: Column, size: int) -> Column:
    """The UTF-8 bytes of a text in blocks of `size` bytes; null or empty text is one empty block."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows, sorted in each partition and numbered from 1 without repeats."""
    return distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id() + 1)


def _block_names(docs: DataFrame, text: str, size: int, draw: int, addressed: Callable[[Column, int], Column]) -> DataFrame:
    """(at, name) of every distinct block."""
    distinct = docs.select(F.explode(blocks(F.col(f"`{text}`"), size)).alias("block")).distinct()
    return stored(_named(distinct, ["block"], "name").select(addressed(F.col("block"), draw).alias("at"), "name"), "names")


def identities(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None, size: int = BLOCK_BYTES,
    addressed: Callable[[Column, int], Column] = address,
) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` under numbers of their own, and the identity of each row's text.

    The first table has row, text_sha256 and carried (a struct of the columns in `carry`); the second has row, level
    and name. Two rows have the same level and name if and only if their texts are equal; null counts as empty.
    `addressed` gives the address of a block for the n-th draw.
    """
    draw = 0
    names = _block_names(docs, text, size, draw, addressed)
    while not names.groupBy("at").count().where("count > 1").isEmpty():
        draw += 1
        names = _block_names(docs, text, size, draw, addressed)

    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    columns = docs.columns if carry is None else carry
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.sha2(raw, 256).alias("text_sha256"),
        F.transform(blocks(F.col(f"`{text}`"), size), lambda b: addressed(b, draw)).alias("at"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("carried"),
    ), "rows")
    longest = rows.agg(F.max(F.size("at"))).first()[0] or 0

    cells = rows.select("row", F.size("at").alias("n"), F.posexplode("at").alias("pos", "at"))
    cells = stored(cells.join(names, "at").select("row", "n", "pos", "name"), "cells")
    level, found = 0, []
    while True:
        found.append(cells.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = cells.where("n > 1").groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"),  # names begin at 1: an odd one out pairs with 0
        )
        pairs = stored(pairs, "pairs")
        names = stored(_named(pairs.select("a", "b").distinct(), ["a", "b"], "name"), "names")
        cells = pairs.join(names, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
        cells = stored(cells, "cells")
        longest = -(-longest // 2)
        level += 1
    every = found[0]
    for one in found[1:]:
        every = every.unionAll(one)
    return rows.select("row", "text_sha256", "carried"), every


def _grouped(docs: DataFrame, text: str, key: str, carry: list[str], size: int, addressed: Callable[[Column, int], Column]) -> DataFrame:
    extra = [c for c in carry if c != key]
    rows, names = identities(docs, text, [key, *extra], size, addressed)
    ids = rows.select("row", "text_sha256", F.col(f"carried.`{key}`").alias("id"), "carried")
    named = stored(names.join(ids.select("row", "id"), "row"), "identities")
    groups = named.groupBy("level", "name").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size"))
    member = named.join(apart(groups, "name"), ["level", "name"])
    member = member.select("row", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"))
    return ids.join(member, "row")


def exact_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = BLOCK_BYTES,
    addressed: Callable[[Column, int], Column] = address,
) -> DataFrame:
    """doc_id (the name of `key`), keep_id, group_size, kept and text_sha256 of every row of `docs`.

    Rows whose texts are the same bytes form a group; the row with the largest id stays, which keep_id names.

    Null text is empty text. Empty texts form a group like any other. Of rows that repeat the largest id exactly
    one stays; a row without an id stays only if none of its group has one. An empty table gives an empty one.
    Columns of `docs` other than the two aren't read, whatever their names.

    All rounds shuffle integers; texts are shuffled once, block by block and without copies, to number the blocks.
    There are as many rounds as the longest text has doublings of a block. Blocks and names that a
    third of the rows hold are skewed join keys, which adaptive execution splits.
    """
    found = _grouped(docs, text, key, [], size, addressed)
    return found.select(F.col("id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = BLOCK_BYTES,
    addressed: Callable[[Column, int], Column] = address,
) -> DataFrame:
    """Rows of `docs`, all columns as they are, without those that `exact_copies` doesn't keep."""
    found = _grouped(docs, text, key, docs.columns, size, addressed).where("kept")
    return found.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
