"""Checksums of files of any size: a tree of digests over blocks, hashed by tasks that read byte ranges.

A plain digest reads a file from its start to its end in one place. Here each block of BLOCK bytes has a digest of its own; the
digests of FAN neighbours, one after another, are digested again, and so on until one is left. The result
depends on the content only, not on the ranges that tasks read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetgauge.functions.crypto import checksum
from fleetgauge.sources.files import open_store, sized_files

BLOCK = 8 << 20
FAN = 1024
#: Bytes of a range, rounded to whole blocks.
RANGE_BYTES = 256 << 20
READ = 1 << 20
ALGORITHMS = ("sha256", "md5")


def tree_digest(blocks: Iterator[bytes], algorithm: str = "sha256", fan: int = FAN) -> str:
    """The rule in plain Python: hex digest of the blocks of a file; a file without bytes is one empty block."""
    level = [hashlib.new(algorithm, b).digest() for b in blocks] or [hashlib.new(algorithm).digest()]
    while True:
        level = [hashlib.new(algorithm, b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0].hex()


class BlockRange(InputPartition):
    """Blocks [first, stop) of one file."""

    def __init__(self, path: str, size: int, first: int, stop: int):
        self.path, self.size, self.first, self.stop = path, size, first, stop


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("block digests need a path")
        self.path, self.algorithm = options["path"], options.get("algorithm", "sha256")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unsupported checksum algorithm: {self.algorithm}")
        self.block = int(options.get("blockbytes", BLOCK))
        self.each = max(1, int(options.get("rangebytes", RANGE_BYTES)) // self.block)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in sized_files(self.path):
            n = max(1, -(-size // self.block))
            out += [BlockRange(path, size, i, min(i + self.each, n)) for i in range(0, n, self.each)]
        return out

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        digests = []
        with store.open_input_file(partition.path) as file:
            for i in range(partition.first, partition.stop):
                at, end = i * self.block, min((i + 1) * self.block, partition.size)
                own = hashlib.new(self.algorithm)
                while at < end:
                    piece = file.read_at(min(READ, end - at), at)
                    if not piece:
                        raise OSError(f"{partition.path} is shorter than the {partition.size} bytes it had when it was listed")
                    own.update(piece)
                    at += len(piece)
                digests.append(own.digest())
        n = len(digests)
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * n), pa.array([partition.size] * n, pa.int64()), pa.array(range(partition.first, partition.stop), pa.int64()), pa.array(digests, pa.binary())],
            names=["path", "size", "block", "digest"],
        )


class BlockDigestSource(DataSource):
    """spark.read.format("blockdigest").load(file, glob or folder): a row per block."""

    @classmethod
    def name(cls) -> str:
        return "blockdigest"

    def schema(self) -> str:
        return "path string, size bigint, block bigint, digest binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def file_checksums(
    spark: SparkSession, path: str, algorithm: str = "sha256", block_bytes: int = BLOCK, range_bytes: int = RANGE_BYTES, fan: int = FAN
) -> DataFrame:
    """(path, size, blocks, checksum) of a file, a glob or a folder's files, whatever their sizes.

    Digests go up the tree in as many shuffles as it is high (two for files up to 8 TB); a group has at most `fan` of them.
    """
    spark.dataSource.register(BlockDigestSource)
    options = {"algorithm": algorithm, "blockbytes": block_bytes, "rangebytes": range_bytes}
    level = spark.read.format("blockdigest").options(**options).load(path)
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block_bytes))).cast("bigint")
    level = level.select("path", "size", count.alias("blocks"), F.col("block").alias("at"), "digest")
    most = max(1, *(-(-size // block_bytes) for _, size in sized_files(path)))
    left = most
    step = 0
    while step == 0 or left > 1:
        # A file whose tree is lower has a single digest already, which stays as it is.
        below = F.ceil(F.col("blocks") / F.lit(fan**step))
        grouped = level.withColumn("done", (below <= 1) & F.lit(step > 0)).groupBy(
            "path", "size", "blocks", "done", F.floor(F.col("at") / fan).alias("at")
        ).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda all_, one: F.concat(all_, one))
        digest = F.when(F.col("done"), F.get("parts", F.lit(0))).otherwise(F.unhex(checksum(joined, algorithm)))
        level = grouped.select("path", "size", "blocks", "at", digest.alias("digest"))
        left, step = -(-left // fan), step + 1
    return level.select("path", "size", "blocks", F.lower(F.hex("digest")).alias("checksum"))
