"""Spark data source for .npy arrays: one row per array row."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 4096


class RowRange(InputPartition):
    """Rows [start, stop) of one file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _open(path: str):
    """File system of a path or URI (local, HDFS, S3, GCS), and the path in it."""
    from pyarrow import fs

    plain = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(plain if re.match("[a-z0-9]+://", plain) else os.path.abspath(plain))


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and type; the file is left at the data."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(file)
    if dtype.hasobject:
        raise ValueError("arrays of pickled objects are refused")
    if len(shape) not in (1, 2):
        raise ValueError(f"the array has {len(shape)} dimensions; 1 or 2 are read")
    return shape, fortran, dtype


class NpyReader(DataSourceReader):
    """Splits files into row ranges; a task reads only the bytes of its own rows."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("npy needs a path")
        self.path = options["path"]
        self.rows = int(options.get("rowspersplit", 1_000_000))

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, path = _open(self.path)
        folder, _, pattern = path.rpartition("/")
        if store.get_file_info(path).type == fs.FileType.Directory:
            folder, pattern = path, "*.npy"
        found = [x.path for x in store.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True)) if fnmatch.fnmatch(x.base_name, pattern)]
        if not found:
            raise FileNotFoundError(self.path)
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        store, _ = _open(self.path)
        out = []
        for f in self._files():
            with store.open_input_file(f) as file:
                n = _header(file)[0][0]
            out += [RowRange(f, s, min(s + self.rows, n)) for s in range(0, max(n, 1), self.rows)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as file:
            shape, fortran, dtype = _header(file)
            at, width = file.tell(), shape[1] if len(shape) == 2 else 1
            for start in range(partition.start, partition.stop, BATCH_ROWS):
                stop = min(start + BATCH_ROWS, partition.stop)
                if fortran and width > 1:
                    columns = [
                        np.frombuffer(file.read_at((stop - start) * dtype.itemsize, at + (j * shape[0] + start) * dtype.itemsize), dtype)
                        for j in range(width)
                    ]
                    block = np.stack(columns, axis=1)
                else:
                    raw = file.read_at((stop - start) * width * dtype.itemsize, at + start * width * dtype.itemsize)
                    block = np.frombuffer(raw, dtype).reshape(stop - start, width)
                block = block.astype("float64")
                offsets = pa.array(np.arange(0, (stop - start) * width + 1, width, dtype="int32") if width else np.zeros(stop - start + 1, "int32"))
                values = pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))
                names = pa.array([partition.path] * (stop - start))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(start, stop)), values], ["file", "row_id", "values"])


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(file, glob or folder)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row_id bigint, values array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, **options):
    """Register the source and read; arrays of pickled objects are refused."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").options(**options).load(path)
