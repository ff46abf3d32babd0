"""Arrays of numbers in ``.npy`` files, read by row ranges: a file is many tasks, whatever its size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _files(path: str) -> tuple:
    """The file system of a path and its ``.npy`` files: itself, or those of the folder."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(place))
        return store, sorted(f.path for f in inside if f.path.endswith(".npy"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return store, [place]


@dataclass
class RowRange(InputPartition):
    """Rows of one file, and where their bytes begin."""

    file: str
    first: int
    count: int
    offset: int
    width: int
    kind: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[RowRange]:
        store, files = _files(self.path)
        out = []
        for name in files:
            with store.open_input_file(name) as f:
                version = np.lib.format.read_magic(f)
                shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                begin = f.tell()
            if kind.kind not in "biuf" or by_column or not 1 <= len(shape) <= 2:
                raise ValueError(f"{name}: rows of numbers are needed, not {kind} of shape {shape}{' by column' if by_column else ''}")
            width = shape[1] if len(shape) == 2 else 1
            for first in range(0, shape[0], self.rows):
                out.append(RowRange(name, first, min(self.rows, shape[0] - first), begin + first * width * kind.itemsize, width, kind.str))
        # Spark asks for one partition at least.
        return out or [RowRange("", 0, 0, 0, 1, "<f8")]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = _files(self.path)
        kind = np.dtype(partition.kind)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.offset)
            for lo in range(0, partition.count, 8192):
                n = min(8192, partition.count - lo)
                values = np.frombuffer(f.read(n * partition.width * kind.itemsize), kind).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(partition.first + lo + np.arange(n)), lists], ["file", "row", "values"])


class NpyRows(DataSource):
    """Format ``npy_rows``: (file, row, values) of a ``.npy`` file or a folder of them; option ``rows``: rows of a task."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", "262144")))


def array_rows(spark: SparkSession, path: str, rows: int = 262_144) -> DataFrame:
    """(file, row, values) of ``.npy`` files of numbers with one or two dimensions; ``rows`` of them a task."""
    spark.dataSource.register(NpyRows)
    return spark.read.format("npy_rows").option("rows", rows).load(path)
