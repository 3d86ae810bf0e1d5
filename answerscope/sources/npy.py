"""``.npy`` tensors as a data source: byte ranges of the files are read by tasks of their own.

The driver lists the files and reads their headers only. Paths are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20  # read by one task
BATCH_BYTES = 4 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    begin: int  # byte at which the values start


def read_header(stream) -> Header:
    version = np.lib.format.read_magic(stream)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if fortran or dtype.kind not in "fiub" or len(shape) < 2:
        raise ValueError(f"a numeric tensor of two axes or more in C order is wanted, not {dtype} {shape}, fortran_order {fortran}")
    return Header(shape, dtype, stream.tell())


@dataclass
class Vectors(InputPartition):
    """Vectors ``first`` to ``end`` of a file whose first axis starts at ``offset`` of the whole tensor."""

    path: str
    header: Header
    offset: int
    first: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, axes: Sequence[str], schema, range_bytes: int):
        self.path, self.axes, self.range_bytes = path, list(axes), range_bytes
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[Vectors]:
        files, root = _opened(self.path)
        found = sorted((i for i in files.get_file_info(pafs.FileSelector(root, recursive=True)) if i.path.endswith(".npy") and i.type == pafs.FileType.File), key=lambda i: i.path)
        out, offset, tail = [], 0, None
        for info in found:
            with files.open_input_file(info.path) as stream:
                header = read_header(stream)
            if len(header.shape) != len(self.axes) + 1 or tail not in (None, header.shape[1:]):
                raise ValueError(f"{info.path} has shape {header.shape}; {len(self.axes)} named axes and one of values are wanted, equal in all files but the first")
            tail = header.shape[1:]
            width = header.shape[-1] * header.dtype.itemsize
            n, step = int(np.prod(header.shape[:-1])), max(1, self.range_bytes // max(1, width))
            if info.size < header.begin + n * width:
                raise ValueError(f"{info.path} ends before its last vector")
            out += [Vectors(info.path, header, offset, a, min(n, a + step)) for a in range(0, n, step)]
            offset += header.shape[0]
        return out

    def read(self, partition: Vectors) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        header, dim = partition.header, partition.header.shape[-1]
        width = dim * header.dtype.itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as stream:
            for a in range(partition.first, partition.end, step):
                b = min(partition.end, a + step)
                stream.seek(header.begin + a * width)
                values = np.frombuffer(stream.read((b - a) * width), header.dtype).astype(np.float32)
                index = list(np.unravel_index(np.arange(a, b), header.shape[:-1]))
                index[0] = index[0] + partition.offset
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * dim), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int64)) for i in index), vectors], names=self.names)


class NpySource(DataSource):
    """Options: ``path`` of a folder, ``axes`` (comma-joined names of the leading axes), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ", ".join(f"`{a}` long" for a in self.options["axes"].split(",")) + ", h array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], self.options["axes"].split(","), schema, int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_npy(spark: SparkSession, path: str, axes: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ``.npy`` files below ``path`` -> one row per vector along the last axis.

    ``axes`` names the leading axes; the first one counts across files in path order. A folder
    without files gives no rows, files of unlike shapes or cut files fail the read.
    """
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("axes", ",".join(axes)).option("rangeBytes", range_bytes).load(path)


def write_npy(df: DataFrame, path: str, column: str = "h") -> int:
    """Vectors of one length as one ``.npy`` block for each task, written beside and moved; returns the number of vectors.

    A task that runs again replaces its block. Null vectors are left out.
    """

    def run(batches):
        parts = [np.asarray(b.column(0).flatten(), np.float32).reshape(len(b), -1) for b in batches if len(b)]
        if not parts:
            return
        files, root = _opened(path)
        files.create_dir(root, recursive=True)
        context, held = TaskContext.get(), io.BytesIO()
        np.save(held, np.concatenate(parts))
        name = f"{root}/block-{context.partitionId():06d}"
        with files.open_output_stream(f"{name}.{context.taskAttemptId()}.part") as stream:
            stream.write(held.getbuffer())
        files.move(f"{name}.{context.taskAttemptId()}.part", f"{name}.npy")
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, parts))], pa.int64())], names=["n"])

    counts = df.where(df[column].isNotNull()).select(df[column].cast("array<float>").alias("h")).mapInArrow(run, "n long")
    return counts.groupBy().sum("n").first()[0] or 0
