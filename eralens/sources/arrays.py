"""Stored NumPy arrays (.npy, and .npz archives) as tables.

Registered as a Python data source: ``spark.read.format("numpy").option("arrays", "x,y").load(path)``.
A row is an index along the first axis, ``row``, with one column per array of the file: a number
for arrays of one dimension, a list for arrays of two. Files are cut into ranges of rows from
the arrays' headers alone; a task reads its range and no more (a stored member of an archive
is read from its place, a compressed one is unpacked up to the range). Arrays that are not
named are not read.

Paths must be readable by Python on every executor (a shared mount), as NumPy's own files are."""

from __future__ import annotations

import ast
import glob
import os
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES = 32 << 20
BATCH_ROWS = 8192
FILE_ROWS, FILE_BYTES = 1 << 18, 64 << 20     # an archive is full at either
SQL_TYPES = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "b1": "boolean"}
WIDER = {"u1": "<i2", "u2": "<i4", "u4": "<i8"}
MAGIC = b"\x93NUMPY"


@dataclass
class Header:
    """What an array's file says before its data."""

    dtype: np.dtype
    shape: tuple[int, ...]
    size: int                     # bytes before the data

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def read_header(f) -> Header:
    start = f.read(8)
    if start[:6] != MAGIC:
        raise ValueError("not a stored array")
    wide = start[6] > 1
    n = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
    said = ast.literal_eval(f.read(n).decode("utf-8" if start[6] > 2 else "latin-1"))
    if said["fortran_order"] and len(said["shape"]) > 1:
        raise ValueError("arrays stored by columns are not supported")
    dtype = np.dtype(said["descr"])
    if dtype.str[1:] not in SQL_TYPES or not 1 <= len(said["shape"]) <= 2:
        raise ValueError(f"no column for arrays of {dtype} with {len(said['shape'])} dimensions")
    return Header(dtype, said["shape"], n + (12 if wide else 10))


def members(path: str) -> dict[str, Header]:
    """Names and headers of the arrays in a file; a .npy file's array is named after the file."""
    if not path.endswith(".npz"):
        with open(path, "rb") as f:
            return {os.path.splitext(os.path.basename(path))[0]: read_header(f)}
    out = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            with z.open(name) as f:
                out[name.removesuffix(".npy")] = read_header(f)
    return out


def rows_of(path: str, name: str, first: int, stop: int) -> np.ndarray:
    """Rows first..stop of one array."""
    def take(f, header):
        f.seek(header.size + first * header.row_bytes)
        data = f.read((stop - first) * header.row_bytes)
        return np.frombuffer(data, header.dtype).reshape(stop - first, *header.shape[1:])

    if not path.endswith(".npz"):
        with open(path, "rb") as f:
            return take(f, read_header(f))
    with zipfile.ZipFile(path) as z, z.open(name + ".npy") as f:
        return take(f, read_header(f))


def as_column(x: np.ndarray) -> pa.Array:
    x = x.astype(WIDER.get(x.dtype.str[1:], x.dtype.newbyteorder("=")))
    flat = pa.array(np.ascontiguousarray(x).ravel())
    return flat if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    stop: int


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numpy"

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file:")
        found = sorted(p for k in ("*.npz", "*.npy") for p in glob.glob(os.path.join(path, k))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def wanted(self) -> dict[str, Header]:
        held = members(self.files()[0])
        asked = [n.strip() for n in self.options.get("arrays", ",".join(held)).split(",")]
        missing = [n for n in asked if n not in held]
        if missing:
            raise ValueError(f"no array named {', '.join(missing)}; there are {', '.join(held)}")
        return {n: held[n] for n in asked}

    def schema(self) -> str:
        kind = lambda h: SQL_TYPES[h.dtype.str[1:]] if len(h.shape) == 1 else f"array<{SQL_TYPES[h.dtype.str[1:]]}>"
        return ", ".join(["file string", "row bigint", *(f"`{n}` {kind(h)}" for n, h in self.wanted().items())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.files(), list(self.wanted()), int(self.options.get("rangeBytes", RANGE_BYTES)))


class ArrayReader(DataSourceReader):
    def __init__(self, files: list[str], names: list[str], range_bytes: int):
        self.files, self.names, self.range_bytes = files, names, range_bytes

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files:
            held = members(path)
            lengths = {held[n].shape[0] for n in self.names}
            if len(lengths) != 1:
                raise ValueError(f"arrays of {path} have different lengths")
            n = lengths.pop()
            each = max(1, self.range_bytes // max(1, sum(held[x].row_bytes for x in self.names)))
            out += [Range(path, a, min(n, a + each)) for a in range(0, n, each)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held = [rows_of(partition.path, n, partition.first, partition.stop) for n in self.names]
        for a in range(0, partition.stop - partition.first, BATCH_ROWS):
            columns = [as_column(x[a:a + BATCH_ROWS]) for x in held]
            n = len(columns[0])
            rows = pa.array(np.arange(partition.first + a, partition.first + a + n))
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(partition.path)] * n), rows, *columns], names=["file", "row", *self.names])


def write_arrays(df: DataFrame, path: str, compress: bool = False, file_rows: int = FILE_ROWS) -> DataFrame:
    """Archives (.npz) of up to ``file_rows`` rows and some ``FILE_BYTES``, with an array for each column (numbers, or lists
    of equal length; no nulls). A task holds one archive's rows at a time. Returns ``file, rows``,
    one row per archive. A task that is run again replaces its files."""
    names = df.columns

    def run(batches):
        from pyspark import TaskContext

        part, own = f"part-{TaskContext.get().partitionId():05d}", f".{TaskContext.get().taskAttemptId()}"

        def store(number, held):
            table = pa.Table.from_batches(held).combine_chunks()
            arrays = {}
            for n, column in zip(names, table.columns):
                column = column.combine_chunks()
                if column.null_count:
                    raise ValueError(f"column {n} has nulls")
                lists = pa.types.is_list(column.type)
                arrays[n] = (column.flatten() if lists else column).to_numpy(zero_copy_only=False).reshape(*([len(column), -1] if lists else [-1]))
            os.makedirs(path, exist_ok=True)
            place = os.path.join(path, f"{part}-{number:05d}.npz")
            with open(place + own, "wb") as f:
                (np.savez_compressed if compress else np.savez)(f, **arrays)
            os.replace(place + own, place)
            return pa.RecordBatch.from_arrays([pa.array([os.path.basename(place)]), pa.array([table.num_rows])], names=["file", "rows"])

        held, n, size, files = [], 0, 0, 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, file_rows - n)
                held.append(taken)
                n, batch = n + taken.num_rows, batch.slice(taken.num_rows)
                size += taken.nbytes
                if n == file_rows or size >= FILE_BYTES:
                    yield store(files, held)
                    held, n, size, files = [], 0, 0, files + 1
        if held:
            yield store(files, held)
            files += 1
        while os.path.exists(stale := os.path.join(path, f"{part}-{files:05d}.npz")):    # of a run with more rows
            os.remove(stale)
            files += 1

    path = path.removeprefix("file:")
    return df.mapInArrow(run, "file string, rows bigint")


def read_arrays(spark: SparkSession, path: str, arrays: list[str] | None = None, **options) -> DataFrame:
    """Rows of the named arrays (all, if none are named) of the files at ``path``."""
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("numpy").options(**options)
    return (reader.option("arrays", ",".join(arrays)) if arrays else reader).load(path)
