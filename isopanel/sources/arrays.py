"""NumPy files as tables: vectors in .npy and sparse matrices (CSR) in .npz, as partitioned data sources.

Reading: headers are parsed once on the driver, a few hundred bytes of each file. Ranges of rows become partitions, and
a task seeks to its own bytes: in .npy rows lie at fixed offsets (columns, in Fortran order), in .npz a range of rows
is a span of indptr, whose ends a search in the file finds so that partitions hold about as many entries each. A
member that is deflated can't be entered in the middle, so such a file is one partition and streams.

Writing: each task writes files of a bounded size, complete when they appear under their name, and the driver's commit
names them in order in FILES; only files named there are read, so what failed tasks leave behind does no harm. A
folder without FILES, or a single file, is read as it is, in the order of names.

Files are opened by pyarrow's file systems, so a path may be local or name a store that these know.
"""

from __future__ import annotations

import io
import json
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FILES = "_files.json"
#: Bytes of a partition that is read, of a file that is written, and of a batch between Python and Spark.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 64 << 20, 4 << 20
#: In a member's own header: where the lengths of its name and its extra field are, which come before its bytes.
LOCAL_LENGTHS = 26
VECTORS, ENTRIES = "row bigint, v array<double>", "row bigint, col bigint, value double"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and the path in it; file:/x counts as file:///x."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def _names(system: pyarrow.fs.FileSystem, path: str, ending: str) -> list[str]:
    """Files below a path in their order."""
    info = system.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if system.get_file_info(f"{path}/{FILES}").type == pyarrow.fs.FileType.File:
        with system.open_input_file(f"{path}/{FILES}") as file:
            return [f"{path}/{name}" for name in json.loads(file.read())]
    return sorted(x.path for x in system.get_file_info(pyarrow.fs.FileSelector(path)) if x.path.endswith(ending))


class Header(NamedTuple):
    """Of an array in the .npy format: where its numbers begin, and how they lie."""

    start: int
    dtype: str
    shape: tuple[int, ...]
    fortran: bool

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def header(file: Any) -> Header:
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(file)
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"arrays of numbers are read, not of {dtype}")
    return Header(file.tell(), dtype.str, shape, fortran)


def _numbers(file: Any, known: Header, start: int, n: int) -> np.ndarray:
    """n numbers from the start-th on, as they lie in the file."""
    dtype = np.dtype(known.dtype)
    file.seek(known.start + start * dtype.itemsize)
    data = file.read(n * dtype.itemsize)
    if len(data) < n * dtype.itemsize:
        raise ValueError("an array's file ends early")
    return np.frombuffer(data, dtype)


def _rows(file: Any, known: Header, low: int, high: int) -> np.ndarray:
    """Rows of a matrix; of one in Fortran order a piece of each column."""
    if known.fortran and known.width > 1:
        return np.stack([_numbers(file, known, c * known.rows + low, high - low) for c in range(known.width)], axis=1)
    return _numbers(file, known, low * known.width, (high - low) * known.width).reshape(high - low, known.width)


@dataclass
class Part(InputPartition):
    path: str
    low: int
    high: int
    first: int
    """The number of the file's first row among all rows."""

    def __post_init__(self) -> None:
        self.value = (self.path, self.low, self.high, self.first)


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        parts: list[InputPartition] = []
        first = 0
        for name in _names(system, path, ".npy"):
            with system.open_input_file(name) as file:
                known = header(file)
            each = max(1, self.split // max(1, known.width * np.dtype(known.dtype).itemsize))
            parts += [Part(name, low, min(low + each, known.rows), first) for low in range(0, known.rows, each)]
            first += known.rows
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        if partition.low == partition.high:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            known = header(file)
            each = max(1, BATCH_BYTES // max(1, 8 * known.width))
            for low in range(partition.low, partition.high, each):
                high = min(low + each, partition.high)
                values = _rows(file, known, low, high).astype(np.float64)
                offsets = pa.array(np.arange(high - low + 1) * known.width, pa.int32())
                vectors = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high) + partition.first), vectors], names=["row", "v"])


class Span:
    """The bytes of a stored member. It knows its own place: zipfile's readers of one archive move one another when they
    seek ahead."""

    def __init__(self, file: Any, info: zipfile.ZipInfo):
        self.file, self.at = file, 0
        file.seek(info.header_offset + LOCAL_LENGTHS)
        lengths = file.read(4)
        self.start = info.header_offset + LOCAL_LENGTHS + 4 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
        self.size = info.file_size

    def tell(self) -> int:
        return self.at

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        self.file.seek(self.start + self.at)
        data = self.file.read(max(0, min(n, self.size - self.at)))
        self.at += len(data)
        return data


class Member:
    """An array within an .npz file, which is open as `file`."""

    def __init__(self, archive: zipfile.ZipFile, name: str, file: Any):
        info = archive.getinfo(f"{name}.npy")
        self.deflated = info.compress_type != zipfile.ZIP_STORED
        self.file = archive.open(info) if self.deflated else Span(file, info)
        self.header = header(self.file)

    def take(self, low: int, high: int) -> np.ndarray:
        return _numbers(self.file, self.header, low, high - low)


class NpzReader(DataSourceReader):
    """Entries of CSR matrices; the rows of a file are numbered from its `first_row`, where it has one."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        parts: list[InputPartition] = []
        for name in _names(system, path, ".npz"):
            with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                if "format.npy" in archive.namelist() and (kind := str(np.load(io.BytesIO(archive.read("format.npy"))).item(), "ascii")) != "csr":
                    raise ValueError(f"{name} is a {kind} matrix; csr is read")
                first = int(np.load(io.BytesIO(archive.read("first_row.npy")))) if "first_row.npy" in archive.namelist() else 0
                indptr, data = Member(archive, "indptr", file), Member(archive, "data", file)
                n = indptr.header.rows - 1
                cuts = [0, n]
                if not (indptr.deflated or data.deflated or Member(archive, "indices", file).deflated):
                    each = max(1, self.split // (np.dtype(data.header.dtype).itemsize + 4))
                    cuts = sorted({0, n, *(_first_at(indptr, n, k) for k in range(each, data.header.rows, each))})
                parts += [Part(name, low, high, first) for low, high in zip(cuts, cuts[1:], strict=False)]
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        if partition.low == partition.high:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            indptr, indices, data = (Member(archive, name, file) for name in ("indptr", "indices", "data"))
            ends = indptr.take(partition.low, partition.high + 1).astype(np.int64)
            for low in range(int(ends[0]), int(ends[-1]), BATCH_BYTES // 24):
                high = min(low + BATCH_BYTES // 24, int(ends[-1]))
                rows = np.searchsorted(ends, np.arange(low, high), "right") - 1 + partition.low + partition.first
                columns = [pa.array(rows), pa.array(indices.take(low, high).astype(np.int64)), pa.array(data.take(low, high).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "col", "value"])


def _first_at(indptr: Member, n: int, entry: int) -> int:
    """The first row that begins at an entry or after it, by bisection in the file."""
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        if int(indptr.take(middle, middle + 1)[0]) < entry:
            low = middle + 1
        else:
            high = middle
    return low


@dataclass
class Written(WriterCommitMessage):
    task: int
    names: list[str]


class FilesWriter(DataSourceArrowWriter):
    """Files of one task after the other; `files` gives their contents from a task's batches."""

    ending = ""

    def __init__(self, path: str, overwrite: bool, size: int):
        self.path, self.size = path, size
        system, folder = file_system(path)
        if system.get_file_info(f"{folder}/{FILES}").type != pyarrow.fs.FileType.NotFound and not overwrite:
            raise FileExistsError(path)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        task, names = TaskContext.get().partitionId(), []  # type: ignore[union-attr]
        for content in self.files(iterator):
            names.append(f"part-{task:06d}-{len(names):06d}-{uuid.uuid4().hex}{self.ending}")
            with system.open_output_stream(f"{folder}/{names[-1]}") as file:
                file.write(content)
        return Written(task, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        done = sorted((m.task, m.names) for m in messages if isinstance(m, Written))
        with system.open_output_stream(f"{folder}/{FILES}") as file:
            file.write(json.dumps([name for _, names in done for name in names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = file_system(self.path)
        for name in (name for m in messages if isinstance(m, Written) for name in m.names):
            system.delete_file(f"{folder}/{name}")


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about size bytes, none of them empty."""
    for batch in batches:
        each = max(1, batch.num_rows * size // max(1, batch.nbytes))
        yield from (batch.slice(low, each) for low in range(0, batch.num_rows, each))


class NpyWriter(FilesWriter):
    """Vectors (v, of one length) in the order of the table's rows."""

    ending = ".npy"

    def __init__(self, path: str, overwrite: bool, size: int, dtype: str):
        super().__init__(path, overwrite, size)
        self.dtype = np.dtype(dtype)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        held: list[np.ndarray] = []
        for batch in _pieces(batches, self.size):
            vectors = batch.column(batch.schema.get_field_index("v"))
            widths = pa.compute.unique(pa.compute.list_value_length(vectors)).to_pylist()
            if vectors.null_count or len(widths) > 1 or held and widths and widths[0] != held[0].shape[1]:
                raise ValueError("vectors of one .npy file are there and of one length")
            held.append(vectors.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(vectors), widths[0]))
            if sum(x.nbytes for x in held) >= self.size:
                yield self._file(held)
                held = []
        if held:
            yield self._file(held)

    @staticmethod
    def _file(held: list[np.ndarray]) -> bytes:
        file = io.BytesIO()
        np.save(file, np.concatenate(held))
        return file.getvalue()


class NpzWriter(FilesWriter):
    """Entries (row, col, value) in order of rows; a file ends anywhere, and a row may go on in the next one."""

    ending = ".npz"

    def __init__(self, path: str, overwrite: bool, size: int, columns: int):
        super().__init__(path, overwrite, size)
        self.columns = columns

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        held: list[list[np.ndarray]] = []
        for batch in _pieces(batches, self.size):
            held.append([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("row", "col", "value")])
            if sum(x.nbytes for part in held for x in part) >= self.size:
                yield self._file(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield self._file(*map(np.concatenate, zip(*held, strict=True)))

    def _file(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
        if np.any(rows[1:] < rows[:-1]):
            raise ValueError("entries of a sparse matrix are written in order of their rows")
        first, n = int(rows[0]), int(rows[-1] - rows[0]) + 1
        indptr = np.searchsorted(rows, np.arange(first, first + n + 1))
        file = io.BytesIO()
        np.savez(file, indices=columns, indptr=indptr, format=np.array(b"csr"), shape=np.array([n, self.columns]), data=values, first_row=np.array(first))
        return file.getvalue()


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return NpyWriter(self.options["path"], overwrite, int(self.options.get("filebytes", FILE_BYTES)), self.options.get("dtype", "<f8"))


class Npz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_csr"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return NpzWriter(self.options["path"], overwrite, int(self.options.get("filebytes", FILE_BYTES)), int(self.options["columns"]))


def _source(spark: SparkSession, kind: type[DataSource]) -> str:
    spark.dataSource.register(kind)
    return kind.name()


def read_npy(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(row, v) of a .npy file or a folder of them: row numbers in file order, vectors of one number for flat arrays."""
    return spark.read.format(_source(spark, Npy)).option("splitbytes", split_bytes).load(path)


def write_npy(vectors: DataFrame, path: str, dtype: str = "<f8", file_bytes: int = FILE_BYTES) -> None:
    """A folder of .npy files with the vectors v, in the order of the table's rows."""
    rows = vectors.select(F.col("v").cast("array<double>").alias("v"))
    rows.write.format(_source(vectors.sparkSession, Npy)).options(dtype=dtype, filebytes=file_bytes).mode("append").save(path)


def read_csr(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(row, col, value): the stored entries of a .npz file with a CSR matrix, or of a folder of them."""
    return spark.read.format(_source(spark, Npz)).option("splitbytes", split_bytes).load(path)


def write_csr(entries: DataFrame, path: str, columns: int, parts: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """A folder of .npz files with the entries (row, col, value) of a matrix, in order of row and column.

    Entries are split by ranges of both, so one row with very many is no task's own.
    """
    rows = entries.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))
    dealt = rows.repartitionByRange(parts, "row", "col") if parts else rows.repartitionByRange("row", "col")
    dealt.sortWithinPartitions("row", "col").write.format(_source(entries.sparkSession, Npz)).options(columns=columns, filebytes=file_bytes).mode("append").save(path)


def adjacency(edges: DataFrame) -> DataFrame:
    """(row, col, value): both halves of the symmetric matrix of edges (source, target, weight)."""
    half = edges.select(F.col("source").alias("row"), F.col("target").alias("col"), F.col("weight").cast("double").alias("value"))
    return half.unionAll(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def edges_of_adjacency(entries: DataFrame) -> DataFrame:
    """(source, target, weight) of a symmetric matrix; an entry without an equal one across is an error.

    Entries of zero are edges: only what is stored counts.
    """
    ends = entries.where("row <> col").groupBy(F.least("row", "col").alias("source"), F.greatest("row", "col").alias("target"))
    both = ends.agg(F.min("value").alias("weight"), F.max("value").alias("_high"), F.count("*").alias("_n"))
    checked = F.when((F.col("_n") == 2) & (F.col("weight") == F.col("_high")), F.col("weight")).otherwise(F.raise_error(F.lit("an adjacency matrix is not symmetric")).cast("double"))
    return both.select("source", "target", checked.alias("weight"))
