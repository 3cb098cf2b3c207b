"""Token ids in files of fixed-width bit-packed blocks.

A file holds ids in the fewest bits that the vocabulary needs, in blocks of BLOCK ids that each begin on a byte, so
block b of width w starts at a known byte and numpy unpacks it alone. Layout, little-endian:

    magic (8 bytes), width u32, block u32
    blocks
    block offsets u64[n_blocks + 1], document ids i64[n_docs], null flags u8[n_docs], starts u64[n_docs + 1]
    n_blocks u64, n_docs u64, n_ids u64, index position u64, magic

The writer puts documents in ascending doc_id order (nulls first, equal ids by text) over files of bounded size; a
table of written files is what commits them, so a lost executor or a second attempt leaves at most unread files.
Defined cases: a null text is an empty one (just its end id); repeated rows are separate documents; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, slices, texts_of, written
from .tokens import VOCABULARY, encoder

MAGIC = b"IDBLOCK1"
BLOCK = 1 << 16
FILE_IDS = 1 << 23


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    def __init__(self, path: str, vocabulary_size: int, block: int = BLOCK):
        where, at = fs.FileSystem.from_uri(path)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(at, compression=None)
        self.width, self.block = max(1, (vocabulary_size - 1).bit_length()), block
        self.out.write(MAGIC + np.array([self.width, block], "<u4").tobytes())
        self.offsets, self.docs, self.starts = [self.out.tell()], [], [0]
        self.rest = np.zeros(0, "<u4")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        rest = np.concatenate([self.rest, ids])
        for start in range(0, len(rest) - self.block + 1, self.block):
            self._block(rest[start : start + self.block])
        self.rest = rest[len(rest) // self.block * self.block :]

    def _block(self, ids: np.ndarray) -> None:
        self.out.write(pack_bits(ids, self.width))
        self.offsets.append(self.out.tell())

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        at = self.out.tell()
        for values, kind in ((self.offsets, "<u8"), ([d or 0 for d in self.docs], "<i8"), ([d is None for d in self.docs], "u1"), (self.starts, "<u8"), ([len(self.offsets) - 1, len(self.docs), self.starts[-1], at], "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(MAGIC)
        self.out.close()


class Reader:
    """Random access: ids(start, stop) reads only the blocks that hold them."""

    def __init__(self, path: str):
        where, at = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(at)
        size = self.file.size()
        tail = self._at(size - 40, 40)
        if tail[32:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        blocks, docs, self.n_ids, index = map(int, np.frombuffer(tail[:32], "<u8"))
        self.width, self.block = map(int, np.frombuffer(self._at(8, 8), "<u4"))
        data = self._at(index, size - 40 - index)
        cut = np.cumsum([0, 8 * (blocks + 1), 8 * docs, docs, 8 * (docs + 1)])
        self.offsets, ids, null, self.starts = (np.frombuffer(data[a:b], k) for a, b, k in zip(cut[:-1], cut[1:], ("<u8", "<i8", "u1", "<u8"), strict=True))
        self.docs = [None if n else int(i) for i, n in zip(ids, null, strict=True)]

    def _at(self, position: int, n: int) -> bytes:
        return self.file.read_at(n, position)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [
            unpack_bits(self._at(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b])), self.width, min(self.block, self.n_ids - b * self.block))
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids), with each block read once or twice."""
        held, low = np.zeros(0, "<u4"), 0
        for doc_id, a, b in zip(self.docs, map(int, self.starts[:-1]), map(int, self.starts[1:]), strict=True):
            if b > low + len(held):
                end = min(self.n_ids, -(-b // self.block) * self.block)
                low, held = a, np.concatenate([held[a - low :], self.ids(low + len(held), end)])
            yield doc_id, a, held[a - low : b - low]


def write_ids(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise and write; returns the table of files: (part, path, part_start, n_docs, n_ids), part_start within the part."""
    folder = folder or shared_dir(docs.sparkSession, "ids")
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(map_batches(ranged, _write, "part int, path string, part_start bigint, n_docs bigint, n_ids bigint", folder, vocabulary, file_ids), "id-files")


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, file_ids: int) -> Iterator[dict[str, Any]]:
    words, out, total = encoder(vocabulary), None, 0
    part, path = TaskContext.get().partitionId(), ""

    def row() -> dict[str, Any]:
        out.close()
        return {"part": [part], "path": [path], "part_start": [total - out.starts[-1]], "n_docs": [len(out.docs)], "n_ids": [out.starts[-1]]}

    for whole in batches:
        for batch in slices(whole):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(path, words.vocabulary_size)
                ids = words.encode(text)
                out.add(doc_id, ids)
                total += len(ids)
                if out.starts[-1] >= file_ids:
                    yield row()
                    out = None
    if out is not None:
        yield row()


def read_ids(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids on demand."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    #: A row for each writing task, not for each document or file.
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    placed = files.join(before, "part").select("path", (F.col("_before") + F.col("part_start")).alias("start"))
    spread = placed.repartition(max(1, min(files.count(), 10_000)), "path")
    return map_batches(spread, _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids, keep_ids)


def _read(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[dict[str, Any]]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = Reader(path)
            docs: list[tuple[Any, ...]] = []
            for doc_id, at, ids in reader.documents():
                docs.append((doc_id, start + at, len(ids), zlib.crc32(ids.tobytes()), ids if keep_ids else None))
                if len(docs) == 4096:
                    yield dict(zip(("doc_id", "start", "n_tokens", "ids_crc32", "ids"), zip(*docs, strict=True), strict=True))
                    docs = []
            if docs:
                yield dict(zip(("doc_id", "start", "n_tokens", "ids_crc32", "ids"), zip(*docs, strict=True), strict=True))
