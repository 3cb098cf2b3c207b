"""Best-fit packing planned over a histogram of lengths.

The plan never sees documents. How many pieces have each length (at most `capacity` counts) decides which ranks of a
length go to which sequences, by best fit in decreasing length; a run of equal sequences is one entry. Each piece then
finds its slot by its rank within its length. Ranks come from counts by (length, salt), so that a length which a third
of all pieces share is ranked in many tasks.

Defined cases: a null text is an empty one; a null doc_id stays null; repeated rows are separate documents; lengths
below 1 take no room and get no slot (sequence_id and offset null); no rows give no sequences; further columns go along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, slices, texts_of, written
from .tokens import VOCABULARY, encoder

CAPACITY = 4096
#: Pieces that one (length, salt) group should hold at most, about.
RANKED_TOGETHER = 500_000
LEAST_SALTS = 512


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots for pieces by (length, rank): ranks first..last of a length go, `each` to a sequence, from `offset` on.

    Entries are bounded by the capacity, not by the pieces: each length splits at most two runs of equal sequences,
    and each use at least halves the room left in a run.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def put(left: int, sequence: int, n: int) -> None:
        if n and left:
            if not room[left]:
                insort(sizes, left)
            room[left].append((sequence, n))

    for length in sorted((x for x in histogram if 0 < x <= capacity), reverse=True):
        rank, count = 0, histogram[length]
        while count:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                sequence, n = room[left].pop()
                if not room[left]:
                    sizes.pop(at)
            else:
                left, sequence = capacity, used
                n = -(-count // (capacity // length))
                used += n
            each = left // length
            full = min(n, count // each)
            if not full:
                each, full = count, 1
            rows.append((length, rank, rank + each * full, sequence, each, capacity - left))
            put(left - each * length, sequence, full)
            put(left, sequence + full, n - full)
            rank += each * full
            count -= each * full
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return dict(zip(("length", "first", "last", "sequence", "each", "offset"), columns, strict=True)) | {"sequences": np.array([used])}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, with a column `length`, and for each its sequence_id and offset.

    pieces is read three times, so give a table rather than a long computation. No piece is longer than capacity.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    histogram = {r["length"]: r["count"] for r in pieces.where(F.col("length").between(1, capacity)).groupBy("length").count().collect()}
    if pieces.where(F.col("length") > capacity).limit(1).count():
        raise ValueError(f"a piece is longer than {capacity}")
    slots = plan(histogram, capacity)
    salts = max(LEAST_SALTS, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    key = ["_length", "_salt"]
    salted = pieces.withColumns({"_length": F.coalesce("length", F.lit(0)), "_salt": F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")})
    counts = salted.groupBy(*key).agg(F.count("*").alias("_n"))
    before = counts.select(*key, (F.sum("_n").over(Window.partitionBy("_length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = [c for c in names if c != "length"] or ["length"]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    ranked = ranked.join(before, key).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked.select(*names, "_rank"), _slot, f"{schema}, sequence_id bigint, offset bigint", names, slots)


def _slot(batches: Iterator[pa.RecordBatch], names: list[str], slots: dict[str, np.ndarray]) -> Iterator[dict[str, Any]]:
    order = np.lexsort((slots["first"], slots["length"]))
    slots = {k: v[order] if k != "sequences" else v for k, v in slots.items()}
    starts = np.searchsorted(slots["length"], np.arange(slots["length"].max(initial=0) + 2))
    #: A key that grows with length, then rank: ranks are below 2^48.
    keys = (slots["length"] << 48) + slots["first"]
    for batch in batches:
        length = batch.column("length").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
        placed = length > 0
        at = np.zeros(len(length), np.int64)
        at[placed] = np.searchsorted(keys, (length[placed] << 48) + rank[placed], "right") - 1
        out: dict[str, Any] = {n: batch.column(n) for n in names}
        if len(starts) > 1 and len(keys):
            index = rank - slots["first"][at]
            sequence = slots["sequence"][at] + index // slots["each"][at]
            offset = slots["offset"][at] + index % slots["each"][at] * length
        else:
            sequence = offset = np.zeros(len(length), np.int64)
        yield out | {"sequence_id": pa.array(sequence, mask=~placed), "offset": pa.array(offset, mask=~placed)}


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Token pieces of each document: (doc_id, piece, start, length, ids_crc32), with ids on demand.

    Only a document of more than capacity tokens, its end token included, has more than one piece.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return map_batches(docs.select("doc_id", "text"), _cut, schema, capacity, vocabulary, ids)


def _cut(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str, ids: bool) -> Iterator[dict[str, Any]]:
    encode = encoder(vocabulary).encode
    for whole in batches:
        for batch in slices(whole):
            out: dict[str, list[Any]] = defaultdict(list)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                tokens = encode(text)
                for piece, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(value)
                    if ids:
                        out["ids"].append(part)
            if out:
                yield out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Tokenise whole documents once, into a table, and pack their pieces."""
    return pack(written(pieces_of(docs, capacity, vocabulary, ids), "pieces"), capacity)
