"""Hashes of many sets as packed arrays, dealt to buckets: few rows to shuffle, sorted and counted by numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

Pack = tuple[list[bytes], np.ndarray, np.ndarray]


def packs(rows: Iterator[tuple[bytes, np.ndarray]], size: int) -> Iterator[Pack]:
    """Sets by name in packs of at least size hashes and fewer than 2^16 names: names, hashes, owners."""
    held: dict[bytes, np.ndarray] = {}
    n = 0

    def give() -> Pack:
        return list(held), np.concatenate(list(held.values())), np.repeat(np.arange(len(held), dtype="<u2"), [len(s) for s in held.values()])

    for name, hashes in rows:
        if name not in held:
            held[name] = hashes
            n += len(hashes)
        if n >= size or len(held) == 65_535:
            yield give()
            held, n = {}, 0
    if held:
        yield give()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(found: Iterator[Pack], buckets: int, width: int) -> Iterator[dict[str, Any]]:
    """A row for each bucket of a pack: hashes in order (their low `width` bytes as byte planes), owners, names of 16 bytes."""
    mask = np.uint64((1 << 8 * width) - 1)
    for names, h, owner in found:
        bucket = bucket_of(h, buckets)
        order = np.lexsort((h & mask, bucket))
        h, owner, bucket = h[order], owner[order], bucket[order]
        table = np.frombuffer(b"".join(names), np.uint8).reshape(len(names), 16)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(h)), strict=True):
            present, at = np.unique(owner[a:b], return_inverse=True)
            planes = h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
            yield {"bucket": [int(bucket[a])], "shingles": [planes.tobytes()], "owners": [at.astype("<u2").tobytes()], "classes": [table[present].tobytes()]}


NUMBERED = "bucket int, pack bigint, hashes binary, owners binary, names binary"


def dealt_by_number(found: Iterator[Pack], buckets: int, width: int) -> Iterator[dict[str, Any]]:
    """A row for each bucket of a pack, as in dealt(); in it a name is its number in the pack, two bytes.

    The names themselves go once, in a row of one bucket, and with them the sizes of their sets. A pack is known by a
    hash of its names.
    """
    mask = np.uint64((1 << 8 * width) - 1)
    for names, h, owner in found:
        table = b"".join(names)
        pack = int(np.uint64(xxhash.xxh3_64_intdigest(table)).astype(np.int64))
        sizes = np.bincount(owner, minlength=len(names)).astype("<u4")
        yield {"bucket": [pack % buckets], "pack": [pack], "hashes": [None], "owners": [None], "names": [table + sizes.tobytes()]}
        fits = width <= 3 and buckets <= 1 << 24
        if fits:  # bucket, hash and owner are one number
            key = bucket_of(h, buckets)
            key <<= np.uint64(24)
            key |= h & mask
            key <<= np.uint64(16)
            key |= owner
            del h
            key.sort()
            starts = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40))
        else:  # buckets are in the order of hashes
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            starts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(np.diff(starts)).tolist():
            a, b = starts[bucket], starts[bucket + 1]
            part, own = (key[a:b] >> np.uint64(16), key[a:b].astype("<u2")) if fits else (h[a:b], owner[a:b])
            planes = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
            yield {"bucket": [bucket], "pack": [pack], "hashes": [planes.tobytes()], "owners": [own.tobytes()], "names": [None]}


def names_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A pack's names and the sizes of their sets."""
    n = len(data) // 20
    return np.frombuffer(data, "V16", n), np.frombuffer(data, "<u4", n, 16 * n).astype(np.int64)


class Gathered(NamedTuple):
    hashes: np.ndarray  # of distinct (hash, name), in order
    names: np.ndarray  # which of a bucket's packs << 16, and the number in it
    counts: np.ndarray  # of names that have the hash
    again: np.ndarray  # names once more for each hash that is no other than one they have
    packs: list[int]


def gathered_by_number(rows: pa.Table, width: int) -> Gathered:
    """A bucket's hashes from all packs; with at most three bytes each, one array is sorted in place."""
    packs: dict[int, int] = {}
    parts, owners = [], []
    for pack, data, owner in zip(rows.column("pack").to_pylist(), rows.column("hashes"), rows.column("owners"), strict=True):
        if not data.is_valid:
            continue
        planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(width, -1)
        h = np.zeros(planes.shape[1], np.uint64)
        for plane in planes[::-1]:
            h <<= np.uint64(8)
            h |= plane
        at = np.frombuffer(owner.as_buffer(), "<u2").astype(np.uint64) | np.uint64(packs.setdefault(pack, len(packs)) << 16)
        if width <= 3:
            h <<= np.uint64(40)
            h |= at
        else:
            owners.append(at)
        parts.append(h)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    if width <= 3:
        h.sort()
        first = np.append(True, h[1:] != h[:-1])[: len(h)]
        at = h & np.uint64((1 << 40) - 1)
        h >>= np.uint64(40)
    else:
        at = np.concatenate(owners) if owners else np.zeros(0, np.uint64)
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        first = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))[: len(h)]
    again = at[~first]
    h, at = h[first], at[first]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    counts = np.diff(np.append(starts, len(h)))
    return Gathered(h, at, np.repeat(counts, counts), again, list(packs))


def gathered(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: distinct (hash, name) in order, each hash's number of names, the names, and how many hashes each
    name's set has here, those that are alike in their low `width` bytes included (each row has a name's whole set).

    Where a hash and a name's number fit in 64 bits, one array of these is sorted in place.
    """
    tables = [np.frombuffer(x, "V16") for x in rows.column("classes").to_pylist()]
    names, same = np.unique(np.concatenate(tables), return_inverse=True)
    same = same.astype(np.uint64)
    free = np.uint64(64 - 8 * width)
    narrow = len(names) < 1 << int(free)
    entries = np.zeros(len(names), np.int64)
    parts, others, n = [], [], 0
    for data, owners, table in zip(rows.column("shingles"), rows.column("owners"), tables, strict=True):
        planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(width, -1)
        h = np.zeros(planes.shape[1], np.uint64)
        for plane in planes[::-1]:
            h <<= np.uint64(8)
            h |= plane
        owner = np.frombuffer(owners.as_buffer(), "<u2").astype(np.int64)
        at, own = same[n + owner], same[n : n + len(table)]
        entries[own] = np.maximum(entries[own], np.bincount(owner, minlength=len(table)))
        n += len(table)
        if narrow:
            h <<= free
            h |= at
        else:
            others.append(at)
        parts.append(h)
    h = np.concatenate(parts)
    del parts
    if narrow:
        h.sort()
        h = h[np.append(True, h[1:] != h[:-1])]
        at = h & np.uint64((1 << int(free)) - 1)
        h >>= free
    else:
        at = np.concatenate(others)
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        first = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))
        h, at = h[first], at[first]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    counts = np.diff(np.append(starts, len(h)))
    return h, at, np.repeat(counts, counts), names, entries


Lists = dict[str, tuple[np.ndarray, np.ndarray]]


def _gather(lengths: np.ndarray, values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """values, cut in pieces of these lengths, with the pieces in another order."""
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def in_parts(names: np.ndarray, lists: Lists, parts: int) -> pa.Table:
    """Names of 16 bytes and each one's lists, as one row for each part that some name falls in.

    lists: by column, the length of each name's list, and all lists one after the other.
    """
    part = np.ascontiguousarray(names).view("<u8").reshape(-1, 2)[:, 0] % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(names) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(names)) if len(names) else cuts
    columns: dict[str, list[bytes] | np.ndarray] = {"part": part[order][cuts].astype(np.int32), "names": [names[order][a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]}
    for column, (lengths, values) in lists.items():
        sizes, flat = lengths[order], _gather(lengths, values, order)
        at = np.append(0, np.cumsum(sizes))
        columns[f"{column}_lengths"] = [sizes[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends, strict=True)]
        columns[column] = [flat[at[a] : at[b]].tobytes() for a, b in zip(cuts, ends, strict=True)]
    return pa.table({k: pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in columns.items()})


def parts_schema(*columns: str) -> str:
    return ", ".join(["part int, names binary", *(f"{c}_lengths binary, {c} binary" for c in columns)])


def joined_parts(rows: pa.Table, kinds: dict[str, str]) -> tuple[np.ndarray, Lists]:
    """The distinct names of a part's rows, and each one's lists from all rows together."""
    names, at = np.unique(np.concatenate([np.frombuffer(x, "V16") for x in rows.column("names").to_pylist()]), return_inverse=True)
    order = np.argsort(at, kind="stable")
    lists: Lists = {}
    for column, kind in kinds.items():
        lengths = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column(f"{column}_lengths").to_pylist()]).astype(np.int64)
        values = np.concatenate([np.frombuffer(x, kind) for x in rows.column(column).to_pylist()])
        lists[column] = (np.bincount(at, lengths, len(names)).astype(np.int64), _gather(lengths, values, order))
    return names, lists


def pieces(lists: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Each name's list as bytes."""
    lengths, values = lists
    at = np.append(0, np.cumsum(lengths))
    return [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
