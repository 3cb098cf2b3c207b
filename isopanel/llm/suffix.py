"""Removal of passages that a document with a smaller id holds too, by enhanced suffix arrays.

Every window of `window` bytes chooses an anchor, the least hashed GRAM bytes in it, so equal windows have equal anchors
and all of them can be found among texts that share one.

1. Texts that are equal byte for byte are one; all but the smallest id go whole.
2. Anchors travel as packed arrays, dealt by hash; what comes back is which of a text's anchors another text has.
3. Only fragments around those (all windows of one anchor, at most 2 * window - GRAM + 1 bytes) are cut out. Equal
   fragments are one with a smallest id, map side first, and all with one anchor meet in a bucket.
4. A bucket's fragments make an enhanced suffix array: suffixes of at least `window` bytes in order, the length of
   each one's common prefix with the one before, and its left neighbour byte. A stack scan of the common prefixes gives
   the interval tree; intervals whose left bytes differ are the maximal repeats, with all their occurrences. In each,
   fragments whose smallest id is above the group's give their bytes.
5. Anchors in more than HOT texts don't meet anywhere: their windows are compared by a grouped minimum over 128-bit
   hashes, which Spark aggregates before it shuffles, and a join that it can split.

Spans are merged for each document and its bytes kept in order. Fragments may cut a repeat in pieces; the pieces cover
what it covers.

Defined cases: null texts are empty; texts shorter than the window lose nothing; a document without an id neither
gives nor loses anything; rows with one id don't take from one another; bytes may be cut inside a character (hence a
digest and a binary column, no text); further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, partitions_for, slices, written
from .packs import dealt, gathered, in_parts, joined_parts, packs, parts_schema, pieces
from .words import mix

WINDOW, GRAM = 50, 20
HOT = 10_000
#: Bytes whose hashes are computed together; bytes of text packed together.
STEP, PACKED_TEXT = 1 << 20, 8_000_000
BUCKET_ANCHORS, BUCKET_FRAGMENTS = 700_000, 40_000
#: Ids that go to every task, 24 bytes each; more are joined by shuffle.
BROADCAST_IDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Anchors(NamedTuple):
    first: np.ndarray  # window starts that chose it: first to last
    last: np.ndarray
    hash: np.ndarray


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes, by doubling."""
    have, width, power, out, done = data.astype(np.uint64) + np.uint64(1), 1, int(_P), None, 0
    while True:
        if size & width:
            n = len(data) - done - width + 1
            out = have[:n] if out is None else out[:n] * np.uint64(power) + have[done : done + n]
            done += width
        width *= 2
        if width > size:
            return mix(out)
        have = have[: -(width // 2)] * np.uint64(power) + have[width // 2 :]
        power = power * power % 2**64


def anchors(data: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> Iterator[Anchors]:
    """Anchors of the valid window starts of data, a bounded part of data at a time."""
    grams = window - GRAM + 1
    for low in range(0, max(0, len(data) - window + 1), STEP):
        part = data[low : low + STEP + window - 1]
        h = gram_hash(part, GRAM)
        best = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if grams > width:
            best = np.minimum(best[: len(best) - (grams - width)], best[grams - width :])
        starts = np.flatnonzero(valid[low : low + len(best)])
        if not len(starts):
            continue
        at = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
        cuts = np.flatnonzero(new)
        yield Anchors(starts[cuts] + low, starts[np.append(cuts[1:], len(starts)) - 1] + low, h[at[cuts]])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for whole in batches:
        for batch in slices(whole, size=STEP):
            yield [(t or "").encode() for t in batch.column("text").to_pylist()]


def _joined(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the text of each, and the window starts that stay in one text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    valid = np.zeros(len(data), bool)
    if len(data) >= window:
        valid[: len(data) - window + 1] = owner[: len(data) - window + 1] == owner[window - 1 :]
    return data, owner, valid


def name_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _deal_anchors(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[dict[str, Any]]:
    def sets() -> Iterator[tuple[bytes, np.ndarray]]:
        for texts in _texts(batches):
            texts = list({t: None for t in texts if len(t) >= window})
            data, owner, valid = _joined(texts, window)
            found = [(a.hash, owner[a.first]) for a in anchors(data, valid, window)]
            if not found:
                continue
            h, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((h, at))
            h, at = h[order], at[order]
            cuts = np.searchsorted(at, np.arange(len(texts) + 1))
            for i, text in enumerate(texts):
                yield name_of(text), np.unique(h[cuts[i] : cuts[i + 1]])

    return dealt(packs(sets(), PACKED_TEXT // 15), buckets, 4)


def _flags(rows: pa.Table, most: int, parts: int) -> pa.Table:
    """Of each text in a bucket, the anchors (bucket and 32 bits) that other texts have, and those that very many have.

    A row for each part of the texts.
    """
    bucket = rows.column("bucket")[0].as_py()
    h, at, counts, classes, _ = gathered(rows, 4)
    some = counts > 1
    key, at, hot = h[some] | np.uint64(bucket) << np.uint64(32), at[some], counts[some] > most
    order = np.argsort(at, kind="stable")
    key, at, hot = key[order], at[order].astype(np.int64), hot[order]
    there = np.flatnonzero(np.bincount(at, minlength=len(classes)))
    lists = {name: (np.bincount(at[x], minlength=len(classes))[there], key[x].astype("<u8")) for name, x in (("keys", ~hot), ("hot", hot))}
    return in_parts(classes[there], lists, parts)


def _by_text(rows: pa.Table) -> pa.Table:
    names, lists = joined_parts(rows, {"keys": "<u8", "hot": "<u8"})
    n = lists["keys"][0] + lists["hot"][0]
    return pa.table({"class": pa.array([x.tobytes() for x in names], pa.binary()), "keys": pa.array(pieces(lists["keys"]), pa.binary()), "hot": pa.array(pieces(lists["hot"]), pa.binary()), "n": pa.array(n, pa.int64())})


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    table = np.sort(table)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _marked(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[tuple[int, bytes, bytes, Anchors, np.ndarray, np.ndarray]]:
    """doc_id, class, text and the anchors of each document, with masks of those that are shared, and by very many."""
    for whole in batches:
        for batch in slices(whole, size=STEP):
            for doc_id, text, name, keys, hot in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "class", "keys", "hot")), strict=True):
                data = (text or "").encode()
                if name_of(data) != name:
                    continue  # another text with this id
                values, _, valid = _joined([data], window)
                common, many = (np.frombuffer(x, "<u8") for x in (keys, hot))
                for a in anchors(values, valid, window):
                    key = (((a.hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | a.hash & np.uint64(0xFFFFFFFF)
                    yield doc_id, name, data, a, _member(key, common), _member(key, many)


def _deal_fragments(batches: Iterator[pa.RecordBatch], window: int, buckets: int, groups: int) -> Iterator[dict[str, Any]]:
    """Equal fragments of a task's documents together: a row for each bucket has its fragments and where they are."""
    held: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
    n = 0

    def give() -> Iterator[dict[str, Any]]:
        by: dict[int, list[bytes]] = defaultdict(list)
        for fragment in held:
            by[int.from_bytes(fragment[:8], "little") * groups >> 64].append(fragment)
        for group, fragments in by.items():
            places = [held[f] for f in fragments]
            flat = np.array([p for x in places for p in x], dtype="<u8").reshape(-1, 3)
            yield {
                "group": [group],
                "fragments": [b"".join(f[8:] for f in fragments)],
                "sizes": [np.array([len(f) - 8 for f in fragments], "<u4").tobytes()],
                "counts": [np.array([len(p) for p in places], "<u4").tobytes()],
                "docs": [flat[:, :2].tobytes()],
                "starts": [flat[:, 2].astype("<u4").tobytes()],
            }
        held.clear()

    for doc_id, name, data, a, shared, _ in _marked(batches, window, buckets):
        own = int.from_bytes(name[:8], "little")
        at = np.flatnonzero(shared)
        keys = mix(a.hash[at] ^ _P).astype("<u8").tobytes()
        for i, (first, last) in enumerate(zip(a.first[at].tolist(), a.last[at].tolist(), strict=True)):
            held[keys[8 * i : 8 * i + 8] + data[first : last + window]].append((doc_id % 2**64, own, first))
        n += len(at)
        if n >= 100_000:
            yield from give()
            n = 0
    yield from give()


def _hot_windows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[dict[str, Any]]:
    for doc_id, name, data, a, _, many in _marked(batches, window, buckets):
        for first, last in zip(a.first[many].tolist(), a.last[many].tolist(), strict=True):
            h = [xxhash.xxh3_128_digest(data[s : s + window]) for s in range(first, last + 1)]
            yield {"doc_id": [doc_id] * len(h), "class": [name] * len(h), "start": list(range(first, last + 1)), "w": h}


class SuffixArray(NamedTuple):
    """Suffixes of at least `window` bytes of fragments, in order; prefix[i]: common to i - 1 and i; left: -1 at a fragment's start."""

    fragment: np.ndarray
    start: np.ndarray
    prefix: np.ndarray
    left: np.ndarray


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, for all places but the last seven."""
    word = data.astype(np.uint64)
    for width in (1, 2, 4):
        word = word[:-width] << np.uint64(8 * width) | word[width:]
    return word


def suffix_array(fragments: list[bytes], window: int = WINDOW, repeated_only: bool = False) -> SuffixArray:
    """With repeated_only, suffixes whose first window occurs once (by its hash) are left out: no repeat has them."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    suffixes = np.maximum(sizes - window + 1, 0)
    fragment = np.repeat(np.arange(len(fragments)), suffixes)
    start = np.arange(len(fragment)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    width = -(-int(sizes.max(initial=1)) // 8) * 8
    data = np.frombuffer(b"".join(fragments) + bytes(width + 8), np.uint8)
    places = (np.cumsum(sizes) - sizes)[fragment] + start
    if repeated_only and len(places):
        h = gram_hash(data, window)[places]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        fragment, start, places = fragment[twice], start[twice], places[twice]
    rest = sizes[fragment] - start
    words = big_endian(data)
    columns = []
    for c in range(0, width, 8):
        # what lies beyond a fragment's end counts as zero
        beyond = (8 * np.clip(8 - (rest - c), 0, 8)).astype(np.uint64)
        word = words[np.minimum(places + c, len(words) - 1)]
        columns.append(np.where(beyond < 64, word >> np.minimum(beyond, 63) << np.minimum(beyond, 63), 0).astype(np.uint64))
    order = np.lexsort((rest, *columns[::-1]))
    fragment, start, rest, places = fragment[order], start[order], rest[order], places[order]
    prefix = np.zeros(len(order), np.int64)
    open_ = np.ones(max(0, len(order) - 1), bool)
    for column in columns:
        both = column[order[1:]] ^ column[order[:-1]]
        top = np.zeros(len(both), np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8, 0):
            top += (both >> np.uint64(shift)) == 0
        prefix[1:] += np.where(open_, top, 0)
        open_ &= both == 0
    prefix[1:] = np.minimum(prefix[1:], np.minimum(rest[1:], rest[:-1]))
    left = np.where(start > 0, data[np.maximum(places - 1, 0)].astype(np.int64), -1)
    return SuffixArray(fragment, start, prefix, left)


def maximal_repeats(array: SuffixArray, least: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(length, low, high): suffixes low..high-1 of the array share `length` bytes, and their left bytes differ.

    A stack scan of the common prefixes. An open interval keeps its length, its first suffix and its left byte, or
    None once two differ; a fragment's start counts as differing from everything.
    """
    prefix, left = array.prefix, array.left.tolist()
    inside = np.flatnonzero(prefix >= least)
    if not len(inside):
        return
    cuts = np.flatnonzero(np.append(True, inside[1:] != inside[:-1] + 1))
    ends = np.append(cuts[1:], len(inside))
    lengths = prefix.tolist()
    for a, b in zip(inside[cuts].tolist(), inside[ends - 1].tolist(), strict=True):
        if a == b:  # two suffixes: one interval
            if left[a - 1] != left[a] or left[a] < 0:
                yield lengths[a], a - 1, a + 1
            continue
        stack: list[tuple[int, int, int | None]] = []
        for i in range(a, b + 2):
            length = lengths[i] if i <= b else 0
            low, byte = i - 1, (left[i - 1] if left[i - 1] >= 0 else None)
            while stack and stack[-1][0] > length:
                depth, low, inner = stack.pop()
                byte = inner if inner == byte else None
                if byte is None:
                    yield depth, low, i
            if stack and stack[-1][0] == length:
                depth, first, outer = stack.pop()
                stack.append((depth, first, outer if outer == byte else None))
            elif length >= least:
                stack.append((length, low, byte))


def covered(fragments: list[bytes], least: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(fragment, start, end) that a repeat with a smaller id than the fragment's least covers."""
    array = suffix_array(fragments, window, True)
    ids = least[array.fragment]
    groups = np.array(list(maximal_repeats(array, window)), np.int64).reshape(-1, 3)
    if not len(groups):
        return np.zeros((0, 3), np.int64)
    length, low, high = groups.T
    # intervals overlap in a tree, so each is reduced by itself: its members one after the other
    sizes = high - low
    members = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    smallest = np.minimum.reduceat(ids[members], np.cumsum(sizes) - sizes)
    later = ids[members] > np.repeat(smallest, sizes)
    at, long = members[later], np.repeat(length, sizes)[later]
    return np.column_stack([array.fragment[at], array.start[at], array.start[at] + long])


def _spans(rows: pa.Table, window: int, parts: int) -> pa.Table:
    number: dict[bytes, int] = {}
    where, owner = [], []
    for data, sizes, counts, docs, starts in zip(*(rows.column(c).to_pylist() for c in ("fragments", "sizes", "counts", "docs", "starts")), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
        own = [number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        owner.append(np.repeat(own, np.frombuffer(counts, "<u4").astype(np.int64)))
        where.append(np.column_stack([np.frombuffer(docs, "<u8").reshape(-1, 2), np.frombuffer(starts, "<u4").astype(np.uint64)]))
    fragments, places, at = list(number), np.concatenate(where), np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    places, at = np.ascontiguousarray(places[order]), at[order]
    cuts = np.searchsorted(at, np.arange(len(fragments) + 1))
    ids = np.ascontiguousarray(places[:, 0]).view(np.int64)
    least = np.minimum.reduceat(ids, cuts[:-1])
    sizes = np.array([len(f) for f in fragments], np.uint64)
    later = ids > least[at]
    whole = np.column_stack([places[later], places[later, 2] + sizes[at[later]]])
    found = covered(fragments, least, window)
    times = np.diff(cuts)[found[:, 0]]
    which = np.repeat(cuts[:-1][found[:, 0]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    first, last = (np.repeat(found[:, c], times).astype(np.uint64) for c in (1, 2))
    cut = np.column_stack([places[which, :2], places[which, 2] + first, places[which, 2] + last])
    spans = np.concatenate([whole, cut])
    part = mix(spans[:, 0]) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    spans, part = np.ascontiguousarray(spans[order]), part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    return pa.table({"part": pa.array(part[cuts].astype(np.int32), pa.int32()), "spans": pa.array([s.astype("<u8").tobytes() for s in np.split(spans, cuts[1:])] if len(cuts) else [], pa.binary())})


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    cuts = np.flatnonzero(new)
    return starts[cuts], ends[np.append(cuts[1:], len(starts)) - 1]


def _by_document(rows: pa.Table) -> pa.Table:
    spans = np.concatenate([np.frombuffer(s, "<u8").reshape(-1, 4) for s in rows.column("spans").to_pylist()])
    order = np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))
    spans = spans[order]
    new = np.append(True, (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] != spans[:-1, 1]))
    cuts = np.flatnonzero(new)
    out = [merged(s[:, 2].astype(np.int64), s[:, 3].astype(np.int64)) for s in np.split(spans, cuts[1:])]
    return pa.table({
        "doc_id": pa.array(spans[cuts, 0].view(np.int64), pa.int64()),
        "own": pa.array([s.astype("<u8").tobytes() for s in spans[cuts, 1]], pa.binary()),
        "spans": pa.array([np.column_stack(s).astype("<u4").tobytes() for s in out], pa.binary()),
    })


def _cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[dict[str, Any]]:
    for whole in batches:
        for batch in slices(whole):
            out: dict[str, list[Any]] = defaultdict(list)
            for doc_id, text, name, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "class", "spans")), strict=True):
                data = (text or "").encode()
                if name_of(data) != name:
                    continue
                spans = np.concatenate([np.frombuffer(p, "<u4").reshape(-1, 2) for p in parts]).astype(np.int64)
                starts, ends = merged(spans[:, 0], spans[:, 1])
                kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                values = (doc_id, name, len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if keep else None)
                for k, v in zip(("doc_id", "class", "n_removed", "n_spans", "kept_sha256", "kept"), values, strict=True):
                    out[k].append(v)
            if out:
                yield dict(out)


def _only(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """docs of the wanted ids; few enough of them go to every task, so that texts move only once."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    if n <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"], "left_semi")
    return docs.select("doc_id", "text").join(wanted, "doc_id")


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with keep, its remaining bytes where some went."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(F.encode(text, "UTF-8"), 256)
    info = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
    info = written(info.withColumn("class", F.unhex(F.substring("sha", 1, 32))), "repeats-documents")
    first = info.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= window)).groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    spans = _all_spans(docs, info, first, window)
    n = spans.select("doc_id").distinct().count()
    joined = _only(docs, spans, n)
    cut = map_batches(joined.select("doc_id", "text", "class", "spans"), _cut, "doc_id bigint, class binary, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep, keep).dropDuplicates(["doc_id", "class"])
    found = info.join(first.select("class", F.col("doc_id").alias("_first")), "class", "left").join(cut, ["doc_id", "class"], "left")
    copy = F.col("_first").isNotNull() & (F.col("doc_id") > F.col("_first"))
    out = [
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    return found.select("doc_id", "n_bytes", *out, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep else []))


def _all_spans(docs: DataFrame, info: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """(doc_id, class, spans): of each distinct text's smallest id, what others with smaller ids have."""
    most = HOT
    size = info.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = int(max(1, -(-size // (15 * BUCKET_ANCHORS))))
    packed = map_batches(docs.where("doc_id IS NOT NULL").select("text"), _deal_anchors, "bucket int, shingles binary, owners binary, classes binary", window, buckets)
    flags = packed.groupBy("bucket").applyInArrow(lambda t: _flags(t, most, buckets), parts_schema("keys", "hot"))
    flags = flags.groupBy("part").applyInArrow(_by_text, "class binary, keys binary, hot binary, n bigint")
    flags = written(flags.join(first, "class"), "repeats-flags")
    groups = partitions_for(flags, F.col("n"), BUCKET_FRAGMENTS)
    marked = _only(docs, flags.select("doc_id", "class", "keys", "hot"), flags.count())
    fragments = "group int, fragments binary, sizes binary, counts binary, docs binary, starts binary"
    cut = map_batches(marked, _deal_fragments, fragments, window, buckets, groups)
    parts = max(1, groups // 4)
    spans = cut.groupBy("group").applyInArrow(lambda t: _spans(t, window, parts), "part int, spans binary")
    spans = spans.groupBy("part").applyInArrow(lambda t: _by_document(t), "doc_id bigint, own binary, spans binary")
    # the first eight bytes of a class tell texts with one id apart
    own = flags.select("doc_id", "class", F.substring("class", 1, 8).alias("own"))
    spans = spans.join(own, ["doc_id", "own"]).select("doc_id", "class", F.array("spans").alias("spans"))
    very = flags.where(F.octet_length("hot") > 0)
    if not very.isEmpty():
        many = map_batches(_only(docs, very.select("doc_id", "class", "keys", "hot"), very.count()), _hot_windows, "doc_id bigint, class binary, start bigint, w binary", window, buckets)
        many = written(many, "repeats-hot")
        # a table of its own, so that the join with a hot window's places can be split
        least = written(many.groupBy("w").agg(F.min("doc_id").alias("least")), "repeats-least")
        later = many.join(least, "w").where("doc_id > least").groupBy("doc_id", "class").agg(F.collect_list("start").alias("starts"))
        hot = map_batches(later, _windows, "doc_id bigint, class binary, spans array<binary>", window)
        spans = spans.unionAll(hot).groupBy("doc_id", "class").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return written(spans, "repeats-spans")


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[dict[str, Any]]:
    for batch in batches:
        spans = [merged(s := np.array(x, np.int64), s + window) for x in batch.column("starts").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "class": batch.column("class"), "spans": [[np.column_stack(s).astype("<u4").tobytes()] for s in spans]}
