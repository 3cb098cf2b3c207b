"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; its zeros don't count, so a replaced word leaves some seeds whole. The
seeds of test items are joined with those of every position of every document, and each hit is verified: along its
diagonal (word i of the item beside word i + d of the document) the best run, a match for +1 and a mismatch for -2,
gives matched words; runs on diagonals at most SLIP apart count together, which bridges inserted and deleted words.

The test side goes to each task as a sorted table of about ITEM_SEEDS seeds. A larger benchmark goes in blocks, one pass
over the documents for each, and one block at a time is in memory: rows are numbered and written once, each pass writes
what it finds by these numbers, and a join brings it back to the rows. Results are the same in one block and in many.

Defined cases: null and empty texts are clean; items without words match nothing; an item of fewer words than the
shortest mask must appear whole; repeated documents are each reported; a null doc_id stays null; repeated items count
once each; an item_id may be null; of equal overlaps the smallest item_id is reported, null last; further columns go
along in clean() and are not read in report().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_batches, slices, written
from .words import PLAIN, gram_hashes, word_hashes

MASKS = ("111111", "1101011", "11001101", "101100101", "1110010101")
#: Matched words that make a document contaminated, or this share of a shorter item.
MATCHED, SHARE = 10, 0.8
LEAST_RUN, SLIP = 5, 4
ITEM_SEEDS = 2_000_000
#: Hits of one seed beyond which its diagonals are marked instead of listed; hits listed, and cells compared, at once.
MANY_HITS, HITS_AT_ONCE, CELLS = 1 << 14, 1 << 20, 1 << 20


class Seeds(NamedTuple):
    masks: list[list[int]]
    keys: np.ndarray  # sorted seed hashes
    item: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]
    names: list[int | None]


Items = list[tuple[int | None, str | None]]


def seed_hashes(words: np.ndarray, mask: list[int]) -> np.ndarray:
    """Other masks give other numbers for the same words, so that no item's hits depend on the masks of others."""
    return gram_hashes(words, mask) ^ np.uint64(xxhash.xxh3_64_intdigest(bytes(mask)))


def seeds_of(items: Items) -> Seeds:
    words = word_hashes([text for _, text in items], PLAIN)
    shortest = min(map(len, MASKS))
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    masks += [list(range(n)) for n in sorted({len(w) for w in words if 0 < len(w) < shortest})]
    parts = []
    for number, mask in enumerate(masks):
        for i, w in enumerate(words):
            if number < len(MASKS) or len(w) == len(mask):
                h = seed_hashes(w, mask)
                parts.append((h, np.full(len(h), i), np.arange(len(h))))
    keys, item, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(keys, kind="stable")
    return Seeds(masks, keys[order], item[order], place[order], words, [n for n, _ in items])


def hits(words: np.ndarray, seeds: Seeds, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (item, diagonal) of all seed hits, in order; filled: which low bits of a hash some seed has."""
    found = []
    for mask in seeds.masks:
        h = seed_hashes(words, mask)
        at = np.flatnonzero(filled[h & np.uint64(len(filled) - 1)])
        if not len(at):
            continue
        low = np.searchsorted(seeds.keys, h[at], "left")
        there = seeds.keys[np.minimum(low, len(seeds.keys) - 1)] == h[at]
        at, low = at[there], low[there]
        if not len(at):
            continue
        n = np.searchsorted(seeds.keys, h[at], "right") - low
        if n.sum() > MANY_HITS:
            _, same, times = np.unique(low, return_inverse=True, return_counts=True)
            many = times[same] * n > MANY_HITS
            for key in np.unique(low[many]):
                found += _spread(at[many & (low == key)], seeds, key, key + n[low == key][0])
            at, low, n = at[~many], low[~many], n[~many]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE)) + 1
        for p, first, k in zip(*(np.split(x, cuts) for x in (at, low, n)), strict=True) if len(cuts) else [(at, low, n)]:
            seed = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(k.sum())
            codes = _code(seeds.item[seed], np.repeat(p, k) - seeds.place[seed])
            found.append(np.unique(codes) if len(cuts) else codes)
    codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return codes >> 40, (codes & ((1 << 40) - 1)) - (1 << 39)


def touched(texts: list[np.ndarray], seeds: Seeds, filled: np.ndarray) -> np.ndarray:
    """Which texts, given by their words, have some hit: all are looked up together."""
    found = np.zeros(len(texts), bool)
    words = np.concatenate([np.zeros(0, np.uint64), *texts])
    ends = np.cumsum([len(t) for t in texts])
    for mask in seeds.masks:
        h = seed_hashes(words, mask)
        at = np.flatnonzero(filled[h & np.uint64(len(filled) - 1)])
        if len(at):
            h = h[at]
            at = at[seeds.keys[np.minimum(np.searchsorted(seeds.keys, h), len(seeds.keys) - 1)] == h]
            text = np.searchsorted(ends, at, "right")
            found[text[at + max(mask) < ends[text]]] = True
    return found


def _code(item: np.ndarray | int, diagonal: np.ndarray) -> np.ndarray:
    return (item << 40) + diagonal + (1 << 39)


def _spread(places: np.ndarray, seeds: Seeds, low: int, high: int) -> list[np.ndarray]:
    """The hits of one repeated seed, marked by diagonal: no more come out than places in the document and the item."""
    items, cuts = np.unique(seeds.item[low:high], return_index=True)
    out = []
    for item, own in zip(items.tolist(), np.split(seeds.place[low:high], cuts[1:]), strict=True):
        least = places[0] - own[-1]
        marked = np.zeros(places[-1] - own[0] - least + 1, bool)
        for place in own:
            marked[places - (place + least)] = True
        out.append(_code(item, np.flatnonzero(marked) + least))
    return out


def best_runs(item: np.ndarray, words: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal a row of the item's places: which match, in the best run along it."""
    at = diagonals[:, None] + np.arange(len(item))
    same = (words[np.clip(at, 0, len(words) - 1)] == item) & (at >= 0) & (at < len(words))
    total = np.zeros((len(diagonals), len(item) + 1), np.int32)
    np.cumsum(np.where(same, 1, -2), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - low, axis=1)[:, None]
    places = np.arange(len(item) + 1)
    lowest = (total == np.take_along_axis(low, end, 1)) & (places <= end)
    start = len(item) - np.argmax(lowest[:, ::-1], axis=1)[:, None]
    return same & (places[:-1] >= start) & (places[:-1] < end)


def overlaps(words: np.ndarray, seeds: Seeds, filled: np.ndarray) -> list[tuple[int | None, int, float]]:
    """(item_id, matched words, share of the item) of each item that overlaps by LEAST_RUN words at least."""
    items, diagonals = hits(words, seeds, filled)
    if not len(items):
        return []
    numbers, cuts = np.unique(items, return_index=True)
    out = []
    for number, own in zip(numbers.tolist(), np.split(diagonals, cuts[1:]), strict=True):
        item = seeds.words[number]
        matched, group, last = 0, None, None
        step = max(1, CELLS // len(item))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            runs = best_runs(item, words, part)
            long = runs.sum(1) >= min(LEAST_RUN, len(item))
            runs, part = runs[long], part[long]
            if not len(part):
                continue
            # runs on diagonals at most SLIP apart count together
            new = np.flatnonzero(np.diff(part, prepend=part[0] if last is None else last) > SLIP)
            firsts = np.union1d([0], new)
            groups = np.logical_or.reduceat(runs, firsts, axis=0)
            if group is not None and not (len(new) and new[0] == 0):
                groups[0] |= group
            matched, group, last = max(matched, int(groups.sum(1).max())), groups[-1], part[-1]
        if matched:
            out.append((seeds.names[number], matched, matched / len(item)))
    return out


def overlaps_of(texts: list[str | None], seeds: Seeds, filled: np.ndarray) -> list[list[tuple[int | None, int, float]]]:
    words = word_hashes(texts, PLAIN)
    return [overlaps(w, seeds, filled) if some else [] for w, some in zip(words, touched(words, seeds, filled), strict=True)]


def bitmap(seeds: Seeds) -> np.ndarray:
    filled = np.zeros(1 << max(16, (16 * len(seeds.keys)).bit_length()), bool)
    filled[seeds.keys & np.uint64(len(filled) - 1)] = True
    return filled


def is_leak(matched: int, share: float) -> bool:
    return matched >= MATCHED or share >= SHARE


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """Test items in blocks of about ITEM_SEEDS seeds, none read yet; how many blocks comes from their words."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    words = F.size(F.split("text", r"[^0-9a-zA-Z\x{80}-\x{10FFFF}]+"))
    n = items.agg(F.sum(words).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(n) * len(MASKS) // ITEM_SEEDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(part == b).orderBy("item_id", "text") for b in range(blocks)]


def _read(block: DataFrame) -> Items:
    return [tuple(r) for r in block.collect()]


SCHEMA = "doc_id bigint, contaminated boolean, n_items bigint, item_id bigint, n_matched bigint, share double"


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")


def _found(rows: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """What SCHEMA has after doc_id, by _row, of the numbered rows that overlap with some item."""
    keyed = rows.select(F.col("_row").alias("doc_id"), "text")
    passes = [written(map_batches(keyed, _report, SCHEMA, _read(b)).where("n_matched > 0"), "decontaminate-block") for b in blocks]
    # as in _report: a leak before none, then the larger overlap, then the smaller item_id, null last
    best = F.max(F.struct("contaminated", "n_matched", "share", F.bitwise_not("item_id").alias("not_id"))).alias("best")
    every = reduce(DataFrame.unionAll, passes).groupBy(F.col("doc_id").alias("_row")).agg(F.sum("n_items").alias("n_items"), best)
    return every.select("_row", "best.contaminated", "n_items", F.bitwise_not("best.not_id").alias("item_id"), "best.n_matched", "best.share")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, item_id, n_matched, share (of its largest overlap)."""
    keyed = docs.select("doc_id", "text")
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return map_batches(keyed, _report, SCHEMA, _read(blocks[0]))
    rows = _numbered(keyed)
    none = {"contaminated": F.lit(False), "n_items": F.lit(0), "n_matched": F.lit(0), "share": F.lit(0.0)}
    joined = rows.select("_row", "doc_id").join(_found(rows, blocks), "_row", "left")
    return joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("contaminated", "n_items", "item_id", "n_matched", "share")))


def _report(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[dict[str, Any]]:
    seeds = seeds_of(items)
    filled = bitmap(seeds)
    for whole in batches:
        for batch in slices(whole):
            out = []
            for found in overlaps_of(batch.column("text").to_pylist(), seeds, filled):
                leaks = [f for f in found if is_leak(*f[1:])]
                item, matched, share = max(leaks or found, key=lambda f: (f[1], f[2], f[0] is not None, -(f[0] or 0)), default=(None, 0, 0.0))
                out.append((bool(leaks), len(leaks), item, matched, share))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(("contaminated", "n_items", "item_id", "n_matched", "share"), zip(*out, strict=True), strict=True))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated ones; all columns stay."""
    blocks = _blocks(benchmark)
    if len(blocks) > 1:
        rows = _numbered(docs)
        return rows.join(_found(rows, blocks).where("contaminated").select("_row"), "_row", "left_anti").drop("_row")
    items = _read(blocks[0])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = seeds_of(items)
        filled = bitmap(seeds)
        for whole in batches:
            for batch in slices(whole):
                stay = [not any(is_leak(*f[1:]) for f in found) for found in overlaps_of(batch.column("text").to_pylist(), seeds, filled)]
                yield batch.filter(pa.array(stay))

    return bounded(docs).mapInArrow(kept, docs.schema)
