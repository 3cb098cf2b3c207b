"""Exact n-gram Jaccard join, its candidates compared by signature trees.

Two texts link when 100 * |A and B| >= 75 * |A or B| over their sets of distinct word 5-grams (a shorter text: its
whole sequence). Texts with one set are one class, known by a digest of the set; classes are what is compared.

1. A class that links to another shares 75 % of its own shingles with other classes at least. Shingles travel as packed
   arrays, dealt by hash; who has fewer shared ones takes no further part. Shingles of 24 bits a bucket may make some
   seem shared that are not, never the other way round: own shingles that are alike in these bits count as shared, and
   so do those of equal texts in different packs.
2. Among the rest, a class's shingles are ordered by how many classes have them, rarest first. Linked classes have one
   in common among the first |A| - ceil(0.75 |A|) + 1 (prefix filter), so all links lie in groups by such a shingle.
3. A first round compares classes that share one of their LEADS least hashed shingles, on whole sets, which joins most
   copies. Then groups whose classes are all in one component are done, and groups of the same classes are one group.
4. In a group a signature tree holds token bitmaps combined by OR and by AND, and size ranges. Pairs of nodes are
   traversed together and pruned when their largest possible overlap is too small, their sizes are too far apart, or
   all below is in one component already. With sets at hand, what is left is verified and joins as it goes, so a group
   gives a forest of links and not its pairs.
5. In the second round bitmaps alone travel to the groups, cut into chunks of which all pairs are compared in different
   tasks. Classes that may link to one of another component form clusters, a forest from each task again, and clusters
   are compared by trees on whole sets, each set once for each pair of chunks of its cluster.

Every link is a link of the result's components; links inside a component that is joined already need no check.
Shingles are compared as 64-bit hashes.

Defined cases: null, empty and blank texts have no shingles and their own component; a null doc_id has the least id
of its component, null if it has none; repeated rows are in one component; further columns go along in keep_one().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, forget, map_batches, slices, written
from .graph import components
from .packs import NUMBERED, dealt_by_number, gathered_by_number, names_of, packs
from .words import gram_hashes, mix, word_hashes

WORDS, PERCENT = 5, 75
#: Shingles that a bucket of packed arrays should hold, and bytes of text that are packed together.
BUCKET_SHINGLES, PACKED_TEXT = 1_000_000, 8_000_000
#: Shingles in one chunk of a group, about.
CHUNK_SHINGLES = 1_000_000
#: Classes in one chunk of a group that is compared by bitmaps.
CHUNK_CLASSES = 4_000
#: Bits of a bitmap: a power of two above 1.5 for each shingle, between these.
LEADS, LEAF, LEAST_BITS, MOST_BITS = 2, 8, 2_048, 32_768
#: Ids of classes that go to every task, 16 bytes each; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Ids of copies that go to every task, 8 bytes each; with more, copies count as other texts in the first filter.
BROADCAST_COPIES = 2_000_000


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of whole texts."""
    return [gram_hashes(w, list(range(len(w)))) if 0 < len(w) < words else np.unique(gram_hashes(w, list(range(words)))) for w in word_hashes(texts)]


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in slices(whole):
            yield batch, shingle_sets(batch.column("text").to_pylist(), words)


def _classes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[dict[str, Any]]:
    for batch, sets in _sets_of(batches, words):
        yield {"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "class": [digest(s) if len(s) else None for s in sets]}


def _deal_texts(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[dict[str, Any]]:
    sets = ((digest(s), s) for _, found in _sets_of(batches, words) for s in found if len(s))
    return dealt_by_number(packs(sets, PACKED_TEXT // 6), buckets, 3)


def _deal_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[dict[str, Any]]:
    sets = ((c, np.frombuffer(s, "<u8")) for b in batches for c, s in zip(b.column("class").to_pylist(), b.column("shingles").to_pylist(), strict=True))
    return dealt_by_number(packs(sets, PACKED_TEXT // 6), buckets, 8)


def _answers(rows: pa.Table, packs_: list[int], owners: np.ndarray, **values: np.ndarray) -> pa.Table:
    """What a bucket found for names, in order of owners: a row for each pack; rows of names go along."""
    at = np.searchsorted(owners >> np.uint64(16), np.arange(len(packs_) + 1, dtype=np.uint64))
    of = [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]
    out = {"pack": pa.array([packs_[i] for i, _, _ in of], pa.int64()), "names": pa.nulls(len(of), pa.binary())}
    for column, x in {"owners": (owners & np.uint64(0xFFFF)).astype("<u2"), **values}.items():
        out[column] = pa.array([x[a:b].tobytes() for _, a, b in of], pa.binary())
    named = rows.filter(pa.compute.is_valid(rows.column("names")))
    same = pa.table({k: named.column(k) if k in ("pack", "names") else pa.nulls(len(named), pa.binary()) for k in out})
    return pa.concat_tables([pa.table(out), same])


def _named(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """The names of a pack, the sizes of their sets, and the rows with answers for them."""
    given = pa.compute.is_valid(rows.column("names"))
    return *names_of(rows.filter(given).column("names")[0].as_py()), rows.filter(pa.compute.invert(given))


def _shared(rows: pa.Table) -> pa.Table:
    """How many shingles each class shares with others in this bucket, at most.

    Shingles of one class with the same bits are one entry; all that this hides counts as shared.
    """
    found = gathered_by_number(rows, 3)
    owners, n = np.unique(found.names[found.counts > 1], return_counts=True)
    again, more = np.unique(found.again, return_counts=True)
    at = np.searchsorted(owners, again)
    there = np.flatnonzero(np.append(owners, 0)[at] == again) if len(owners) else at[:0]
    n[at[there]] += more[there]
    return _answers(rows, found.packs, owners, shared=n.astype("<u4"))


def _close(rows: pa.Table) -> pa.Table:
    """Classes of a pack that share enough in all buckets together."""
    names, sizes, answers = _named(rows)
    totals = np.zeros(len(names), np.int64)
    for owners, shared in zip(answers.column("owners").to_pylist(), answers.column("shared").to_pylist(), strict=True):
        totals[np.frombuffer(owners, "<u2")] += np.frombuffer(shared, "<u4")
    return pa.table({"class": pa.array([x.tobytes() for x in names[totals >= least_overlap(sizes)]], pa.binary())})


def _frequencies(rows: pa.Table) -> pa.Table:
    """Each class's shared shingles in this bucket and how many classes have them (255: or more)."""
    found = gathered_by_number(rows, 8)
    some = found.counts > 1
    order = np.argsort(found.names[some], kind="stable")
    counts = np.minimum(found.counts[some][order], 255)
    return _answers(rows, found.packs, found.names[some][order], hashes=found.hashes[some][order].astype("<u8"), counts=counts.astype(np.uint8))


def least_overlap(n: Any) -> Any:
    """ceil(0.75 n): what a set of n shares with any set that it links to."""
    return -(-PERCENT * n // 100)


def _prefixes(rows: pa.Table) -> pa.Table:
    """Of each class in a pack, shared shingles among its first ones, rarest first; leads: the least of all, by hashes."""
    names, sizes, answers = _named(rows)
    owners, h, counts = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in answers.column(c).to_pylist())]) for c, kind in (("owners", "<u2"), ("hashes", "<u8"), ("counts", "u1")))
    order = np.lexsort((h, counts, owners))
    h = h[order]
    cuts = np.searchsorted(owners[order], np.arange(len(names) + 1))
    out: dict[str, list[Any]] = {"class": [], "leads": [], "tokens": []}
    for name, n, a, b in zip(names, sizes.tolist(), cuts[:-1], cuts[1:], strict=True):
        if b - a < least_overlap(n):
            continue  # those that only this class has come first, and are too many
        out["class"].append(name.tobytes())
        out["leads"].append([h[a:b][np.argmin(mix(h[a:b] + np.uint64(i)))].astype(np.int64) for i in range(LEADS)])
        out["tokens"].append(h[a : b - least_overlap(n) + 1].astype(np.int64))
    return pa.table({k: pa.array(v, pa.binary() if k == "class" else pa.list_(pa.int64())) for k, v in out.items()})


class Forest:
    """Which members are joined, by union and find."""

    def __init__(self, labels: list[int]):
        self.up = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            self.up[i] = first.setdefault(label, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        r, s = self.root(i), self.root(j)
        self.up[max(r, s)] = min(r, s)
        return r != s

    def all_one(self, members: list[int]) -> bool:
        root = self.root(members[0])
        return all(self.root(m) == root for m in members)


class Node:
    __slots__ = ("any", "every", "high", "kids", "low", "members")

    def __init__(self, members: list[int], kids: list[Node], any_: np.ndarray, every: np.ndarray, low: int, high: int):
        self.members, self.kids, self.any, self.every, self.low, self.high = members, kids, any_, every, low, high


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap wide enough for the set that it isn't full; a wider one folds to a narrower one by OR of its halves."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (3 * len(shingles) // 2).bit_length()))
    bits = np.zeros(width, bool)
    bits[mix(shingles) & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def _fold(signs: np.ndarray, width: int) -> np.ndarray:
    while signs.shape[-1] > width:
        signs = signs[..., : signs.shape[-1] // 2] | signs[..., signs.shape[-1] // 2 :]
    return signs


class SignatureTree:
    """Over the members of a group: their sizes, bitmaps and components, and their sorted sets if these are at hand.

    Members with bitmaps of one width have one root. Without sets, `near` joins members that may link, and `involved`
    are those that may link to a member of another component.
    """

    def __init__(self, sizes: list[int], signs: list[bytes], labels: list[Any], sets: list[np.ndarray] | None = None):
        number: dict[Any, int] = {}
        self.sets, self.forest = sets, Forest([number.setdefault(x, len(number)) for x in labels])
        self.near, self.involved = Forest(list(range(len(sizes)))), np.zeros(len(sizes), bool)
        self.sizes = np.array(sizes, np.int64)
        self.signs = [np.frombuffer(s, np.uint64) for s in signs]
        self.roots = []
        for width in sorted({len(s) for s in signs}):
            # members of one component, of like size, and with like bitmaps stand together
            order = sorted((i for i, s in enumerate(signs) if len(s) == width), key=lambda i: (self.forest.root(i), int(np.log(max(1, sizes[i])) / 0.25), signs[i]))
            self.roots.append(self._build(order))

    def _build(self, order: list[int]) -> Node:
        level = []
        for a in range(0, len(order), LEAF):
            members = order[a : a + LEAF]
            signs, sizes = [self.signs[m] for m in members], self.sizes[members]
            level.append(Node(members, [], np.bitwise_or.reduce(signs), np.bitwise_and.reduce(signs), int(sizes.min()), int(sizes.max())))
        while len(level) > 1:
            level = [
                Node([m for k in kids for m in k.members], kids, np.bitwise_or.reduce([k.any for k in kids]), np.bitwise_and.reduce([k.every for k in kids]), min(k.low for k in kids), max(k.high for k in kids))
                for kids in (level[a : a + LEAF] for a in range(0, len(level), LEAF))
            ]
        return level[0]

    def _apart(self, a: Node, b: Node) -> bool:
        """No set below a can link to one below b: tokens on bits that no set of the other has can't be shared."""
        if 100 * a.high < PERCENT * b.low or 100 * b.high < PERCENT * a.low:
            return True
        width = min(len(a.any), len(b.any))
        most = min(x.high - int(np.bitwise_count(_fold(x.every, width) & ~_fold(y.any, width)).sum()) for x, y in ((a, b), (b, a)))
        return (100 + PERCENT) * most < PERCENT * (a.low + b.low)

    def _done(self, a: Node, b: Node) -> bool:
        members = a.members + b.members
        return self.forest.all_one(members) or (self.sets is None and bool(self.involved[members].all()) and self.near.all_one(members))

    def links(self) -> list[tuple[int, int]]:
        """A forest of links between components; without sets, of pairs that may link, over all that are involved."""
        found: list[tuple[int, int]] = []
        todo = [(a, b) for i, a in enumerate(self.roots) for b in self.roots[i:]]
        while todo:
            a, b = todo.pop()
            if (a is not b and self._apart(a, b)) or self._done(a, b):
                continue
            if not a.kids and not b.kids:
                self._leaves(a, b, found)
            elif a is b:
                todo += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i + 1 :]] + [(x, x) for x in a.kids]
            elif not b.kids or (a.kids and len(a.members) >= len(b.members)):
                todo += [(x, b) for x in a.kids]
            else:
                todo += [(a, x) for x in b.kids]
        return found

    def _leaves(self, a: Node, b: Node, found: list[tuple[int, int]]) -> None:
        left, right = np.array(a.members), np.array(b.members)
        width = min(len(a.any), len(b.any))
        x, y = (_fold(np.stack([self.signs[m] for m in node.members]), width) for node in (a, b))
        x, y = x[:, None], y[None]
        sizes = self.sizes[left][:, None], self.sizes[right][None]
        most = np.minimum(sizes[0] - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), sizes[1] - np.bitwise_count(y & ~x).sum(2, dtype=np.int64))
        for i, j in np.argwhere((100 + PERCENT) * most >= PERCENT * (sizes[0] + sizes[1])):
            p, q = int(left[i]), int(right[j])
            if (a is b and i >= j) or self.forest.root(p) == self.forest.root(q):
                continue
            if self.sets is None:
                self.involved[[p, q]] = True
                if self.near.join(p, q):
                    found.append((p, q))
            elif linked(self.sets[p], self.sets[q]):
                self.forest.join(p, q)
                found.append((p, q))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(shared) and 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _compare(rows: pa.Table) -> pa.Table:
    """A forest of links among a group's classes; without their sets, of pairs that may link."""
    names = rows.column("class").to_pylist()
    where = {c: i for i, c in enumerate(names)}  # a pair of chunks may hold a class twice
    at = list(where.values())
    part = rows.take(pa.array(at))
    sets = [np.frombuffer(s, "<u8") for s in part.column("shingles").to_pylist()] if "shingles" in rows.column_names else None
    tree = SignatureTree(part.column("n_shingles").to_pylist(), part.column("signature").to_pylist(), part.column("component").to_pylist(), sets)
    pairs = tree.links()
    ends = [[min(names[at[i]], names[at[j]]) for i, j in pairs], [max(names[at[i]], names[at[j]]) for i, j in pairs]]
    return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})


def _by_chunks(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """members (token, class, component) of groups of several chunks at each pair (p, q) with their own chunk."""
    placed = members.join(chunks, "token").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("p"), F.greatest(c, F.col("chunk")).alias("q")))
    return placed.select("token", "class", "component", F.explode(pairs).alias("pair")).select("token", "pair.p", "pair.q", "class", "component")


def _only(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The sets of members; few enough names go to every task, so that other sets don't move."""
    wanted = members.select("class").distinct()
    return sets.join(F.broadcast(wanted), "class", "left_semi") if wanted.count() <= BROADCAST_IDS else sets


def _first_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members (token, class, component) of one token and one chunk, on their sets."""
    sized = members.join(sets.select("class", "n_shingles"), "class")
    # a table of its own, so that the join with a hot token's members can be split
    chunks = written(sized.groupBy("token").agg(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES).alias("chunks")), "jaccard-chunks")
    placed = sized.join(chunks, "token").select("token", F.pmod(F.xxhash64("class"), F.col("chunks")).alias("chunk"), "class", "component")
    return placed.join(_only(sets, members), "class").groupBy("token", "chunk").applyInArrow(_compare, "a binary, b binary")


def _clusters(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, class, component): classes that may link to one of another component; a cluster's name is its token."""
    chunks = written(members.groupBy("token").agg(F.ceil(F.count("*") / CHUNK_CLASSES).alias("chunks")), "jaccard-chunks")
    small = _by_chunks(members, chunks).join(sets.select("class", "n_shingles", "signature"), "class")
    near = components(small.groupBy("token", "p", "q").applyInArrow(_compare, "a binary, b binary"), "jaccard-near")
    return near.select(F.col("component").alias("token"), F.col("node").alias("class")).join(members.select("class", "component").distinct(), "class")


def _cluster_links(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    sized = clusters.join(sets.select("class", "n_shingles"), "class")
    chunks = written(sized.groupBy("token").agg(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES).alias("chunks")), "jaccard-chunks")
    return _by_chunks(clusters, chunks).join(_only(sets, clusters), "class").groupBy("token", "p", "q").applyInArrow(_compare, "a binary, b binary")


def classes_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class of every document."""
    return map_batches(docs.select("doc_id", "text"), _classes, "doc_id bigint, n_shingles bigint, class binary", words)


def join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, with its class."""
    return _joined(docs, words).select("doc_id", "n_shingles", "component_id", F.hex("class").alias("class"))


def _joined(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class, component (its least class), component_id."""
    members = written(classes_of(docs, words), "jaccard-classes")
    classes = members.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    total = members.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    links = _class_links(docs, _copies(members, classes), classes, int(total), words)
    named = written(components(links, "jaccard-components"), "jaccard-named")
    forget(links)
    joined = named.withColumnRenamed("node", "class").join(classes, "class")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    larger = joined.join(least, "component").select("class", "component", "component_id")
    found = classes.select("class", "least").join(larger, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    return members.join(found, "class", "left").select("doc_id", "n_shingles", "class", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def _copies(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The ids whose every text another id's text stands for."""
    own = members.where("doc_id IS NOT NULL").join(classes.select("class", "least"), "class", "left")
    found = own.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") > F.col("least")).alias("copy"))
    return written(found.where("copy").select(F.col("doc_id").alias("_copy")), "jaccard-copies")


def _class_links(docs: DataFrame, copies: DataFrame, classes: DataFrame, total: int, words: int) -> DataFrame:
    buckets = max(1, -(-total // BUCKET_SHINGLES))
    single = docs.join(F.broadcast(copies), docs["doc_id"] == copies["_copy"], "left_anti") if copies.count() <= BROADCAST_COPIES else docs
    dealt = map_batches(single.select("text"), _deal_texts, NUMBERED, words, buckets)
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "pack bigint, names binary, owners binary, shared binary")
    shared = shared.groupBy("pack").applyInArrow(_close, "class binary").distinct()
    close = written(classes.join(shared, "class").select("class", "least", "n_shingles"), "jaccard-close")

    n, kept = close.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    wanted = F.broadcast(close) if n <= BROADCAST_IDS else close
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("least").alias("_least")).distinct(), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = map_batches(texts, _sets, "class binary, n_shingles bigint, signature binary, shingles binary", words).join(wanted.select("class"), "class", "left_semi")
    sets = written(sets.dropDuplicates(["class"]), "jaccard-sets")

    few = max(1, -(-int(kept) // BUCKET_SHINGLES))
    dealt = map_batches(sets.select("class", "shingles"), _deal_sets, NUMBERED, few)
    counted = dealt.groupBy("bucket").applyInArrow(_frequencies, "pack bigint, names binary, owners binary, hashes binary, counts binary")
    prefixes = written(counted.groupBy("pack").applyInArrow(_prefixes, "class binary, leads array<bigint>, tokens array<bigint>"), "jaccard-prefixes")

    leads = prefixes.select(F.explode(F.array_distinct("leads")).alias("token"), "class", F.col("class").alias("component"))
    leads = written(_several(leads), "jaccard-leads")
    named = components(_first_links(leads, sets), "jaccard-first").withColumnRenamed("node", "class")
    tokens = prefixes.select("class", F.explode("tokens").alias("token")).join(named, "class", "left")
    tokens = written(_several(tokens.select("token", "class", F.coalesce("component", "class").alias("component"))), "jaccard-tokens")
    clusters = written(_clusters(tokens, sets), "jaccard-clusters")
    rest = _cluster_links(clusters, sets)
    links = written(rest.unionAll(named.where("class <> component").select(F.col("class").alias("a"), F.col("component").alias("b"))), "jaccard-links")
    forget(copies, close, sets, prefixes, leads, tokens, clusters)
    return links


def _several(members: DataFrame) -> DataFrame:
    """Members (token, class, component) of tokens whose members are in several components, one token for each set of members."""
    own = F.xxhash64("class")
    groups = members.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = groups.where("low <> high").groupBy("n", "x", "y").agg(F.min("token").alias("token"))
    return members.join(groups.select("token"), "token", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[dict[str, Any]]:
    for _, found in _sets_of(batches, words):
        if sets := [s for s in found if len(s)]:
            yield {"class": [digest(s) for s in sets], "n_shingles": [len(s) for s in sets], "signature": [signature(s) for s in sets], "shingles": [s.astype("<u8").tobytes() for s in sets]}


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row of each component, that with the least doc_id, and all without words; all columns stay.

    Of rows with that id in one component, or without ids in a component that has none, any one stays.
    """
    found = written(_joined(docs, words), "jaccard-joined").withColumnRenamed("doc_id", "_id")
    worded = found.where("class IS NOT NULL")
    several = written(worded.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 OR _id IS NULL").select("_id"), "jaccard-several")
    apart = found.where("_id <> component_id").select("_id").distinct().unionAll(several)
    apart = written(apart, "jaccard-apart")
    ids = F.broadcast(apart) if apart.count() <= BROADCAST_COPIES else apart
    known = docs.join(ids, docs["doc_id"].eqNullSafe(apart["_id"]), "left_anti")
    if several.isEmpty():
        return known
    rows = docs.join(several, docs["doc_id"].eqNullSafe(several["_id"]), "left_semi").select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = bounded(rows).mapInArrow(lambda batches: _with_class(batches, words), T.StructType([*rows.schema.fields, T.StructField("class", T.BinaryType())]))
    of = worded.select("_id", F.col("class").alias("_of"), "component", "component_id").dropDuplicates(["_id", "_of"])
    rows = rows.join(of, rows["doc_id"].eqNullSafe(of["_id"]) & (rows["class"] == of["_of"]), "left")
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last()))
    own = F.col("class").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("first") == 1))
    return known.unionAll(rows.withColumn("first", first).where(own).select("row.*"))


def _with_class(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets_of(batches, words):
        yield batch.append_column("class", pa.array([digest(s) if len(s) else None for s in sets], pa.binary()))
