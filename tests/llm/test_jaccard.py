import random
import re

import pytest

from isopanel.llm import jaccard
from isopanel.llm.graph import components

SCHEMA = "doc_id long, text string, component_id string, class string"


def brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                n = len(a & sets[j])
                if 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    brute.roots = [root(i) for i in range(len(rows))]
    return sorted(((d, len(s), least[root(i)]) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


def kept_ids(rows):
    """One row of each component, with its least id; without words each row is a component."""
    found = {}
    brute(rows)
    for (d, *_), root in zip(rows, brute.roots):
        found[root] = min((x for x in (found.get(root), d) if x is not None), default=None)
    return sorted(map(str, found.values()))


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        if i % 4 == 0:
            text += common
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(2, int(len(copy) * 0.8))]
            rows.append((len(rows), "  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy), "x", None))
    base = rng.choices(vocabulary, k=60)
    for _ in range(80):
        copy = list(base)
        copy[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(copy), "x", None))
    n = len(rows)
    rows += [(n + 1, None, None, None), (n + 2, "", None, None), (n + 3, " \t\n", None, None), (n + 4, "one", None, None), (n + 5, "ONE", None, None), (n + 6, "É one", None, None), (None, "one", None, None), (None, "lonely words here", None, None), (n + 4, "one", None, None), (n + 7, rows[0][1] + " ", None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_join(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 500)
        monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 300)
        monkeypatch.setattr(jaccard, "CHUNK_CLASSES", 3)
        monkeypatch.setattr(jaccard, "PACKED_TEXT", 3000)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = fixture(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.join(df)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == kept_ids(rows)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(df).count() == 0


def test_tree_finds_what_brute_force_finds():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)
        for _ in range(5):
            part = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.3])]
            sets.append(np.unique(np.append(part, rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64))))
    sets = [s for s in sets if len(s)]
    tree = jaccard.SignatureTree([len(s) for s in sets], [jaccard.signature(s) for s in sets], list(range(len(sets))), sets)
    tree.links()
    want = jaccard.Forest(list(range(len(sets))))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                want.up[max(want.root(i), want.root(j))] = min(want.root(i), want.root(j))
    assert [tree.forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    for part_edges in (7, 500_000):
        df = spark.createDataFrame(edges, "a long, b long").repartition(40)
        got = {r["node"]: r["component"] for r in components(df, part_edges=part_edges).collect()}
        assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_long_texts_and_a_family(spark, monkeypatch):
    """Long texts are told apart by their bitmaps, and a family gives a forest, not its pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 3_000).astype(np.uint64)) for _ in range(60)]
    tree = jaccard.SignatureTree([len(s) for s in sets], [jaccard.signature(s) for s in sets], list(range(60)))
    assert tree.links() == [] and not tree.involved.any()
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    family = [np.unique(np.append(base[rng.random(120) > 0.1], rng.integers(0, 1 << 62, 5).astype(np.uint64))) for _ in range(500)]
    rows = pa.table({"class": [jaccard.digest(s) for s in family], "n_shingles": [len(s) for s in family], "signature": [jaccard.signature(s) for s in family], "component": [jaccard.digest(s) for s in family]})
    for table in (rows, rows.append_column("shingles", pa.array([s.astype("<u8").tobytes() for s in family]))):
        assert 0 < jaccard._compare(table).num_rows < 500
    words = [f"w{i}" for i in range(9_000)]
    docs = []
    for _ in range(12):
        text = list(rng.choice(words, 3_004))
        docs += [text, text[:2_400], text[700:]]
    texts = [" ".join(t) for t in docs]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)


def test_long_texts_whose_own_shingles_collide(spark):
    words = [f"w{i}" for i in range(100_004)]
    rows = [(1, " ".join(words), None, None), (2, " ".join(words[:75_054]), None, None), (3, " ".join(words[:75_002]), None, None)]
    # 75,050 of 100,000 link; 74,998 of 100,000 don't
    for other, linked in ((2, True), (3, False)):
        df = spark.createDataFrame([r for r in rows if r[0] in (1, other)], SCHEMA)
        got = sorted(tuple(r)[:3] for r in jaccard.join(df).collect())
        assert got == [(1, 100_000, 1), (other, 75_050 if linked else 74_998, 1 if linked else 3)]
