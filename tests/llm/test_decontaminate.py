import random

import numpy as np

from isopanel.llm import decontaminate as dc
from isopanel.llm.words import PLAIN, word_hashes

WORDS = [f"w{i}" for i in range(3000)] + ["the", "of"] * 300
SCHEMA = "doc_id long, text string, item_id long, contaminated string"


def fixture():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 8, 14, 30, 45])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "?!"), (0, items[0][1])]
    docs, leaked = [], set()
    for i in range(300):
        words = rng.choices(WORDS, k=rng.choice([0, 5, 60, 400, 3000]))
        if i % 3 == 0:
            item = rng.choice(items[:40])[1].upper().split()
            for at in range(len(item)):
                if at % 9 == 4 and i % 2:
                    item[at] = "replaced"
            if len(item) >= 14 or i % 2 == 0:
                leaked.add(i)
                words[len(words) // 2 : len(words) // 2] = [w + "," for w in item]
        docs.append((i, " ".join(words), 7, "x"))
    return items, [*docs, (None, "clean", None, None), (900, None, 1, None), (901, "", 1, None), (5, docs[5][1], 1, "x")], leaked


def test_leaks(spark, monkeypatch):
    items, docs, leaked = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    got = dc.report(df, bench).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"] for r in got if r["contaminated"]} == leaked
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(leaked)
    monkeypatch.setattr(dc, "ITEM_SEEDS", 1000)
    assert len(dc._blocks(bench)) > 2
    assert {r["doc_id"] for r in dc.report(df, bench).collect() if r["contaminated"]} == leaked
    assert dc.clean(df, bench).count() == len(docs) - len(leaked)


def test_empty(spark):
    items, docs, _ = fixture()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, SCHEMA)
    assert dc.report(df.limit(0), bench).count() == 0
    assert dc.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_hits_equal_brute_force():
    items, docs, _ = fixture()
    seeds = dc.seeds_of([x for x in items if x[1]])
    filled = dc.bitmap(seeds)
    for _, text, *_ in docs[:10]:
        words = word_hashes([text], PLAIN)[0]
        want = set()
        for i, item in enumerate(seeds.words):
            for mask in dc.MASKS:
                ones = [k for k, c in enumerate(mask) if c == "1"]
                for p in range(len(words) - len(mask) + 1):
                    if len(item) >= len(mask):
                        same = np.ones(len(item) - len(mask) + 1, bool)
                        for k in ones:
                            same &= item[k : k + len(same)] == words[p + k]
                        want |= {(i, p - int(q)) for q in np.flatnonzero(same)}
            if 0 < len(item) < 6:
                want |= {(i, p) for p in range(len(words) - len(item) + 1) if (words[p : p + len(item)] == item).all()}
        assert set(zip(*(x.tolist() for x in dc.hits(words, seeds, filled)))) == want


def test_texts_together_equal_texts_alone():
    items, docs, _ = fixture()
    seeds = dc.seeds_of(items)
    filled = dc.bitmap(seeds)
    texts = [d[1] for d in docs] + [items[7][1], "", items[3][1][:9]]
    alone = [dc.overlaps(word_hashes([t], PLAIN)[0], seeds, filled) for t in texts]
    assert dc.overlaps_of(texts, seeds, filled) == alone and sum(map(bool, alone)) > 50
    assert dc.overlaps_of([], seeds, filled) == [] and dc.overlaps_of(texts, dc.seeds_of([]), dc.bitmap(dc.seeds_of([]))) == [[]] * len(texts)


def one_run(item, words, diagonal):
    """Places of the item that match in the best run along a diagonal, by trying all."""
    same = [0 <= i + diagonal < len(words) and item[i] == words[i + diagonal] for i in range(len(item))]
    total = [0]
    for x in same:
        total.append(total[-1] + (1 if x else -2))
    best = max((total[e] - total[b], -e, b) for e in range(len(total)) for b in range(e + 1))
    return {i for i in range(best[2], -best[1]) if same[i]}


def test_overlaps_equal_brute_force(monkeypatch):
    monkeypatch.setattr(dc, "MANY_HITS", 40)
    monkeypatch.setattr(dc, "HITS_AT_ONCE", 50)
    monkeypatch.setattr(dc, "CELLS", 100)
    rng = random.Random(11)
    for _ in range(25):
        few = [f"x{i}" for i in range(rng.choice([1, 2, 5, 60]))]
        items = [(i, " ".join(rng.choices(few, k=rng.choice([3, 9, 30])))) for i in range(4)]
        doc = rng.choices(few, k=60) + items[0][1].split()[:12] + ["new"] + items[0][1].split()[12:]
        seeds = dc.seeds_of(items)
        words = word_hashes([" ".join(doc)], PLAIN)[0]
        want = []
        found = list(zip(*(x.tolist() for x in dc.hits(words, seeds, dc.bitmap(seeds)))))
        for i, item in enumerate(seeds.words):
            groups, last = [], None
            for diagonal in sorted(d for j, d in found if j == i):
                run = one_run(item.tolist(), words.tolist(), diagonal)
                if len(run) >= min(dc.LEAST_RUN, len(item)):
                    if last is None or diagonal - last > dc.SLIP:
                        groups.append(set())
                    groups[-1] |= run
                    last = diagonal
            if groups:
                n = max(map(len, groups))
                want.append((i, n, n / len(item)))
        assert sorted(dc.overlaps(words, seeds, dc.bitmap(seeds))) == want


def test_repeated_words_take_no_square_of_time():
    import time

    seeds = dc.seeds_of([(1, "again " * 400), (2, "to be or not " * 100)])
    words = word_hashes(["again " * 20_000, "or not to be " * 5_000], PLAIN)
    began = time.time()
    assert [dc.overlaps(w, seeds, dc.bitmap(seeds)) for w in words] == [[(1, 400, 1.0)], [(2, 400, 1.0)]]
    assert time.time() - began < 10


def test_blocks_give_the_same_rows(spark, monkeypatch):
    items, docs, _ = fixture()
    rng = random.Random(3)
    lost = " ".join(rng.choices(WORDS, k=30))
    items = [*items, (None, lost), (77, items[1][1]), (78, lost)]
    docs = [*docs, (None, items[1][1], 2, "y"), (None, None, 3, None), (None, "clean too", 4, None), (950, f"a {lost} b", 5, "z"), (950, f"a {lost} b", 6, "z"), (950, "clean", 7, None)]
    only_null = spark.createDataFrame([(None, lost)], "item_id long, text string")
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, SCHEMA)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want, stay = rows(dc.report(df, bench)), rows(dc.clean(df, bench))
    assert len(want) == len(docs) and [r[1:4] for r in want if r[0] == 950] == [(False, 0, None), (True, 2, 78), (True, 2, 78)]
    assert sorted(r[1] for r in want if r[0] is None) == [False, False, False, True]
    assert [r[:5] for r in rows(dc.report(df, only_null)) if r[1]] == [(950, True, 1, None, 30)] * 2
    assert dc.clean(df, only_null).count() == len(docs) - 2
    monkeypatch.setattr(dc, "ITEM_SEEDS", 1000)
    blocks = dc._blocks(bench)
    assert len(blocks) > 2 and sum(b.count() for b in blocks) == len([x for x in items if x[1] is not None])
    again = dc.clean(df, bench)
    assert rows(dc.report(df, bench)) == want and rows(again) == stay and again.columns == df.columns
