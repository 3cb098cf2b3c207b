import hashlib
import random

import numpy as np
import pytest

from isopanel.llm import suffix

SCHEMA = "doc_id long, text string, n_bytes long, class string"


def brute(rows, window=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - window + 1):
                w = t[i : i + window]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1) if d is not None else ():
            if first[t[i : i + window]] < d:
                gone[i + 1 : i + 1 + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rng.choice([9, 12, 20, 60]))) for _ in range(12)]
    rows = []
    for i in range(160):
        text = " ".join(word() for _ in range(rng.choice([1, 10, 40, 200])))
        for _ in range(rng.choice([0, 0, 1, 3])):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            text = text[: len(text) // 2] + p[a : a + rng.randint(30, 400)] + text[len(text) // 2 :]
        if i % 9 == 0:
            text += "ha " * rng.randint(10, 80)
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1]
        if i % 11 == 0 and rows:
            text = (rng.choice(rows)[1] or "") + text
        rows.append((i * 3, text, 1, "x"))
    rows += [(1000, None, None, None), (1001, "", 1, None), (None, passages[3] * 3, 1, None), (1002, "x" * 49, 1, None), (1003, "x" * 49, 1, None), (1004, "x" * 51, 1, None), (1005, "x" * 500, 1, None), (3, passages[3] + passages[4], 1, None), (3, rows[1][1], 1, None), (-5, passages[5], 1, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 10_000), (2, 4), (3, 10_000)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    if seed == 3:
        monkeypatch.setattr(suffix, "BROADCAST_IDS", 0)
        monkeypatch.setattr(suffix, "BUCKET_FRAGMENTS", 200)
        monkeypatch.setattr(suffix, "BUCKET_ANCHORS", 300)
    rows = fixture(seed)
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_nothing(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_array_and_intervals():
    rng = random.Random(4)
    fragments = [bytes(rng.choices(b"ab", k=rng.randint(5, 30))) for _ in range(40)]
    array = suffix.suffix_array(fragments, 5)
    suffixes = [fragments[f][s:] for f, s in zip(array.fragment, array.start)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(max(0, len(f) - 4) for f in fragments)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert array.prefix[1:].tolist() == [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    got = set(suffix.maximal_repeats(array, 5))
    want = set()
    for text in {s[:n] for s in suffixes for n in range(5, len(s) + 1)}:
        there = [i for i, s in enumerate(suffixes) if s.startswith(text)]
        after = {suffixes[i][len(text) : len(text) + 1] for i in there}
        before = [array.left[i] for i in there]
        if len(there) > 1 and (len(after) > 1 or b"" in after) and (-1 in before or len(set(before)) > 1):
            want.add((len(text), there[0], there[-1] + 1))
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 20, 31])
def test_gram_hash(size):
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabc", np.uint8)
    h = suffix.gram_hash(data, size)
    assert len(h) == len(data) - size + 1
    assert (h[3:] == h[:-3]).all() and len(set(h.tolist())) == 3
