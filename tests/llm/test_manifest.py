import hashlib
import random
import zlib

import pytest

from isopanel.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, place int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text, *_):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and each node's (slot, siblings) level by level."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for slot, node in enumerate(run):
                for i in owner[node]:
                    paths[i].append((slot, [nodes[x] for x in run if x != node]))
        owner = [[i for node in run for i in owner[node]] for run in runs]
        nodes = [h(*(nodes[x] for x in run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: climb([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    root, tops = climb([trees[n][0] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        for (*_, own, r), path in zip(sorted(groups[n], key=lambda x: x[:3]), trees[n][1], strict=True):
            whole = path + top
            again = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                again = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for slot, siblings in whole:
                again = h(*siblings[:slot], again, *siblings[slot:])
            out.append((r[0], own, trees[n][0], root, h(*(x for _, s in whole for x in s)), again, again == root))
    return out


def in_order(rows):
    return sorted(tuple((x is not None, x) for x in r) for r in rows)


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (64, 1, 600, 7, 3, 2, 1, 1, 12)])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "", "EN", "en", "é", "zz", "fr", "a=", "-"]
    ids = rng.sample(range(-50, 5000), sum(sizes))
    rows = [(ids.pop(), rng.choice(["s1", None, ""]), lang, rng.choice([3, None]), rng.choice(["Some Text", "plain", "ÉA", "", None, "B" * 3000]), "n", 7) for lang, n in zip(langs, sizes, strict=False) for _ in range(n)]
    if len(sizes) > 2:
        rows += [(None, "s", "en", 1, "A", "n", 7), (None, "s", "en", 2, "A", "n", 7), rows[0], rows[0], (rows[0][0], "other", *rows[0][2:])]
    got = manifest.verified(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert in_order(map(tuple, got.collect())) == in_order(brute(rows))


def test_empty_and_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s", "en" if i % 3 else "de", 1, f"Text {i}", "n", 7) for i in range(40)], SCHEMA)
    assert manifest.verified(docs.limit(0)).count() == 0
    table = spark.read.parquet(manifest.write_manifest(docs, f"{tmp_path}/manifest"))
    assert table.columns == ["doc_id", "leaf", "subroot", "root", "path"] and table.count() == 40
    assert table.where(manifest.folded(table["leaf"], table["path"]) != table["root"]).count() == 0
