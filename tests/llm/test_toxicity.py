import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isopanel.llm import toxicity as tox

SCHEMA = "doc_id long, text string, toxic string, score string"


def test_composition():
    g = tox.Grammar({"trash": 2.0})
    w = lambda s: g.weigh(s.split())
    assert w("you are trash") > w("it is trash") > w("he said it was trash") > w("it is not trash") > 0
    assert w("kill the lights") == 0 < w("they will kill")
    assert g.clauses("Fine words.") == []
    found = g.clauses("All is well. You are TRASH! Trash2, no.")
    assert [(c.start, c.end) for c in found] == [(12, 27), (27, 39)]
    assert len(g.clauses("« trash»")) == 1 and g.clauses("trashy İ") == []


def test_learned(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs, labels, truth = [], [], {}
    for i in range(1500):
        text = rng.choices(words, k=rng.randint(3, 200))
        truth[i] = int(i % 8 == 0)
        if truth[i]:
            text[len(text) // 2] = rng.choice(["grobian", "trash"])
        docs.append((i, " ".join(text), "1", "x"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, truth[i] if rng.random() > 0.02 else 1 - truth[i], 1))
    docs += [(None, "trash", None, None), (5000, None, None, None), (5001, "", None, None), (1, docs[1][1], "1", "x"), (5002, "a trash " * 50_000, None, None)]
    df, lf = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = tox.learn(df, lf)
    assert "grobian" in model.insults
    got = tox.score(df, model).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    wrong = [r for r in got if r["doc_id"] in truth and r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) < 10
    # labels, and words of the held-out fold, leave no trace
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    assert tox.learn(df, spark.createDataFrame(flipped, "doc_id long, toxic int, quality int")) == model
    none = tox.learn(df, lf.limit(0))
    assert {r["doc_id"] for r in tox.score(df, none).collect() if r["predicted"]} >= {5002}
    assert tox.score(df.limit(0), model).count() == 0


def test_targets_that_follow():
    g = tox.Grammar({"stupid": 2.0})
    w = lambda s: g.weigh(s.split())
    assert w("kill the lights") == 0 < w("i will kill you") == w("we will hurt them") == w("they will kill") == tox.THREAT_WEIGHT
    assert w("i will not kill you") == tox.NEGATED * w("i will kill you")
    assert w("she will kill you") == w("i will kill you") and w("i will kill you and them") == w("i will kill you")
    assert w("kill and burn you") == 2 * tox.THREAT_WEIGHT
    assert w("kill a b c d e you") > 0 == w("kill a b c d e f you")
    assert w("stupid you") == w("you stupid") == tox.TARGETED * w("stupid")
    assert [(c.start, c.end) for c in g.clauses("Kill it. You go. I will kill you.")] == [(16, 33)]


def test_threats_are_scored(spark):
    docs = spark.createDataFrame([(1, "I will kill you.", "", ""), (2, "Kill the lights.", "", ""), (3, "Fine words.", "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in tox.score(docs, tox.Model({}, [1.5, 0.5, 0.5, 0.0, 0.0, -2.5])).collect()}
    assert got[1]["score"] > got[2]["score"] == got[3]["score"] and got[1]["heaviest"] == "I will kill you."


def by_counters(words, insults):
    """The grammar without tables: what is in force, counted word by word."""
    total = 0.0
    for at, word in enumerate(words):
        def near(listed, reach, after=False):
            part = words[at + 1 : at + 1 + reach] if after else words[max(0, at - reach) : at]
            return any(w in listed for w in part)

        factor = (tox.NEGATED if near(tox.NEGATIONS, 3) else 1) * (tox.REPORTED if near(tox.REPORTS, 8) else 1)
        aimed = near(tox.TARGETS, 6) or near(tox.TARGETS, 6, True)
        if word in insults:
            total += insults[word] * factor * (tox.TARGETED if aimed else 1)
        elif word in tox.THREATS:
            total += tox.THREAT_WEIGHT * factor * aimed
    return total


def test_composed_tables_equal_counters():
    rng = random.Random(12)
    insults = {"trash": 2.0, "ain't": 3.0}
    g = tox.Grammar(insults)
    assert len(g.step) == 4 * 9 * 7
    for _ in range(3000):
        words = rng.choices(["trash", "ain't", "kill", "burn", "you", "not", "said", "a", "b", "c", "d"], [2, 1, 2, 1, 1, 1, 1, 3, 3, 3, 3], k=rng.randint(1, 25))
        assert abs(g.weigh(words) - by_counters(words, insults)) < 1e-9


def test_apostrophes_weigh_the_same_beside_any_letters():
    g = tox.Grammar({"ain't": 3.0})
    assert [c.weight for c in g.clauses("you ain't here")] == [c.weight for c in g.clauses("you ain't here Ж")] == [3.0 * tox.TARGETED]
    assert g.clauses("you ain here") == []


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=".;\na \u2028", max_size=30))
def test_ends_of_clauses(text):
    assert list(tox._ends(text)) == [m.end() for m in re.finditer(r"[.;:!?\n]+(?=\s|$)", text)]


@pytest.mark.parametrize("tail", ["." * 1_000_000 + "a", ".\n" * 500_000 + "a", "!a" * 500_000])
def test_long_runs_take_linear_time(tail):
    began = time.process_time()
    assert tox.Grammar({"trash": 2.0}).clauses("you trash " + tail)
    assert time.process_time() - began < 2
