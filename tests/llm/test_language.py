import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isopanel.llm import language

WORDS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwart", "kwik", "bijl", "wijk"], "cc": ["čeština", "řeka", "žába", "měsíc"]}


def text(rng, name, n):
    return " ".join(rng.choices(WORDS[name], k=n))


def test_documents(spark):
    rng = random.Random(1)
    docs, truth = [], {}
    for i in range(900):
        name = rng.choices(list(WORDS), [5, 3, 1])[0]
        truth[i] = name
        docs.append((i, text(rng, name, rng.randint(3, 90)), name if rng.random() > 0.05 else "aa", f"s{i % 5 if i % 3 else 0}", i, "x"))
    docs += [(900, None, "aa", "s0", 1, "x"), (901, "", None, None, 1, None), (902, "12 ?! 7", "aa", "s1", 1, "x"), (None, "lorem ipsum dolor", None, None, None, None), (5, docs[5][1], docs[5][2], docs[5][3], 5, "x"), (903, text(rng, "bb", 40_000), "bb", "s0", 1, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long, language string")
    got = language.documents_languages(df).collect()
    assert len(got) == len(docs)
    assert sum(r["language"] != truth[r["doc_id"]] for r in got if r["doc_id"] in truth) <= 5
    assert {r["doc_id"] for r in got if not r["accepted"]} == {900, 901, 902}
    kept = language.keep(df)
    assert kept.columns == df.columns and kept.count() == len(docs) - 3
    assert language.keep(df.limit(0)).count() == 0 and language.documents_languages(df.limit(0)).count() == 0
    assert not language.documents_languages(df.where("lang IS NULL")).where("accepted").count()


def test_pages_take_evidence_from_markup_and_hosts(spark):
    rng = random.Random(2)
    pages = []
    for i in range(400):
        name = ["aa", "bb"][i % 2]
        pages.append((i, f"https://www.h{i % 4}.example.{name}/p?x", f"<html lang='{name}'><script>lorem</script><p>{text(rng, name, 30)}</p></html>"))
    pages += [(1000, "https://www.h1.example.bb/x", "<html lang=bb><p>wijklorem</p>"), (1001, None, None), (1002, "no url", "<p></p>"), (None, "https://u@www.h0.example.aa:80/x", "<p>" + text(rng, "aa", 9))]
    got = {r["page_id"]: r for r in language.pages_languages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["language"] == ["aa", "bb"][i % 2] for i in range(400))
    assert got[1000]["language"] == "bb" and got[None]["language"] == "aa"
    assert not got[1001]["accepted"] and not got[1002]["accepted"]


def test_trigrams():
    buckets, n = language.trigrams(["ab", "", "é1b", "ab"])
    assert n.tolist() == [2, 0, 3, 2]
    assert (buckets[:2] == buckets[-2:]).all() and buckets.max() < language.BUCKETS
    assert language.trigrams([])[1].tolist() == [] and np.all(language.trigrams([""])[1] == 0)


def many(spark, n):
    """n rows of one language and five of another."""
    common = spark.range(n).selectExpr("id AS doc_id", "concat('lorem ipsum dolor amet ', id % 7) AS text", "'aa' AS lang", "'s' AS source")
    return common.unionAll(spark.createDataFrame([(n + i, "zwart kwik bijl wijk kwik", "bb", "s") for i in range(5)], common.schema))


def test_rare_languages_of_large_tables_are_trained(spark):
    df = many(spark, 150_000)
    rare = language.documents_languages(df.where("lang = 'bb' OR doc_id < 100")).where("declared = 'bb'").collect()
    got = language.documents_languages(df).where("declared = 'bb'").collect()
    assert {(r["language"], r["text_language"], r["accepted"]) for r in rare} == {(r["language"], r["text_language"], r["accepted"]) for r in got} == {("bb", "bb", True)} and len(got) == 5


def test_sample_by_language(spark):
    rows = language.from_documents(many(spark, 20_000).unionAll(spark.range(3000).selectExpr("id", "'12 ?'", "'cc'", "'s'")).unionAll(spark.createDataFrame([(9, "čas", "cc", "s")], "doc_id long, text string, lang string, source string")).unionAll(spark.range(500).selectExpr("1", "'one text'", "'dd'", "'s'")))
    n = {r["declared"]: r["count"] for r in language.sample(rows, ["aa", "bb", "cc", "dd"], 100).groupBy("declared").count().collect()}
    assert 50 < n["aa"] < 200 and n["bb"] == 5 and n["cc"] == 1 and n["dd"] > 0


def test_blocks_of_languages(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, text(rng, name, 20), name, "s") for i, name in enumerate(list(WORDS) * 30)] + [(1000, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    want = sorted(language.documents_languages(df).collect())
    for most in (1, 2):
        monkeypatch.setattr(language, "MOST_LANGUAGES", most)
        assert sorted(language.documents_languages(df).collect()) == want
    assert {r["language"] for r in want} == {*WORDS, "und"}


def test_fusion_equals_brute_force(spark):
    """All evidence in plain Python: likelihoods, and tables of rows but one's own."""
    from collections import defaultdict
    from math import exp, log

    rng = random.Random(6)
    docs = []
    for i in range(120):
        name = rng.choices(list(WORDS), [5, 3, 1])[0]
        mixed = text(rng, name, rng.randint(1, 6)) + " " + text(rng, rng.choice(list(WORDS)), rng.randint(0, 3))
        docs.append((i, mixed, rng.choice([name, name, "aa", None]), rng.choice([name, "s0", "s1", None])))
    docs += [(500, None, "aa", "s0"), (501, "12", None, "s1"), (502, text(rng, "bb", 3_000), "bb", "s0")]
    names = sorted(WORDS)
    table = {n: np.full(language.BUCKETS, language.ALPHA) for n in names}
    for _, t, lang, _ in docs:
        if lang and any(c.isalpha() for c in t or ""):
            np.add.at(table[lang], language.trigrams([t])[0], 1)
    model = {n: np.log(c / c.sum()).astype(np.float32).astype(float) for n, c in table.items()}
    rows = []
    for d, t, lang, source in docs:
        buckets = language.trigrams([t or ""])[0]
        means = [model[n][buckets].mean() if len(buckets) else 0.0 for n in names]
        known = len(buckets) > 0 and max(means) > -log(language.BUCKETS)
        score = [m * min(len(buckets), language.EVIDENCE) for m in means]
        e = [exp(x - max(score)) for x in score]
        rows.append((d, lang or "", source or "", known, score, [x / sum(e) if known else 0.0 for x in e]))
    sums = defaultdict(lambda: np.zeros(3))
    for _, lang, source, _, _, share in rows:
        for key in ("all", ("declared", lang), ("suffix", ""), ("parent", ""), ("host", source)):
            sums[key] += share
    every = sums["all"] + 1
    n_declared = len({r[1] for r in rows})
    want = {}
    for d, lang, source, known, score, share in rows:
        others = lambda key: np.maximum(sums[key] - share, 0)
        host = every / every.sum()
        for key in (("parent", ""), ("host", source)):
            host = (others(key) + language.HOST_ROWS * host) / (others(key).sum() + language.HOST_ROWS)
        fused = np.array(score) + np.log(host)
        for key, n in ((("declared", lang), n_declared), (("suffix", ""), 1)):
            fused += np.log((others(key) + language.VALUE_ROWS) / (every + language.VALUE_ROWS * n))
        p = 1 / np.exp(fused - fused.max()).sum()
        want[d] = (names[int(fused.argmax())], p, names[int(np.argmax(score))]) if known else ("und", 0.0, "und")
    got = language.documents_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(docs) and len({w[0] for w in want.values()}) >= 3
    for r in got:
        language_, p, by_text = want[r["doc_id"]]
        assert (r["language"], r["text_language"], r["accepted"]) == (language_, by_text, p >= language.LEAST_PROBABILITY)
        assert abs(r["probability"] - p) < 1e-4


MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["<script", "<style>", "</script>", "</SCRIPT >", "</style", "-->", "<!--", "<!-->", ">", "<", "a", " ", "\n", "<scripts", "é"]), max_size=14).map("".join))
def test_visible_text(html):
    assert language.visible(html) == MARKUP.sub(" ", html)


@pytest.mark.parametrize("html", ["<script " * 130_000, "<!-- " * 200_000, "<style></script " * 60_000, "<!--" * 250_000 + ">"])
def test_unclosed_markup_takes_linear_time(html):
    began = time.process_time()
    language.visible(html)
    assert time.process_time() - began < 2
