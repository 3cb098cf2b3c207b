"""Language identification by Bayesian evidence fusion.

For each row and language four pieces of evidence are added as log probabilities: the text's likelihood under letter
trigram models, the declared language (markup, or a column), the address suffix, and a prior of the host. The tables
behind the last three are grouped aggregates over all rows of what the text alone makes of them: P(declared | language)
and P(suffix | language), and for hosts a hierarchy (host, its parent domain, everything), each level smoothed towards
the one above and without the row's own share. Text counts as much as EVIDENCE trigrams at most, so that long texts
don't drown what else is known.

Trigram models are trained for each declared language on about LABELLED_ROWS of its rows that have letters, picked by a
hash of the id, or on all of them where it has no more. Languages are all declared ones; those beyond MOST_LANGUAGES go
in further blocks of columns, one pass over the texts for each, so that a task holds one block's models.

Defined cases: a text without letters, null or empty, is UNDETERMINED and rejected, as is one that its best model finds
less likely than chance; a missing declaration, suffix or host is a value of its own; null ids and repeated rows are
decided row by row; without any declared language every row is UNDETERMINED; further columns go along in keep().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, texts_of, written

UNDETERMINED = "und"
LABELLED_ROWS = 4000
#: Languages whose models are held at once.
MOST_LANGUAGES = 200
BUCKETS = 1 << 16
EVIDENCE = 64
#: Smoothing: of trigrams, of the levels of hosts, of declarations and suffixes.
ALPHA, HOST_ROWS, VALUE_ROWS = 0.1, 20.0, 1.0
LEAST_PROBABILITY = 0.5
#: Grouped tables of up to so many rows (a few numbers each) go to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000
#: Hashes that pick rows are below this.
HASHES = 1 << 40
_LETTER = r"[a-zA-Z\x{80}-\x{10FFFF}]"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RAW = re.compile(r"(?i)<(?:(script)|style)\b")
_RAW_ENDS = {True: re.compile(r"(?i)</script\s*>"), False: re.compile(r"(?i)</style\s*>")}


def visible(html: str) -> str:
    """html with a space for each tag, comment, script and style sheet; one that nothing closes is a tag, or text.

    One pass: an ending that isn't found once is not looked for again.
    """
    out, low, at = [], 0, 0
    over: set[bool | str] = set()
    while (at := html.find("<", at)) >= 0:
        end = 0
        if (raw := _RAW.match(html, at)) and (kind := bool(raw[1])) not in over:
            closing = _RAW_ENDS[kind].search(html, raw.end())
            end = closing.end() if closing else 0
            over |= {kind} if not end else set()
        for ending, skip in (("-->", 4 * html.startswith("<!--", at)), (">", 1)):
            if not end and skip and ending not in over:
                end = html.find(ending, at + skip) + len(ending)
                if end < len(ending):
                    end = 0
                    over.add(ending)
        if end:
            out += [html[low:at], " "]
            low = end
        at = end or at + 1
    return "".join([*out, html[low:]])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams around a letter, text after text, and how many each text has."""
    data = [b" " + t.lower().encode().translate(_LETTERS) + b" " for t in texts]
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    used = (b[1:-1] != 32) & (owner[:-2] == owner[2:])
    return h[used] >> np.uint32(16), np.bincount(owner[1:-1][used], minlength=len(texts))


def languages(docs: DataFrame) -> list[str]:
    return sorted(r["declared"] for r in docs.where("declared <> ''").select("declared").distinct().collect())


def sample(docs: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """declared and text of rows to train on: about `limit` of each language, all rows of rarer ones, never none."""
    known = docs.where(F.col("declared").isin(names) & F.col("text").rlike(_LETTER)).select("declared", "text", F.pmod(F.xxhash64("key"), F.lit(HASHES)).alias("hash"))
    share = F.lit(float(limit or LABELLED_ROWS)) / F.count("*")
    bounds = known.groupBy("declared").agg(F.greatest(F.min("hash"), (share * HASHES).cast("bigint")).alias("bound"))
    # a row for each language
    return known.join(F.broadcast(bounds), "declared").where("hash <= bound").select("declared", "text")


def train(docs: DataFrame, names: list[str], limit: int | None = None) -> np.ndarray:
    """log P(trigram bucket | language), of rows with a declared language: BUCKETS x languages."""
    counts = map_batches(sample(docs, names, limit), _counts, "language string, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(names)), ALPHA)
    place = {name: i for i, name in enumerate(names)}
    for batch in counts.toArrow().to_batches():  # at most BUCKETS for each language
        columns = [place[x] for x in batch.column("language").to_pylist()]
        table[batch.column("bucket").to_numpy(), columns] += batch.column("n").to_numpy()
    return np.log(table / table.sum(0)).astype(np.float32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for whole in batches:
        for batch in slices(whole):
            texts, declared = texts_of(batch), batch.column("declared").to_pylist()
            for name in set(declared):
                n = np.bincount(trigrams([t for t, d in zip(texts, declared, strict=True) if d == name])[0], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield {"language": [name] * len(at), "bucket": at, "n": n[at]}


def _likelihood(batches: Iterator[pa.RecordBatch], model: np.ndarray, columns: list[str]) -> Iterator[dict[str, Any]]:
    """Mean log likelihood by language, after those at hand, and number of trigrams of each text."""
    for whole in batches:
        for batch in slices(whole, size=2_000_000):
            buckets, n = trigrams(texts_of(batch))
            means = np.zeros((len(n), model.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                starts = (np.cumsum(n) - n)[some]
                for j in range(model.shape[1]):
                    means[some, j] = np.add.reduceat(model[buckets, j], starts, dtype=np.float64) / n[some]
            before = np.array(batch.column("means").to_pylist(), float).reshape(len(n), -1)
            yield {c: batch.column(c) for c in columns} | {"n": n, "means": list(np.hstack([before, means]))}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def from_pages(pages: DataFrame) -> DataFrame:
    """(key, text, declared, suffix, host, parent) of web pages: text without tags, declared from markup."""
    html = F.coalesce("html", F.lit(""))
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    rows = pages.select(F.struct("page_id").alias("key"), html.alias("html"), declared.alias("declared"), F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("parent"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for whole in batches:
            for batch in slices(whole, "html"):
                yield {c: batch.column(c) for c in ("page_id", "declared", "suffix", "host", "parent")} | {"text": [visible(h) for h in batch.column("html").to_pylist()]}

    flat = rows.select("key.page_id", "html", "declared", "suffix", "host", "parent")
    return map_batches(flat, strip, "page_id bigint, text string, declared string, suffix string, host string, parent string").select(F.struct("page_id").alias("key"), "text", "declared", "suffix", "host", "parent")


def from_documents(docs: DataFrame) -> DataFrame:
    """(key, text, declared, suffix, host, parent) of documents: their language column, and their source as the host."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    declared = F.lower(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit(""))))
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text", declared.alias("declared"), F.lit("").alias("suffix"), source.alias("host"), F.lit("").alias("parent"))


def identify(rows: DataFrame) -> DataFrame:
    """key, language, probability, text_language, declared, accepted, of (key, text, declared, suffix, host, parent)."""
    names = languages(rows)
    keys = rows.select("key.*").schema
    if not names:
        return rows.select("key", F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("probability"), F.lit(UNDETERMINED).alias("text_language"), "declared", F.lit(False).alias("accepted"))
    columns = [*keys.names, "declared", "suffix", "host", "parent"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "declared string, suffix string, host string, parent string, n bigint, means array<double>"])
    evidence = rows.select("key.*", "text", "declared", "suffix", "host", "parent", F.array().cast("array<double>").alias("means"))
    for at in range(0, len(names), MOST_LANGUAGES):
        model = train(rows, names[at : at + MOST_LANGUAGES])
        if at + MOST_LANGUAGES < len(names):
            evidence = written(map_batches(evidence, _likelihood, f"{schema}, text string", model, [*columns, "text"]), "language-block")
        else:
            evidence = map_batches(evidence, _likelihood, schema, model, columns)
    evidence = written(evidence.select(F.struct(*keys.names).alias("key"), "declared", "suffix", "host", "parent", "n", "means"), "language-evidence")

    text = F.transform("means", lambda m: m * F.least(F.col("n"), F.lit(EVIDENCE)))
    evidence = evidence.withColumn("text", text).withColumn("known", (F.col("n") > 0) & (F.array_max("means") > -float(np.log(BUCKETS))))
    share = F.transform("text", lambda x: F.exp(x - F.array_max("text")))
    evidence = evidence.withColumn("share", share)
    total = F.aggregate("share", F.lit(0.0), lambda a, b: a + b)
    evidence = evidence.withColumn("share", F.when(F.col("known"), F.transform("share", lambda x: x / total)).otherwise(F.transform("share", lambda x: x * 0)))

    sums = [F.sum(F.get("share", F.lit(i))) for i in range(len(names))]

    def counts(*by: str) -> tuple[DataFrame, int]:
        """Written, and broadcast where its counted rows are few."""
        found = written(evidence.groupBy(*by).agg(F.array(*sums).alias(f"by_{by[-1]}")), f"language-{by[-1]}")
        n = found.count()
        return (F.broadcast(found) if n <= BROADCAST_ROWS else found), max(1, n)

    all_rows = evidence.agg(F.array(*sums).alias("s")).first()["s"]
    every = np.array([x or 0 for x in all_rows]) + 1
    prior = F.array(*(F.lit(float(p)) for p in every / every.sum()))
    values = {c: counts(c) for c in ("declared", "suffix")}
    fused = evidence.join(counts("parent", "host")[0], ["parent", "host"], "left").join(counts("parent")[0], ["parent"], "left")
    for c, (found, _) in values.items():
        fused = fused.join(found, [c], "left")

    own = lambda counted: F.zip_with(counted, "share", lambda n, s: F.greatest(n - s, F.lit(0.0)))

    def smoothed(counted: str, above: Column) -> Column:
        others = own(counted)
        rows_there = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(others, above, lambda n, p: (n + HOST_ROWS * p) / (rows_there + HOST_ROWS))

    host = smoothed("by_host", smoothed("by_parent", prior))
    log_sum = F.zip_with("text", host, lambda t, p: t + F.log(p))
    for c, (_, n_values) in values.items():
        spread = F.array(*(F.lit(float(x + VALUE_ROWS * n_values)) for x in every))
        given = F.zip_with(own(f"by_{c}"), spread, lambda n, e: F.log((n + VALUE_ROWS) / e))
        log_sum = F.zip_with(log_sum, given, lambda a, b: a + b)
    fused = fused.withColumn("fused", log_sum)
    weights = F.transform("fused", lambda x: F.exp(x - F.array_max("fused")))
    named = F.array(*(F.lit(x) for x in names))
    at = lambda c: F.get(named, F.array_position(c, F.array_max(c)).cast("int") - 1)
    probability = F.when(F.col("known"), 1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    return fused.select(
        "key",
        F.when(F.col("known"), at("fused")).otherwise(UNDETERMINED).alias("language"),
        probability.alias("probability"),
        F.when(F.col("known"), at("text")).otherwise(UNDETERMINED).alias("text_language"),
        "declared",
        (F.col("known") & (probability >= LEAST_PROBABILITY)).alias("accepted"),
    )


def documents_languages(docs: DataFrame) -> DataFrame:
    return identify(from_documents(docs)).select("key.doc_id", "language", "probability", "text_language", "declared", "accepted")


def pages_languages(pages: DataFrame) -> DataFrame:
    return identify(from_pages(pages)).select("key.page_id", "language", "probability", "text_language", "declared", "accepted")


def keep(docs: DataFrame) -> DataFrame:
    """docs whose language is accepted; all columns stay."""
    rejected = identify(from_documents(docs)).where(~F.col("accepted")).select(F.col("key.doc_id").alias("_id"), F.col("key.text_hash").alias("_hash")).distinct()
    rejected = written(rejected, "language-rejected")
    same = docs["doc_id"].eqNullSafe(rejected["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(rejected["_hash"])
    return docs.join(rejected, same, "left_anti")
