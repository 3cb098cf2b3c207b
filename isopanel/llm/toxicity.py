"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by transducers in a cascade. The first rewrites words as symbols (insult, threat, target, negation,
reported speech, other). The second reads from right to left and marks insults and threats that a target follows. The
third is the composition of three small ones, each a table of states and arcs that weighs what it passes: negation and
reported speech in force weaken insults and threats, a target in force (or marked as following) strengthens an insult
and gives a threat its weight. So "not stupid" or "he said 'trash'" weighs less than "you are trash", a threat counts
only towards a target, before it ("they will kill") or after it ("I will kill you"), and a clause's weight is the sum
along its path. Documents are scored from their clauses: the heaviest, their sum, how many, and their share.

What the grammar can't know is learned from labelled rows of the training folds, LABELLED_ROWS of them at most: which
words are insults (their weights are smoothed log odds over documents) and the weights of the clause features. Labels,
language, source and id are no inputs of a score. Fold 0 of FOLDS (crc32 of the id as text) is held out.

Defined cases: null and empty texts have no clause and get the base score; a null doc_id counts as the empty string
for its fold; unlabelled tables leave the seed lexicon with its default weights; repeated rows are each scored;
further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, texts_of, written

FOLDS = 5
LABELLED_ROWS = 20_000
#: A learned insult: documents it is in, and its log odds less this many standard errors is above LEAST_ODDS.
LEAST_DOCUMENTS, ERRORS, LEAST_ODDS = 4, 2.0, 1.5
#: Seed symbols; what is learned is added to the insults.
INSULTS = "idiot moron stupid dumb fool loser scum trash worthless pathetic disgusting clown imbecile coward freak".split()
THREATS = "kill hurt destroy beat burn shoot attack crush stab punish".split()
TARGETS = "you your yours they them their he him she her people everyone".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't cannot can't hardly".split()
REPORTS = "said says say wrote writes called reported quoted claims claimed alleged according told".split()
#: How long a negation, reported speech and a target stay in force, in words; a target that follows is as near.
REACH = {"negation": 3, "report": 8, "target": 6}
#: What an arc does to an insult's weight in each state.
NEGATED, REPORTED, TARGETED = 0.3, 0.6, 1.3
THREAT_WEIGHT = 2.0
#: A clause ends with a run of these that white space or the text's end follows.
_RUN = re.compile(r"[.;:!?\n]++")
_WORD = re.compile(r"[^\W\d_]+(?:'t)?")
_FOREIGN = re.compile(r"[^\x00-\x7fß-öø-ÿ]")
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "insult before a target", "threat before a target")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED_INSULT, AIMED_THREAT = range(len(SYMBOLS))
AIMED = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}


class Transducer(NamedTuple):
    """By state and symbol: the next state, and the factor of the arc. State 0 is the first."""

    step: np.ndarray
    factor: np.ndarray


def in_force(opens: int, reach: int, on: dict[int, float], off: dict[int, float]) -> Transducer:
    """`opens` is in force for the next `reach` words; factors of symbols while it is, and while it isn't."""
    states = np.arange(reach + 1)
    step = np.repeat(np.maximum(states - 1, 0)[:, None], len(SYMBOLS), axis=1)
    step[:, opens] = reach
    factor = np.ones(step.shape)
    for symbol in range(len(SYMBOLS)):
        factor[1:, symbol], factor[0, symbol] = on.get(symbol, 1.0), off.get(symbol, 1.0)
    return Transducer(step, factor)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: states are pairs, and an arc's factor is the product."""
    step = a.step[:, None, :] * len(b.step) + b.step[None, :, :]
    return Transducer(step.reshape(-1, len(SYMBOLS)), (a.factor[:, None, :] * b.factor[None, :, :]).reshape(-1, len(SYMBOLS)))


def grammar_transducer() -> Transducer:
    weakened = lambda x: dict.fromkeys((INSULT, THREAT, AIMED_INSULT, AIMED_THREAT), x)
    plain = dict.fromkeys((OTHER, TARGET, NEGATION, REPORT), 0.0)
    aimed = plain | {AIMED_INSULT: TARGETED, AIMED_THREAT: THREAT_WEIGHT}
    target = in_force(TARGET, REACH["target"], aimed | {INSULT: TARGETED, THREAT: THREAT_WEIGHT}, aimed | {INSULT: 1.0, THREAT: 0.0})
    return compose(compose(in_force(NEGATION, REACH["negation"], weakened(NEGATED), {}), in_force(REPORT, REACH["report"], weakened(REPORTED), {})), target)


class Clause(NamedTuple):
    start: int
    end: int
    weight: float


def _ends(text: str) -> Iterator[int]:
    """Ends of clauses. A run within a word can still end one before its last line break, so each run is read once."""
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end == len(text) or text[end].isspace():
            yield end
        elif (line := text.rfind("\n", start + 1, end)) >= 0:
            yield line


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.symbols = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words} | dict.fromkeys(insults, INSULT)
        self.heads = frozenset((*insults, *THREATS))
        self.head_bytes = frozenset(w.removesuffix("'t").encode() for w in self.heads)
        found = grammar_transducer()
        self.step, self.factor = found.step.tolist(), found.factor.tolist()

    def _any(self, low: str) -> bool:
        """Can some word weigh anything? Most texts end here, so those of plain letters are split as bytes, without 't."""
        if _FOREIGN.search(low):
            return not self.heads.isdisjoint(_WORD.findall(low))
        return not self.head_bytes.isdisjoint(low.encode().translate(_LETTERS).split())

    def marked(self, words: list[str]) -> list[int]:
        """Symbols, read from right to left: a target is in force for the words before it."""
        symbols = [self.symbols.get(w, OTHER) for w in words]
        left = 0
        for at in range(len(symbols) - 1, -1, -1):
            symbol = symbols[at]
            if left:
                symbols[at] = AIMED.get(symbol, symbol)
            left = REACH["target"] if symbol == TARGET else max(0, left - 1)
        return symbols

    def weigh(self, words: list[str]) -> float:
        """The sum along the clause's path."""
        state, total = 0, 0.0
        for word, symbol in zip(words, self.marked(words), strict=True):
            if factor := self.factor[state][symbol]:
                total += factor * self.insults.get(word, 1.0)
            state = self.step[state][symbol]
        return total

    def clauses(self, text: str) -> list[Clause]:
        """Clauses that weigh something; only those that hold an insult or a threat are read."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found, start = [], 0
        if self._any(low):
            for end in [*_ends(low), len(low)]:
                words = _WORD.findall(low, start, end)
                if not self.heads.isdisjoint(words) and (weight := self.weigh(words)):
                    found.append(Clause(start, end, weight))
                start = end
        return found

    @staticmethod
    def features(text: str, found: list[Clause]) -> tuple[float, ...]:
        """Of the document's clauses: any, heaviest, log of sum, log of number, share of its length."""
        if not found:
            return (0.0,) * 5
        weights = [c.weight for c in found]
        share = sum(c.end - c.start for c in found) / max(1, len(text))
        return (1.0, min(max(weights), 20.0) / 5, math.log1p(sum(weights)), math.log1p(len(found)), min(1.0, share))


class Model(NamedTuple):
    insults: dict[str, float]
    weights: list[float]  # of the features, then the constant


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """Texts of the training folds with their label: all of them, or about `limit` picked by a hash of their id."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about `limit` rows of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> Model:
    rows = written(labelled(docs, labels, limit), "toxicity-labelled")
    words = map_batches(rows, _words, "word string, toxic int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    bad, good = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (F.lit(bad) - F.col("bad") + 0.5)) - F.log((F.col("n") - F.col("bad") + 0.5) / (F.lit(good) - F.col("n") + F.col("bad") + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    picked = words.where(F.col("bad") >= LEAST_DOCUMENTS).select("word", odds.alias("odds"), error.alias("error")).where(F.col("odds") - ERRORS * F.col("error") > LEAST_ODDS)
    learned = {r["word"]: float(r["odds"]) for r in picked.collect()}
    known = {r["word"]: (r["bad"], r["n"]) for r in words.where(F.col("word").isin(INSULTS)).collect()}
    # a seed that labelled texts use often, and not for insults, loses its place
    seeds = {w: 2.0 for w in INSULTS if w not in learned and not (known.get(w, (0, 0))[1] >= 20)}
    insults = seeds | {w: min(x, 6.0) for w, x in learned.items() if w not in TARGETS + NEGATIONS + REPORTS + THREATS}
    grams = map_batches(rows, _features, "toxic int, features array<double>, n bigint", insults).groupBy("toxic", "features").agg(F.sum("n").alias("n"))
    sample = grams.collect()
    if not bad or not good:
        return Model(insults, [1.5, 0.5, 0.5, 0.0, 0.0, -2.5])
    x = np.array([[*r["features"], 1.0] for r in sample])
    return Model(insults, fit(x, np.array([r["toxic"] for r in sample], float), np.array([r["n"] for r in sample], float)).tolist())


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant has no penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for whole in batches:
        for batch in slices(whole):
            seen: Counter[tuple[str, int]] = Counter()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                seen.update((w, toxic) for w in set(_WORD.findall(text.lower())))
            if seen:
                yield {"word": [w for w, _ in seen], "toxic": [t for _, t in seen], "n": list(seen.values())}


def _features(batches: Iterator[pa.RecordBatch], insults: dict[str, float]) -> Iterator[dict[str, Any]]:
    grammar = Grammar(insults)
    for whole in batches:
        for batch in slices(whole):
            seen = Counter((t, tuple(round(f, 2) for f in grammar.features(s, grammar.clauses(s)))) for s, t in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True))
            yield {"toxic": [t for t, _ in seen], "features": [f for _, f in seen], "n": list(seen.values())}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, then n_clauses and heaviest: the clause with most weight."""
    schema = "doc_id bigint, score double, predicted int, n_clauses bigint, heaviest string"
    scored = map_batches(docs.select("doc_id", "text"), _score, schema, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "n_clauses", "heaviest")


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[dict[str, Any]]:
    grammar, weights = Grammar(model.insults), np.array(model.weights)
    for whole in batches:
        for batch in slices(whole):
            texts = texts_of(batch)
            found = [grammar.clauses(t) for t in texts]
            x = np.array([[*grammar.features(t, f), 1.0] for t, f in zip(texts, found, strict=True)])
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            top = [max(f, key=lambda c: (c.weight, -c.start), default=None) for f in found]
            yield {
                "doc_id": batch.column("doc_id"),
                "score": p,
                "predicted": (p >= 0.5).astype(np.int32),
                "n_clauses": [len(f) for f in found],
                "heaviest": [None if c is None else t[c.start : c.end].strip()[:500] for t, c in zip(texts, top, strict=True)],
            }
