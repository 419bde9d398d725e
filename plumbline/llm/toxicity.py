"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text (operator 1).

Folding: lower case; invisible characters and accents go; letters of other scripts that look like Latin
ones, and digits and signs that stand for letters next to letters, become those letters; `l`, `i` and
their stand-ins become one letter, in the lexicon and in the text alike.

Training uses at most SAMPLE_ROWS labelled documents (those of smallest hash of doc_id, whole texts). In
how many toxic and other documents each folded word occurs gives its weight, the lower confidence bound
of a smoothed log-odds ratio; the lexicon keeps words of at least MIN_TOXIC toxic documents and a weight
above MIN_WEIGHT, and given extra entries. Exception phrases are given, or learned: pairs of a lexicon word
with the word before or after it that occur in other documents only.

Scoring: hits must stand between word ends; a hit inside an exception phrase doesn't count. The sum of
weights, and the sum over the square root of the number of words, go through a logistic function that is
fitted on the sample.

Defined cases: null, empty and wordless texts have no hits and get the score of no hits; repeated rows
score alike; with no labelled rows, or only one label, the lexicon is what is given and the function is
a fixed one; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batch, sampled

SAMPLE_ROWS = 20_000
MIN_TOXIC = 8
MIN_WEIGHT = 2.0
MAX_WORDS = 2_000
MIN_EXCEPTION = 4

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ß": "ss", "ø": "o", "đ": "d", "ł": "l",
}
# Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
INVISIBLE = "­​‌‍⁠﻿︎️"

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_STAND = re.compile(r"(?<=[^\W\d_])[0-9@$!|€+]+(?=[^\W\d_])|(?<![\w@$!|€+])[0-9@$€]+(?=[^\W\d_])|(?<=[^\W\d_]{2})[0-9]+(?![\w])")
_WORD = re.compile(r"[^\W\d_]+")
_AFTER = re.compile(r" [^\W\d_]+")


class _Fold(dict):
    """Character by character, as met."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        else:
            out = "".join(HOMOGLYPHS.get(x, x) for d in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(d) for x in HOMOGLYPHS.get(d, d))
        self[code] = out
        return out


_fold_table = _Fold()


def fold(text: str | None) -> str:
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_fold_table)
    t = _STAND.sub(lambda m: "".join(STAND_INS.get(c, c) for c in m[0]), t)
    return t.replace("l", "i")


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 2.0)
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def automaton(self):
        """Words carry their weight; phrases, which contain a word, carry None."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for p in self.exceptions:
                a.add_word(p, (len(p), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words that stand alone and outside of exception phrases."""
        a = self.automaton()
        if not len(a):
            return []
        words, phrases = [], []
        n = len(folded)
        for last, (size, weight) in a.iter(folded):
            s, e = last + 1 - size, last + 1
            if (s and folded[s - 1].isalpha()) or (e < n and folded[e].isalpha()):
                continue
            (phrases if weight is None else words).append((s, e, weight))
        if not phrases:
            return words
        # how far the phrases reach that begin at a place or before it
        phrases.sort(key=lambda p: p[0])
        begins, reach = [p[0] for p in phrases], list(accumulate((p[1] for p in phrases), max))
        return [w for w in words if not ((i := bisect_right(begins, w[0])) and reach[i - 1] >= w[1])]

    def features(self, text: str | None) -> tuple[float, float]:
        t = fold(text)
        total = sum(w for _, _, w in self.hits(t))
        # words are counted only where it matters
        return total, total / np.sqrt(len(t.split())) if total else 0.0

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(max(x, 0)) + c * y, -30, 30))))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        met: dict[str, list[int]] = {}
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in set(_WORD.findall(fold(t))):
                met.setdefault(w, [0, 0])[1 if y else 0] += 1
        if met:
            yield batch(word=list(met), clean=pa.array([v[0] for v in met.values()], pa.int64()), toxic=pa.array([v[1] for v in met.values()], pa.int64()))


def _phrases(t: str, s: int, e: int) -> list[str]:
    """The hit at s to e with the whole word before it, and with the one after it."""
    out, i = [], s - 1
    if i > 0 and t[i] == " ":
        while i and _WORD.match(t[i - 1]):
            i -= 1
        if i < s - 1:
            out.append(t[i:e])
    after = _AFTER.match(t, e)
    if after:
        out.append(t[s : after.end()])
    return out


def _contexts(model):
    """For every hit the phrases with the word before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = fold(t)
                own = set()
                for s, e, _ in model.value.hits(t):
                    own.update(_phrases(t, s, e))
                for x in own:
                    met.setdefault(x, [0, 0])[1 if y else 0] += 1
            if met:
                yield batch(word=list(met), clean=pa.array([v[0] for v in met.values()], pa.int64()), toxic=pa.array([v[1] for v in met.values()], pa.int64()))

    return run


def _featurer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.value.features(t) for t in b.column(0).to_pylist()]
            yield batch(x=[float(a) for a, _ in f], y=[float(c) for _, c in f], toxic=b.column(1))

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Regularised logistic regression by Newton's method."""
    design = np.column_stack([np.ones(len(x)), np.log1p(np.maximum(x[:, 0], 0)), x[:, 1]])
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: dict[str, float] | None = None, exceptions: set[str] | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of which at most so many are used."""
    sc = docs.sparkSession.sparkContext
    given = {fold(w): x for w, x in (words or {}).items()}
    phrases = {fold(p) for p in exceptions or ()}
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sampled(docs.select("doc_id", "text"), marks, rows).select("text", "toxic").repartition(sc.defaultParallelism).persist()
    try:
        n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        clean, toxic = n.get(0, 0), n.get(1, 0)
        if not clean or not toxic:
            return Model(given, phrases)
        counts = sample.mapInArrow(_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        found = counts.where(F.col("toxic") >= MIN_TOXIC).withColumn("weight", odds - 1.64 * error).where(F.col("weight") > MIN_WEIGHT).orderBy(F.desc(F.col("weight") * F.col("toxic")), "word").limit(MAX_WORDS).collect()
        model = Model({r.word: float(r.weight) for r in found} | given, phrases)
        seen = sample.mapInArrow(_contexts(sc.broadcast(model)), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        learned = seen.where((F.col("clean") >= MIN_EXCEPTION) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "word").limit(MAX_WORDS).collect()
        model = Model(model.weights, phrases | {r.word for r in learned})
        data = sample.mapInArrow(_featurer(sc.broadcast(model)), "x double, y double, toxic int").toPandas()
        return Model(model.weights, model.exceptions, _logistic(data[["x", "y"]].to_numpy(), data["toxic"].to_numpy(float)))
    finally:
        sample.unpersist()


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(doc_id=b.column(0), held_out=b.column(2), score=[model.value.score(t) for t in b.column(1).to_pylist()])

    return run


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
