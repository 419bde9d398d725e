"""Language identification by words first, shorter and shorter n-grams for unseen words (operator 2).

Training counts words per language on at most SAMPLE_ROWS labelled documents (those of smallest hash of
doc_id; whole texts). A word's counts are one row for a language and word; n-grams of 1 to MAX_GRAM
characters are counted over the distinct words of each language. The model keeps the most frequent words
(at most WORDS) and n-grams of every length (at most GRAMS each), keys met equally often together, as smoothed
log frequencies for each language, so its size has a bound and it can be broadcast.

A text is scored word by word. A known word adds its log frequencies. An unknown one backs off: the mean
of its longest n-grams if any of them is known, else of the next shorter ones, down to single letters.
The language of the highest sum wins; the score is its share after a softmax over the sums divided by the
square root of the number of words, which keeps a margin in long texts without saturating at once.

Defined cases: `und` and score 0 for a null or empty text, or one without a letter; words are runs of
letters, lower-cased; a text whose letters the model has never seen gets the most frequent language with
a low score; with no labelled rows every text is `und`; ties go to the language that sorts first; all
columns of the input are kept, so repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textnum
from plumbline.llm.common import Scratch, batch, sampled

SAMPLE_ROWS = 6_000
WORDS = 60_000
GRAMS = 8_000
MAX_GRAM = 5
CACHE = 60_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; single letters are unmarked."""
    if n == 1:
        return list(word)
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str, Counter[str]] = {}
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(_WORD.findall(t.lower()))
        rows = [(lang, 0, w, n) for lang, words in seen.items() for w, n in words.items()]
        for lang, words in seen.items():
            by: Counter[tuple[int, str]] = Counter()
            for w, n in words.items():
                for k in range(1, MAX_GRAM + 1):
                    for g in grams(w, k):
                        by[k, g] += n
            rows += [(lang, k, g, n) for (k, g), n in by.items()]
        if rows:
            lang, kind, key, n = zip(*rows, strict=True)
            yield batch(lang=list(lang), kind=pa.array(kind, pa.int32()), key=list(key), n=pa.array(n, pa.int64()))


class Model:
    """Log frequencies: tables[0] of words, tables[k] of k-grams; rows are places in `values`."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], counts: np.ndarray, totals: np.ndarray):
        """counts: a row for each place and a column for each language; totals: the same for each table."""
        self.langs, self.tables = langs, tables
        self.values = np.empty(counts.shape, np.float64)
        for table, total in zip(tables, totals, strict=True):
            at = np.fromiter(table.values(), np.int64, len(table))
            self.values[at] = np.log((counts[at] + 0.1) / (total + 0.1 * (len(counts) + 1)))
        self.cache: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """The log frequencies of a word, or of the longest of its n-grams that are known."""
        at = self.tables[0].get(w)
        if at is not None:
            return self.values[at]
        for k in range(MAX_GRAM, 0, -1):
            places = [p for g in grams(w, k) if (p := self.tables[k].get(g)) is not None]
            if places:
                return self.values[places].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        met = Counter(words)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        rows = []
        for w in met:
            r = cache.get(w)
            if r is None:
                r = cache[w] = self.word(w)
            rows.append(r)
        total = np.fromiter(met.values(), np.float64, len(met)) @ np.array(rows)
        z = (total - total.max()) / np.sqrt(len(words))
        p = np.exp(z)
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled (doc_id, text, lang), of which at most so many rows are used."""
    known = labelled.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sample = sampled(known, known.select("doc_id").distinct(), rows)
    counts = sample.select("text", "lang").repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(_count, "lang string, kind int, key string, n long")
    scratch = Scratch(sample.sparkSession)
    each = scratch.save(counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")))
    known = each.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in known})
    column = {lang: i for i, lang in enumerate(langs)}
    totals = np.zeros((MAX_GRAM + 1, len(langs)))
    for r in known:
        totals[r.kind, column[r.lang]] = r.n
    # how many keys have each count tells how often a key must be met; keys of one count stay or go together
    sums = scratch.save(each.groupBy("kind", "key").agg(F.sum("n").alias("m"), F.collect_list(F.struct("lang", "n")).alias("by")))
    least = F.lit(0)
    held = [0] * (MAX_GRAM + 1)
    for kind, m, keys in sorted(map(tuple, sums.groupBy("kind", "m").count().collect()), key=lambda r: -r[1]):
        held[kind] += keys
        if held[kind] > (WORDS if kind == 0 else GRAMS) >= held[kind] - keys:
            least = F.when(F.col("kind") == kind, m + 1).otherwise(least)
    kept = sums.where(F.col("m") >= least).select("kind", "key", F.explode("by").alias("b"))
    # flat rows in Arrow batches: the driver holds no object for a row
    tables: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
    place, lang, n, met = [], [], [], 0
    for b in kept.select("kind", "key", "b.lang", "b.n").toArrow().to_batches(max_chunksize=8192):
        for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at = tables[kind].setdefault(key, met)
            met += at == met
            place.append(at)
        lang += [column[x] for x in b.column(2).to_pylist()]
        n += b.column(3).to_pylist()
    scratch.drop(each)
    scratch.drop(sums)
    filled = np.zeros((met, len(langs)))
    filled[place, lang] = n
    return Model(langs, tables, filled, totals)


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            found = [model.value.predict(t) for t in b.column(at).to_pylist()]
            out = b.append_column("lang_pred", pa.array([x for x, _ in found], pa.string()))
            yield out.append_column("lang_score", pa.array([s for _, s in found], pa.float64()))

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score appended to its columns, one of which is text."""
    taken = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields)
    return taken.mapInArrow(_predictor(shared), f"{schema}, lang_pred string, lang_score double")


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        yield b.filter(pa.array([_WORD.search((t or "").lower()) is not None for t in texts], pa.bool_()))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text holds a letter."""
    return docs.mapInArrow(_lettered, docs.schema)


def fold(doc_id: str | Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))
