"""Removal of long repeated spans through a compacted de Bruijn graph (operator 9).

A text is a walk over token k-mers. The k-mer of smallest hash among the `window - k + 1` of a window is its
anchor; consecutive windows with one anchor make one step of the walk, about one for every (window - k + 2) / 2
words. Steps are the graph's edges, named by a signature of all their words; what comes before and after
an edge are its neighbours. Only edges are shuffled, never windows:

1. one scan hashes the texts and writes each document's edges: anchor, signature, coordinates;
2. edges whose anchor lies in one document only are dropped (the large majority);
3. equal edges become one row: the smallest document and a place in it (the source), and the least and
   greatest edge before and after it, which tell degrees of one from higher ones. An anchor with one
   signature is plain, one with several is where walks branch;
4. plain edges that always follow each other (one way out of the first, one way into the second, over
   all documents) compact into one path. All their occurrences are the same walks, so the path has one
   source, in which its edges lie in a row;
5. sources are read again at their coordinates: they give a check of each path, from hashes of a family of
   their own, and the windows of branching edges, whose owners are found window by window;
6. every occurrence of a path gets its owner and check. Where the words are taken out, the check is made
   again from the occurrence's words; a span that doesn't pass it stays.

A passage that a third of all documents share has a hot key: what joins on anchors, signatures and windows
goes through spread_join, and aggregates combine before they shuffle.

Defined cases: null and empty texts have no words; texts of fewer than `window` words are kept whole;
rows with equal doc_id are never removed in favour of each other (no id is smaller); a null doc_id
neither owns nor loses words; the order of rows and further columns don't matter; very long texts are
hashed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textnum
from plumbline.llm.common import Scratch, batch, hot_limit, lists, map_arrow, only_likely, spread_join

WINDOW = 50
KMER = 16

_SCAN = "doc_id long, text_key long, n_words long, sha string, anchor array<long>, sig array<long>, at array<int>, n array<int>"


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", text_key().alias("text_key"))


def _leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """For each start the index of the first smallest value among the next width, by doubling."""
    at, span = np.arange(len(x)), 1
    while span * 2 <= width:
        left, right = at[: len(at) - span], at[span:]
        at, span = np.where(x[right] < x[left], right, left), span * 2
    if span < width:
        gap = width - span
        left, right = at[: len(at) - gap], at[gap:]
        at = np.where(x[right] < x[left], right, left)
    return at


def paths(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, signature, first window and number of windows of each path of one text."""
    n = len(hashes) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e.view(np.uint64), e.view(np.uint64), e, e
    kmers = textnum.runs(hashes, k)
    at = _leftmost_min(kmers, window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    anchor = at[first]
    windows = textnum.runs(hashes, window)
    # a path has at most window - k + 1 windows, so its first and last one cover all its words
    with np.errstate(over="ignore"):
        sig = textnum.mix(windows[first] + textnum.mix(windows[first + count - 1] + (count * 4096 + (anchor - first)).astype(np.uint64)))
    return kmers[anchor], sig, first, count


def _scan(window: int, k: int):
    def run(b: pa.RecordBatch):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in textnum.chunks(texts):
            words = textnum.Words(texts[lo:hi])
            found, ends, shas = [], [0], []
            for i, t in enumerate(texts[lo:hi]):
                s, e = words.bounds(i)
                p = paths(words.hashes[s:e], window, k)
                found.append(p)
                ends.append(ends[-1] + len(p[0]))
                shas.append(hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest())
            cat = [np.concatenate([f[j] for f in found]) for j in range(4)]
            yield batch(doc_id=ids[lo:hi], text_key=b.column(2)[lo:hi], n_words=pa.array(words.counts()), sha=shas, anchor=lists(cat[0].view(np.int64), ends, pa.int64()), sig=lists(cat[1].view(np.int64), ends, pa.int64()), at=lists(cat[2].astype(np.int32), ends, pa.int32()), n=lists(cat[3].astype(np.int32), ends, pa.int32()))

    return run


def _checks(windows: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A check of the words of the windows b to e - 1, from windows of the second family."""
    with np.errstate(over="ignore"):
        return textnum.mix(windows[b] + textnum.mix(windows[e - 1] + (e - b).astype(np.uint64)))


def _sources(window: int):
    """For each spot of a text its check (j = -1) and, where walks branch, its windows and their checks."""

    def run(b: pa.RecordBatch):
        texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
        wanted = b.column("spots").to_pylist()
        for lo, hi in textnum.chunks(texts):
            words = textnum.Words(texts[lo:hi])
            runs, second = words.runs(window), textnum.Words(texts[lo:hi], check=True).runs(window)
            sig, place, value, check, doc = [], [], [], [], []
            for i in range(hi - lo):
                s, _ = words.bounds(i)
                for x in wanted[lo + i]:
                    n = 0 if x["plain"] else x["n"]
                    at = s + x["at"] + np.arange(n)
                    first = np.array([s + x["at"]])
                    sig.append(np.full(n + 1, x["sig"], np.int64))
                    place.append(np.arange(-1, n, dtype=np.int32))
                    value.append(np.concatenate([np.zeros(1, np.uint64), runs[at]]))
                    check.append(np.concatenate([_checks(second, first, first + x["n"]), _checks(second, at, at + 1)]))
                    doc += [ids[lo + i]] * (n + 1)
            if sig:
                yield batch(sig=np.concatenate(sig), j=np.concatenate(place), w=np.concatenate(value).view(np.int64), v=np.concatenate(check).view(np.int64), doc_id=pa.array(doc, pa.int64()))

    return run


def _cut(window: int):
    """Takes the words of the removed windows that pass their checks out of each text.

    kept_text joins the kept words by one space; cut_text keeps the text between kept neighbours as it is
    and puts a line feed where something is gone.
    """

    def run(b: pa.RecordBatch):
        texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
        for lo, hi in textnum.chunks(texts):
            words = textnum.Words(texts[lo:hi])
            second = textnum.Words(texts[lo:hi], check=True).runs(window)
            removed, kept, cut = [], [], []
            for i in range(hi - lo):
                s, e = words.bounds(i)
                edge = np.zeros(e - s + 1, np.int32)
                b_, e_, v = (np.array([x[c] for x in spans[lo + i]], np.int64) for c in ("b", "e", "v"))
                same = _checks(second, s + b_, s + e_) == v.view(np.uint64)
                np.add.at(edge, b_[same], 1)
                np.add.at(edge, e_[same] + window - 1, -1)
                stays = np.cumsum(edge)[:-1] <= 0
                begin, end = words.starts[s:e], words.ends[s:e]
                flips = np.flatnonzero(np.diff(np.concatenate([[False], stays, [False]])))
                parts = [words.buffer[begin[p] : end[q - 1]] for p, q in zip(flips[::2], flips[1::2], strict=True)]
                removed.append(int((~stays).sum()))
                kept.append(b" ".join(w for part in parts for w in part.split()).decode("utf-8", "surrogatepass"))
                cut.append(b"\n".join(parts).decode("utf-8", "surrogatepass"))
            yield batch(doc_id=b.column("doc_id")[lo:hi], text_key=b.column("text_key")[lo:hi], n_removed=pa.array(removed, pa.int64()), kept_text=pa.array(kept, pa.string()), cut_text=pa.array(cut, pa.string()))

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """The scan of all documents, and (doc_id, text_key, spans): b <= start of a removed window < e, check v."""
    if not 0 < k < window:
        raise ValueError("k must be positive and below window")
    slim = _keyed(docs)
    scan = scratch.save(map_arrow(slim, _scan(window, k), _SCAN))
    some = F.size("sig") - 1
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("sig", 1, some))
    after = F.concat(F.slice("sig", 2, some), F.array(F.lit(0).cast("long")))
    walks = scan.where("doc_id is not null and size(sig) > 0").withColumns({"before": before, "after": after})
    each = walks.select("doc_id", "text_key", F.explode(F.arrays_zip("anchor", "sig", "at", "n", "before", "after")).alias("p")).select("doc_id", "text_key", "p.*")
    anchors = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("sig") == F.max("sig")).alias("plain"), F.count("*").alias("rows")).where("lo < hi")
    anchors = scratch.save(anchors.select("anchor", "plain", "rows"))
    limit = hot_limit(anchors)
    here = scratch.save(spread_join(each, anchors.select("anchor", "plain"), "anchor", anchors.where(F.col("rows") > limit)).drop("anchor"))
    # equal edges become one row with the smallest document, one place in it, and their neighbours
    ends = [f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("lo", F.min), ("hi", F.max))]
    edges = here.groupBy("sig", "plain").agg(F.min(F.struct("doc_id", "text_key", "at", "n")).alias("own"), F.count("*").alias("rows"), *ends)
    edges = scratch.save(edges.select("sig", "plain", "own.*", "rows", *[f"{c}_{n}" for c in ("before", "after") for n in ("lo", "hi")]))
    paths_ = scratch.save(_compacted(edges.where("plain")).unionByName(edges.where("not plain").select("sig", "plain", "doc_id", "text_key", "at", "n", "rows")))
    spots = scratch.save(paths_.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("sig", "at", "n", "plain")).alias("spots")))
    sources = only_likely(slim, ["doc_id"], spots.select("doc_id"))
    read = scratch.save(map_arrow(sources.join(spots, ["doc_id", "text_key"]).select("doc_id", "text", "spots"), _sources(window), "sig long, j int, w long, v long, doc_id long"))
    checks = read.where("j < 0").groupBy("sig").agg(F.min("v").alias("v"))
    found = scratch.save(paths_.select("sig", "plain", F.col("doc_id").alias("own"), F.col("n").alias("length"), "rows").join(checks, "sig"))
    hot = found.where(F.col("rows") > limit)
    # who owns the windows of branching edges; only those that a smaller document than some other holds matter
    windows = read.where("j >= 0").select("sig", "j", "w", "v", "doc_id")
    owners = windows.groupBy("w").agg(F.min(F.struct("doc_id", "v")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("first.doc_id < last")
    owners = scratch.save(owners.select("w", F.col("first.doc_id").alias("owner"), F.col("first.v").alias("v"), "rows"))
    common = owners.where(F.col("rows") > hot_limit(owners))
    owned = spread_join(windows.drop("v", "doc_id"), owners.drop("rows"), "w", common).groupBy("sig").agg(F.collect_set(F.struct("j", "owner", "v")).alias("owned"))
    whole = spread_join(here.where("plain").drop("plain"), found.where("plain").select("sig", "own", "length", "v"), "sig", hot).where("doc_id > own")
    whole = whole.select("doc_id", "text_key", F.struct(F.col("at").alias("b"), (F.col("at") + F.col("length")).alias("e"), "v").alias("span"))
    # a branching edge's own smallest document owns all its windows that no other edge has
    parts = found.where("not plain").select("sig", "own", "v").join(owned, "sig", "left")
    many = spread_join(here.where("not plain").drop("plain"), parts, "sig", hot)
    mine = F.filter(F.coalesce("owned", F.array().cast("array<struct<j:int,owner:long,v:long>>")), lambda x: x["owner"] < F.col("doc_id"))
    later = F.when(F.col("own") < F.col("doc_id"), F.array(F.struct(F.col("at").alias("b"), (F.col("at") + F.col("n")).alias("e"), "v"))).otherwise(F.transform(mine, lambda x: F.struct((F.col("at") + x["j"]).alias("b"), (F.col("at") + x["j"] + 1).alias("e"), x["v"].alias("v"))))
    parts = many.select("doc_id", "text_key", F.explode(later).alias("span"))
    spans = whole.unionAll(parts).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    return scan.select("doc_id", "text_key", "n_words", "sha"), scratch.save(spans)


def _compacted(edges: DataFrame) -> DataFrame:
    """Plain edges in paths: (sig of the first edge, plain, doc_id, text_key, at, n of all, rows).

    Two edges are one path where all ways out of the first lead to the second and all ways into the second
    come from the first; a text's end is a way of its own (0). They then lie in a row in their source.
    """
    row = Window.partitionBy("doc_id", "text_key").orderBy("at")
    follows = (F.col("before_lo") == F.col("before_hi")) & (F.lag("sig").over(row) == F.col("before_lo")) & (F.lag("after_lo").over(row) == F.lag("after_hi").over(row)) & (F.lag("after_lo").over(row) == F.col("sig"))
    first = edges.withColumn("_first", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_path", F.sum("_first").over(row))
    out = first.groupBy("doc_id", "text_key", "_path").agg(F.min(F.when(F.col("_first") == 1, F.col("sig"))).alias("sig"), F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.max("rows").alias("rows"))
    return out.select("sig", F.lit(True).alias("plain"), "doc_id", "text_key", "at", "n", "rows")


def removed_text(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_removed, kept_text, cut_text) of the documents that lose words."""
    likely = only_likely(_keyed(docs), ["doc_id"], spans.select("doc_id"))
    return map_arrow(likely.join(spans, ["doc_id", "text_key"]), _cut(window), "doc_id long, text_key long, n_removed long, kept_text string, cut_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    scan, spans = repeated_spans(docs, scratch, window, k)
    cut = removed_text(docs, spans, window).select("doc_id", "text_key", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("_sha")).dropDuplicates(["doc_id", "text_key"])
    out = scan.join(cut, ["doc_id", "text_key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_sha", "sha").alias("kept_sha256"))
