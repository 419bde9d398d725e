"""Exact n-gram Jaccard join by vertical partitioning (operator 5).

A document is the set of its distinct k-word shingles. All shingles have one global order: those met
often come last, by rising count, the others first, by hash. The order is cut into fragments and a set
into the segments that lie in them; overlaps are counted segment by segment and summed for each pair.

1. one scan counts shingles in each chunk of documents; counts of those that a chunk has met at least
   MIN_COUNT times are summed, and the FREQUENT most frequent are broadcast (a fixed number of 16-byte
   rows). Counts only set the order: any order gives the same links;
2. a second scan writes each document's set size, the digest of its set and its prefix, the
   n - ceil(t * n) + l first shingles of the order, where l is SPARE of n. Two sets with Jaccard >= t
   share l of these, l taken for the smaller set;
3. equal sets become one class, represented by the smallest doc_id, before anything is paired;
4. prefix shingles of classes form lists. A shingle is live for a class if its list holds another class
   of fitting size (sizes differ by at most the factor t). Fewer than l live shingles: no partner.
   Otherwise all but l - 1 of the live ones are enough, and the rarest, counted exactly over all
   documents, are taken. What is left is split by set size into bands;
5. links are found in rounds. A round of neighbours takes only consecutive rows of each list, once by
   size and once in a hashed order, so a group of m near copies costs m pairs, not m * m; what it links
   is contracted to components. The last round takes all remaining pairs of a list whose components
   differ, so no link between components is lost, and pairs inside a component need no check. Lists of
   more than SMALL rows aren't paired: the classes that such lists connect are compared in blocks of
   BLOCK rows against each other by the bound of step 6, and only pairs that it passes leave a block;
6. a pair is checked twice. The sizes of its segments in PARTS finer fragments, which the scan has
   written, bound its overlap by the sum of the smaller ones; this rules out nearly all pairs that met
   by chance. For the others the segments themselves are made, and the sizes of their intersections
   summed over the fragments.

Counting links (`links`) needs each pair and isn't part of the component result.

Defined cases: null or blank text: empty set, linked with nothing, its own component; fewer than k
words: the whole sequence is one shingle; a null doc_id is its own row with a null component; rows that
repeat a doc_id with different texts are told apart by their sets and both link through that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textnum
from plumbline.llm.common import Scratch, batch, components, hot_limit, lists, map_arrow, only_likely, spread_join

#: Share of a set by which its prefix is longer than one common shingle needs, in per cent.
SPARE = 5
#: A shingle must be met so often in one chunk of documents for its count to be kept.
MIN_COUNT = 4
#: Rows of the broadcast order.
FREQUENT = 1 << 17
#: Fragments of the order's hashed part; the frequent shingles are one more.
FRAGMENTS = 4
#: Finer fragments, by hash, of which only sizes are kept.
PARTS = 512
#: Lists of more rows are compared in blocks.
SMALL = 64
BLOCK = 512

_SCAN = "doc_id long, n_shingles long, set_key string, key long, prefix array<long>, sizes binary"
_PAIR = ["ra", "ka", "na", "rb", "kb", "nb"]
_PAIR_SCHEMA = "ra long, ka long, na int, rb long, kb long, nb int"


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in textnum.chunks(texts):
        words = textnum.Words(texts[lo:hi], fold=True)
        runs = words.runs(k)
        for i in range(hi - lo):
            s, e = words.bounds(i)
            if e - s >= k:
                yield np.unique(runs[s : e - k + 1])
            else:
                yield np.array([textnum.whole(words.hashes[s:e])] if e > s else [], np.uint64)


def _ceil_share(n: np.ndarray | int, num: int, den: int):
    return -(-n * num // den)


def _spare(n):
    return _ceil_share(n, SPARE, 100)


def _counter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= MIN_COUNT
            return batch(s=pa.array(values[often].view(np.int64)), c=pa.array(counts[often].astype(np.int64)))

        for b in batches:
            for x in shingle_sets(b.column(0).to_pylist(), k):
                held.append(x)
                size += len(x)
                if size > 1 << 19:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _ranks(values: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Places in the broadcast order (often: sorted hashes, ranks), -1 for the others."""
    if not len(often):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(often["s"], values), len(often) - 1)
    return np.where(often["s"][at] == values, often["r"][at], -1)


def _scanner(k: int, num: int, den: int, often):
    def run(b: pa.RecordBatch):
        texts = b.column(1).to_pylist()
        for lo, hi in textnum.chunks(texts):
            keys, short, sizes, parts, ends, fine = [], [], [], [], [0], []
            for x in shingle_sets(texts[lo:hi], k):
                n = len(x)
                name = textnum.digest(x)
                keys.append(name.hex() if n else None)
                short.append(int.from_bytes(name[:8], "little", signed=True))
                sizes.append(n)
                rank = _ranks(x, often.value)
                take = n - int(_ceil_share(n, num, den)) + int(_spare(n))
                rare = x[rank < 0]
                if len(rare) >= take:
                    parts.append(rare[:take])
                else:
                    common = x[rank >= 0]
                    parts.append(np.concatenate([rare, common[np.argsort(rank[rank >= 0])][: take - len(rare)]]))
                ends.append(ends[-1] + len(parts[-1]))
                # the lower bits, as the upper ones order the rare shingles
                fine.append(np.minimum(np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
            yield batch(doc_id=b.column(0)[lo:hi], n_shingles=pa.array(sizes, pa.int64()), set_key=pa.array(keys, pa.string()), key=pa.array(short, pa.int64()), prefix=lists(np.concatenate(parts).view(np.int64), ends, pa.int64()), sizes=pa.array(fine, pa.binary()))

    return run


def _segmenter(k: int, often):
    def run(b: pa.RecordBatch):
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in textnum.chunks(texts):
            rep, key, fragment, flat, ends = [], [], [], [], [0]
            for i, x in zip(ids[lo:hi], shingle_sets(texts[lo:hi], k), strict=True):
                name = int.from_bytes(textnum.digest(x)[:8], "little", signed=True)
                where = np.where(_ranks(x, often.value) >= 0, FRAGMENTS, (x >> np.uint64(62)).astype(np.int64) * FRAGMENTS // 4)
                for f in np.unique(where).tolist():
                    own = x[where == f]
                    rep.append(i)
                    key.append(name)
                    fragment.append(f)
                    flat.append(own)
                    ends.append(ends[-1] + len(own))
            if flat:
                yield batch(rep=pa.array(rep, pa.int64()), key=pa.array(key, pa.int64()), fragment=pa.array(fragment, pa.int32()), segment=lists(np.concatenate(flat).view(np.int64), ends, pa.int64()))

    return run


def _likely(most: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    most = np.minimum(most, np.minimum(na, nb))
    return (most * den >= (na + nb - most) * num) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bound of the overlap of sets by their segments' sizes; full where a size may be larger."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(axis=-1), np.int64(1) << 40, low.sum(axis=-1, dtype=np.int64))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, PARTS)


def _bounder(num: int, den: int):
    def run(b: pa.RecordBatch):
        a, c = _matrix(b.column("sa").to_pylist()), _matrix(b.column("sb").to_pylist())
        keep = _likely(_overlap(a, c), b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy().astype(np.int64), num, den)
        return b.select(_PAIR).filter(pa.array(keep))

    return run


def _block(num: int, den: int):
    """The likely pairs between two blocks, or inside one, with different labels."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        pdf = pdf.sort_values(["rep", "key", "label"], kind="stable").reset_index(drop=True)
        size, n, label, rep = _matrix(pdf["sizes"]), pdf["n"].to_numpy().astype(np.int64), pdf["label"].to_numpy(), pdf["rep"].to_numpy()
        left, right = np.flatnonzero(pdf["block"] == i), np.flatnonzero(pdf["block"] == j)
        found = []
        for x in left:
            ys = right[(label[right] != label[x]) & ((right > x) if i == j else True)]
            ys = ys[np.minimum(n[ys], n[x]) * den >= np.maximum(n[ys], n[x]) * num]
            if len(ys):
                ys = ys[_likely(_overlap(size[x][None, :], size[ys]), np.full(len(ys), n[x]), n[ys], num, den)]
                found += [(x, y) for y in ys.tolist()]
        k = pdf["key"].to_numpy()
        a = np.array([(x, y) if (rep[x], k[x]) < (rep[y], k[y]) else (y, x) for x, y in found], np.int64).reshape(-1, 2)
        x, y = a[:, 0], a[:, 1]
        return pd.DataFrame({"ra": rep[x], "ka": k[x], "na": n[x].astype(np.int32), "rb": rep[y], "kb": k[y], "nb": n[y].astype(np.int32)})

    return run


class NgramJoin:
    """The join of one table of documents (doc_id, text), at Jaccard >= num / den."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100):
        if not 0 < num <= den or k < 1:
            raise ValueError("0 < num <= den and k >= 1 are needed")
        self.k, self.num, self.den = k, num, den
        self.spark = docs.sparkSession
        self.docs = docs.select("doc_id", "text")
        self.scratch = Scratch(self.spark)
        self.often = self.spark.sparkContext.broadcast(self._order())
        self.scan = self.scratch.save(map_arrow(self.docs, _scanner(k, num, den, self.often), _SCAN))
        self.members = self._classes()
        self.rows = self._lists()
        # texts are read once more, for the documents that are left in lists
        likely = only_likely(self.docs.where("doc_id is not null"), ["doc_id"], self.rows.select(F.col("rep").alias("doc_id")).distinct())
        made = map_arrow(likely, _segmenter(k, self.often), "rep long, key long, fragment int, segment array<long>")
        self.segments = self.scratch.save(made.join(self.rows.select("rep", "key").distinct(), ["rep", "key"], "left_semi"))

    def _order(self) -> np.ndarray:
        counts = self.docs.select("text").mapInArrow(_counter(self.k), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
        top = counts.orderBy(F.desc("c"), "s").limit(FREQUENT).toPandas()
        out = np.zeros(len(top), [("s", np.uint64), ("r", np.int64)])
        out["s"] = top["s"].to_numpy().astype(np.int64).view(np.uint64)
        out["r"] = np.arange(len(top))[::-1]  # the most frequent comes last
        return np.sort(out, order="s")

    def _classes(self) -> DataFrame:
        """(set_key, rep, members)."""
        named = self.scan.where("set_key is not null and doc_id is not null")
        return self.scratch.save(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))

    def _lists(self) -> DataFrame:
        """(s, band, rep, key, n): the rows of lists that have a partner of fitting size.

        A class is named by its rep and a key of its set, as rows with one doc_id may have several sets.
        """
        one = self.scan.where("set_key is not null").select(F.col("doc_id").alias("rep"), "set_key", "key", F.col("n_shingles").cast("int").alias("n"), "prefix")
        one = one.join(self.members.select("rep", "set_key"), ["rep", "set_key"])
        posts = one.select("rep", "key", "n", F.explode("prefix").alias("s"))
        live = self._live(posts)
        live = live.withColumn("_df", F.count("*").over(Window.partitionBy("s")))
        own = Window.partitionBy("rep", "key")
        # the smallest partner's l, in whole numbers as in the scan
        least = F.ceil((F.ceil(F.col("n") * self.num / self.den - 1e-9) * SPARE) / 100 - 1e-9)
        live = live.withColumn("_live", F.count("*").over(own)).withColumn("_rank", F.row_number().over(own.orderBy("_df", "s")))
        posts = self._live(live.where(F.col("_rank") <= F.col("_live") - least + 1).select("rep", "key", "n", "s"))
        if self.num == self.den:
            band = F.array(F.col("n"))
        else:
            # 1e-9 keeps a size at a band's edge in one band or the other, and each is also in the next
            low = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.den / self.num)) + 1e-9).cast("int")
            band = F.array(low, low + 1)
        return self.scratch.save(posts.select("s", F.explode(band).alias("band"), "rep", "key", "n"))

    def _live(self, posts: DataFrame) -> DataFrame:
        """The rows (s, rep, key, n) whose list holds another class of fitting size."""
        near = Window.partitionBy("s").orderBy("n", "rep", "key")
        # rows that repeat an id and a set are one class
        again = F.coalesce(F.lag(F.struct("rep", "key")).over(near) == F.struct("rep", "key"), F.lit(False))
        posts = posts.withColumn("_again", again).where("not _again").drop("_again")
        fits = (F.col("n") * self.num <= F.lag("n").over(near) * self.den) | (F.lead("n").over(near) * self.num <= F.col("n") * self.den)
        return posts.withColumn("_fits", fits).where("_fits").drop("_fits")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose overlap the sizes of their fine segments don't rule out."""
        left = self._sizes().select(F.col("doc_id").alias("ra"), F.col("key").alias("ka"), F.col("sizes").alias("sa"))
        right = self._sizes().select(F.col("doc_id").alias("rb"), F.col("key").alias("kb"), F.col("sizes").alias("sb"))
        both = pairs.join(left, ["ra", "ka"]).join(right, ["rb", "kb"]).select(*_PAIR, "sa", "sb")
        return map_arrow(both, _bounder(self.num, self.den), _PAIR_SCHEMA)

    def _sizes(self) -> DataFrame:
        """One row for each class and id."""
        return self.scan.where("set_key is not null").select("doc_id", "key", "sizes")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Pairs among the classes that large lists connect, by bound and block."""
        name = F.struct("s", "band").alias("_list")
        lists_ = self.scratch.save(rows.groupBy("s", "band").agg(F.min("rep").alias("least"), F.count("*").alias("rows")).select(name, "least", "rows"))
        hot = lists_.where(F.col("rows") > hot_limit(lists_))
        edges = spread_join(rows.select(name, "rep"), lists_.drop("rows"), "_list", hot).select(F.col("rep").alias("a"), F.col("least").alias("b"))
        families = components(edges, self.scratch).select(F.col("id").alias("rep"), F.col("component").alias("family"))
        one = rows.select("rep", "key", "n", "band", "label").distinct().join(families, "rep")
        full = self.scratch.save(one.join(self._sizes().withColumnRenamed("doc_id", "rep"), ["rep", "key"]))
        count = full.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = full.join(count, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")})
        cells = dealt.select("family", "band", "i", "j", "block", "rep", "key", "n", "label", "sizes").groupBy("family", "band", "i", "j")
        return cells.applyInPandas(_block(self.num, self.den), _PAIR_SCHEMA)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold, with their overlap o."""
        pairs = self.scratch.save(pairs.distinct())
        segments = self.segments
        left = pairs.join(segments.select(F.col("rep").alias("ra"), F.col("key").alias("ka"), "fragment", F.col("segment").alias("sa")), ["ra", "ka"])
        both = left.join(segments.select(F.col("rep").alias("rb"), F.col("key").alias("kb"), "fragment", F.col("segment").alias("sb")), ["rb", "kb", "fragment"])
        part = both.select(*_PAIR, "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o")).distinct()
        summed = part.groupBy(*_PAIR).agg(F.sum("o").alias("o"))
        return summed.where(F.col("o") * self.den >= (F.col("na") + F.col("nb") - F.col("o")) * self.num)

    def _neighbours(self, rows: DataFrame, order: list) -> DataFrame:
        """Consecutive rows of each list, in this order, whose labels differ."""
        me = F.struct("rep", "key", "n", "label")
        w = Window.partitionBy("s", "band").orderBy(*order)
        two = rows.select(me.alias("x"), F.lag(me).over(w).alias("y")).where("y is not null and x.label <> y.label")
        return self._ordered(two)

    def _ordered(self, two: DataFrame) -> DataFrame:
        """Distinct pairs of fitting sizes from structs x and y, the smaller first."""
        # compared by columns: generated code for least and greatest of structs is long
        first = (F.col("x.rep") < F.col("y.rep")) | ((F.col("x.rep") == F.col("y.rep")) & (F.col("x.key") < F.col("y.key")))
        names = list(zip(("rep", "key", "n"), _PAIR[:3], _PAIR[3:], strict=True))
        flat = two.select(*(F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(a) for c, a, _ in names), *(F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(b) for c, _, b in names))
        return flat.where(F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num).distinct()

    def _labelled(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of lists that still have two labels."""
        found = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.scratch)
        named = rows.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        open_lists = named.groupBy("s", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s", "band")
        return self.scratch.save(named.join(open_lists, ["s", "band"], "left_semi"))

    def connecting_links(self) -> DataFrame:
        """Links (ra, rb) that connect everything that all links connect."""
        rows = self.rows.withColumn("label", F.col("rep"))
        links = self.scratch.save(self._verified(self._bounded(self._neighbours(rows, ["n", "rep", "key"]))).select("ra", "rb"))
        rows = self._labelled(self.rows, links)
        links = links.unionAll(self.scratch.save(self._verified(self._bounded(self._neighbours(rows, [F.xxhash64("rep", "key"), F.col("rep")]))).select("ra", "rb")))
        rows = self._labelled(rows.drop("label"), links)
        return links.unionAll(self._verified(self._rest(rows)).select("ra", "rb"))

    def _rest(self, rows: DataFrame) -> DataFrame:
        """All pairs of a list whose labels differ and whose sizes don't rule a link out."""
        rows = self.scratch.save(rows.withColumn("_rows", F.count("*").over(Window.partitionBy("s", "band"))))
        few, many = rows.where(F.col("_rows") <= SMALL).drop("_rows"), rows.where(F.col("_rows") > SMALL).drop("_rows")
        on = (F.col("l.s") == F.col("r.s")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.label") < F.col("r.label")) & (F.least("l.n", "r.n") * self.den >= F.greatest("l.n", "r.n") * self.num)
        both = few.alias("l").join(few.alias("r"), on)
        pairs = self._bounded(self._ordered(both.select(F.struct("l.rep", "l.key", "l.n").alias("x"), F.struct("r.rep", "r.key", "r.n").alias("y"))))
        return pairs.unionAll(self._blocks(many)) if many.limit(1).count() else pairs

    def links(self) -> DataFrame:
        """Every link between classes: (ra, rb, jaccard); copies are in `members`."""
        found = self._verified(self._rest(self.rows.withColumn("label", F.xxhash64("rep", "key"))))
        return found.select("ra", "rb", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("jaccard"))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        found = components(self.connecting_links().select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionAll(self._same_id()), self.scratch)
        named = self.members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("_component"))
        out = self.scan.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))

    def _same_id(self) -> DataFrame:
        """Classes that share a doc_id, as its rows have several sets, hang together."""
        several = self.scan.where("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
        sets = self.scan.join(several, "doc_id").select("doc_id", "set_key").distinct().join(self.members.select("set_key", "rep"), "set_key")
        return sets.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def ngram_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return NgramJoin(docs, k, num, den).classes()
