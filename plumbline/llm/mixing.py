"""Mixing sources to target weights by weighted fair queueing (operator 6), in DataFrame functions only.

Every source is a queue of its documents in a hashed (shuffled) order, repeated up to `epochs` times, and
serves word by word. The virtual finish time of a word is its place in its source's queue divided by the
source's weight. All queues are merged in order of finish time and the merged queue is cut where it holds
`budget` words, the number of words of all documents. A source that runs out leaves its share to the
others. In whole numbers throughout: times are multiples of 1 / lcm(weights), so every run agrees.

* Running sums within a source: documents are dealt into ranges of their hash, about RANGE_ROWS rows in
  each; sums of ranges give each range's start, and windows run inside ranges only, so a source that holds
  a third of all rows is as many tasks as its size asks for.
* The global order: the time axis is cut into RANGES ranges. A document's words lie in a row on it, so each
  range gets a number of words from each document that crosses it; running sums over the ranges tell the
  one in which the budget runs out. That one is cut into RANGES ranges again, until one holds at most LAST
  words, which are put in order one by one. The last word that fits is the cut: documents before it are
  taken whole, those after it not at all, and the one that each queue is at is cut at its word.
* Targets, for the report: a source's target is min(cap, level * weight), where cap is `epochs` times its
  size, and the level makes all targets sum to the budget. Fair queueing comes within a word of them.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its own, last
in order; no documents or no words: targets and takes 0; a null doc_id is a value like any other; rows with
equal doc_id are told apart by their texts, equal rows by their number `tie` (of `ties`), they are counted
before they are queued; other columns don't matter; reruns and other partitionings agree, since nothing
depends on where a row lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

WEIGHTS = (5, 2, 1)
EPOCHS = 3
RANGE_ROWS = 1 << 14
MIN_RANGE_BITS = 8
RANGES = 256
LAST = 1 << 16

_EDGE = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_EDGE)), F.lit(0)).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The place of a document in its queue, from its id and text; equal only for equal ones."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, _i, target) from (source, source_size); _i numbers the sources in order."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    known = sizes.withColumn("_i", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1))
    cap = F.col("source_size").cast("double") * epochs
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the level counts from the first source on whose cap isn't below its share
    known = known.withColumn("_cap", cap).withColumn("_total", F.sum("source_size").over(everything).cast("double")).withColumn("_level", level)
    known = known.withColumn("_level", F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "_i", "_level"))).over(everything)["_level"])
    return known.select("source", "source_size", "weight", "_i", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), "_cap")).alias("target"))


def _upto(time: Column | int) -> Column:
    """How many of a document's words, over all its passes (array _begins), finish at this time or before."""
    served = F.floor((time if isinstance(time, Column) else F.lit(time)) / F.col("_step"))
    one = lambda begin: F.greatest(F.lit(0), F.least(F.col("size"), served - begin))
    return F.aggregate(F.transform("_begins", one), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _cut(items: DataFrame, budget: int, end: int) -> tuple[int, int]:
    """(time, place of the source) of the last word that fits, from items (_begin, size, _step, _i), one for each pass."""
    low, before = 0, 0  # words finishing at `low` or before it are counted in `before`
    first, last = F.col("_begin") + 1, F.col("_begin") + F.col("size")
    while True:
        width = -(-(end - low) // RANGES)
        place = lambda c: F.floor((c * F.col("_step") - low - 1) / width)  # noqa: E731, B023
        crossing = items.where((last * F.col("_step") > low) & (first * F.col("_step") <= end))
        spread = crossing.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), place(first)), F.least(F.lit(RANGES - 1), place(last)))))
        edge = lambda r: F.greatest(F.col("_begin"), F.least(last, F.floor((r * width + low) / F.col("_step"))))  # noqa: E731, B023
        counts = spread.groupBy("r").agg(F.sum(edge(F.col("r") + 1) - edge(F.col("r"))).alias("n"))
        upto = before + F.sum("n").over(Window.orderBy("r"))
        r = counts.withColumn("upto", upto).where(F.col("upto") >= budget).orderBy("r").first()
        low, end, before = low + r.r * width, min(end, low + (r.r + 1) * width), r.upto - r.n
        if r.n <= LAST or end - low <= 1:
            break
    # one by one in the range that is left; words of one time go by the order of sources
    inside = items.where((last * F.col("_step") > low) & (first * F.col("_step") <= end))
    inside = inside.withColumns({"a": F.greatest(first, F.floor(F.lit(low) / F.col("_step")) + 1), "b": F.least(last, F.floor(F.lit(end) / F.col("_step")))}).where("a <= b")
    one = inside.select("_i", "_step", F.explode(F.sequence("a", "b")).alias("c")).select("_i", (F.col("c") * F.col("_step")).alias("t"))
    cut = one.orderBy("t", "_i").limit(budget - before).agg(F.max(F.struct("t", "_i")).alias("x")).first().x
    return cut.t, cut._i


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, row_key, tie, ties for every row of docs (doc_id, text, source)."""
    if not weights or any(not isinstance(w, int) or w < 1 for w in weights):
        raise ValueError("weights are positive whole numbers")
    scratch = scratch or Scratch(docs.sparkSession)
    scale = math.lcm(*weights)
    slim = docs.select("doc_id", "source", words("text").alias("size"), row_key().alias("row_key"))
    # equal rows are one row with their number
    slim = scratch.save(slim.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("ties")))
    rows = slim.count()
    shift = 32 - min(32, max(MIN_RANGE_BITS, (rows // RANGE_ROWS).bit_length()))
    slim = slim.withColumn("_range", F.shiftright(F.conv(F.substring("row_key", 1, 8), 16, 10).cast("long"), shift))
    sums = slim.groupBy("source", "_range").agg(F.sum(F.col("size") * F.col("ties")).alias("_sum"))
    sources = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, epochs)
    starts = sums.withColumn("_start", F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum"))
    sources = scratch.save(sources.withColumn("_step", (scale / F.col("weight")).cast("long")))
    starts = scratch.save(starts.withColumnsRenamed({"source": "_s", "_range": "_r"}).join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("source", "weight"))
    inside = Window.partitionBy("source", "_range").orderBy("row_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = slim.withColumn("_in", F.sum(F.col("size") * F.col("ties")).over(inside)).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    queue = queue.withColumn("tie", F.explode(F.sequence(F.lit(1).cast("long"), "ties")))
    # pass e of a document begins after e whole passes of its source
    begin = F.col("_start") + F.col("_in") - F.col("size") * (F.col("ties") - F.col("tie") + 1)
    begins = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: e * F.col("source_size") + begin)
    queue = scratch.save(queue.select("doc_id", "source", "size", "source_size", "target", "row_key", "tie", "ties", "_i", "_step", begins.alias("_begins")))
    total = sources.agg(F.sum("source_size").alias("budget"), F.max(F.col("source_size") * epochs * F.col("_step")).alias("end")).first()
    if not total.budget:
        taken = F.lit(0).cast("long")
    else:
        items = queue.where("size > 0").select("size", "_step", "_i", F.explode("_begins").alias("_begin"))
        time, place = _cut(items, total.budget, total.end)
        # of the words that finish at the very time of the cut those of later sources don't fit
        taken = _upto(F.when(F.col("_i") <= place, time).otherwise(time - 1))
    return queue.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "row_key", "tie", "ties")
