"""The long series table and the operators on it that need order.

All ordered checks work on one unpivoted table (column, keys, t, v), so a family of checks is one job
whatever the number of columns. Windows are keyed by column and series. Where only dates matter, dates
are made distinct first, so an un-keyed window holds one row for each day, not one for each observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.columns import as_date, col, finite
from plumbline.operators.profile import exact_quantiles


def long(df: DataFrame, time: Column, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, k, t, v): finite values as doubles; k is the series' key as a struct."""
    k = F.struct(*[col(c) for c in keys]) if keys else F.lit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), finite(df, c).cast("double").alias("v")) for c in columns])
    return df.select(k.alias("k"), time.alias("t"), F.explode(pairs).alias("p")).select("p.column", "k", "t", "p.v").where("v is not null and t is not null")


def dates(df: DataFrame, time: Column, keys: list[str]) -> DataFrame:
    """(k, d, first, last): the days of each series with their first and last time."""
    k = F.struct(*[col(c) for c in keys]) if keys else F.lit(0)
    return df.select(k.alias("k"), time.alias("t")).where("t is not null").groupBy("k", as_date(F.col("t")).alias("d")).agg(F.min("t").alias("first"), F.max("t").alias("last"))


def gaps(df: DataFrame, time: Column, keys: list[str]) -> DataFrame:
    """(k, prev, t, prev_day, gap) between consecutive days of each series; gap in days, as a long."""
    w = Window.partitionBy("k").orderBy("d")
    days = dates(df, time, keys)
    out = days.select("k", F.lag("last").over(w).alias("prev"), F.col("first").alias("t"), F.lag("d").over(w).alias("prev_day"), "d")
    return out.where("prev_day is not null").select("k", "prev", "t", "prev_day", F.datediff("d", "prev_day").cast("long").alias("gap"))


def modal_gap(g: DataFrame) -> DataFrame:
    """(gap, n) of the most frequent gap; the smallest in a tie."""
    return g.groupBy("gap").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap").limit(1)


def cadence_gaps(df: DataFrame, time: Column, keys: list[str]) -> DataFrame:
    """(k, prev, t, gap, cadence, missing, why): what is longer than the usual gap, and why.

    A hole has lost at least one whole period. Jitter is longer than a period, but lost none, and the weekend
    of daily data isn't a hole.
    """
    g = gaps(df, time, keys)
    one = modal_gap(g).select(F.col("gap").alias("cadence"))
    wide = g.crossJoin(F.broadcast(one)).where("gap > cadence")
    weekend = (F.col("cadence") == 1) & (F.col("gap") == 3) & (F.dayofweek("prev_day") == 6)
    missing = F.greatest(F.lit(0), F.bround(F.col("gap") / F.col("cadence")) - 1).cast("long")
    why = F.when(weekend, "weekend").when(F.col("missing") > 0, "hole").otherwise("jitter")
    return wide.withColumn("missing", missing).withColumn("why", why).select("k", "prev", "t", "gap", "cadence", "missing", "why")


def inversions(df: DataFrame, order: list[Column], time: Column, keys: list[str]) -> DataFrame:
    """(rows, inversions, in_series): rows stored before an earlier time, overall and in their series.

    The un-keyed comparison cuts the stored order into ranges of the order columns; each range compares
    its own rows and the ranges' ends are compared in one small window.
    """
    k = F.struct(*[col(c) for c in keys]) if keys else F.lit(0)
    slim = df.select(k.alias("k"), time.alias("t"), F.struct(*order).alias("o"))
    inside = Window.partitionBy("k").orderBy("o")
    in_series = slim.withColumn("p", F.lag("t").over(inside)).agg(F.count_if(F.col("t") < F.col("p")).alias("in_series"))
    # a file's rows are cut into pieces of a fixed number of rows
    piece = slim.withColumn("_piece", F.struct(*[F.col("o").getField(i) for i in _fields(slim)[:-1]], F.floor(F.col("o").getField(_fields(slim)[-1]) / 65536).alias("n")))
    own = Window.partitionBy("_piece").orderBy("o")
    each = piece.withColumn("p", F.lag("t").over(own)).groupBy("_piece").agg(F.count("*").alias("n"), F.count_if(F.col("t") < F.col("p")).alias("i"), F.min(F.struct("o", "t"))["t"].alias("head"), F.max(F.struct("o", "t"))["t"].alias("tail"))
    ends = each.withColumn("before", F.lag("tail").over(Window.orderBy("_piece")))
    total = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("i") + F.coalesce((F.col("head") < F.col("before")).cast("int"), F.lit(0))), F.lit(0)).alias("inversions"), F.max(F.struct("_piece", "tail"))["tail"].alias("last_stored"), F.max("tail").alias("_m"))
    return total.drop("_m").crossJoin(F.broadcast(in_series)).crossJoin(F.broadcast(slim.agg(F.max("t").alias("latest"))))


def _fields(df: DataFrame) -> list[str]:
    return df.schema["o"].dataType.fieldNames()


def runs(series: DataFrame) -> DataFrame:
    """(column, k, v, n, first, last): runs of equal values in each series."""
    w = Window.partitionBy("column", "k").orderBy("t", "v")
    edge = series.withColumn("_new", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(1)))
    island = edge.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("column", "k", "_i").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).drop("_i")


def flat_tails(series: DataFrame) -> DataFrame:
    """(column, v, n, last, longest_other) where the run that ends last is at least MIN_RUN and the longest.

    Both runs are found by aggregates of structs, so no task sees all runs of a column in order.
    """
    r = runs(series)
    tail = r.groupBy("column").agg(F.max(F.struct("last", "n", "v", "k")).alias("x")).select("column", "x.*")
    first = r.alias("r").join(F.broadcast(tail).alias("x"), "column")
    own = (F.col("r.last") == F.col("x.last")) & (F.col("r.n") == F.col("x.n")) & (F.col("r.v") == F.col("x.v")) & (F.col("r.k") == F.col("x.k"))
    others = first.groupBy("column").agg(F.max(F.when(~own, F.col("r.n"))).alias("longest_other"))
    return tail.join(others, "column").withColumn("longest_other", F.coalesce("longest_other", F.lit(0))).where(f"n >= {names.MIN_RUN} and n > longest_other").select("column", "v", "n", "last", "longest_other")


def steps(series: DataFrame, logged: list[str]) -> DataFrame:
    """(column, k, t, step, before, after): changes with the medians of ten values on either side."""
    y = F.when(F.col("column").isin(logged), F.ln("v")).otherwise(F.col("v")) if logged else F.col("v")
    w = Window.partitionBy("column", "k").orderBy("t", "v")
    before = F.percentile("y", F.lit(0.5)).over(w.rowsBetween(-names.CONTEXT, -1))
    after = F.percentile("y", F.lit(0.5)).over(w.rowsBetween(0, names.CONTEXT - 1))
    return series.withColumn("y", y).select("column", "k", "t", (F.col("y") - F.lag("y").over(w)).alias("step"), before.alias("before"), after.alias("after"))


def level_shifts(series: DataFrame, logged: list[str]) -> DataFrame:
    """(column, k, t, step, before, after, excess): at most ten steps a column far outside of its others.

    Scales are pooled over the series of a column; they are exact quantiles that no single task computes.
    """
    s = steps(series, logged)
    known = s.where("step is not null")
    middle = exact_quantiles(known.select("column", F.col("step").alias("v")), (0.5,)).select("column", F.col("quantiles")[0].alias("m"))
    off = known.join(F.broadcast(middle), "column").withColumn("excess", F.abs(F.col("step") - F.col("m")))
    scale = exact_quantiles(off.select("column", F.col("excess").alias("v")), (0.5, names.STEP_TAIL_QUANTILE))
    scale = scale.select("column", (names.MAD_TO_SIGMA * F.col("quantiles")[0]).alias("mad"), F.col("quantiles")[1].alias("tail"))
    far = off.join(F.broadcast(scale), "column").where((F.col("mad") > 0) & (F.col("excess") > names.STEP_MAD_MULTIPLE * F.col("mad")) & (F.col("excess") > names.STEP_TAIL_MULTIPLE * F.col("tail")))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("excess"), "t", "k"))
    return far.withColumn("_r", rank).where(F.col("_r") <= names.MAX_SHIFTS).select("column", "k", "t", "step", "before", "after", "excess")


def decades(series: DataFrame) -> DataFrame:
    """(column, decade, n, distinct, largest) of finite values other than zero."""
    d = F.floor(F.log10(F.abs("v"))).cast("long")
    return series.where("v <> 0").groupBy("column", d.alias("decade")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct"), F.max(F.abs("v")).alias("largest"))


def residue(table: DataFrame) -> DataFrame:
    """The first jump of RESIDUE_DECADES and more between occupied decades of a column, from decades()."""
    w = Window.partitionBy("column").orderBy("decade")
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    jumps = table.select("column", "decade", F.lead("decade").over(w).alias("next"), F.sum("n").over(total).alias("cluster_rows"), F.sum("distinct").over(total).alias("cluster_distinct"), F.max("largest").over(total).alias("cluster_max"))
    wide = jumps.where(F.col("next") - F.col("decade") >= names.RESIDUE_DECADES)
    first = wide.groupBy("column").agg(F.min("decade").alias("decade"))
    return wide.join(first, ["column", "decade"]).select("column", "decade", (F.col("next") - F.col("decade")).alias("gap_decades"), "cluster_rows", "cluster_distinct", "cluster_max")
