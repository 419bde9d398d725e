"""Checks that need no order, roll-ups, and the data behind the report's charts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.columns import as_date, col, finite


def mojibake(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, hits, distinct_values) of text that looks like UTF-8 read as Latin-1."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("v")) for c in columns])
    hits = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("v").rlike(names.MOJIBAKE))
    return hits.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg(F.sum("n").alias("hits"), F.count("*").alias("distinct_values"))


def mojibake_examples(df: DataFrame, column: str, n: int = 5) -> list[str]:
    """The first few different values, in order."""
    hits = df.where(col(column).rlike(names.MOJIBAKE)).select(col(column).alias("v")).distinct()
    return [r.v for r in hits.orderBy("v").limit(n).collect()]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, excess_rows); nested columns are compared as JSON, as maps don't group."""
    keys = [F.to_json(F.struct(col(f.name))).alias(f"k{i}") if f.dataType.typeName() in ("map", "variant") else col(f.name).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    n = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n"))
    return n.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("distinct_rows")).withColumn("excess_rows", F.col("rows") - F.col("distinct_rows"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n, variants) of keys that occur more than once; variants counts different other values."""
    others = [c for c in df.columns if c not in key]
    variants = F.count_distinct(F.struct(*[col(c) for c in others])) if others else F.lit(1).cast("long")
    return df.groupBy(*[col(c) for c in key]).agg(F.count("*").alias("n"), variants.alias("variants")).where("n > 1")


def future_rows(df: DataFrame, time: Column, as_of: Column) -> DataFrame:
    """(future_rows, latest, days_ahead) after a day."""
    ahead = as_date(time) > as_of
    return df.agg(F.count_if(ahead).alias("future_rows"), F.max(time).alias("latest"), F.datediff(as_date(F.max(time)), as_of).cast("long").alias("days_ahead"))


def bounds_hit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, non_null, low, high, at_low, at_high): how many values sit on a column's own bounds."""
    ends = df.agg(*[F.struct(F.min(finite(df, c)).alias("lo"), F.max(finite(df, c)).alias("hi")).alias(f"c{i}") for i, c in enumerate(columns)])
    joined = df.crossJoin(F.broadcast(ends))
    parts = [F.struct(F.lit(c).alias("column"), F.count(finite(df, c)).alias("non_null"), F.first(f"c{i}.lo").cast("double").alias("low"), F.first(f"c{i}.hi").cast("double").alias("high"), F.count_if(finite(df, c) == F.col(f"c{i}.lo")).alias("at_low"), F.count_if(finite(df, c) == F.col(f"c{i}.hi")).alias("at_high")) for i, c in enumerate(columns)]
    return joined.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


@dataclass
class Level:
    dropped: str
    keys: list[str]
    measures: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"without {self.dropped}"


def classify_measures(columns: dict[str, str], excluded: set[str], declared: dict | None = None) -> dict[str, str]:
    """sum or mean for each numeric column that isn't excluded.

    What is declared goes before names of amounts: additive columns first, then aggregate, where none leaves a
    column out and unknown words say nothing, then non_additive.
    """
    declared = declared or {}
    stated = dict.fromkeys(declared.get("non_additive") or (), "mean")
    stated |= {c: how for c, how in (declared.get("aggregate") or {}).items() if how in ("sum", "mean", "none")}
    stated |= dict.fromkeys(declared.get("additive") or (), "sum")
    numeric = [c for c, k in columns.items() if k == "numeric" and c not in excluded]
    found = {c: stated.get(c) or ("sum" if names.AMOUNT_NAME.search(c) else "mean") for c in numeric}
    return {c: how for c, how in found.items() if how != "none"}


def levels(group_columns: list[str], measures: dict[str, str]) -> list[Level]:
    """One level for each key column left out."""
    return [Level(d, [c for c in group_columns if c != d], measures) for d in group_columns]


def roll_up(df: DataFrame, level: Level, time: list[str]) -> DataFrame:
    """The table at a coarser grain; amounts add, everything else is averaged."""
    how = [(F.sum if a == "sum" else F.avg)(finite(df, c)).alias(c) for c, a in level.measures.items()]
    return df.groupBy(*[col(c) for c in (*time, *level.keys)]).agg(*how)


def locate_series(df: DataFrame, time: Column, keys: list[str], at: Column) -> DataFrame:
    """The key of a series with a row at this time; the smallest."""
    return df.where(time == at).select(*[col(c) for c in keys]).orderBy(*[col(c) for c in keys]).limit(1)


def series_around(series: DataFrame, at: Column, span: int = 24) -> DataFrame:
    """(t, v, rn): a series' rows around a time, by row number."""
    rows = series.withColumn("rn", F.row_number().over(Window.partitionBy("column", "k").orderBy("t", "v")))
    hit = rows.where(F.col("t") >= at).agg(F.min("rn").alias("hit"))
    return rows.crossJoin(F.broadcast(hit)).where((F.col("rn") >= F.col("hit") - span) & (F.col("rn") <= F.col("hit") + span)).select("t", "v", F.col("rn").cast("long").alias("rn"))


def series_tail(series: DataFrame, n: int = 60) -> DataFrame:
    return series.select("t", "v").orderBy(F.desc("t"), F.desc("v")).limit(n)


def value_bins(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, n): equal-width bins over the finite values."""
    x = finite(df, column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def coverage_cells(df: DataFrame, time: Column, cadence: int, limit: int = 420, focus: Column | None = None) -> DataFrame:
    """(d, present): days that are there and whole periods that are missing between them.

    At most `limit` cells: the last ones, or as many on either side of the day `focus`. A day that only slips
    by less than a period leaves no hole.
    """
    days = df.select(as_date(time).alias("d")).where("d is not null").distinct()
    # un-keyed, but with one row for a day of the calendar
    holes = days.withColumn("p", F.lag("d").over(Window.orderBy("d"))).withColumn("m", F.bround(F.datediff("d", "p") / cadence).cast("int") - 1).where("m > 0")
    missing = holes.select("p", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i")).select(F.date_add("p", F.col("i") * cadence).alias("d"))
    cells = days.select("d", F.lit(True).alias("present")).unionAll(missing.select("d", F.lit(False).alias("present")))
    if focus is None:
        return cells.orderBy(F.desc("d")).limit(limit)
    back = cells.where(F.col("d") < focus).orderBy(F.desc("d")).limit(limit // 2)
    return back.unionAll(cells.where(F.col("d") >= focus).orderBy("d").limit(limit - limit // 2))
