"""The column profile, in groups of metrics that are asked for one by one.

Numeric columns are unpivoted to (column, v), so a group is one narrow aggregate whatever the number of
columns, and its generated code stays small:

* counts, extremes and moments: partial aggregates, one row for each column and task is shuffled;
* digits: values are combined first, so each distinct value is written as text once;
* quantiles: sketches bracket each quantile in a first pass, a second one counts what lies below a bracket
  and puts only the values inside in order, so no task holds all values of a column;
* distinct values and top values: pairs (column, value) that combine before they are shuffled. Distinct counts
  are exact whatever the size, as keys and gates rest on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.columns import col, finite, floating, kinds, nonfinite, significant_digits


def text_value(c: Column, kind: str) -> Column:
    return F.to_json(F.struct(c)) if kind in ("nested", "other") else c.cast("string")


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, odd): every value as a double, null where there is none; odd ones, not finite, as null."""
    pairs = []
    for c in columns:
        x = finite(df, c).cast("double")
        odd = col(c).isNotNull() & nonfinite(col(c)) if floating(df, c) else F.lit(False)
        pairs.append(F.struct(F.lit(c).alias("column"), x.alias("v"), odd.alias("odd")))
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def numeric_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, nonfinite, non_null, min, max, mean, stddev, zeros, negatives, integral, sentinels)."""
    v = F.col("v")
    counts = [F.count_if(v.isNull() & ~F.col("odd")).alias("nulls"), F.count_if("odd").alias("nonfinite"), F.count("v").alias("non_null"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives")]
    shape = [F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"), F.bool_and(v == F.floor("v")).alias("integral")]
    marks = [F.count_if(v == s).alias(f"_s{i}") for i, s in enumerate(names.NUMERIC_SENTINELS)]
    out = long_values(df, columns).groupBy("column").agg(*counts, *shape, *marks)
    return out.withColumn("sentinels", F.array(*[f"_s{i}" for i in range(len(marks))])).drop(*[f"_s{i}" for i in range(len(marks))])


def digit_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, sig_max, sig_median, sig_high): significant digits of finite values."""
    n = long_values(df, columns).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    digits = n.select("column", significant_digits(F.col("v")).alias("g"), "n").groupBy("column", "g").agg(F.sum("n").alias("n"))
    # a column has a few dozen lengths at most
    return digits.groupBy("column").agg(F.max("g").alias("sig_max"), F.percentile(F.col("g").cast("double"), F.lit(0.5), F.col("n")).alias("sig_median"), F.coalesce(F.sum(F.when(F.col("g") >= names.DERIVED_DIGITS, F.col("n"))), F.lit(0)).alias("sig_high"))


#: Rank error of the sketches that bracket quantiles is one of so many parts of all rows.
SKETCH = 2000


def exact_quantiles(series: DataFrame, wanted: tuple[float, ...] = names.QUANTILES) -> DataFrame:
    """(column, quantiles) from (column, v): linear between neighbouring ranks, exact."""
    series = series.select("column", "v").where("v is not null")
    slack = 3 / SKETCH
    # beyond the first and last rank there is nothing to look for
    low, high = ([F.lit(min(1.0, max(0.0, q + d))) for q in wanted] for d in (-slack, slack))
    sketch = series.groupBy("column").agg(F.count("*").alias("rows"), F.percentile_approx("v", F.array(*low), SKETCH).alias("low"), F.percentile_approx("v", F.array(*high), SKETCH).alias("high"))
    open_low, open_high = F.array(*[F.lit(q <= slack) for q in wanted]), F.array(*[F.lit(q >= 1 - slack) for q in wanted])
    sketch = sketch.withColumn("low", F.zip_with("low", open_low, lambda x, o: F.when(o, float("-inf")).otherwise(x))).withColumn("high", F.zip_with("high", open_high, lambda x, o: F.when(o, float("inf")).otherwise(x)))
    sketch = F.broadcast(sketch)  # one row for each column
    near = series.join(sketch, "column").withColumn("_at", F.sequence(F.lit(0), F.lit(len(wanted) - 1)))
    inside = F.filter("_at", lambda i: (F.col("v") >= F.get("low", i)) & (F.col("v") <= F.get("high", i)))
    below = series.join(sketch, "column").groupBy("column", "rows").agg(*[F.count_if(F.col("v") < F.get("low", F.lit(i))).alias(f"_b{i}") for i in range(len(wanted))])
    below = below.select("column", "rows", F.array(*[f"_b{i}" for i in range(len(wanted))]).alias("below"))
    counts = near.select("column", "v", F.explode(inside).alias("i")).groupBy("column", "i", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column", "i").orderBy("v"))
    ranked = counts.withColumn("_upto", upto).join(F.broadcast(below), "column")
    place = F.element_at(F.array(*[F.lit(q) for q in wanted]), F.col("i") + 1) * (F.col("rows") - 1)
    upto = F.col("_upto") + F.get("below", F.col("i"))
    # the value of rank r is the first one up to which more than r values lie
    ends = ranked.groupBy("column", "i").agg(F.min(F.when(upto > F.floor(place), F.col("v"))).alias("a"), F.min(F.when(upto > F.ceil(place), F.col("v"))).alias("b"), F.first(place - F.floor(place)).alias("f"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    return ends.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q")).select("column", F.col("q.v").alias("quantiles"))


def quantile_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, quantiles) of finite values, one for each of names.QUANTILES."""
    return exact_quantiles(long_values(df, columns))


def text_metrics(df: DataFrame, columns: list[str], kind: str = "text") -> DataFrame:
    """(column, nulls, non_null, min, max[, min_length, max_length]) as text."""
    c = F.col("value")
    metrics = [F.count_if(c.isNull()).alias("nulls"), F.count(c).alias("non_null"), F.min(c).alias("min"), F.max(c).alias("max")]
    if kind == "text":
        metrics += [F.min(F.length(c)).alias("min_length"), F.max(F.length(c)).alias("max_length")]
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), col(x).cast("string").alias("value")) for x in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column").agg(*metrics)


def values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) for all columns; nulls are left out. A NaN is a value."""
    k = kinds(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text_value(F.when(col(c) == 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(col(c)) if floating(df, c) else col(c), k[c]).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct), exact: pairs are combined before the one shuffle."""
    return values(df, columns).groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("distinct"))


def top_values(df: DataFrame, columns: list[str], limit: int = names.TOP_LIMIT) -> DataFrame:
    """(column, value, n): the most frequent values, smaller first in a tie; for columns of few values."""
    counts = values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


@dataclass
class ColumnProfile:
    name: str
    type: str
    kind: str
    rows: int
    nulls: int = 0
    nonfinite: int = 0
    non_null: int = 0
    distinct: int = 0
    distinct_exact: bool = True
    min: Any = None
    max: Any = None
    mean: float | None = None
    stddev: float | None = None
    quantiles: dict[float, float] = field(default_factory=dict)
    zeros: int = 0
    negatives: int = 0
    integral: bool | None = None
    sig_max: int | None = None
    sig_median: float | None = None
    sig_high: int = 0
    min_length: int | None = None
    max_length: int | None = None
    sentinels: dict[float, int] = field(default_factory=dict)
    top: list[tuple[str, int]] = field(default_factory=list)

    @property
    def robust_sigma(self) -> float | None:
        q = self.quantiles
        return (q[0.75] - q[0.25]) / names.NORMAL_IQR if q.get(0.75) is not None else None

    @property
    def sigma_ratio(self) -> float | None:
        r = self.robust_sigma
        return round(self.stddev / r, 4) if r and self.stddev is not None else None

    def properties(self) -> dict[str, Any]:
        """What the measurements say about the column."""
        out: dict[str, Any] = {}
        if self.nonfinite:
            out["non_finite"] = self.nonfinite
        if not self.non_null:
            return out | {"all_null": True}
        if self.distinct <= 1:
            out["constant"] = True
        if self.distinct == self.non_null == self.rows:
            out["candidate_key"] = True
        if self.nulls > names.HIGH_NULL_SHARE * self.rows:
            out["high_null"] = self.nulls / self.rows
        if self.kind != "numeric":
            return out
        low, high = float(self.min), float(self.max)
        if not self.negatives:
            out["non_negative"] = True
        if self.integral:
            out["integral"] = True
        if 0 <= low and high <= 1:
            out["unit_interval"] = True
        elif 0 <= low and high <= 100:
            out["percent_range"] = bool(names.PERCENT_NAME.search(self.name))
        if self.sig_high >= names.DERIVED_SHARE * self.non_null:
            out["derived_precision"] = self.sig_high / self.non_null
        out["sigma_establishable"] = self.non_null >= names.MIN_SIGMA_ROWS and bool(self.robust_sigma) and (self.sigma_ratio or 0) <= names.HEAVY_TAIL_RATIO
        if self.sentinels:
            out["numeric_sentinel"] = self.sentinels
        return out

    def to_dict(self) -> dict:
        """Text columns' extremes are cell values and stay out."""
        d = {k: v for k, v in self.__dict__.items() if k not in ("min", "max", "quantiles", "sentinels", "top")}
        if self.kind != "text":
            d |= {"min": _plain(self.min), "max": _plain(self.max)}
        d |= {"quantiles": {str(k): v for k, v in self.quantiles.items()}, "sentinels": {str(k): v for k, v in self.sentinels.items()}, "top_values": [{"value": v, "count": n} for v, n in self.top], "top_values_raw": bool(self.top)}
        d |= {"robust_sigma": round(self.robust_sigma, 6) if self.robust_sigma is not None else None, "sigma_ratio": self.sigma_ratio, "properties": {k: (v if not isinstance(v, dict) else {str(a): b for a, b in v.items()}) for k, v in self.properties().items()}}
        return d


def _plain(v: Any) -> Any:
    return v if v is None or isinstance(v, (bool, int, float, str)) else float(v) if type(v).__name__ == "Decimal" else str(v)


def profile_columns(df: DataFrame) -> list[ColumnProfile]:
    """The profile of every column; each group of metrics is one job over all columns that have it."""
    k = kinds(df)
    out = []
    if not df.columns:
        return out
    # extremes keep their own types here, and every column's nulls are counted
    plain = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        x = finite(df, c)
        plain += [F.count(col(c)).alias(f"n{i}")] + ([F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")] if k[c] not in ("nested", "other") else [])
        plain += [F.min(F.length(x)).alias(f"c{i}"), F.max(F.length(x)).alias(f"d{i}")] if k[c] == "text" else []
    row = df.agg(*plain).first().asDict()
    n = row["rows"]
    numeric = [c for c in df.columns if k[c] == "numeric"]
    metrics: dict[str, dict] = {c: {} for c in df.columns}
    if numeric:
        for part in (numeric_metrics, digit_metrics, quantile_metrics):
            for r in part(df, numeric).collect():
                metrics[r["column"]] |= r.asDict()
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df, df.columns).collect()}
    few = [c for c in df.columns if 0 < distinct.get(c, 0) <= names.TOP_MAX_DISTINCT]
    tops: dict[str, list] = {}
    for r in (top_values(df, few).orderBy("column", F.desc("n"), "value").collect() if few else []):
        tops.setdefault(r["column"], []).append((r["value"], r["n"]))
    for i, f in enumerate(df.schema.fields):
        m = metrics[f.name]
        p = ColumnProfile(f.name, f.dataType.simpleString(), k[f.name], n, distinct=distinct.get(f.name, 0), top=tops.get(f.name, []))
        p.nulls, p.non_null = n - row[f"n{i}"], row[f"n{i}"] - (m.get("nonfinite") or 0)
        p.min, p.max, p.min_length, p.max_length = (row.get(f"{x}{i}") for x in "abcd")
        for key in ("nonfinite", "zeros", "negatives", "sig_high"):
            setattr(p, key, m.get(key) or 0)
        for key in ("mean", "stddev", "integral", "sig_max", "sig_median"):
            setattr(p, key, m.get(key))
        p.quantiles = dict(zip(names.QUANTILES, m["quantiles"], strict=True)) if m.get("quantiles") else {}
        ends = {float(x) for x in (p.min, p.max) if x is not None} if f.name in numeric else set()
        p.sentinels = {s: c for s, c in zip(names.NUMERIC_SENTINELS, m.get("sentinels") or (), strict=False) if c and s in ends}
        out.append(p)
    return out


def same_rows(df: DataFrame, flags: dict[str, Column], counts: dict[str, int]) -> list[list[str]]:
    """Blocks of columns whose flags are set on exactly the same rows.

    A column's rows are told by sums of two hashes of a row's values over the rows where its flag is set; one
    pass gives every column's, whatever the number of columns. Equal sums and counts name candidates, and one
    more aggregate compares each with the first of its block.
    """
    by: dict[int, list[str]] = {}
    for c, n in counts.items():
        if n:
            by.setdefault(n, []).append(c)
    likely = [c for cs in by.values() if len(cs) > 1 for c in cs]
    if not likely:
        return []
    # rows are equal for this purpose if all flags of the candidates are
    pattern = F.xxhash64(*[F.coalesce(flags[c], F.lit(False)) for c in likely])
    sums = df.select(pattern.alias("_h"), *[F.coalesce(flags[c], F.lit(False)).alias(f"f{i}") for i, c in enumerate(likely)])
    row = sums.agg(*[F.sum(F.when(F.col(f"f{i}"), F.col("_h").cast("decimal(38,0)"))).alias(f"s{i}") for i in range(len(likely))]).first()
    blocks: dict[tuple, list[str]] = {}
    for c, total in zip(likely, row, strict=True):
        blocks.setdefault((counts[c], total), []).append(c)
    tried = [(b[0], c, n) for (n, _), b in blocks.items() for c in b[1:]]
    if not tried:
        return []
    both = df.agg(*[F.count_if(flags[a] & flags[c]) for a, c, _ in tried]).first()
    out: dict[str, list[str]] = {}
    for (a, c, n), hits in zip(tried, both, strict=True):
        if hits == n:
            out.setdefault(a, [a]).append(c)
    return list(out.values())
