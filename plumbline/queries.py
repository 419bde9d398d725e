"""Registered queries of the audit operators, each with the SQL that it must equal.

The given tables are clean, so checks that need a defect run over views that plant one by a rule which
reads the same in both engines. Money is summed as decimal(18,2), so sums don't depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.columns import assembled_date, significant_digits
from plumbline.operators import profile as P
from plumbline.operators import series as S
from plumbline.operators import structure as ST
from plumbline.operators import tables as T
from plumbline.plans import audit as A
from plumbline.plans.manifest import Manifest
from plumbline.sources import rawscan as R
from plumbline.sources.tables import Source

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2000-01-01"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey"]


@query(_union([f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count({c}) AS non_null, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c})::DOUBLE, 6) AS mean, round(stddev_samp({c}), 6) AS stddev, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, bool_and({c} = floor({c})) AS integral FROM lineitem" for c in _NUM]))
def profile_numeric(spark, d):
    return P.numeric_metrics(read(spark, d, "lineitem"), _NUM).select("column", "nulls", "non_null", "min", "max", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "zeros", "negatives", "integral")


_TEXT = ["c_name", "c_mktsegment"]


@query(_union([f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count({c}) AS non_null, min({c}) AS min, max({c}) AS max, min(length({c})) AS min_length, max(length({c})) AS max_length FROM customer" for c in _TEXT]))
def profile_text(spark, d):
    return P.text_metrics(read(spark, d, "customer"), _TEXT).select("column", "nulls", "non_null", "min", "max", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query("SELECT 'o_orderdate' AS \"column\", count(*) FILTER (o_orderdate IS NULL) AS nulls, count(o_orderdate) AS non_null, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max FROM orders")
def profile_temporal(spark, d):
    return P.text_metrics(read(spark, d, "orders"), ["o_orderdate"], "temporal").select("column", "nulls", "non_null", F.date_format(F.col("min").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("min"), F.date_format(F.col("max").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("max"))


@query(_union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]))
def profile_distinct(spark, d):
    df = read(spark, d, "orders")
    return P.distinct_counts(df, df.columns)


@query(f"SELECT q, round(v, 6) AS v FROM (SELECT unnest({list(names.QUANTILES)}) AS q, unnest(quantile_cont(o_totalprice, {list(names.QUANTILES)})) AS v FROM orders)")
def profile_quantiles(spark, d):
    x = P.quantile_metrics(read(spark, d, "orders"), ["o_totalprice"])
    return x.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in names.QUANTILES]).alias("q"), "quantiles")).alias("z")).select(F.col("z.q").alias("q"), F.round("z.quantiles", 6).alias("v"))


@query(_union([f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY {c} ORDER BY n DESC, value LIMIT 10)" for c in ("p_brand", "p_size", "p_type")]))
def profile_topk(spark, d):
    return P.top_values(read(spark, d, "part"), ["p_brand", "p_size", "p_type"])


@query("SELECT s, count(*) FILTER (v = s) AS n FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -999.0 WHEN o_orderkey % 50 = 1 THEN 9999.0 ELSE o_totalprice END AS v FROM orders), (SELECT unnest([-99999.0, -9999.0, -999.0, -99.0, 9999.0, 99999.0, 999999.0])::DOUBLE AS s) GROUP BY s")
def profile_sentinels(spark, d):
    k = F.col("o_orderkey") % 50
    v = read(spark, d, "orders").select(F.when(k == 0, -999.0).when(k == 1, 9999.0).otherwise(F.col("o_totalprice")).alias("v"))
    x = P.numeric_metrics(v, ["v"])
    return x.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in names.NUMERIC_SENTINELS]).alias("s"), "sentinels")).alias("z")).select("z.s", F.col("z.sentinels").alias("n"))


_DIGITS = "length(ltrim(regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '[eE].*$', ''), '[^0-9]', '', 'g'), '0'))"


@query(f"SELECT o_orderkey, CASE WHEN o_totalprice / 7 = 0 THEN 0 ELSE {_DIGITS.format(x='o_totalprice / 7')} END AS derived, CASE WHEN o_totalprice = 0 THEN 0 ELSE {_DIGITS.format(x='o_totalprice')} END AS plain FROM orders")
def sig_digits(spark, d):
    return read(spark, d, "orders").select("o_orderkey", significant_digits(F.col("o_totalprice") / 7).alias("derived"), significant_digits(F.col("o_totalprice")).alias("plain"))


@query(f"SELECT max(g) AS sig_max, quantile_cont(g, 0.5)::DOUBLE AS sig_median, count(*) FILTER (g >= 15) AS sig_high, count(*) FILTER (g >= 15) >= 0.05 * count(*) AS derived FROM (SELECT {_DIGITS.format(x='l_extendedprice / 7')} AS g FROM lineitem)")
def derived_precision(spark, d):
    v = read(spark, d, "lineitem").select((F.col("l_extendedprice") / 7).alias("v"))
    return P.digit_metrics(v, ["v"]).crossJoin(F.broadcast(v.agg(F.count("v").alias("_n")))).select("sig_max", "sig_median", "sig_high", (F.col("sig_high") >= 0.05 * F.col("_n")).alias("derived"))


@query(_union([f"SELECT '{c}' AS \"column\", count({c}) AS n, round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349, 6) AS robust_sigma, count({c}) >= 30 AND stddev_samp({c}) / ((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349) <= 2.0 AS establishable FROM orders" for c in ("o_totalprice",)]))
def sigma_gate(spark, d):
    df = read(spark, d, "orders")
    x = P.numeric_metrics(df, ["o_totalprice"]).join(P.quantile_metrics(df, ["o_totalprice"]), "column")
    q = list(names.QUANTILES)
    r = (F.col("quantiles")[q.index(0.75)] - F.col("quantiles")[q.index(0.25)]) / names.NORMAL_IQR
    return x.select("column", F.col("non_null").alias("n"), F.round(r, 6).alias("robust_sigma"), ((F.col("non_null") >= 30) & (F.col("stddev") / r <= 2.0)).alias("establishable"))


def _nan(spark, d):
    k, p = F.col("o_orderkey") % 50, F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.when(k == 0, float("nan")).otherwise(p).alias("a"), F.when(k == 0, float("nan")).otherwise(p).alias("b"), F.when(k == 1, float("inf")).otherwise(p).alias("c"))


_NAN = "(SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 50 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS b, CASE WHEN o_orderkey % 50 = 1 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS c FROM orders)"


@query(_union([f"SELECT '{c}' AS \"column\", count(*) FILTER (NOT isfinite({c})) AS nonfinite, count(*) FILTER (isfinite({c})) AS non_null, round(max(CASE WHEN isfinite({c}) THEN {c} END), 4) AS max FROM {_NAN}" for c in "abc"]))
def nonfinite_counts(spark, d):
    return P.numeric_metrics(_nan(spark, d), ["a", "b", "c"]).select("column", "nonfinite", "non_null", F.round("max", 4).alias("max"))


@query(f"SELECT 'a,b' AS block, count(*) FILTER (NOT isfinite(a) AND NOT isfinite(b)) AS n FROM {_NAN}")
def nonfinite_blocks(spark, d):
    df = _nan(spark, d)
    flags = {c: P.nonfinite(F.col(c)) for c in "abc"}
    counts = df.agg(*[F.count_if(flags[c]).alias(c) for c in "abc"]).first().asDict()
    blocks = P.same_rows(df, flags, counts)
    return df.sparkSession.createDataFrame([(",".join(b), counts[b[0]]) for b in blocks], "block string, n long")


@query("SELECT 'a,b' AS block, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0")
def comissing_blocks(spark, d):
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice")
    df = read(spark, d, "orders").select(F.when(k != 0, p).alias("a"), F.when(k != 0, F.col("o_custkey")).alias("b"), F.when(k != 1, p).alias("c"))
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in "abc"]).first().asDict()
    return df.sparkSession.createDataFrame([(",".join(b), counts[b[0]]) for b in P.same_rows(df, {c: F.col(c).isNull() for c in "abc"}, counts)], "block string, n long")


def _raw(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    shown = F.when(k % 10 == 0, F.lit("N/A")).when(k % 10 == 1, F.lit("1.234")).when(k % 10 == 2, F.translate(price, ".", ",")).when(k % 10 == 3, k.cast("string")).when(k % 10 == 4, F.lit("")).otherwise(price)
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "MM/dd/yy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    pairs = F.array(F.struct(F.lit("amount").alias("field"), shown.alias("value")), F.struct(F.lit("day").alias("field"), day.alias("value")))
    return o.select(F.explode(pairs).alias("p")).select("p.*")


_RAW = "(SELECT 'amount' AS field, CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' WHEN o_orderkey % 10 = 1 THEN '1.234' WHEN o_orderkey % 10 = 2 THEN replace(format('{:.2f}', o_totalprice), '.', ',') WHEN o_orderkey % 10 = 3 THEN o_orderkey::VARCHAR WHEN o_orderkey % 10 = 4 THEN '' ELSE format('{:.2f}', o_totalprice) END AS value FROM orders UNION ALL SELECT 'day', CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders)"
_EU, _US = names.EU_NUMBER, names.US_NUMBER
_PLAINV = "lower(value) NOT IN ('na','n/a','#n/a','null','none','nil','-','--','?','nan','unknown','.') AND value <> ''"


@query(f"SELECT field, count(*) FILTER (c = 'eu') AS eu, count(*) FILTER (c = 'us') AS us, count(*) FILTER (c = 'ambiguous') AS ambiguous, count(*) FILTER (c = 'integer') AS \"integer\", count(*) FILTER (value = '') AS blank FROM (SELECT *, CASE WHEN NOT ({_PLAINV}) THEN NULL WHEN regexp_matches(value, '{_EU}') THEN 'eu' WHEN regexp_matches(value, '{_US}') THEN 'us' WHEN regexp_matches(value, '{names.AMBIGUOUS_NUMBER}') THEN 'ambiguous' WHEN regexp_matches(value, '{names.PLAIN_INTEGER}') THEN 'integer' END AS c FROM {_RAW}) GROUP BY field")
def raw_decimal_tally(spark, d):
    t = R.tallies(_raw(spark, d))
    return t.select("field", *[F.col(f"number_{c}").alias(c) for c in ("eu", "us", "ambiguous", "integer")], "blank")


@query(f"SELECT field, count(*) FILTER ({_PLAINV} AND regexp_matches(value, '{names.ISO_DATE}')) AS iso, count(*) FILTER (p) AS parts, count(*) FILTER (p AND TRY_CAST(regexp_extract(value, '{names.PARTS_DATE}', 1) AS INT) > 12) AS first_high, count(*) FILTER (p AND TRY_CAST(regexp_extract(value, '{names.PARTS_DATE}', 2) AS INT) > 12) AS second_high, count(*) FILTER (p AND length(regexp_extract(value, '{names.PARTS_DATE}', 3)) = 2) AS short_year FROM (SELECT *, {_PLAINV} AND regexp_matches(value, '{names.PARTS_DATE}') AS p FROM {_RAW}) GROUP BY field")
def raw_date_tally(spark, d):
    return R.tallies(_raw(spark, d)).select("field", F.col("date_iso").alias("iso"), F.col("date_parts").alias("parts"), F.col("date_first_high").alias("first_high"), F.col("date_second_high").alias("second_high"), F.col("date_short_year").alias("short_year"))


@query("SELECT 'amount' AS field, 'N/A' AS token, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0")
def raw_string_sentinels(spark, d):
    return R.string_sentinels(_raw(spark, d))


_PREFIXES = [["o_orderdate"], ["o_orderdate", "o_orderstatus"], ["o_orderdate", "o_orderstatus", "o_orderpriority"]]


@query(_union([f"SELECT '{'+'.join(k)}' AS key, count(*) AS tuples FROM (SELECT DISTINCT {', '.join(k)} FROM orders)" for k in _PREFIXES]))
def grain_prefix_distinct(spark, d):
    counts = ST.tuple_counts(read(spark, d, "orders"), _PREFIXES)
    return spark.createDataFrame([("+".join(k), n) for k, n in zip(_PREFIXES, counts, strict=True)], "key string, tuples long")


@query("SELECT count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS excess_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def grain_excess_rows(spark, d):
    return ST.excess(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, (make_date(year(o_orderdate)::INT, month(o_orderdate)::INT, 1) + ((ceil(least(day(o_orderdate), 30) / 10.0)::INT - 1) * 10)) AS d FROM orders")
def composite_axis(spark, d):
    t = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", assembled_date(F.year(t), F.month(t), None, F.ceil(F.least(F.day(t), F.lit(30)) / 10).cast("int")).alias("d"))


@query(_union([f"SELECT '{c}' AS \"column\", min(v)::DOUBLE AS value, count(v) AS n FROM (SELECT {x} AS v FROM orders) HAVING count(DISTINCT v) = 1" for c, x in (("zero", "0.0"), ("price", "o_totalprice"))]))
def constant_numeric(spark, d):
    df = read(spark, d, "orders").select(F.lit(0.0).alias("zero"), F.col("o_totalprice").alias("price"))
    m = P.numeric_metrics(df, ["zero", "price"])
    return m.join(P.distinct_counts(df, ["zero", "price"]).where(F.col("distinct") == 1), "column").select("column", F.col("min").alias("value"), F.col("non_null").alias("n"))


@query("SELECT 'c_name' AS \"column\", count(*) AS hits, count(DISTINCT c_name) AS distinct_values FROM customer WHERE c_custkey % 10 = 0")
def mojibake(spark, d):
    pair = "Ã©"
    df = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit(pair))).otherwise(F.col("c_name")).alias("c_name"), F.lit("SÃO PAULO").alias("city"))
    return T.mojibake(df, ["c_name", "city"])


@query('SELECT count(*) AS "rows", count(*) - count(*) FILTER (copy) AS distinct_rows, count(*) FILTER (copy) AS excess_rows FROM (SELECT false AS copy FROM orders UNION ALL SELECT true FROM orders WHERE o_orderkey % 100 = 0)')
def duplicate_rows(spark, d):
    o = read(spark, d, "orders")
    return T.duplicate_rows(o.unionAll(o.where(F.col("o_orderkey") % 100 == 0)))


@query("SELECT k, count(*) AS n, count(DISTINCT v) AS variants FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 100 = 0) GROUP BY k HAVING count(*) > 1")
def duplicate_grain(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return T.duplicate_keys(o.unionAll(o.where(F.col("k") % 100 == 0).select("k", F.col("v") + 1)), ["k"])


@query(f"SELECT count(*) FILTER (o_orderdate::DATE > DATE '{AS_OF}') AS future_rows, max(o_orderdate) AS latest, date_diff('day', DATE '{AS_OF}', max(o_orderdate)::DATE)::BIGINT AS days_ahead FROM orders")
def future_dates(spark, d):
    return T.future_rows(read(spark, d, "orders"), F.col("o_orderdate"), F.lit(AS_OF).cast("date"))


_DAILY = "(SELECT o_orderdate::DATE AS t, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1)"
_GAPPED = f"(SELECT * FROM {_DAILY} WHERE NOT (t BETWEEN DATE '1997-03-01' AND DATE '1997-03-20'))"
_GAPS = "(SELECT prev, t, date_diff('day', prev, t) AS gap FROM (SELECT lag(t) OVER (ORDER BY t) AS prev, t FROM {s}) WHERE prev IS NOT NULL)"


def _daily(spark, d, *keys):
    o = read(spark, d, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("t"), *keys).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


@query(f"SELECT gap::BIGINT AS gap, count(*) AS n FROM {_GAPS.format(s=_DAILY)} GROUP BY gap ORDER BY n DESC, gap LIMIT 1")
def modal_gap(spark, d):
    return S.modal_gap(S.gaps(_daily(spark, d), F.col("t"), []))


@query(f"WITH g AS (SELECT * FROM {_GAPS.format(s=_GAPPED)}), m AS (SELECT gap AS cadence FROM g GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1) SELECT prev, t, gap::BIGINT AS gap, cadence::BIGINT AS cadence, greatest(0, round_even(gap / cadence, 0) - 1)::BIGINT AS missing FROM g, m WHERE gap > cadence AND NOT (cadence = 1 AND gap = 3 AND dayofweek(prev) = 5) AND round_even(gap / cadence, 0) - 1 >= 1")
def cadence_gap(spark, d):
    df = _daily(spark, d).where(~F.col("t").between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-20").cast("date")))
    return S.cadence_gaps(df, F.col("t"), []).where("why = 'hole'").drop("k", "why")


@query('SELECT count(*) AS "rows", count(*) FILTER (t < p) AS inversions, count(*) FILTER (t < q) AS in_series FROM (SELECT o_orderdate AS t, lag(o_orderdate) OVER (ORDER BY file_row_number) AS p, lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY file_row_number) AS q FROM (SELECT *, o_orderkey AS file_row_number FROM orders))')
def file_order(spark, d):
    o = read(spark, d, "orders")
    return S.inversions(o, [F.lit(0), F.col("o_orderkey")], F.col("o_orderdate"), ["o_orderstatus"]).select("rows", "inversions", "in_series")


@query(f"WITH g AS (SELECT * FROM {_GAPS.format(s=_DAILY)}) SELECT date_diff('day', (SELECT max(o_orderdate)::DATE FROM orders), DATE '2003-01-01')::BIGINT AS behind, max(gap)::BIGINT AS worst_gap FROM g")
def stale_tail(spark, d):
    df = _daily(spark, d)
    worst = S.gaps(df, F.col("t"), []).agg(F.max("gap").alias("worst_gap"))
    return df.agg(F.datediff(F.lit("2003-01-01").cast("date"), F.max("t")).cast("long").alias("behind")).crossJoin(F.broadcast(worst))


@query(f"WITH s AS (SELECT t, CASE WHEN t >= DATE '2001-06-01' THEN 42.0 ELSE v END AS v FROM {_DAILY}), i AS (SELECT t, v, row_number() OVER (ORDER BY t) - row_number() OVER (PARTITION BY v ORDER BY t) AS g FROM s), r AS (SELECT v, count(*) AS n, max(t) AS last FROM i GROUP BY v, g) SELECT 'v' AS \"column\", v, n, last, (SELECT max(n) FROM r WHERE last < (SELECT max(last) FROM r)) AS longest_other FROM r WHERE last = (SELECT max(last) FROM r) AND n >= 3")
def flatline_tail(spark, d):
    df = _daily(spark, d).withColumn("v", F.when(F.col("t") >= F.lit("2001-06-01").cast("date"), 42.0).otherwise(F.col("v")))
    return S.flat_tails(S.long(df, F.col("t"), [], ["v"]))


@query("SELECT 'v' AS \"column\", count(v) AS non_null, min(v) AS low, max(v) AS high, count(*) FILTER (v = lo) AS at_low, count(*) FILTER (v = hi) AS at_high FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 100.0 ELSE o_totalprice / 10000 END AS v FROM orders))")
def saturation_at_bound(spark, d):
    v = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, 100.0).otherwise(F.col("o_totalprice") / 10000).alias("v"))
    return T.bounds_hit(v, ["v"])


@query("WITH d AS (SELECT floor(log10(abs(v)))::BIGINT AS decade, count(*) AS n, count(DISTINCT v) AS dv, max(abs(v)) AS m FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -7e-22 ELSE o_totalprice END AS v FROM orders) WHERE v <> 0 GROUP BY 1), j AS (SELECT decade, lead(decade) OVER (ORDER BY decade) - decade AS gap_decades, sum(n) OVER (ORDER BY decade) AS cluster_rows, sum(dv) OVER (ORDER BY decade) AS cluster_distinct, max(m) OVER (ORDER BY decade) AS cluster_max FROM d) SELECT 'v' AS \"column\", decade, gap_decades, cluster_rows::BIGINT AS cluster_rows, cluster_distinct::BIGINT AS cluster_distinct, cluster_max FROM j WHERE gap_decades >= 6 ORDER BY decade LIMIT 1")
def negligible_residue(spark, d):
    v = read(spark, d, "orders").select(F.lit(0).alias("k"), F.col("o_orderdate").alias("t"), F.when(F.col("o_orderkey") % 5 == 0, -7e-22).otherwise(F.col("o_totalprice")).alias("v"), F.lit("v").alias("column"))
    return S.residue(S.decades(v))


_SHIFT = "(SELECT t, 1e6 * (1 + (dayofyear(t) % 7) / 1000.0) * CASE WHEN t >= DATE '1998-06-01' THEN 1000 ELSE 1 END AS v FROM (SELECT DISTINCT o_orderdate::DATE AS t FROM orders))"


def _shift(spark, d):
    t = F.col("t")
    days = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("t")).distinct()
    return days.select("t", (1e6 * (1 + (F.dayofyear(t) % 7) / 1000.0) * F.when(t >= F.lit("1998-06-01").cast("date"), 1000).otherwise(1)).alias("v"))


_SHIFTS = f"WITH s AS (SELECT t, y - lag(y) OVER w AS step, median(y) OVER (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before, median(y) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS after FROM (SELECT t, ln(v) AS y FROM {_SHIFT}) WINDOW w AS (ORDER BY t)), m AS (SELECT median(step) AS m FROM s), c AS (SELECT 1.4826 * median(abs(step - m)) AS mad, quantile_cont(abs(step - m), 0.95) AS tail FROM s, m WHERE step IS NOT NULL) SELECT t, step, before, after, abs(step - m) AS excess FROM s, m, c WHERE mad > 0 AND abs(step - m) > 20 * mad AND abs(step - m) > 4 * tail ORDER BY excess DESC, t LIMIT 10"


@query(f"SELECT t, round(step, 6) AS step, round(before, 6) AS before, round(after, 6) AS after FROM ({_SHIFTS})")
def level_shift_candidates(spark, d):
    return S.level_shifts(S.long(_shift(spark, d), F.col("t"), [], ["v"]), ["v"]).select("t", *[F.round(c, 6).alias(c) for c in ("step", "before", "after")])


@query(f"SELECT CAST(t AS VARCHAR) AS t, 'defect' AS disposition, 'high' AS confidence FROM ({_SHIFTS}) WHERE abs(after - before) >= 0.5 * abs(step) AND abs(exp(abs(step)) - 1000) <= 10")
def level_shift_graded(spark, d):
    rows = [r.asDict() for r in S.level_shifts(S.long(_shift(spark, d), F.col("t"), [], ["v"]), ["v"]).collect()]
    return spark.createDataFrame([(f.evidence["t"], f.disposition, f.confidence) for f in A.grade_shifts(rows, {"v"}, ["v"])], "t string, disposition string, confidence string")


def _panel(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"), F.min("o_totalprice").alias("floor_price"))


_PANEL = "(SELECT o_orderdate::DATE AS day, o_orderstatus AS status, o_orderpriority AS priority, sum(o_totalprice::DECIMAL(18,2)) AS revenue, min(o_totalprice) AS floor_price FROM orders GROUP BY ALL)"


def _rolled(spark, d, dropped):
    df = _panel(spark, d)
    measures = T.classify_measures({"revenue": "numeric", "floor_price": "numeric"}, set())
    level = next(x for x in T.levels(["status", "priority"], measures) if x.dropped == dropped)
    return T.roll_up(df, level, ["day"]).select("day", *level.keys, F.col("revenue").cast("double").alias("revenue"), F.round("floor_price", 6).alias("floor_price"))


@query(f"SELECT day, priority, sum(revenue)::DOUBLE AS revenue, round(avg(floor_price), 6) AS floor_price FROM {_PANEL} GROUP BY day, priority")
def rollup_drop_status(spark, d):
    return _rolled(spark, d, "status")


@query(f"SELECT day, status, sum(revenue)::DOUBLE AS revenue, round(avg(floor_price), 6) AS floor_price FROM {_PANEL} GROUP BY day, status")
def rollup_drop_priority(spark, d):
    return _rolled(spark, d, "priority")


@query("SELECT least(39, floor((o_totalprice - lo) / (hi - lo) * 40))::BIGINT AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def chart_value_bins(spark, d):
    return T.value_bins(read(spark, d, "orders"), "o_totalprice")


@query("SELECT floor(log10(abs(value)))::BIGINT AS decade, count(*) AS n FROM events WHERE value <> 0 AND isfinite(value) GROUP BY 1")
def chart_decades(spark, d):
    return S.decades(S.long(read(spark, d, "events"), F.col("ts"), [], ["value"])).select("decade", "n")


@query(f"WITH r AS (SELECT t, v, row_number() OVER (ORDER BY t) AS rn FROM {_DAILY}), h AS (SELECT min(rn) AS hit FROM r WHERE t >= DATE '1998-06-01') SELECT t, v, rn FROM r, h WHERE rn BETWEEN hit - 24 AND hit + 24")
def chart_series_around(spark, d):
    return T.series_around(S.long(_daily(spark, d), F.col("t"), [], ["v"]), F.lit("1998-06-01").cast("date"))


@query(f"SELECT t, v FROM {_DAILY} ORDER BY t DESC LIMIT 60")
def chart_series_tail(spark, d):
    return T.series_tail(S.long(_daily(spark, d), F.col("t"), [], ["v"]))


@query(f"WITH s AS (SELECT DISTINCT t FROM {_GAPPED}), p AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM s), a AS (SELECT t AS d, true AS present FROM s UNION ALL SELECT unnest(generate_series(p + 1, t - 1, INTERVAL 1 DAY))::DATE, false FROM p WHERE date_diff('day', p, t) > 1) SELECT d, present FROM a ORDER BY d DESC LIMIT 420")
def chart_coverage_cells(spark, d):
    df = _daily(spark, d).where(~F.col("t").between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-20").cast("date")))
    return T.coverage_cells(df, F.col("t"), 1)


@query("SELECT o_orderstatus FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) ORDER BY 1 LIMIT 1")
def chart_locate_series(spark, d):
    o = read(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("m"))
    return T.locate_series(o.crossJoin(F.broadcast(last)), F.col("o_orderdate"), ["o_orderstatus"], F.col("m"))


def _audited(df, as_of, **more):
    return A.audit(Source(df, "", "parquet", "strict", ""), as_of=date.fromisoformat(as_of), **more)


_COVERAGE = {
    "constant_numeric": ("n >= 2", "no numeric column, or fewer than 2 rows"), "schema_drift": ("false", "no manifest lists the columns"), "mojibake": ("true", ""), "duplicate_rows": ("n >= 2", "fewer than 2 rows"),
    "duplicate_grain": ("keys = n", "which columns identify a row?"), "future_dates": ("true", ""), "cadence_gap": ("n >= 12", "fewer than 12 rows"), "file_order": ("false", "rows have no stored order here"),
    "stale_tail": ("n >= 12", "fewer than 12 rows"), "flatline_tail": ("n >= 12", "fewer than 12 rows"), "saturation_at_bound": ("n >= 30 AND prices >= 20", "no numeric column with enough values"),
    "negligible_residue": ("n >= 20 AND prices >= 2", "no numeric column with enough values"), "level_shift": ("n >= 20 AND prices >= 3", "no numeric column with enough values"),
}


@query("WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(DISTINCT o_totalprice) AS prices FROM orders) " + _union([f"SELECT '{c}' AS check_id, CASE WHEN {ok} THEN 'ran' ELSE '{'blocked' if c == 'duplicate_grain' else 'withheld'}' END AS status, CASE WHEN {ok} THEN '' ELSE '{why}' END AS reason FROM o" for c, (ok, why) in _COVERAGE.items()]))
def coverage_table(spark, d):
    return _audited(read(spark, d, "orders"), "2003-01-01").coverage_df(spark)


_KNOWN = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_clerk", "o_orderdate"]


@query(f"WITH now AS (SELECT column_name AS c FROM (DESCRIBE orders)), known AS (SELECT unnest({_KNOWN}) AS c), s AS (SELECT 'added' AS change, c FROM now WHERE c NOT IN (FROM known) UNION ALL SELECT 'removed', c FROM known WHERE c NOT IN (FROM now)) SELECT change, c AS \"column\", CASE WHEN (SELECT count(*) FROM s WHERE change = 'removed') > 0 THEN 'defect' ELSE 'suspect' END AS disposition FROM s")
def schema_drift(spark, d):
    df = read(spark, d, "orders")
    manifest = Manifest(schema={"columns": _KNOWN})
    context = A.Context(df, [P.ColumnProfile(c, "", "", 0) for c in df.columns], ST.Structure(), manifest, date.fromisoformat(AS_OF))
    return spark.createDataFrame([(change, c, f.disposition) for f in A.schema_drift(context) for change in ("added", "removed") for c in f.evidence[change]], "change string, column string, disposition string")


_PILED = f"(SELECT t, CASE WHEN day(t) % 3 = 0 THEN 1e9 WHEN day(t) % 5 = 0 THEN -7e-22 ELSE v END AS v FROM {_DAILY})"


@query(
    f"WITH s AS (SELECT * FROM {_PILED}), m AS (SELECT max(v) AS hi, count(*) AS n FROM s), sat AS (SELECT count(*) AS hits FROM s, m WHERE v = hi HAVING count(*) >= 2 AND count(*) >= 0.05 * (SELECT n FROM m)), "
    "d AS (SELECT DISTINCT floor(log10(abs(v))) AS decade FROM s WHERE v <> 0), res AS (SELECT count(*) AS jumps FROM (SELECT lead(decade) OVER (ORDER BY decade) - decade AS up FROM d) WHERE up >= 6 HAVING count(*) > 0), "
    f"g AS (SELECT * FROM {_GAPS.format(s='s')}), c AS (SELECT gap AS cadence FROM g GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1), "
    "holes AS (SELECT count(*) AS n FROM g, c WHERE NOT (cadence = 1 AND gap = 3 AND dayofweek(prev) = 5) AND round_even(gap / cadence, 0) >= 2 HAVING count(*) > 0) "
    "SELECT 'saturation_at_bound' AS check_id, 'v' AS \"column\", 'suspect' AS disposition, CASE WHEN EXISTS (FROM res) THEN 'high' ELSE 'medium' END AS confidence FROM sat "
    "UNION ALL SELECT 'negligible_residue', 'v', 'defect', 'high' FROM res UNION ALL SELECT 'cadence_gap', 't', 'suspect', 'medium' FROM holes"
)
def corroborated_findings(spark, d):
    t = F.col("t")
    df = _daily(spark, d).withColumn("v", F.when(F.day(t) % 3 == 0, 1e9).when(F.day(t) % 5 == 0, -7e-22).otherwise(F.col("v")))
    last = df.agg(F.max("t")).first()[0]
    return _audited(df, str(last)).findings_df(spark).select("check_id", "column", "disposition", "confidence")


def _holes(level: str, keys: str) -> str:
    day = f"(SELECT DISTINCT day AS t, {keys} FROM {_PANEL})"
    gaps = f"(SELECT prev, date_diff('day', prev, t) AS gap FROM (SELECT lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS prev, t FROM {day}) WHERE prev IS NOT NULL)"
    cadence = f"(SELECT gap FROM {gaps} GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)"
    lost = f"(SELECT round_even(gap / {cadence}, 0)::BIGINT - 1 AS lost FROM {gaps} WHERE NOT ({cadence} = 1 AND gap = 3 AND dayofweek(prev) = 5))"
    return f"SELECT '{level}' AS level, 'cadence_gap' AS check_id, count(*) AS gaps, sum(lost)::BIGINT AS missing FROM {lost} WHERE lost > 0 HAVING count(*) > 0"


_WORST = f"(SELECT max(gap) FROM (SELECT date_diff('day', lag(t) OVER (PARTITION BY status, priority ORDER BY t), t) AS gap FROM (SELECT DISTINCT day AS t, status, priority FROM {_PANEL})))"


@query(_union([_holes("file", "status, priority"), _holes("without status", "priority"), _holes("without priority", "status"), f"SELECT 'file', 'stale_tail', NULL, NULL FROM (SELECT date_diff('day', max(day), DATE '2003-01-01') AS behind FROM {_PANEL}) WHERE behind > 2 * {_WORST}"]))
def rollup_only_new(spark, d):
    """Of the levels' findings only those that the file doesn't have: a stale end is told once."""
    found = _audited(_panel(spark, d), "2003-01-01", rollup=True).findings_df(spark)
    number = lambda k: F.get_json_object("evidence", f"$.{k}").cast("long").alias(k)
    return found.select("level", "check_id", number("gaps"), number("missing"))
