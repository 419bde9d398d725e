"""Evidence in raw text before a reader gives it types.

A delimited file is scanned as lines of bytes, all of it unless a cap is given: one pass checks that lines are
UTF-8 and counts rows and fields, one aggregate over (field, value) counts how numbers, dates and placeholders
are written. A line is a row here: quoted line feeds aren't joined.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names

UTF8, LATIN1 = "utf-8", "latin-1 (fallback)"


@dataclass
class RawEvidence:
    delimiter: str
    confidence: float
    header: list[str]
    encoding: str = UTF8
    not_utf8: int = 0
    rows: int = 0
    ragged: int = 0
    ragged_sizes: dict[int, int] = field(default_factory=dict)
    unquoted_ragged: int = 0
    quoted_sample: bool = False
    truncated: bool = False
    bytes_scanned: int | None = None
    fields: dict[str, dict] = field(default_factory=dict)
    tokens: dict[str, dict[str, int]] = field(default_factory=dict)

    def to_dict(self) -> dict:
        shown = {name: {"decimal": decimal_verdict(t), "dates": date_verdict(t)} | {k: v for k, v in t.items() if k != "field"} for name, t in self.fields.items()}
        return {k: v for k, v in self.__dict__.items() if k not in ("fields", "header")} | {"columns": self.header, "fields": shown}


def decode(raw: bytes) -> tuple[str, str]:
    """UTF-8 without its byte-order mark, else Latin-1, and which it was."""
    if raw.startswith(b"\xef\xbb\xbf"):
        raw = raw[3:]
    try:
        return raw.decode("utf-8"), UTF8
    except UnicodeDecodeError:
        return raw.decode("latin-1"), LATIN1


def is_sentinel(v: Column) -> Column:
    return F.lower(v).isin(*names.STRING_SENTINELS)


def number_class(v: Column) -> Column:
    """eu, us, ambiguous, integer or null; the first that matches."""
    return F.when(v.rlike(names.EU_NUMBER), "eu").when(v.rlike(names.US_NUMBER), "us").when(v.rlike(names.AMBIGUOUS_NUMBER), "ambiguous").when(v.rlike(names.PLAIN_INTEGER), "integer")


def tallies(fields: DataFrame) -> DataFrame:
    """One row of counts for each field of (field, value), values as they stand in the file."""
    v = F.trim("value")
    plain = ~is_sentinel(v) & (v != "")
    n = number_class(v)
    first, second, year = (F.regexp_extract(v, names.PARTS_DATE, i) for i in (1, 2, 3))
    parts = v.rlike(names.PARTS_DATE) & plain
    return fields.groupBy("field").agg(
        F.count("*").alias("values"), F.count_if(v == "").alias("blank"), F.count_if((F.col("value") != v) & (v != "")).alias("untrimmed"), F.max(F.length("value")).alias("max_length"),
        F.count_if(is_sentinel(v)).alias("sentinels"), *[F.count_if(plain & (n == c)).alias(f"number_{c}") for c in ("eu", "us", "ambiguous", "integer")],
        F.count_if(plain & v.rlike(names.ISO_DATE)).alias("date_iso"), F.count_if(parts).alias("date_parts"), F.count_if(parts & (first.try_cast("int") > 12)).alias("date_first_high"), F.count_if(parts & (second.try_cast("int") > 12)).alias("date_second_high"), F.count_if(parts & (F.length(year) == 2)).alias("date_short_year"),
    )


def string_sentinels(fields: DataFrame) -> DataFrame:
    """(field, token, n) in the spelling of the file."""
    v = F.trim("value")
    return fields.where(is_sentinel(v)).groupBy("field", v.alias("token")).agg(F.count("*").alias("n"))


def decimal_verdict(t: dict) -> str:
    if t["number_eu"] and t["number_us"]:
        return "conflicting"
    if t["number_eu"]:
        return ","
    if t["number_us"]:
        return "."
    return "ambiguous" if t["number_ambiguous"] else "not applicable"


def date_verdict(t: dict) -> str:
    if not t["date_parts"]:
        return "ISO-8601" if t["date_iso"] else "not applicable"
    if t["date_first_high"] and t["date_second_high"]:
        return "conflicting"
    if t["date_first_high"]:
        return "DD/MM"
    return "MM/DD" if t["date_second_high"] else "ambiguous"


def _quoteless(line: Column) -> Column:
    """A line in which a quoted field is one letter."""
    return F.regexp_replace(line, '"(?:[^"]|"")*"', "q")


def _sizes(line: Column, sep: str) -> Column:
    return F.size(F.split(line, "\\Q" + sep + "\\E", -1))


def fields_of(lines: DataFrame, header: list[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """(field, value) of the rows that have as many fields as the header, and the ragged lines.

    lines has a column value, without the header; quoted fields are parsed by the reader's own rules.
    """
    schema = ", ".join(f"`f{i}` string" for i in range(len(header)))
    kept = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = lines.where(F.trim("value") != "").select("value", _sizes(_quoteless(F.col("value")), sep).alias("n"))
    good = rows.where(F.col("n") == len(header)).select(F.from_csv("value", F.lit(schema), kept).alias("r"))
    pairs = F.array(*[F.struct(F.lit(h).alias("field"), F.coalesce(F.col(f"r.f{i}"), F.lit("")).alias("value")) for i, h in enumerate(header)])
    return good.select(F.explode(pairs).alias("p")).select("p.*"), rows.where(F.col("n") != len(header))


def sniff_delimiter(lines: list[str]) -> tuple[str, float]:
    """The delimiter whose field count most lines agree on, then the one with most fields; and their share."""
    import csv
    from collections import Counter

    best = (0.0, 0, ",")
    kept = [x for x in lines if x.strip()][:200]
    for d in names.DELIMITERS:
        sizes = Counter(len(next(csv.reader([x], delimiter=d), [])) for x in kept)
        if sizes:
            n, hits = sizes.most_common(1)[0]
            if n >= 2 and (hits / len(kept), n) > best[:2]:
                best = (hits / len(kept), n, d)
    return best[2], best[0]


def _prefix(spark: SparkSession, path: str, cap: int) -> tuple[DataFrame, int]:
    """The whole lines among a local file's first bytes."""
    with open(path, "rb") as f:
        raw = f.read(cap).rpartition(b"\n")[0]
    return spark.createDataFrame([(bytearray(x.rstrip(b"\r")),) for x in raw.split(b"\n")], "raw binary"), len(raw)


def scan(spark: SparkSession, path: str, byte_cap: int | None = None, delimiter: str | None = None) -> RawEvidence | None:
    """The evidence of a delimited file, or None if it is empty."""
    import csv

    truncated = byte_cap is not None and os.path.isfile(path) and os.path.getsize(path) > byte_cap
    scanned = None
    if truncated:
        lines, scanned = _prefix(spark, path, byte_cap)
    else:
        # the reader hands bytes on as they are
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))
    first = [decode(bytes(r.raw))[0] for r in lines.limit(200).collect()]
    if not first:
        return None
    sniffed, confidence = sniff_delimiter(first)
    sep = delimiter or sniffed
    header = [h.strip() or f"column_{i}" for i, h in enumerate(next(csv.reader([first[0]], delimiter=sep), []))]
    latin = F.decode("raw", "ISO-8859-1")
    bad = lines.agg(F.count_if(~F.is_valid_utf8(F.col("raw").cast("string")))).first()[0]
    text = lines.select((F.col("raw").cast("string") if not bad else latin).alias("value"))
    body = text.where((F.col("value") != first[0]) & (F.col("value") != "﻿" + first[0]) & (F.trim("value") != ""))
    # a row that repeats the header's text is a row; only one line of each file is the header
    repeats = text.where((F.col("value") == first[0]) | (F.col("value") == "﻿" + first[0])).count() - 1
    out = RawEvidence(sep, confidence if not delimiter else 1.0, header, LATIN1 if bad else UTF8, bad, truncated=truncated, bytes_scanned=scanned)
    sizes = body.groupBy(_sizes(_quoteless(F.col("value")), sep).alias("n"), (_sizes(F.col("value"), sep) == len(header)).alias("plain")).agg(F.count("*").alias("rows"))
    for r in sizes.collect():
        out.rows += r["rows"]
        if r["n"] != len(header):
            out.ragged += r["rows"]
            out.ragged_sizes[r["n"]] = out.ragged_sizes.get(r["n"], 0) + r["rows"]
        if not r["plain"]:
            out.unquoted_ragged += r["rows"]
    out.rows += max(0, repeats) if os.path.isfile(path) else 0
    out.quoted_sample = any('"' in x for x in first)
    fields, _ = fields_of(body, header, sep)
    out.fields = {r["field"]: r.asDict() for r in tallies(fields).collect()}
    out.fields = {h: out.fields[h] for h in dict.fromkeys(header) if h in out.fields}
    for r in string_sentinels(fields).orderBy("field", F.desc("n"), "token").collect():
        out.tokens.setdefault(r["field"], {})[r["token"]] = r["n"]
    return out
