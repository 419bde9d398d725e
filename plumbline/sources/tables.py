"""Reading tables, with provenance.

The reader is chosen by suffix. A delimited file's text is scanned first, and what the scan finds says how it
must be read: strict, as its first lines suggest; quoted, where quotes appear only later and lines would fall
apart without them; lenient, where lines have other numbers of fields than the header and are left out.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import rawscan

PARQUET, DELIMITED = ("parquet", "pq"), ("csv", "tsv", "txt")


class UnsupportedFormat(ValueError):
    pass


@dataclass
class Source:
    df: DataFrame
    path: str
    reader: str
    read_mode: str
    sha256: str
    rejected: int = 0
    order: list | None = None
    read_at: str = ""
    delimiter: str | None = None
    raw: rawscan.RawEvidence | None = None

    def provenance(self) -> dict:
        return {"path": self.path, "reader": self.reader, "read_mode": self.read_mode, "sha256": self.sha256, "rejected_rows": self.rejected, "read_at": self.read_at}


def reader_for(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in PARQUET:
        return "parquet"
    if suffix in DELIMITED:
        return "csv"
    raise UnsupportedFormat(f"no reader for .{suffix}; known are {', '.join((*PARQUET, *DELIMITED))}")


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, streamed; of the sorted (name, hash) list for many files, hashed in parallel."""
    if os.path.isfile(path):
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                h.update(part)
        return h.hexdigest()
    parts = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name")
    h = hashlib.sha256()
    for r in parts.toLocalIterator():
        h.update(f"{r.name}:{r.h}\n".encode())
    return h.hexdigest()


def read_mode(raw: rawscan.RawEvidence) -> str:
    if raw.ragged:
        return "lenient"
    return "quoted" if raw.unquoted_ragged and not raw.quoted_sample else "strict"


def load(spark: SparkSession, path: str, byte_cap: int | None = None) -> Source:
    """byte_cap: scan only so many first bytes of raw text; the table is read in full."""
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    kind = reader_for(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        meta = F.col("_metadata")
        return Source(df, path, kind, "strict", content_hash(spark, path), order=[meta["file_path"], meta["row_index"]], read_at=now)
    raw = rawscan.scan(spark, path, byte_cap, "\t" if path.lower().endswith(".tsv") else None)
    if raw is None:
        raise UnsupportedFormat(f"{path} is empty")
    mode = read_mode(raw)
    options = {"header": True, "sep": raw.delimiter, "quote": '"', "escape": '"', "nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf", "encoding": "UTF-8" if raw.encoding == rawscan.UTF8 else "ISO-8859-1"}
    if mode == "lenient":
        # all columns are parsed, or lines with too many or too few fields wouldn't be seen
        options |= {"mode": "DROPMALFORMED", "columnPruning": False, "enforceSchema": True}
    schema = spark.read.options(**options).option("inferSchema", True).csv(path).schema
    df = spark.read.options(**options).schema(schema).csv(path)
    files = df.select(F.input_file_name()).distinct().limit(2).count()
    order = [F.input_file_block_start(), F.monotonically_increasing_id()] if files <= 1 else None
    return Source(df, path, kind, mode, content_hash(spark, path), raw.ragged, order, now, raw.delimiter, raw)
