"""Document fingerprints by one-permutation MinHash (operator 3).

Word shingles are hashed once. A hash's top bits choose one of `bins` bins and the smallest hash of each
bin is kept. An empty bin borrows the value of a bin that a universal sequence of probes finds (optimal
densification: the same probes for every document, so equal sets stay equal and borrowed values collide
with the sets' likeness). Of each value the `bits` low-order bits are packed. Two random values agree in
them with chance c = 2 ** -bits, so the share m of agreeing bins gives the likeness (m - c) / (1 - c).

`neighbour_fingerprints` compares each text with the next document's: documents are cut into ranges of
descending doc_id of about RANGE_ROWS rows by quantiles of the ids, the first row of each range is also
sent to the end of the range before it, and a range is walked row by row. Texts are shuffled once.

Defined cases: a null text is the empty text; a text without words has the empty fingerprint, whose
likeness is 1 to another empty one and 0 to others; texts of fewer than `words` words are one shingle;
rows with equal doc_id follow one another in the order of their texts' hashes; a null doc_id comes last;
a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textnum
from plumbline.llm.common import batch

BINS = 512
BITS = 4
WORDS = 5
RANGE_ROWS = 4096
MAX_RANGES = 100_000

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_probes: dict[tuple[int, int], np.ndarray] = {}


def _probe(bins: int, block: int) -> np.ndarray:
    """Bins that each empty bin tries next: 64 of them for each block of attempts."""
    if (bins, block) not in _probes:
        tries = np.arange(64, dtype=np.uint64) + np.uint64(64 * block)
        with np.errstate(over="ignore"):
            x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + tries[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
        _probes[bins, block] = (textnum.mix(x) % np.uint64(bins)).astype(np.int32)
    return _probes[bins, block]


def minhash(shingles: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The densified values of the bins; None for an empty set."""
    if not len(shingles):
        return None
    s = np.sort(shingles)
    place = (s >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[place[first]], full[place[first]] = s[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        tries = _probe(bins, block)[empty]
        hit = full[tries]
        got = hit.any(axis=1)
        out[empty[got]] = out[tries[got, hit[got].argmax(axis=1)]]
        empty, block = empty[~got], block + 1
    return out


def packed(values: np.ndarray | None, bits: int = BITS) -> bytes:
    if values is None:
        return b""
    # hashed again with its bin, a value that many bins share doesn't decide all of them by one draw
    with np.errstate(over="ignore"):
        values = textnum.mix(values + np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (values & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint8)) & 1).astype(np.uint8)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The bias-corrected estimate of the Jaccard likeness of two sets."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (1.0 - differ.mean() - chance) / (1.0 - chance))))


def fingerprints(texts: list[str | None], k: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    out = []
    for lo, hi in textnum.chunks(texts):
        words = textnum.Words(texts[lo:hi])
        runs = words.runs(k)
        for i in range(hi - lo):
            s, e = words.bounds(i)
            if e - s >= k:
                own = runs[s : e - k + 1]
            else:
                own = np.array([textnum.whole(words.hashes[s:e])] if e > s else [], np.uint64)
            out.append(packed(minhash(own, bins), bits))
    return out


def edited(text: str, following: str) -> str:
    """The last half replaced by as many (or all) of the first code points of the following text."""
    m = len(text) // 2
    return text[: len(text) - m] + following[:m]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order; the first guest row that ends a range is only a next document."""
    last: tuple | None = None

    def described(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        changed = [edited(t, n[2]) for t, n in zip(texts, following, strict=True)]
        prints, other = fingerprints(texts), fingerprints(changed)
        # what is next is mostly the row after; only ends of batches are hashed again
        after = prints[1:] + fingerprints([following[-1][2]]) if rows else []
        after = [p if following[i] is rows[i + 1] else None for i, p in enumerate(after[:-1])] + after[-1:]
        for i in [i for i, p in enumerate(after) if p is None]:
            after[i] = fingerprints([following[i][2]])[0]
        return batch(doc_id=pa.array([r[1] for r in rows], pa.int64()), n_chars=pa.array([len(t) for t in texts], pa.int64()), edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], fingerprint=[base64.b64encode(p).decode() for p in prints], edited_fingerprint=[base64.b64encode(p).decode() for p in other], near_edited=[likeness(a, b) for a, b in zip(prints, other, strict=True)], near_next=[likeness(a, b) for a, b in zip(prints, after, strict=True)])

    for b in batches:
        rows: list[tuple] = []
        following: list[tuple] = []
        size = 0
        for row in zip(*(b.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_guest")), strict=True):
            row = (row[0], row[1], row[2] or "", row[3])
            if last is not None and last[0] == row[0] and not last[3]:
                rows.append(last)
                following.append(row)
                size += len(last[2])
                if size > textnum.CHUNK_BYTES:
                    yield described(rows, following)
                    rows, following, size = [], [], 0
            last = row
        if rows:
            yield described(rows, following)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of all rows of docs (doc_id, text), of their edited texts, and likenesses."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    slim = docs.select("doc_id", "text", key.alias("_key"))
    n = slim.count()
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = sorted({int(x) for x in slim.stat.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    # range 0 has the largest ids
    placed = slim.withColumn("_range", _place(cuts).cast("int"))
    heads = placed.groupBy("_range").agg(F.max("_key").alias("head")).orderBy("_range").collect()
    before = {h["head"]: heads[i - 1]["_range"] for i, h in enumerate(heads)}
    sent = F.broadcast(docs.sparkSession.createDataFrame(list(before.items()), "_key long, _to int"))
    both = placed.join(sent, "_key", "left")
    goes = F.when(F.col("_to").isNull(), F.array(F.struct("_range", F.lit(False).alias("_guest")))).otherwise(F.array(F.struct("_range", F.lit(False).alias("_guest")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_guest"))))
    dealt = both.select("doc_id", "text", "_key", F.explode(goes).alias("_at")).select("doc_id", "text", "_key", "_at._range", "_at._guest")
    ordered = dealt.repartition("_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), F.xxhash64("text"))
    return ordered.select("_range", "doc_id", "text", "_guest").mapInArrow(_walk, _OUT)


def _place(cuts: list[int]):
    """How many cuts are not below a key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    widths = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    below = F.aggregate(widths, F.lit(0), lambda at, w: F.when(F.coalesce(F.try_element_at(table, at + w) < F.col("_key"), F.lit(False)), at + w).otherwise(at))
    return F.lit(len(cuts)) - below
