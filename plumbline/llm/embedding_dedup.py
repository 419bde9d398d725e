"""Near-duplicates among embeddings: spherical k-means cells and blocked cosine products (operator 4).

1. equal vectors become one class, represented by the smallest vec_id; a class counts with its size;
2. spherical k-means on at most SAMPLE classes (those of smallest hash) gives about one centre for every
   CELL classes, at most MAX_CELLS; centres closer than MERGE become one, so that vectors that are all
   alike stay together; every class is put into the PROBES nearest centres' cells by a matrix product in the workers;
3. a cell of more than SPLIT classes is split once more in the same way, by centres of its own that come
   from about SAMPLE of its classes, in tasks of about PIECE rows; so cells stay small up to MAX_CELLS
   squared times CELL classes (four billion), and what is more in a cell is dealt with by step 4;
4. a cell is dealt into blocks of about BLOCK rows, and every pair of blocks is one task's group: two
   blocks of bounded size, whatever the size of the cell;
5. a group multiplies its blocks in double precision and returns, for each row, the number of vectors it
   links to, and edges that span the linked rows: at most one row for each row it got, never all pairs.
   A pair that several cells see is counted in the least of them;
6. counts are summed and components of the edges found.

Which pairs are compared depends on the cells, so recall may be below 1 (it is measured in the tests and
is 1.0 on the given tables); what is linked is exact.

Defined cases: a vector that is null, empty or zero, or has null or non-finite components links with nothing and is
its own component; vectors of different lengths never link, those of each length are compared by themselves; equal vec_ids are one vertex; a row with a null
vec_id gets what an equal vector gets, and counts for nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, batch, components, map_arrow

THRESHOLD = 0.95
CELL = 256
MAX_CELLS = 4096
SAMPLE = 16_384
ROUNDS = 8
PROBES = 3
MERGE = 0.9
SPLIT = 16 * CELL
PIECE = 8192
BLOCK = 512


def _unit(b: pa.RecordBatch):
    """vec_id, the digest of a usable vector and its unit vector as bytes."""
    keys, vectors = [], []
    for v in b.column(1).to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, np.float64)
            scale = np.abs(x).max()
            x = x / scale if np.isfinite(scale) and scale > 0 and np.isfinite(x).all() else None
        if x is None:
            keys.append(None)
            vectors.append(None)
        else:
            raw = (np.array(v, np.float64) + 0.0).tobytes()
            keys.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
            vectors.append((x / np.sqrt(x @ x)).tobytes())
    return batch(vec_id=b.column(0).cast(pa.int64()), key=pa.array(keys, pa.string()), unit=pa.array(vectors, pa.binary()))


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows of the (hashed) sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    kept = np.zeros(k, bool)
    for i in range(k):
        kept[i] = not (c[kept] @ c[i] > MERGE).any()
    return c[kept]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The numbers of the PROBES nearest of the centres, or of all if they are fewer."""
    p = min(PROBES, len(c))
    return np.argpartition(-(x @ c.T), p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(p), (len(x), 1))


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _assigner(c):
    def run(b: pa.RecordBatch):
        near = _nearest(_matrix(b.column("unit").to_pylist()), c.value).astype(np.int64) << 32
        yield batch(rep=b.column("rep"), size=b.column("size"), unit=b.column("unit"), cells=pa.array(near.tolist(), pa.list_(pa.int64())))

    return run


def _fit(cell: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("h")["unit"])
        c = centres(x, min(len(x), most, max(1, -(-int(pdf["rows"].iloc[0]) // cell))))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "centres": [c.tobytes()]})

    return run


def _descend(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
    """The cells inside a large cell for some of its rows."""
    if not len(rows):
        return pd.DataFrame({"rep": [], "leaf": []}, dtype=np.int64)
    x = _matrix(rows["unit"])
    # without a sampled row the cell stays one
    near = _nearest(x, np.frombuffer(fitted["centres"].iloc[0], np.float64).reshape(-1, x.shape[1])) if len(fitted) else np.zeros((len(x), 1), np.int64)
    return pd.DataFrame({"rep": np.repeat(rows["rep"].to_numpy(), near.shape[1]), "leaf": (rows["cell"].to_numpy()[:, None] + near + 1).ravel()})


def _split(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """placed with the cells inside large cells in the place of those; a cell's number is its centre's, shifted, plus that of the inner one."""
    inside = placed.select("rep", "unit", F.explode("cells").alias("cell"))
    large = scratch.save(inside.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > SPLIT))
    if large.isEmpty():
        return placed
    # at most MAX_CELLS rows
    rows = inside.join(F.broadcast(large), "cell")
    chosen = rows.withColumn("h", F.xxhash64("rep")).where(F.pmod("h", F.lit(1 << 32)) / (1 << 32) < F.lit(SAMPLE) / F.col("rows"))
    fitted = scratch.save(chosen.select("cell", "rows", "unit", "h").groupBy("cell").applyInPandas(_fit(CELL, MAX_CELLS), "cell long, centres binary"))
    pieces = F.ceil(F.col("rows") / PIECE)
    ways = large.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).join(fitted, "cell").select("cell", "piece", "centres")
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("rep"), pieces))
    leaves = dealt.select("cell", "piece", "rep", "unit").groupBy("cell", "piece").cogroup(ways.groupBy("cell", "piece")).applyInPandas(_descend, "rep long, leaf long")
    whole = inside.join(F.broadcast(large), "cell", "left_anti").select("rep", F.col("cell").alias("leaf"))
    cells = leaves.unionAll(whole).groupBy("rep").agg(F.collect_list("leaf").alias("cells"))
    return scratch.save(placed.drop("cells").join(cells, "rep"))


def _block(threshold: float):
    """The links between two blocks of a cell, or inside one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key
        pdf = pdf.sort_values("rep", kind="stable")
        x = _matrix(pdf["unit"])
        rep, size, part = pdf["rep"].to_numpy(), pdf["size"].to_numpy(), pdf["block"].to_numpy()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        # a pair belongs to the least of the cells that hold both
        width = pdf["cells"].map(len).max()
        cells = np.array([[*c, *[-1] * (width - len(c))] for c in pdf["cells"]])
        mine = np.ones(len(a), bool)
        for n in range(width):
            other = cells[a, n]
            mine &= ~((other >= 0) & (other < cell) & (cells[b] == other[:, None]).any(axis=1))
        a, b = a[mine], b[mine]
        count = np.bincount(a, size[b], len(pdf)) + np.bincount(b, size[a], len(pdf))
        least, before = np.arange(len(pdf)), None
        while before is None or (least != before).any():
            before = least.copy()
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            least = least[least]
        linked = np.flatnonzero(least < np.arange(len(pdf)))
        e = np.stack([linked, least[linked]], axis=1)
        met = np.flatnonzero(count)
        return pd.DataFrame({"a": np.concatenate([rep[met], rep[e[:, 0]]]), "b": np.concatenate([np.full(len(met), -1), rep[e[:, 1]]]), "n": np.concatenate([count[met].astype(np.int64), np.zeros(len(e), np.int64)]), "edge": np.repeat([False, True], [len(met), len(e)])})

    return run


def _links(classes: DataFrame, m: int, threshold: float, scratch: Scratch) -> DataFrame:
    """a, b, n, edge of the m classes, whose vectors have one length."""
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").toPandas()
    x = _matrix(sample["unit"])
    c = classes.sparkSession.sparkContext.broadcast(centres(x, min(len(x), MAX_CELLS, max(1, -(-m // CELL)))))
    placed = scratch.save(map_arrow(classes.select("rep", "size", "unit"), _assigner(c), "rep long, size long, unit binary, cells array<long>"))
    placed = _split(placed, scratch)
    blocks = placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = placed.select("rep", "size", "unit", "cells", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")})
    return scratch.save(pairs.select("cell", "i", "j", "rep", "size", "unit", "cells", "block").groupBy("cell", "i", "j").applyInPandas(_block(threshold), "a long, b long, n long, edge boolean"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    units = scratch.save(map_arrow(vectors.select("vec_id", "embedding"), _unit, "vec_id long, key string, unit binary"))
    usable = units.where("key is not null and vec_id is not null").withColumn("width", F.length("unit"))
    classes = scratch.save(usable.groupBy("width", "key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("size"), F.first("unit").alias("unit")))
    found = spark.createDataFrame([], "a long, b long, n long, edge boolean, width int")
    for width, m in sorted(tuple(r) for r in classes.groupBy("width").count().collect()):
        found = found.unionAll(_links(classes.where(F.col("width") == width), m, threshold, scratch).withColumn("width", F.lit(width)))
    # rows that share a vec_id but not a vector hang together through it
    ids = usable.select("vec_id", "key").distinct().join(classes.select("key", "rep"), "key")
    same = ids.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    stars = components(found.where("edge").select("a", "b").unionAll(same), scratch)
    links = found.where("not edge").groupBy("width", F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    per_key = classes.select("width", "key", "rep", "size").join(links, ["width", "rep"], "left").select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = units.join(per_key, "key", "left").join(stars.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
