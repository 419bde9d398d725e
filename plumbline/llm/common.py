"""What the operators share: shared-folder tables, Arrow helpers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast filter over hashed keys; the filter only spares a shuffle, so it may fill up.
FILTER_BUCKETS = 1 << 19


#: Rows of an Arrow batch; long texts make Spark's default a matter of hundreds of megabytes.
ARROW_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Workers get at most ARROW_ROWS rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is made only where none is set and all runs in one process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder in place of long lineages; they survive lost executors."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        Scratch.made.append(self)
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "lz4_raw").parquet(path)  # a codec without native memory
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def release(cls, since: int) -> None:
        """Deletes all tables of those made since there were so many of them; nothing may read them again."""
        for scratch in cls.made[since:]:
            scratch._delete(scratch.root)
        del cls.made[since:]


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def lists(values, offsets, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def sampled(docs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """docs joined with at most so many rows of chosen (doc_id, ...), those of smallest hash of doc_id.

    Only ids are put in order; the chosen ones, at most `rows`, are broadcast, so texts aren't shuffled.
    """
    ids = chosen.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", *chosen.columns).limit(rows).drop("_h")
    return docs.join(F.broadcast(ids), "doc_id")


def only_likely(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of df whose keys may be among wanted's: a filter of at most FILTER_BUCKETS numbers.

    It keeps every row with a wanted key and some others, so an exact join must follow.
    """

    def bucket() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BUCKETS)).cast("int").alias("_bucket")

    numbers = wanted.select(bucket()).distinct()
    return df.withColumn("_bucket", bucket()).join(F.broadcast(numbers), "_bucket", "left_semi").drop("_bucket")


#: So many edges may lie in one task.
FEW_EDGES = 1 << 20
#: Keys that hold more than one of so many parts of all rows are hot; there are fewer of them.
HOT_PARTS = 4096


def hot_limit(counts: DataFrame) -> int:
    """From counts (.., rows) of keys: a key with more rows than this is hot."""
    return (counts.agg(F.sum("rows")).first()[0] or 0) // HOT_PARTS


def spread_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """big joined with small, which has one row for a key; rows of hot keys stay where they are.

    hot holds the hot keys, fewer than HOT_PARTS. They and their rows of small are broadcast, so no task gets
    all rows of a hot key; the others are joined by a shuffle.
    """
    few = hot.select(key)
    stay = big.join(F.broadcast(small.join(F.broadcast(few), key, "left_semi")), key)
    return stay.unionByName(big.join(F.broadcast(few), key, "left_anti").join(small, key))


def _edge_sum(edges: DataFrame) -> tuple:
    """The number of edges and a sum that tells sets of them apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    edges has the long columns a and b. Alternates large-star and small-star rounds, each of which links
    every vertex to a smaller one, until the edges form stars around the smallest ids. A round is two
    shuffles of the edges and its result is written to the shared folder; the edges of a hot vertex stay
    where they are.
    """
    both = edges.select("a", "b").where("a <> b")
    now = scratch.save(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = _edge_sum(now)
    for _ in range(limit):
        # a vertex with more edges than this is hot; there are fewer than HOT_PARTS of them, and none in a small table
        most = 2 * rows[0] // HOT_PARTS

        def met(big: DataFrame, least: DataFrame, key: str) -> DataFrame:
            if rows[0] <= FEW_EDGES:
                return big.join(least.drop("rows"), key)
            return spread_join(big, least.drop("rows"), key, least.where(F.col("rows") > most))

        # large star: every larger neighbour of a vertex is linked to its smallest neighbour
        ways = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = ways.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("rows")).select("v", F.least("m", "v").alias("m"), "rows")
        large = met(ways, least, "v").where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the vertex, is linked to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        small = met(large, least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.save(small)
        after = _edge_sum(new)
        scratch.drop(now)
        now, same = new, after == rows
        rows = after
        if same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {limit} rounds")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())
