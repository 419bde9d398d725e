"""A training corpus from raw documents: each stage works on what its predecessor kept.

run(spark, sf_dir) applies STAGES to the table documents. Every stage but the last returns the columns of
documents. In each, rows whose doc_id is null go through the same rules as others, null and empty texts pass or
go as the stage's docstring says, further columns are left out, and an empty table gives an empty one.

ORACLE_SQL is None: the stages' models, hashes and tokenizer have no SQL. tests/llm holds their operators
against brute force and the stages against planted copies, spans and odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import language_id, mixing, ngram_join, packing, substring_dedup
from plumbline.llm.common import Scratch, only_likely, table
from plumbline.llm.queries import tokenizer

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be found (no letter at all) go."""
    model = language_id.train(docs)
    if not model.langs:
        # nothing was learned, so und would say nothing about a text
        return language_id.with_letters(docs.select(COLUMNS))
    return language_id.identify(docs.select(COLUMNS), model).where(F.col("lang_pred") != language_id.UNKNOWN).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a Jaccard likeness of 0.8 over five-word shingles the first stays, by doc_id and text.

    Texts count, not ids: a doc_id's rows with other texts stay. Of rows with equal doc_id and text the one stays
    whose other columns sort first.
    """
    docs = docs.select(COLUMNS)
    named = docs.where("doc_id is not null").withColumn("_key", F.coalesce(F.sha2("text", 256), F.lit("")))
    several = named.groupBy("doc_id").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b")).where("_a <> _b").select("doc_id")
    edge = named.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    # the texts of an id that has several get numbers of their own, which no id has
    start = 0 if edge.high is None else edge.high + 1 if edge.high < 1 << 62 else edge.low - (1 << 60)
    texts = named.select("doc_id", "_key").join(several, "doc_id", "left_semi").distinct()
    texts = Scratch(spark).save(texts.withColumn("_row", F.monotonically_increasing_id() + F.lit(start)))
    if texts.isEmpty():
        classes = ngram_join.ngram_components(docs, k=5, num=80, den=100)
        gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
        kept = named.join(gone, "doc_id", "left_anti")
    else:
        rows = named.join(texts, ["doc_id", "_key"], "left").withColumn("_row", F.coalesce("_row", "doc_id"))
        classes = ngram_join.ngram_components(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=80, den=100)
        placed = rows.select("_row", "doc_id", "_key").join(classes.select(F.col("doc_id").alias("_row"), "component_id").distinct(), "_row")
        first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key", "_row")).alias("_first")).select("_first._row")
        kept = rows.join(first, "_row", "left_semi")
    one = kept.groupBy("doc_id", "_key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_one"))
    return one.select("doc_id", "_one.*").select(COLUMNS).unionAll(docs.where("doc_id is null"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 50 and more words that an earlier document has are cut out of the text.

    Spans belong to a doc_id and text, so rows that share a doc_id keep their own texts.
    """
    _, spans = substring_dedup.repeated_spans(docs, Scratch(spark))
    cut = substring_dedup.removed_text(docs, spans).groupBy("doc_id", "text_key").agg(F.first("cut_text").alias("_cut"))
    cut = cut.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    keyed = docs.select(*COLUMNS, substring_dedup.text_key().alias("_text_key"))
    out = keyed.join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").withColumn("text", F.coalesce("_cut", "text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a source may be cut after some words.

    Rows with equal doc_id, text and source get the takes of equal rows, one each.
    """
    mixed = mixing.mix(docs).select(F.col("row_key").alias("_key"), F.col("source").alias("_source"), F.col("size").alias("_size"), "taken", "tie", "ties")
    keyed = docs.select(*COLUMNS, mixing.row_key().alias("_row_key"))
    same = (F.col("_row_key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))
    single = keyed.join(mixed.where("ties = 1 and taken > 0"), same)
    several = mixed.where("ties > 1 and _size > 0")
    place = Window.partitionBy("_row_key", "source").orderBy("lang", "n_chars")
    first = several.where("tie = 1")
    numbered = only_likely(keyed, ["_row_key"], first.select(F.col("_key").alias("_row_key"))).join(first, same, "left_semi").withColumn("_n", F.row_number().over(place))
    tied = numbered.join(several.where("taken > 0"), same & (F.col("_n") == F.col("tie")))
    both = single.unionByName(tied.drop("_n"))
    whole = F.floor(F.col("taken") / F.col("_size")).cast("int")
    rest = (F.col("taken") % F.col("_size")).cast("int")
    begin = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, rest), " ")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(begin)).otherwise(F.array().cast("array<string>")))
    out = both.withColumn("text", F.explode(copies))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_spans),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's input."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        made, before = len(Scratch.made), docs
        docs = scratch.save(stage(spark, docs, sf_dir))
        Scratch.release(made)  # the next stage reads only what this one wrote
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
