"""The registered queries of the ten operators, with their production parameters.

The contracts of operators 4, 5, 6 and 9 are set logic, so DuckDB can be asked for the same rows (ORACLE_SQL).
The others' models, hashes and tokenizers have no counterpart in SQL; tests/llm holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, fingerprints, html_text, language_id, mixing, ngram_join, packing, substring_dedup, token_counts, toxicity
from plumbline.llm.common import table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = language_id.fold("doc_id", 5)
    return toxicity.score(docs, toxicity.train(docs, labels.where(remainder != 0)), remainder == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = language_id.fold("doc_id", 4)
    model = language_id.train(docs.where(remainder != 2))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_language_id, op3_fingerprints, op4_embedding_dedup, op5_ngram_join, op6_mixing, op7_html_text, op8_token_counts, op9_substring_dedup, op10_packing, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The smallest id that links (a, b, both ways) reach from each id of a.
_REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), component AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)"

_OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id)::BIGINT AS n_links, coalesce(c, v.vec_id) AS component_id, v.vec_id = coalesce(c, v.vec_id) AS kept FROM v LEFT JOIN component ON a = v.vec_id"""

_OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN component ON a = d.doc_id"""

_OP6 = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format('text')}) AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][i % 3 + 1] AS weight, [2, 5, 10][i % 3 + 1] AS step, sum(n) OVER () AS budget FROM s),
v AS (SELECT *, (budget - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY 3 * n / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM v WHERE 3 * n >= level * weight ORDER BY 3 * n / weight, i LIMIT 1),
t AS (SELECT unnest(generate_series(greatest(0, floor(level * 10)::BIGINT - 40), floor(level * 10)::BIGINT + 400)) AS t FROM l),
c AS (SELECT min(t) AS t FROM (SELECT t, sum(least(3 * n, t // step)) AS served, any_value(budget) AS budget FROM t, w GROUP BY t) WHERE served >= budget),
x AS (SELECT w.*, least(3 * n, (t - 1) // step) AS sure, (t % step = 0 AND t // step <= 3 * n)::INT AS due FROM w, c),
y AS (SELECT *, sure + CASE WHEN due = 1 AND sum(due) OVER (ORDER BY i) <= budget - sum(sure) OVER () THEN 1 ELSE 0 END AS served FROM x),
q AS (SELECT d.*, y.n, y.weight, y.served, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, least(3.0 * n, level * weight)::DOUBLE AS target, (greatest(0, least(size, served - start)) + greatest(0, least(size, served - start - n)) + greatest(0, least(size, served - start - 2 * n)))::BIGINT AS taken, source FROM q, l"""

_OP9 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT r, doc_id, j, array_to_string(w[j : j + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS j FROM d WHERE len(w) >= 50)),
g AS (SELECT r, j FROM (SELECT r, j, doc_id, min(doc_id) OVER (PARTITION BY g) AS lo FROM p) WHERE lo < doc_id),
k AS (SELECT r, list(DISTINCT x) AS gone FROM (SELECT r, unnest(range(j, j + 50)) AS x FROM g) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

ORACLE_SQL: dict[str, str] = {"op4_embedding_dedup": _OP4, "op5_ngram_join": _OP5, "op6_mixing": _OP6, "op9_substring_dedup": _OP9}
