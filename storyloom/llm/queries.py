"""The registered queries of this package: thin wrappers that read whole tables and apply an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import ann_forest, byte_bpe, exact_topk, licenses, mixing, near_dedup, pii, token_tables, toxicity, url_filter
from storyloom.llm.common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


#: The rules of the registered query, host/path and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), weights=(3, 1, 2))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(_table(spark, sf_dir, "documents")))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_pii that SQL can say."""
    return pii.base_digests(_table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_url_filter that SQL can say."""
    return url_filter.apply_rules(url_filter.split_urls(_table(spark, sf_dir, "pages")), URL_RULES)


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-tables")
    token_tables.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_tables.read_summary(spark, path)


#: The paths that documents are given have no names of license files: short texts with a license count as such.
LICENSE_FILE_WORDS = 80


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_path(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), file_words=LICENSE_FILE_WORDS)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_decode_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ann_forest": op2_ann_forest,
        "op3_url_filter": op3_url_filter,
        "op4_exact_topk": op4_exact_topk,
        "op5_mixing": op5_mixing,
        "op6_pii": op6_pii,
        "op7_token_tables": op7_token_tables,
        "op8_licenses": op8_licenses,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_byte_bpe": op10_byte_bpe,
    }


def parts() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The parts of the operators' queries that SQL can say where it can't say the whole."""
    return {
        "pii_base_spans": pii_base_spans,
        "url_rules": url_rules,
    }


#: Exact inner products of all pairs of a query and another vector.
_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

#: Jaccard similarity by an inverted list of all shingles, and components by reachability.
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * c >= 80 * (n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
lowest AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept FROM s LEFT JOIN lowest USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn or tokenize, which SQL can't; the tests hold them against brute force."""
    return {
        "op4_exact_topk": _TOP_K,
        "op5_mixing": mixing.oracle((3, 1, 2)),
        "op8_licenses": licenses.oracle(LICENSE_FILE_WORDS),
        "op9_minhash_dedup": _NEAR,
    }


def parts_sql() -> dict[str, str]:
    return {
        "pii_base_spans": pii.oracle_base(),
        "url_rules": url_filter.oracle_rules(URL_RULES),
    }
