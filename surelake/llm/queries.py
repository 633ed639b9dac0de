"""The registered queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.llm import centroids, decontaminate, exact_topk, html_extraction, jaccard_join, language_id, lm_scoring, mixing, packing, quality_cnn, spelling, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"), with_text=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), with_text=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents")).drop("row", "root")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).drop("rejected")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_read(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, _read(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_read(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), packing.by_chunks(public_tokenizers.path(tokenizer)))


def language_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5's result SQL can tell: which rows are held out, and which have no language."""
    found = op5_language_id(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8's result SQL can tell: all but the model's own score."""
    found = op8_lm_scoring(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def quality_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9's result SQL can tell."""
    return op9_quality(spark, sf_dir).select("doc_id", "held_out", F.col("score").between(0, 1).alias("is_probability"))


# crc32 of doc_id as text, bit by bit, and its remainder; false where doc_id is null.
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: CAST((ascii(s) >> i) & 1 AS BIGINT))))"
_CRC = f"coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % {{n}}, -1)"

LANGUAGE_SQL = f"""SELECT doc_id, {_CRC.format(n=5)} = 0 AS held_out, coalesce(NOT regexp_matches(text, '\\pL'), true) AS und FROM documents"""
BASE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC.format(n=7)} = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+'), chr(0) || 'end') AS t FROM documents),
w AS (SELECT r, held_out, unnest(t) AS token FROM d), c AS (SELECT token, count(*) AS n FROM w WHERE NOT held_out GROUP BY token), s AS (SELECT coalesce(sum(n), 0) AS n, count(*) AS v FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c.n) AS n_known, CAST(any_value(s.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 1) / (s.n + s.v + 1)::DOUBLE)), 4) AS base_score
FROM d JOIN w USING (r) LEFT JOIN c USING (token) CROSS JOIN s GROUP BY r"""
QUALITY_SQL = f"SELECT doc_id, {_CRC.format(n=3)} = 1 AS held_out, true AS is_probability FROM documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_warc, op4_jaccard_join, op5_language_id, op6_exact_topk, op7_mixing, op8_lm_scoring, op9_quality, op10_html_extraction, op11_centroids, op12_spelling, op13_packing, language_facts, lm_base, quality_facts)}


def oracle_sql() -> dict[str, str]:
    """Language ID, LM scoring, quality, HTML extraction and packing can't be put in SQL as a whole; tests hold them against brute force or held-out rows."""
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op4_jaccard_join": jaccard_join.ORACLE_SQL,
        "op6_exact_topk": exact_topk.ORACLE_SQL,
        "op7_mixing": mixing.oracle_sql(),
        "op11_centroids": centroids.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
        "language_facts": LANGUAGE_SQL,
        "lm_base": BASE_SQL,
        "quality_facts": QUALITY_SQL,
    }
