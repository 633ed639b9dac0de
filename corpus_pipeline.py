"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
``run`` writes what a stage returns as Parquet to the shared folder and reads it again for the next.

Stages read doc_id, text, lang and source of ``docs``; all but the last return the columns of documents and
nothing else, whatever else docs has, under any name. An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.llm import language_id, mixing
from surelake.llm.decontaminate import decontaminate
from surelake.llm.jaccard_join import one_of_each
from surelake.llm.shared import stored
from surelake.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: null, empty or letterless texts, those below the calibrated threshold, and those with too many subwords that no learned language has.

    It learns from rows with a lang; without any, nothing is recognised. Repeated rows and rows without id stay as they are.
    """
    return language_id.recognised(docs, language_id.fit(docs)).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the one with the smallest doc_id.

    Of rows that tie, with equal id and text, one stays; so does one row of a group that has no id at all. Null and blank
    texts are no duplicates of each other.
    """
    return one_of_each(docs.select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also start elsewhere go; documents that lose all their words go with them, and so do null and blank texts.

    Repeated rows are each other's passages. Rows without id, source or lang are treated alike.
    """
    return _with_text(substring_dedup(docs, carry=("lang", "source")).where("n_words > n_removed"), "kept_text")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the few hit spans are cut. Null and blank texts hit nothing and stay; repeated rows are judged alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate(docs, benchmark, carry=("lang", "source"))
    return _with_text(marked.where("NOT contaminated"), "kept_text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of the tokens.

    A null source or lang is a value of its own. Rows without id are drawn by their text; repeated rows are drawn together.
    """
    return mixing.sampled(docs.select(*COLUMNS)).select(*COLUMNS, F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__p").alias("p"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources to target weights", mix_sources),
]

#: The stages learn and iterate, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
