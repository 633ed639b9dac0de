"""Question sets of three dialects, normalised to one schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.functions import answers
from surelake.operators.selection import Profile, select_examples

# The sources of a run, as (dataset, config).
MATH_SUBJECTS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
REQUESTS = [("gsm8k", "main"), *(("math", s) for s in MATH_SUBJECTS), ("gsm_plus", "default")]
SCHEMA = "example_id string, dataset string, source_revision string, source_config string, split string, source_row_id string, question string, gold_answer string, gold_solution string, gold_status string, subject string, perturbation_type string, seed_question_id string"
_REVISION = re.compile(r"[0-9a-fA-F]{40,64}")


def check_revisions(revisions: dict[str, str], datasets: list[str]) -> None:
    """Every dataset must be pinned to a commit."""
    for d in datasets:
        if not isinstance(revisions.get(d), str) or not _REVISION.fullmatch(revisions[d]):
            raise ValueError(f"{d} needs a revision of 40 to 64 hexadecimal digits")


def _assembled(rows: DataFrame, dataset: str, config: Column, split: Column, revision: Column, row_id: str, question: Column, gold: Column, solution: Column, status: Column, **more: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        answers.example_id(F.lit(dataset), config, split, F.col(row_id)).alias("example_id"), F.lit(dataset).alias("dataset"), revision.alias("source_revision"), config.alias("source_config"),
        split.alias("split"), F.col(row_id).cast("string").alias("source_row_id"), question.alias("question"), gold.alias("gold_answer"), solution.alias("gold_solution"), status.alias("gold_status"),
        *(more.get(c, null).alias(c) for c in ("subject", "perturbation_type", "seed_question_id")),
    )


def normalize(rows: DataFrame, dataset: str, config: str, split: str, revision: str, row_id: str = "source_row_id") -> DataFrame:
    """One dialect's rows in the common schema. The row's place in its split comes in the column ``row_id``."""
    if dataset not in ("gsm8k", "math", "gsm_plus"):
        raise ValueError(f"unsupported dataset {dataset!r}")
    if not all(isinstance(v, str) and v.strip() for v in (config, split, revision)):
        raise ValueError("config, split and revision must be text that is not blank")
    where = (F.lit(config), F.lit(split), F.lit(revision), row_id)
    if dataset == "gsm8k":
        solution = answers.optional_text(F.col("answer"))
        marked = F.contains(solution, F.lit("####"))
        gold = F.when(marked, answers.optional_text(F.substring_index(solution, "####", -1)))
        status = F.when(~F.coalesce(marked, F.lit(False)), "missing_final_marker").when(gold.isNull(), "missing_final_answer").otherwise("parsed")
        return _assembled(rows, dataset, *where, answers.required_text(F.col("question"), "question"), gold, solution, status)
    if dataset == "math":
        solution = answers.optional_text(F.col("solution"))
        rows = rows.withColumn("__span", answers.answer_span(solution))
        gold = F.when(F.col("__span.method") == "boxed", F.col("__span.value"))
        status = F.when(gold.isNull(), "missing_boxed_answer").otherwise("parsed")
        return _assembled(rows, dataset, *where, answers.required_text(F.col("problem"), "problem"), gold, solution, status, subject=F.lit(config))
    text = answers.optional_text(F.col("answer"))
    gold = F.when(~F.lower(text).isin(*answers.NO_ANSWER), text)
    status = F.when(gold.isNull(), "unanswerable").otherwise("parsed")
    return _assembled(
        rows, dataset, *where, answers.required_text(F.col("question"), "question"), gold, answers.optional_text(F.col("solution")), status,
        perturbation_type=answers.optional_text(F.col("perturbation_type")), seed_question_id=answers.seed_question_id(answers.optional_text(F.col("seed_question"))),
    )


def require_all_sources(examples: DataFrame, requests: list[tuple[str, str]] | None = None) -> None:
    """Stops if any (dataset, config) has no row; only the sources asked for are looked at."""
    wanted = examples.sparkSession.createDataFrame(requests or REQUESTS, "dataset string, source_config string")
    found = {(r.dataset, r.source_config) for r in examples.select("dataset", "source_config").join(F.broadcast(wanted), ["dataset", "source_config"], "left_semi").distinct().collect()}
    if missing := [r for r in requests or REQUESTS if r not in found]:
        raise ValueError(f"no rows of {missing}")


def read_examples(spark: SparkSession, root: str, revisions: dict[str, str], split: str = "test", requests: list[tuple[str, str]] | None = None, fmt: str = "parquet") -> DataFrame:
    """Normalised rows of all sources, laid out as root/dataset/config/revision=<sha>/, each with its place in source_row_id. A source without rows is an error."""
    requests = requests or REQUESTS
    check_revisions(revisions, sorted({d for d, _ in requests}))
    parts = [normalize(spark.read.format(fmt).load(f"{root}/{d}/{c}/revision={revisions[d]}"), d, c, split, revisions[d]) for d, c in requests]
    found = reduce(DataFrame.unionByName, parts)
    require_all_sources(found, requests)
    return found


def load_selected(spark: SparkSession, root: str, revisions: dict[str, str], profile: Profile, seed: int, requests: list[tuple[str, str]] | None = None, fmt: str = "parquet") -> DataFrame:
    """The examples that a profile takes from all sources, which are read offline from their pinned folders."""
    return select_examples(read_examples(spark, root, revisions, profile.split, requests, fmt), profile, seed)
