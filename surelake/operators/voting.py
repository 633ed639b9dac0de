"""Votes of repeated samples by canonical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_vote(votes: DataFrame, key: str, position: str, answer: str) -> DataFrame:
    """The largest group of equal answers of each key; the earliest wins ties; missing answers are one group that can win.

    Two aggregations with partial sums: an id with very many votes is summed up before it is shuffled.
    """
    groups = votes.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    best = F.max(F.struct(F.col("n"), (-F.col("at").cast("bigint")).alias("early"), F.col(answer).alias("answer")))
    out = groups.groupBy(key).agg(best.alias("b"), F.sum("n").alias("sample_count"))
    return out.select(key, "sample_count", F.col("b.answer").alias("majority_answer"), F.col("b.n").alias("majority_vote_count"), (F.col("b.n") / F.col("sample_count")).alias("majority_vote_share"))


def agreement(votes: DataFrame, key: str, answer: str, greedy: str) -> DataFrame:
    """How many samples equal the greedy answer of their row; missing ones on either side never do."""
    same = F.coalesce(F.col(answer) == F.col(greedy), F.lit(False))
    return votes.groupBy(key).agg(F.count("*").alias("sample_count"), F.count_if(same).alias("greedy_agreement_count")).withColumn("greedy_agreement_share", F.col("greedy_agreement_count") / F.col("sample_count"))
