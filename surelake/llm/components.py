"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm.shared import forget, stored


_SALTS = 16  # parts of a hub's edges; a round's shuffle has that many short rows for each node


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node u that is not the smallest itself.

    edges: (u, v) of numbers, in any direction; loops and repeats do no harm. Rounds go on until nothing changes, about the
    logarithm of the largest component's size; each is written to the shared folder, and the one before removed. Only a count and a checksum
    of the edges come to the driver; the joins are by sorting, as Spark takes rows that are repeated by salt for as few as they were
    and would broadcast them. More than ``most_rounds`` rounds raise an error: no edge is left out silently.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            return edges
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"), every.alias("salt"))
        salted = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
        large = salted.join(least.hint("merge"), ["a", "salt"]).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.distinct())
        forget(last)
        after = _digest(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
