"""Which keys two tables differ in, by trees of digests: rows are shuffled only where the digests say that something differs.

A leaf is a range of hashed keys. Its digest is order-free: how many rows it has and the sum and the exclusive or of their hashes.
Each level splits the leaves that differ further; rows of leaves that agree never leave the scan. What differs is compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12  # of a level: 4,096 leaves below each that differs
_MOST = 1 << 18  # leaves that a level goes on with


def _place(key: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def _hash(columns: list[str], salt: int) -> Column:
    """Of a row, nulls told apart from what they would be hashed as."""
    return F.xxhash64(F.lit(salt), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def leaf_digests(rows: DataFrame, key: list[str], columns: list[str], bits: int) -> DataFrame:
    """(__leaf, n, x, s): a row for each leaf, added up on each task before it is shuffled."""
    hashed = rows.select(_place(key, bits).alias("__leaf"), _hash(columns, 1).alias("a"), _hash(columns, 2).alias("b"))
    return hashed.groupBy("__leaf").agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.sum((F.col("b") % (1 << 31)).cast("bigint")).alias("s"))


def differing_leaves(left: DataFrame, right: DataFrame, key: list[str], columns: list[str], bits: int) -> DataFrame:
    a, b = (leaf_digests(t, key, columns, bits) for t in (left, right))
    joined = a.alias("a").join(b.alias("b"), "__leaf", "full_outer")
    same = reduce(lambda p, q: p & q, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "x", "s")))
    return joined.where(~same).select("__leaf")


def narrowed(left: DataFrame, right: DataFrame, key: list[str], columns: list[str], levels: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """The rows of both tables in the last level's leaves that differ, and how many those are.

    Each level reads both tables and shuffles digests alone. Leaves come to the driver's count only; once there are more than 2**18
    of them, splitting further would not narrow and the rows are taken as they are.
    """
    bits, leaves = 0, None
    for _ in range(levels):
        bits += BITS
        found = differing_leaves(left, right, key, columns, bits).persist()
        leaves = found.count()
        if not leaves:
            found.unpersist()
            return left.limit(0), right.limit(0), 0
        if leaves > _MOST:
            found.unpersist()
            break
        known = F.broadcast(found)  # at most 2**18 numbers
        left, right = (t.withColumn("__leaf", _place(key, bits)).join(known, "__leaf", "left_semi").drop("__leaf") for t in (left, right))
    return left, right, leaves


def differences(left: DataFrame, right: DataFrame, key: str | list[str], columns: list[str] | None = None, levels: int = 3) -> DataFrame:
    """Keys that only one table has, or whose columns (all that the left one has, by default) or numbers of rows differ; null equals null.

    Returns the keys, left and right (rows of the key) and equal, false where both have it with other values. Columns are compared as they
    are. Tables that agree are read once and shuffle a digest for each of at most 4,096 leaves and task; bytes shuffled beyond that follow the difference.
    Digests have 64 bits and a sum and a count besides: tables that differ and agree in all of them are taken for equal.
    """
    key = [key] if isinstance(key, str) else key
    columns = columns or left.columns
    use = list(dict.fromkeys([*key, *columns]))
    a, b, _ = narrowed(left.select(*use), right.select(*use), key, use, levels)
    marked = a.withColumn("__l", F.lit(1)).unionByName(b.withColumn("__l", F.lit(0)))
    each = marked.groupBy(*use).agg(F.sum("__l").alias("l"), F.sum(1 - F.col("__l")).alias("r"))
    return each.groupBy(*key).agg(F.sum("l").alias("left"), F.sum("r").alias("right"), F.bool_and(F.col("l") == F.col("r")).alias("equal")).where("NOT equal")


def same_tables(left: DataFrame, right: DataFrame, key: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: keys only on the left, only on the right, on both with other values, and whether the tables are equal."""
    found = differences(left, right, key, columns)
    out = found.agg(F.count_if(F.col("right") == 0).alias("only_left"), F.count_if(F.col("left") == 0).alias("only_right"), F.count_if((F.col("left") > 0) & (F.col("right") > 0)).alias("changed"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("changed") == 0))
