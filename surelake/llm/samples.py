"""Bounded, reproducible samples of labelled rows, to fit the classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def learns(key: str, modulus: int, held: int) -> Column:
    """Rows to learn from: crc32 of the key as text, modulo modulus, is not held. A null key is not learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus != held, F.lit(False))


def held_out(key: str, modulus: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == held, F.lit(False))


def balanced(rows: DataFrame, key: str, text: str, label: str, most: int, salt: str = "", max_bytes: int = 1 << 18) -> tuple[list[tuple[str, object]], dict]:
    """About ``most`` (text, label) rows at most, shared out evenly over the labels, picked by a hash of the key.

    Rows whose text has more than ``max_bytes`` bytes are not picked, so what comes to the driver is bounded by both. Labels
    with fewer rows than their share give all; beyond ``most`` labels, the most frequent ones take part, as no sample of
    that size can hold them all. Also returns how many rows each label has among those that could be picked.
    """
    rows = rows.where(F.col(label).isNotNull() & (F.octet_length(F.col(text).cast("string")) <= max_bytes))
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most).collect()
    if not sizes:
        return [], {}
    left, share, rate = most, {}, None
    for k, r in enumerate(sorted(sizes, key=lambda r: r.n)):
        share[r.label] = min(r.n, left // (len(sizes) - k))
        left -= share[r.label]
    u = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    for r in sizes:
        hit = (F.col(label) == r.label) & (u < share[r.label] / r.n)
        rate = hit if rate is None else rate | hit
    picked = rows.where(rate).select(F.col(text), F.col(label), F.xxhash64(F.col(key), F.lit(salt)).alias("o")).collect()
    return [(r[0], r[1]) for r in sorted(picked, key=lambda r: (r[2], r[0]))], {r.label: r.n for r in sizes}
