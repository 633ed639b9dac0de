"""Deterministic hash-ranked sampling, seeds and leakage-safe selection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surelake.functions.answers import leak_group


@dataclass(frozen=True)
class Profile:
    """How many rows of each dataset a run takes; None: all."""

    name: str
    gsm8k: int | None
    math_per_subject: int | None
    gsm_plus: int | None
    gsm_plus_one_per_seed: bool = True
    sample_count: int = 8
    max_new_tokens: int = 1024
    split: str = "test"
    target_hours: float | None = None

    def __post_init__(self):
        caps = (self.gsm8k, self.math_per_subject, self.gsm_plus)
        whole = lambda x: type(x) is int and x > 0  # noqa: E731 (True is no number here)
        sound = all(c is None or whole(c) for c in caps) and whole(self.sample_count) and whole(self.max_new_tokens) and (self.target_hours is None or self.target_hours > 0)
        if not (sound and self.name and self.split):
            raise ValueError(f"no sound profile: {self}")


# The two profiles of the study.
PROFILES = {"smoke": Profile("smoke", 1, 1, 1, sample_count=2), "mini_12h": Profile("mini_12h", 40, 3, 50, target_hours=12)}


def rank_key(key: str | Column, seed: int) -> Column:
    """sha256 of the seed, a zero byte and the key, in hex: its order is the order of the bytes."""
    c = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.sha2(F.concat(F.lit(f"{seed}\0"), c), 256)


def take_ranked(df: DataFrame, strata: list[str], key: str, seed: int, limit: int | None, digest_only: bool = False, place: str | None = None) -> DataFrame:
    """The ``limit`` rows of each stratum that come first by rank key, then key, with their ``place``, if it is named.

    The limit is a literal, so it reaches the map side (WindowGroupLimit): a task sends ``limit`` rows of a stratum at most.
    """
    if limit is None and place is None:
        return df
    order = [rank_key(key, seed)] + ([] if digest_only else [F.col(key)])
    ranked = df.withColumn(place or "__place", F.row_number().over(Window.partitionBy(*(strata or [F.lit(0)])).orderBy(*order)))
    kept = ranked if limit is None else ranked.where(F.col(place or "__place") <= limit)
    return kept if place else kept.drop("__place")


def seed_group(seed: str, key: str) -> Column:
    """A row without a seed question is a group of its own."""
    return F.coalesce(F.col(seed), F.concat(F.lit("missing-seed:"), F.col(key)))


def check_examples(examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Stops on repeated keys; and on datasets other than the three known ones. Keys are counted on each task before they are shuffled; rows go on without a key that is there twice, as there is none."""
    known = F.coalesce(F.col("dataset").isin("gsm8k", "math", "gsm_plus"), F.lit(False))
    checked = examples.withColumn(key, F.when(known, F.col(key)).otherwise(F.raise_error(F.lit("unsupported dataset")).cast(examples.schema[key].dataType)))
    stop = F.raise_error(F.lit("duplicate example id")).cast("boolean")
    twice = examples.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.when(F.col("__n") > 1, stop).otherwise(F.lit(False))).select("__key")
    return checked.join(twice, F.col(key) == F.col("__key"), "left_anti")


def select_examples(examples: DataFrame, profile: Profile, seed: int, key: str = "example_id") -> DataFrame:
    """gsm8k up to its cap, math per source_config, gsm_plus one per seed question and then up to its cap; ordered by key.

    Repeated keys and unknown datasets stop the query.
    """
    examples = check_examples(examples, key)
    by = lambda name: examples.where(F.col("dataset") == name)
    plus = by("gsm_plus")
    if profile.gsm_plus_one_per_seed:
        plus = take_ranked(plus.withColumn("__group", seed_group("seed_question_id", key)), ["__group"], key, seed, 1).drop("__group")
    parts = [take_ranked(by("gsm8k"), ["dataset"], key, seed, profile.gsm8k), take_ranked(by("math"), ["source_config"], key, seed, profile.math_per_subject), take_ranked(plus, ["dataset"], key, seed, profile.gsm_plus)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(key)


def without_leaks(candidates: DataFrame, training: DataFrame, key: str = "example_id", group: str = "leak_group") -> DataFrame:
    """Candidates that are not in training and share no group with it. Null groups never match."""
    out = candidates.join(training.select(key).distinct(), key, "left_anti")
    return out.join(training.where(F.col(group).isNotNull()).select(group).distinct(), group, "left_anti").select(candidates.columns)


def training_groups(training: DataFrame, examples: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, leak_group) of the training ids that are among the examples; others are passed over."""
    group = leak_group(F.col("dataset"), F.col("question"), F.col("seed_question_id"))
    return training.select(key).distinct().join(examples.select(key, group.alias("leak_group")), key)


def select_heldout(examples: DataFrame, training: DataFrame, seed: int, gsm8k: int = 300, math_per_subject: int = 20, gsm_plus: int = 200, key: str = "example_id") -> DataFrame:
    """Scorable examples without leaks, ranked by digest alone in each bucket (dataset, and config of math).

    gsm_plus keeps the first of each seed question, where missing ones are one group, unlike in ``select_examples``. Returns
    the rows with their bucket_config and place; order by dataset, bucket_config, place.
    """
    scorable = examples.where((F.col("gold_status") == "parsed") & F.col("gold_answer").isNotNull())
    rows = without_leaks(scorable, training, key).withColumn("bucket_config", F.when(F.col("dataset") == "math", F.col("source_config")))
    of = lambda name: rows.where(F.col("dataset") == name)
    plus = take_ranked(of("gsm_plus"), ["seed_question_id"], key, seed, 1, digest_only=True)
    parts = [(of("gsm8k"), [], gsm8k), (of("math"), ["bucket_config"], math_per_subject), (plus, [], gsm_plus)]
    return reduce(DataFrame.unionByName, [take_ranked(part, ["dataset", *strata], key, seed, limit, digest_only=True, place="place") for part, strata, limit in parts])


def sample_seed(base_seed: int, key: str | Column, index: str | Column) -> Column:
    """The first 63 bits, but for the sign, of sha256(seed, key, index with zero bytes between)."""
    k, i = ((F.col(c) if isinstance(c, str) else c).cast("string") for c in (key, index))
    digest = F.sha2(F.concat(F.lit(f"{base_seed}\0"), k, F.lit("\0"), i), 256)
    unsigned = F.concat(F.translate(F.substring(digest, 1, 1), "89abcdef", "01234567"), F.substring(digest, 2, 15))  # without the first bit
    return F.conv(unsigned, 16, 10).cast("bigint")
