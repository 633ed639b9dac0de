"""Gated training sets and the comparison of conditions."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GATE = 0.75
# The pairs of conditions that are compared.
COMPARISONS = [("base", "kd_all"), ("base", "kd_gated"), ("base", "kd_oracle"), ("kd_all", "kd_gated"), ("kd_oracle", "kd_gated")]
_PLACES, _TASK_DRAWS = 1 << 12, 1 << 24  # of a row and of a task, when resamples are drawn place by place


def responses(records: DataFrame) -> DataFrame:
    """Greedy and sampled responses of each record in long form, with truncated and correct (samples: unknown)."""
    first = F.struct(F.col("greedy.text").alias("response"), F.col("greedy.predicted_answer").alias("answer"), F.coalesce(F.col("greedy.was_truncated"), F.lit(False)).alias("truncated"), F.col("greedy.correct").alias("correct"))
    others = F.transform("samples", lambda s: F.struct(s["text"].alias("response"), s["answer"].alias("answer"), (~s["termination_reason"].eqNullSafe(F.lit("eos"))).alias("truncated"), F.lit(None).cast("boolean").alias("correct")))
    keep = ["example_id", "question", F.col("gold_answer").alias("gold"), F.col("self_consistency.majority_answer").alias("majority"), F.col("self_consistency.majority_vote_share").alias("share")]
    return records.select(*keep, F.posexplode(F.concat(F.array(first), others)).alias("ordinal", "r")).select("example_id", "question", "gold", "majority", "share", "ordinal", "r.*")


def training_sets(rows: DataFrame, gate: float = GATE) -> DataFrame:
    """Usable responses tagged by condition: all of them are kd_all; those whose text equals a majority with enough votes are kd_gated too."""
    usable = rows.where("NOT truncated AND answer IS NOT NULL")
    gated = F.coalesce((F.coalesce(F.col("share"), F.lit(0.0)) >= gate) & (F.col("answer") == F.col("majority")), F.lit(False))
    conditions = F.when(gated, F.array(F.lit("kd_all"), F.lit("kd_gated"))).otherwise(F.array(F.lit("kd_all")))
    return usable.withColumn("condition", F.explode(conditions))


def oracle_set(items: DataFrame) -> DataFrame:
    """Responses that are known to be right, or that grade as right."""
    from surelake.functions.answers import answer_span
    from surelake.functions.grading import grade_answer

    graded = F.when(F.col("correct").isNull(), grade_answer(answer_span("response")["value"], F.col("gold"))["correct"])
    return items.where(F.coalesce(F.col("correct"), graded, F.lit(False)))


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("condition").agg(F.count("*").alias("responses"), F.countDistinct("example_id").alias("questions"))


def student_summary(results: DataFrame) -> DataFrame:
    """A row for each condition and dataset, and one with dataset ``overall`` that has the macro accuracy and truncated share. Unknown counts as wrong."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("int")
    each = results.groupBy("condition", "dataset").agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.count_if("truncated").alias("cut"))
    overall = each.groupBy("condition").agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), F.avg(F.col("right") / F.col("n")).alias("macro_accuracy"), (F.sum("cut") / F.sum("n")).alias("truncated_fraction"))
    rows = each.select("condition", "dataset", "n", (F.col("right") / F.col("n")).alias("accuracy"), F.lit(None).cast("double").alias("macro_accuracy"), F.lit(None).cast("double").alias("truncated_fraction"))
    return rows.unionByName(overall.withColumn("dataset", F.lit("overall")))


def paired_wide(results: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """A row for each example with the difference of each comparison, ``d0``, ``d1`` and so on: right's outcome minus left's.

    One aggregation by example serves all comparisons. Null where the left condition lacks the example; one that only the right
    one lacks, or that a condition has twice, stops the query.
    """
    value = F.coalesce(F.col("correct"), F.lit(False)).cast("int")
    names = sorted({c for pair in comparisons for c in pair})
    of = {c: F.when(F.col("condition") == c, value) for c in names}
    each = results.where(F.col("condition").isin(*names)).groupBy("example_id").agg(*(F.sum(of[c]).alias(f"v_{k}") for k, c in enumerate(names)), *(F.count(of[c]).alias(f"n_{k}") for k, c in enumerate(names)))
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.col("example_id").cast("string"))).cast("int")
    v = {c: F.when(F.col(f"n_{k}") > 1, stop("two results of one condition for ")).otherwise(F.col(f"v_{k}")) for k, c in enumerate(names)}
    return each.select("example_id", *(F.when(v[a].isNotNull(), F.coalesce(v[b], stop("no paired result for ")) - v[a]).alias(f"d{k}") for k, (a, b) in enumerate(comparisons)))


def paired(results: DataFrame, left: str, right: str) -> DataFrame:
    """(example_id, diff) of the left condition's examples; an example that the right one lacks stops the query."""
    return paired_wide(results, [(left, right)]).where("d0 IS NOT NULL").select("example_id", F.col("d0").cast("int").alias("diff"))


def paired_delta(results: DataFrame, comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """left, right, n and mean difference of each comparison, from one pass over the results."""
    pairs = comparisons or COMPARISONS
    sums = paired_wide(results, pairs).agg(*(F.struct(F.count(f"d{k}").alias("n"), F.avg(f"d{k}").alias("delta")).alias(f"c{k}") for k in range(len(pairs))))
    rows = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{k}.n").alias("n"), F.col(f"c{k}.delta").alias("delta")) for k, (a, b) in enumerate(pairs)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def drawn_sums(spark: SparkSession, seed: int, n: int, rounds: int, sizes: list[list[tuple[int, int]]]) -> DataFrame:
    """(round, t0, t1, ...): the sums of each round's n draws, one for each list of (value, count) in ascending order.

    Place ``i`` of ``round`` draws the first 48 bits of the SHA-256 of ``seed:round:i``, modulo n, and so the value that a cumulative count
    has there. A round's places are cut into parts of 4,096; a task hashes a round's head once a part and goes on from there for every place.
    """
    parts, tasks = -(-n // _PLACES), max(spark.sparkContext.defaultParallelism, rounds * n // _TASK_DRAWS)
    names = [f"t{k}" for k in range(len(sizes))]

    def draw(batches):
        part, tails = None, []
        for batch in batches:
            at = batch.column("id").to_numpy()
            sums = np.zeros((len(sizes), len(at)))
            for j, x in enumerate(at.tolist()):
                own, r = divmod(x, rounds)  # a task's rounds of one part follow each other
                if own != part:
                    part, tails = own, [b"%d" % i for i in range(own * _PLACES, min(n, (own + 1) * _PLACES))]
                head = hashlib.sha256(f"{seed}:{r}:".encode()).copy
                digests = b"".join([(h := head()).update(i) or h.digest() for i in tails])
                place = (np.frombuffer(digests, ">u8")[::4] >> np.uint64(16)) % np.uint64(n)
                for k, values in enumerate(sizes):
                    reached = below = 0
                    for d, c in values:
                        reached, before = reached + c, below
                        below = np.count_nonzero(place < reached)
                        sums[k, j] += d * (below - before)
            yield pa.RecordBatch.from_pydict({"round": pa.array(at % rounds), **dict(zip(names, map(pa.array, sums), strict=True))})

    found = spark.range(0, rounds * parts, 1, tasks).mapInArrow(draw, ", ".join(["round bigint", *(f"{c} double" for c in names)]))
    return found.groupBy("round").agg(*(F.sum(c).alias(c) for c in names))  # whole numbers, so their order does not matter


def comparison_table(results: DataFrame, seed: int, rounds: int = 5000, comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """left, right, n, delta, ci_low and ci_high of every comparison, each by ``rounds`` resamples.

    As ``bootstrap``, but comparisons over equally many examples share their draws, so that five cost little more than one.
    """
    pairs = comparisons or COMPARISONS
    wide = paired_wide(results, pairs)
    counts = wide.agg(*(F.count_if(F.col(f"d{k}") == d).alias(f"c{k}_{d + 1}") for k in range(len(pairs)) for d in (-1, 0, 1))).first()
    sizes = [[(d, counts[f"c{k}_{d + 1}"]) for d in (-1, 0, 1)] for k in range(len(pairs))]
    spark, out = results.sparkSession, []
    lo, hi = int(0.025 * rounds), max(int(0.975 * rounds) - 1, 0)
    for n in sorted({sum(c for _, c in s) for s in sizes}):
        own = [k for k, s in enumerate(sizes) if sum(c for _, c in s) == n]
        if not n:
            raise ValueError("there is nothing to resample")
        means = drawn_sums(spark, seed, n, rounds, [sizes[k] for k in own]).select(*((F.col(f"t{j}") / n).alias(f"m{k}") for j, k in enumerate(own)))
        draws = means.agg(*(F.sort_array(F.collect_list(f"m{k}")).alias(f"m{k}") for k in own))  # as many as rounds, which is a parameter
        entry = lambda k: F.struct(
            F.lit(pairs[k][0]).alias("left"), F.lit(pairs[k][1]).alias("right"), F.lit(n).cast("bigint").alias("n"), F.lit(sum(d * c for d, c in sizes[k]) / n).alias("delta"),  # noqa: B023
            F.get(f"m{k}", F.lit(lo)).alias("ci_low"), F.get(f"m{k}", F.lit(hi)).alias("ci_high"),
        )
        out.append(draws.select(F.explode(F.array(*map(entry, own))).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, out)


def bootstrap(diffs: DataFrame, seed: int, rounds: int = 5000) -> DataFrame:
    """delta and the 95 % interval of the mean of ``diff`` over resamples with replacement.

    Draws come from a hash of seed, round and place, so they do not depend on partitions. A resample's mean only depends on
    how many differences of each value it draws, so each draw looks up a cumulative count of the few values of
    ``diff`` instead of joining a row; the draws are a range that no executor has to hold.
    """
    sizes = diffs.groupBy("diff").agg(F.count("*").alias("c")).orderBy("diff").collect()  # at most -1, 0 and 1
    n = sum(r.c for r in sizes)
    if not n:
        raise ValueError("there is nothing to resample")
    spark = diffs.sparkSession
    means = drawn_sums(spark, seed, n, rounds, [[(r.diff, r.c) for r in sizes]]).select((F.col("t0") / n).alias("mean"))
    draws = means.agg(F.sort_array(F.collect_list("mean")).alias("draws"))  # as many as rounds, which is a parameter
    lo, hi = int(0.025 * rounds), max(int(0.975 * rounds) - 1, 0)
    delta = sum(r.diff * r.c for r in sizes) / n
    return draws.select(F.lit(n).cast("bigint").alias("n"), F.lit(delta).alias("delta"), F.get("draws", F.lit(lo)).alias("ci_low"), F.get("draws", F.lit(hi)).alias("ci_high"))


def overview(rows: DataFrame) -> DataFrame:
    """Of each dataset: questions, scorable, right, majority right among the scorable, and the mean agreement of right and wrong ones."""
    known = F.col("greedy_correct").isNotNull()
    return rows.groupBy("dataset").agg(
        F.count("*").alias("questions"), F.count_if(known).alias("scorable"), F.count_if("greedy_correct").alias("greedy_right"), F.count_if(known & F.col("majority_correct")).alias("majority_right"),
        F.avg(F.when(F.col("greedy_correct"), F.col("agreement_share"))).alias("agreement_right"), F.avg(F.when(~F.col("greedy_correct"), F.col("agreement_share"))).alias("agreement_wrong"),
    )


def exemplars(rows: DataFrame, ordinal: str = "ordinal", math: str = "math") -> DataFrame:
    """example_id of the confident right (math only), the flagged wrong and the confident wrong row; the first row wins ties, by any ordinal that has an order."""
    share, sure = F.coalesce("agreement_share", F.lit(0.0)), F.coalesce("entropy_confidence", F.lit(0.0))
    most = lambda when: F.min_by("example_id", F.when(when, F.struct((-share).alias("a"), (-sure).alias("b"), F.col(ordinal).alias("c"))))
    wrong = ~F.col("greedy_correct")
    low = F.struct(F.coalesce("agreement_share", F.lit(1.0)).alias("a"), F.col(ordinal).alias("c"))
    return rows.agg(
        most(F.col("greedy_correct") & (F.col("dataset") == math)).alias("confident_right"),
        F.min_by("example_id", F.when(wrong & F.col("greedy_answer").isNotNull(), low)).alias("flagged_wrong"),
        most(wrong).alias("confident_wrong"),
    )


def resampled_means(spark, sizes: list[list[tuple[int, int]]], seed: int, rounds: int) -> DataFrame:
    """(k, mean) of each round of each comparison k, given the counts of its few values.

    A resample of n rows only matters by how many of each value it draws: these are multinomial, and are drawn as such, by conditional
    binomials. So the work is rounds times values, whatever n is. Each round has a generator of its own, keyed by seed, comparison and round.
    """

    def draw_counts(batches):
        for batch in batches:
            at = batch.column("id").to_numpy()
            means = np.empty(len(at))
            for i, x in enumerate(at.tolist()):
                k, r = divmod(x, rounds)
                values, counts = (np.array(v, np.float64) for v in zip(*sizes[k], strict=True))
                n = int(sum(c for _, c in sizes[k]))
                means[i] = float(np.random.Generator(np.random.Philox(key=[seed % 2**64, k << 40 | r])).multinomial(n, counts / n) @ values) / n
            yield pa.RecordBatch.from_pydict({"k": pa.array(at // rounds, pa.int32()), "mean": pa.array(means)})

    return spark.range(rounds * len(sizes)).mapInArrow(draw_counts, "k int, mean double")


def comparison_intervals(results: DataFrame, seed: int, rounds: int = 5000, comparisons: list[tuple[str, str]] | None = None) -> DataFrame:
    """left, right, n, delta, ci_low and ci_high of every comparison: the paired bootstrap, drawn by counts.

    The same distribution as ``comparison_table`` and ``bootstrap``, which draw row by row; their work grows with rounds times n,
    this one's does not grow with n once the differences are counted. A comparison without examples stops the query.
    """
    pairs = comparisons or COMPARISONS
    counts = paired_wide(results, pairs).agg(*(F.count_if(F.col(f"d{k}") == d).alias(f"c{k}_{d + 1}") for k in range(len(pairs)) for d in (-1, 0, 1))).first()
    sizes = [[(d, counts[f"c{k}_{d + 1}"]) for d in (-1, 0, 1)] for k in range(len(pairs))]
    totals = [sum(c for _, c in s) for s in sizes]
    if not all(totals):
        raise ValueError("there is nothing to resample")
    spark = results.sparkSession
    lo, hi = int(0.025 * rounds), max(int(0.975 * rounds) - 1, 0)
    draws = resampled_means(spark, sizes, seed, rounds).groupBy("k").agg(F.sort_array(F.collect_list("mean")).alias("v"))  # as many as rounds, which is a parameter
    known = spark.createDataFrame([(k, a, b, totals[k], sum(d * c for d, c in sizes[k]) / totals[k]) for k, (a, b) in enumerate(pairs)], "k int, left string, right string, n bigint, delta double")
    return draws.join(F.broadcast(known), "k").select("left", "right", "n", "delta", F.get("v", F.lit(lo)).alias("ci_low"), F.get("v", F.lit(hi)).alias("ci_high"))
