"""Calibration and ranking metrics per group, and what a report makes of them.

All take a long frame: grouping columns, a score and a 0/1 outcome. Unknown values are
null and never count as wrong. Grouping columns may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 15
MIN_SCORABLE_FRACTION = 0.95
# The reasons that a summary gives.
REASONS = {
    "incomplete": "The run is incomplete; no gate recommendation is made.",
    "mini_12h": "The mini_12h subset (111 questions) is too small to justify a KD gate; metrics are descriptive only.",
    "other": "The {profile} profile is a setup/runtime check, not a gate recommendation.",
}


def valid_score(score: str | Column) -> Column:
    """The score if it is a number from 0 to 1, else null (NaN fails the comparison too)."""
    c = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.when(~F.isnan(c) & c.between(0.0, 1.0), c)


def known_outcome(value: str | Column) -> Column:
    c = (F.col(value) if isinstance(value, str) else value).cast("int")
    return F.when(c.isin(0, 1), c)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names], F.lit(True))


def checked(df: DataFrame, score: str, outcome: str) -> DataFrame:
    """Stops the query at a score that is null, not finite or outside [0, 1], or an outcome that is not 0 or 1."""
    bad = valid_score(score).isNull() | known_outcome(outcome).isNull()
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit("scores must lie in [0, 1] and outcomes be 0 or 1"))).otherwise(F.col(score)))


def calibration_bins(df: DataFrame, groups: list[str], score: str = "score", outcome: str = "outcome", n_bins: int = BINS) -> DataFrame:
    """All n bins of equal width of every group: bin_index, lower, upper, count, mean_confidence and accuracy (null if empty).

    The last bin includes 1. One aggregation with partial sums; a group's bins are then laid out from a map, without a join.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    index = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    per_bin = df.where(F.col(score).isNotNull()).groupBy(*groups, index.alias("bin_index")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_confidence"), F.avg(outcome).alias("accuracy"))
    packed = per_bin.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("bin_index", F.struct("count", "mean_confidence", "accuracy")))).alias("bins"))
    every = packed.select(*groups, "bins", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin_index"))
    value = F.try_element_at("bins", F.col("bin_index"))
    return every.select(
        *groups, "bin_index", (F.col("bin_index") / n_bins).alias("lower"), ((F.col("bin_index") + 1) / n_bins).alias("upper"),
        F.coalesce(value["count"], F.lit(0)).cast("bigint").alias("count"), value["mean_confidence"].alias("mean_confidence"), value["accuracy"].alias("accuracy"),
    )


def ece_from_bins(bins: DataFrame, groups: list[str]) -> DataFrame:
    """n, accuracy and expected calibration error of each group from its bins."""
    gap = F.col("count") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return bins.groupBy(*groups).agg(F.sum("count").alias("n"), F.try_divide(F.sum(F.col("count") * F.col("accuracy")), F.sum("count")).alias("accuracy"), F.try_divide(F.sum(gap), F.sum("count")).alias("ece"))


def ece(df: DataFrame, groups: list[str], score: str = "score", outcome: str = "outcome", n_bins: int = BINS) -> DataFrame:
    return ece_from_bins(calibration_bins(df, groups, score, outcome, n_bins), groups)


def score_slice(s: Column, per_octave: int = 4096) -> Column:
    """A number that ascends with the score: each factor of two, on either side of 0, has so many slices, whatever the score's range."""
    place = lambda x: F.floor(F.least(F.log2(x), F.lit(1100.0)) * per_octave) + 1100 * per_octave  # noqa: E731 (above 0 for every double)
    return F.when(F.isnan(s), 1 << 40).when(s == 0, 0).when(s > 0, place(s)).otherwise(-place(-s))


def score_counts(df: DataFrame, groups: list[str], score: str = "score", outcome: str = "outcome") -> DataFrame:
    """Rows with a known outcome per distinct score ``s`` of each group, null too: pos and neg. All metrics can be made from it, and counts of parts of a table add up to its own."""
    o = known_outcome(outcome)
    return df.where(o.isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("s")).agg(F.sum(o).alias("pos"), F.sum(1 - o).alias("neg"))


def _ranked(df: DataFrame, groups: list[str], score: str, outcome: str) -> DataFrame:
    return ranked_counts(score_counts(df, groups, score, outcome), groups)


def ranked_counts(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Of ``score_counts``: pos, neg, and ``won``, the pairs that its positives win, ties as halves.

    Negatives below a score are those of lower slices, which are summed up first, plus those below it in its slice; so no
    task sorts a whole group. Rows without a score are counted too and win nothing.
    """
    sliced = counted.withColumn("slice", score_slice(F.col("s")))
    lower = sliced.groupBy(*groups, "slice").agg(F.sum(F.when(F.col("s").isNotNull(), F.col("neg"))).alias("n"))
    lower = lower.withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy(*groups, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("near", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    joined = ranked.join(lower, _same(ranked, lower, [*groups, "slice"])).select(*(ranked[g] for g in groups), "s", "pos", "neg", "near", "below")
    won = F.when(F.col("s").isNotNull(), F.col("pos") * (F.col("below") + F.col("near") + F.col("neg") / 2))
    return joined.select(*groups, "s", "pos", "neg", won.alias("won"))


def auroc(df: DataFrame, groups: list[str], score: str = "score", outcome: str = "outcome") -> DataFrame:
    """Tie-correct area under the ROC curve of each group; null if it has one class only."""
    ranked = _ranked(df.where(F.col(score).isNotNull()), groups, score, outcome)
    return ranked.groupBy(*groups).agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def metric_table(df: DataFrame, groups: list[str], scorable: str = "scorable_n", n_bins: int = BINS) -> DataFrame:
    """One row for each group with a known outcome: n, scorable_n, coverage, accuracy, ece and auroc.

    df has score and outcome, null where unknown. Rows with a known outcome are scorable, those that also have a valid score
    count. All metrics come from one count per distinct score, summed up per bin and then per group.
    """
    return metrics_of_counts(score_counts(df.withColumn("score", valid_score("score")), groups), groups, scorable, n_bins)


def metrics_of_counts(counted: DataFrame, groups: list[str], scorable: str = "scorable_n", n_bins: int = BINS) -> DataFrame:
    """``metric_table`` from ``score_counts`` of valid scores."""
    ranked = ranked_counts(counted, groups)
    index = F.when(F.col("s").isNotNull(), F.least(F.floor(F.col("s") * n_bins), F.lit(n_bins - 1)).cast("int"))
    rows = F.col("pos") + F.col("neg")
    bins = ranked.groupBy(*groups, index.alias("bin")).agg(F.sum(rows).alias("rows"), F.sum(F.col("s") * rows).alias("conf"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    scored = lambda c: F.sum(F.when(F.col("bin").isNotNull(), F.col(c)))
    n = F.coalesce(scored("rows"), F.lit(0))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("pos")))  # the bin's rows times |mean confidence - accuracy|
    out = bins.groupBy(*groups).agg(n.alias("n"), F.sum("rows").alias(scorable), F.try_divide(scored("pos"), n).alias("accuracy"), F.try_divide(F.sum(gap), n).alias("ece"), F.try_divide(F.sum("won"), scored("pos").cast("double") * scored("neg")).alias("auroc"))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("n"), F.col(scorable)), F.lit(0.0)))


def signals_to_rows(records: DataFrame, keep: list[str], signals: dict[str, str], outcome: str, analysis: str) -> DataFrame:
    """A row for each record and signal: keep, analysis, signal, score, outcome. One scan for all signals."""
    entries = F.array(*(F.struct(F.lit(name).alias("signal"), F.col(path).cast("double").alias("score")) for name, path in signals.items()))
    return records.select(*keep, F.lit(analysis).alias("analysis"), F.col(outcome).alias("outcome"), F.explode(entries).alias("e")).select(*keep, "analysis", F.col("e.signal").alias("signal"), F.col("e.score").alias("score"), "outcome")


def report_rows(records: DataFrame, keep: list[str], greedy: dict[str, str], primary: list[str], majority: str, correct: str = "correct", majority_correct: str = "majority_correct") -> DataFrame:
    """The three analyses of a report in long form, from one scan: every greedy signal, the primary ones on rows where all of them are valid, and the majority share."""
    whole = reduce(lambda a, b: a & b, [valid_score(greedy[p]).isNotNull() for p in primary])
    entry = lambda a, s, path, o: F.struct(F.lit(a).alias("analysis"), F.lit(s).alias("signal"), F.col(path).cast("double").alias("score"), F.col(o).cast("int").alias("outcome"))
    plain = [entry("greedy", s, path, correct) for s, path in greedy.items()] + [entry("majority", "majority_vote_share", majority, majority_correct)]
    paired = [entry("paired_primary", p, greedy[p], correct) for p in primary]
    return records.select(*keep, F.explode(F.when(whole, F.array(*plain, *paired)).otherwise(F.array(*plain))).alias("e")).select(*keep, "e.*")


def report_metrics(records: DataFrame, keep: list[str], greedy: dict[str, str], primary: list[str], majority: str, domain: DataFrame | None = None, correct: str = "correct", majority_correct: str = "majority_correct") -> DataFrame:
    """The metric table of ``report_rows``; paired rows have the unrestricted number of known outcomes as denominator.

    domain: combinations of ``keep`` for which rows come out even if there are no records.
    """
    groups = [*keep, "analysis", "signal"]
    found = metric_table(report_rows(records, keep, greedy, primary, majority, correct, majority_correct), groups)
    names = [("greedy", s, k) for k, s in enumerate(greedy)] + [("paired_primary", s, len(greedy) + k) for k, s in enumerate(primary)] + [("majority", "majority_vote_share", len(greedy) + len(primary))]
    labels = F.array(*(F.struct(F.lit(a).alias("analysis"), F.lit(s).alias("signal"), F.lit(k).alias("ordinal")) for a, s, k in names))
    domain = (domain if domain is not None else records.select(*keep).distinct()).select(*keep, F.explode(labels).alias("l")).select(*keep, "l.analysis", "l.signal", "l.ordinal")
    out = domain.join(found, _same(domain, found, groups), "left").select(*(domain[g] for g in groups), "ordinal", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("scorable_n", F.lit(0)).alias("own_n"), "accuracy", "ece", "auroc")
    known = F.max(F.when(F.col("analysis") == "greedy", F.col("own_n"))).over(Window.partitionBy(*keep))  # a few rows for each
    out = out.withColumn("scorable_n", F.when(F.col("analysis") == "paired_primary", known).otherwise(F.col("own_n")))
    return out.withColumn("coverage", F.coalesce(F.try_divide("n", "scorable_n"), F.lit(0.0))).select(*groups, "ordinal", "n", "scorable_n", "coverage", "accuracy", "ece", "auroc")


def reliability_points(df: DataFrame, groups: list[str], score: str = "score", outcome: str = "outcome") -> DataFrame:
    """Non-empty bins over all rows with a known outcome and a valid score."""
    rows = df.withColumn(score, valid_score(score)).withColumn(outcome, known_outcome(outcome)).where(f"{score} IS NOT NULL AND {outcome} IS NOT NULL")
    return calibration_bins(rows, groups, score, outcome).where("count > 0")


def null_poisoned_sum(value: str | Column) -> Column:
    """Null if any value is null or negative, 0 of no rows: the opposite of SQL's SUM."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.count_if(c.isNull() | (c < 0)) == 0, F.coalesce(F.sum(c), F.lit(0)))


def dataset_summary(records: DataFrame, selected: DataFrame, signals: dict[str, str], dataset: str = "dataset") -> DataFrame:
    """Counts and shares of each dataset; every share has its own denominator.

    records: dataset, gold_status, gold_answer, correct, prediction_parseable, sample_count, parseable_count, and counts of
    unknowns (parse_unknown, agreement_unknown, comparison_unknown); selected: dataset, selected_rows.
    """
    scorable = (F.col("gold_status") == "parsed") & F.col("gold_answer").isNotNull()
    scorable = F.coalesce(scorable, F.lit(False))
    outcome = F.when(scorable, known_outcome("correct"))
    sums = records.groupBy(dataset).agg(
        F.count("*").alias("total_rows"), F.count(outcome).alias("scorable_rows"), F.count_if(scorable).alias("source_scorable_rows"), F.sum(outcome).alias("right"),
        F.count_if(F.coalesce(F.col("prediction_parseable"), F.lit(False))).alias("parsed"), F.coalesce(F.sum("sample_count"), F.lit(0)).alias("sample_count"),
        F.coalesce(F.sum("parseable_count"), F.lit(0)).alias("sample_answer_parseable_count"), null_poisoned_sum("parse_unknown").alias("sample_answer_parse_unknown_count"),
        null_poisoned_sum("agreement_unknown").alias("greedy_agreement_unknown_count"), null_poisoned_sum("comparison_unknown").alias("majority_comparison_unknown_count"),
        *(F.count(F.when(scorable, valid_score(path))).alias(f"scored_{name}") for name, path in signals.items()),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    joined = selected.join(sums, dataset, "left").na.fill(0, ["total_rows", "scorable_rows", "source_scorable_rows", "parsed", "sample_count", "sample_answer_parseable_count", *(f"scored_{s}" for s in signals)])
    return joined.select(
        dataset, "total_rows", "selected_rows", "scorable_rows", (F.col("total_rows") - F.col("scorable_rows")).alias("unscorable_rows"), "source_scorable_rows",
        (F.col("total_rows") - F.col("source_scorable_rows")).alias("source_unscorable_rows"), share("source_scorable_rows", "selected_rows").alias("source_scorable_fraction"),
        share("scorable_rows", "source_scorable_rows").alias("outcome_label_coverage"), (F.col("source_scorable_rows") - F.col("scorable_rows")).alias("unknown_outcome_label_count"),
        F.try_divide("right", "scorable_rows").alias("greedy_accuracy"), share("parsed", "total_rows").alias("prediction_parse_coverage"), "sample_answer_parseable_count",
        "sample_answer_parse_unknown_count", "sample_count", "greedy_agreement_unknown_count", "majority_comparison_unknown_count",
        share("sample_answer_parseable_count", "sample_count").alias("sample_answer_parse_coverage"), *(share(f"scored_{s}", "source_scorable_rows").alias(f"coverage_{s}") for s in signals),
    )


def coverage_gate(summary: DataFrame) -> DataFrame:
    """One row: is every dataset's scorable fraction 0.95 or more and its outcome coverage 1? True of no datasets."""
    good = (F.col("source_scorable_fraction") >= MIN_SCORABLE_FRACTION) & (F.col("outcome_label_coverage") == 1.0)
    return summary.agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("valid"))


def macro(metrics: DataFrame, n_datasets: int, gate: bool, dataset: str = "dataset") -> DataFrame:
    """Equal-weight means over datasets of each greedy signal; null unless every dataset is defined. A signal may be recommended if all coverages are 1 and the gate is open."""
    whole = (F.count("auroc") == n_datasets) & (F.count("ece") == n_datasets) & (F.countDistinct(dataset) == n_datasets)
    given = metrics.where("analysis = 'greedy'").groupBy("signal").agg(
        F.when(whole, F.avg("auroc")).alias("macro_auroc"), F.when(whole, F.avg("ece")).alias("macro_ece"), F.when(whole, F.min("auroc")).alias("minimum_dataset_auroc"),
        whole.alias("all_datasets_defined"), (whole & F.bool_and(F.col("coverage") == 1.0) & F.lit(gate)).alias("eligible_for_recommendation"),
    )
    return given


def recommendation(run_complete: bool, profile: str) -> dict:
    """Never names a signal: a small run only describes."""
    status = "exploratory" if run_complete else "insufficient"
    return {"signal": None, "status": status, "reason": REASONS["incomplete"] if not run_complete else REASONS.get(profile, REASONS["other"].format(profile=profile))}


def run_accounting(selected: DataFrame, completed: DataFrame, failed: DataFrame, key: str = "example_id") -> DataFrame:
    """One row: selected, completed, failed and pending counts, and whether the completed keys are exactly the selected ones.

    Duplicate selected keys and completed keys outside the selection stop the query.
    """
    marks = selected.select(key, F.lit(1).alias("s"), F.lit(0).alias("c"), F.lit(0).alias("f")).unionByName(completed.select(key, F.lit(0).alias("s"), F.lit(1).alias("c"), F.lit(0).alias("f"))).unionByName(failed.select(key, F.lit(0).alias("s"), F.lit(0).alias("c"), F.lit(1).alias("f")))
    each = marks.groupBy(key).agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("f").alias("f"))
    sums = each.agg(
        F.coalesce(F.max("s"), F.lit(0)).alias("most"), F.count_if((F.col("c") > 0) & (F.col("s") == 0)).alias("outside"), F.count_if(F.col("s") > 0).alias("selected"),
        F.count_if(F.col("c") > 0).alias("completed"), F.count_if((F.col("f") > 0) & (F.col("c") == 0)).alias("failed"),
    )
    guard = F.when(F.col("most") > 1, F.raise_error(F.lit("duplicate selected ids"))).when(F.col("outside") > 0, F.raise_error(F.lit("completed ids outside the selection"))).otherwise(F.col("selected"))
    out = sums.select(guard.alias("selected"), "completed", "failed").withColumn("pending", F.col("selected") - F.col("completed") - F.col("failed"))
    return out.withColumn("run_complete", (F.col("pending") == 0) & (F.col("failed") == 0))
