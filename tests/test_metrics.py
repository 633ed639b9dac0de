import random

import pytest
from pyspark.sql import functions as F

from surelake.operators import metrics


def pairs(spark, scores, outcomes, group="g"):
    return spark.createDataFrame([(group, float(s), int(o)) for s, o in zip(scores, outcomes, strict=True)], "g string, score double, outcome int")


def test_ece(spark):
    def ece(s, o):
        return metrics.ece(pairs(spark, s, o), ["g"], n_bins=2).first().ece

    assert ece([0.9, 0.7, 0.2, 0.1], [1, 0, 1, 0]) == pytest.approx(0.325)
    assert ece([0, 1], [1, 1]) == pytest.approx(0.5)


def test_bins(spark):
    b = metrics.calibration_bins(pairs(spark, [0, 0.25, 0.5, 0.75, 1], [0, 0, 1, 1, 1]), ["g"], n_bins=2).orderBy("bin_index").collect()
    assert [(r["count"], r.mean_confidence, r.accuracy) for r in b] == [(2, 0.125, 0.0), (3, 0.75, 1.0)]
    b = metrics.calibration_bins(pairs(spark, [0.1], [0]), ["g"], n_bins=3).orderBy("bin_index").collect()
    assert [(r["count"], r.mean_confidence) for r in b] == [(1, 0.1), (0, None), (0, None)]
    assert [(round(r.lower, 4), round(r.upper, 4)) for r in b] == [(0, 0.3333), (0.3333, 0.6667), (0.6667, 1)]
    with pytest.raises(ValueError):
        metrics.calibration_bins(pairs(spark, [0.1], [0]), ["g"], n_bins=0)


def test_checked(spark):
    assert metrics.checked(pairs(spark, [0.1], [1]), "score", "outcome").count() == 1
    for s, o in [(1.1, 1), (float("nan"), 0), (0.5, 2)]:
        with pytest.raises(Exception, match="scores must lie"):
            metrics.checked(pairs(spark, [s], [o]), "score", "outcome").collect()


def test_auroc(spark):
    def auc(s, o):
        return metrics.auroc(pairs(spark, s, o), ["g"]).first().auroc

    assert auc([0.9, 0.9, 0.2, 0.1], [1, 0, 1, 0]) == 0.625
    assert auc([0.1, 0.2, 0.3], [1, 1, 1]) is None
    rng = random.Random(1)
    s = [round(rng.uniform(-0.5, 1.5), 2) for _ in range(400)]
    o = [int(rng.random() < 0.4) for _ in s]
    won = [(a > b) + (a == b) / 2 for a, x in zip(s, o, strict=True) if x for b, y in zip(s, o, strict=True) if not y]
    assert auc(s, o) == pytest.approx(sum(won) / len(won))


def records(spark):
    rows = []
    for d in ("gsm8k", "math", "gsm_plus"):
        for k, (correct, entropy, agree, answer, seq, majority, share) in enumerate(
            [(1, 0.9, 0.8, 0.8, 0.7, 0, 0.9), (0, 0.1, 0.2, None, 0.3, 0, 0.8), (1, 0.8, 0.7, 0.7, 0.6, 1, 0.7), (0, 0.2, 0.3, 0.3, 0.4, 1, 0.6), (None, 0.5, 0.5, None, 0.5, None, 0.5)]
        ):
            rows.append((d, k, correct, entropy, agree, answer, seq, majority, share))
    return spark.createDataFrame(rows, "dataset string, k int, correct int, entropy double, agree double, answer double, seq double, majority_correct int, share double")


NAMES = {"entropy": "entropy", "agreement": "agree", "answer": "answer", "sequence": "seq"}


def test_report_rows(spark):
    found = metrics.report_metrics(records(spark).where("k < 4"), ["dataset"], NAMES, ["entropy", "agreement"], "share").collect()
    assert len(found) == 21
    by = {(r.dataset, r.analysis, r.signal): r for r in found}
    assert (by["math", "greedy", "entropy"].n, by["math", "greedy", "entropy"].auroc) == (4, 1.0)
    assert by["math", "majority", "majority_vote_share"].auroc == 0.0
    assert by["math", "greedy", "answer"].coverage == 0.75
    table = spark.createDataFrame(found)
    m = {r.signal: r for r in metrics.macro(table, 3, True).collect()}
    assert m["entropy"].macro_auroc == 1.0 and m["entropy"].eligible_for_recommendation and not m["answer"].eligible_for_recommendation
    assert metrics.macro(table, 4, True).where("macro_auroc IS NOT NULL").count() == 0


def test_paired_denominator(spark):
    r = records(spark).withColumn("entropy", F.when(~((F.col("k") == 0) & (F.col("dataset") == "math")), F.col("entropy")))
    found = metrics.report_metrics(r, ["dataset"], NAMES, ["entropy", "agreement"], "share").where("analysis = 'paired_primary' AND dataset = 'math'").collect()
    assert {(x.n, x.scorable_n, x.coverage, x.auroc) for x in found} == {(3, 4, 0.75, 1.0)}


def test_empty_groups_come_out(spark):
    domain = spark.createDataFrame([("none",), ("math",)], "dataset string")
    found = metrics.report_metrics(records(spark), ["dataset"], NAMES, ["entropy"], "share", domain).where("dataset = 'none'").collect()
    assert len(found) == 6 and {(r.n, r.scorable_n, r.coverage, r.ece, r.auroc) for r in found} == {(0, 0, 0.0, None, None)}


def test_summary_and_gate(spark):
    rows = [(d, "parsed" if not (d == "math" and i < 2) else "unanswerable", "1", None if d == "gsm8k" and i == 5 else 1, True, 8, 8, 0, 0, None if d == "gsm8k" and i == 1 else 0, 0.5) for d in ("gsm8k", "math") for i in range(20)]
    r = spark.createDataFrame(rows, "dataset string, gold_status string, gold_answer string, correct int, prediction_parseable boolean, sample_count int, parseable_count int, parse_unknown int, agreement_unknown int, comparison_unknown int, e double")
    selected = spark.createDataFrame([("gsm8k", 20), ("math", 20), ("absent", 5)], "dataset string, selected_rows bigint")
    s = metrics.dataset_summary(r, selected, {"e": "e"})
    by = {x.dataset: x for x in s.collect()}
    assert by["gsm8k"].outcome_label_coverage == 0.95 and by["math"].source_scorable_fraction == 0.9
    assert by["gsm8k"].majority_comparison_unknown_count is None and by["math"].majority_comparison_unknown_count == 0
    assert (by["absent"].total_rows, by["absent"].source_scorable_fraction, by["absent"].greedy_accuracy) == (0, 0.0, None)
    assert not metrics.coverage_gate(s).first().valid
    assert metrics.coverage_gate(s.limit(0)).first().valid


def test_accounting(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "example_id string")
    assert tuple(metrics.run_accounting(ids("a", "b", "c"), ids("a"), ids("b")).first()) == (3, 1, 1, 1, False)
    assert metrics.run_accounting(ids("a"), ids("a"), ids()).first().run_complete
    for bad in [(ids("a", "a"), ids(), ids()), (ids("a"), ids("z"), ids())]:
        with pytest.raises(Exception, match="ids"):
            metrics.run_accounting(*bad).collect()


def test_recommendation():
    assert metrics.recommendation(False, "mini_12h")["status"] == "insufficient"
    assert "111" in metrics.recommendation(True, "mini_12h")["reason"] and "smoke" in metrics.recommendation(True, "smoke")["reason"]


def test_auroc_of_any_score_range(spark):
    """Slices follow the magnitude of scores: negative, tiny, huge, infinite, and tied ones."""
    rng = random.Random(5)
    scores = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)] + [0.0, -0.0, 1.0, 1.0, 1.5, 1.5, float("inf"), float("-inf"), 5e-324, -5e-324] * 3
    rows = [(s, int(rng.random() < 0.4)) for s in scores]
    won = sum((a > b) + (a == b) / 2 for a, x in rows for b, y in rows if x and not y)
    expected = won / (sum(x for _, x in rows) * sum(1 - x for _, x in rows))
    df = spark.createDataFrame([("g", s, o) for s, o in rows], "g string, score double, outcome int")
    assert metrics.auroc(df, ["g"]).first().auroc == pytest.approx(expected, abs=1e-12)


def test_no_slice_holds_a_whole_group(spark):
    df = spark.range(20000).select(metrics.score_slice((F.col("id") + 1) * 1.0).alias("s"), metrics.score_slice(F.lit(0.5) + F.col("id") / 50000).alias("t"))
    for c in ("s", "t"):
        assert df.groupBy(c).count().agg(F.max("count")).first()[0] < 200
