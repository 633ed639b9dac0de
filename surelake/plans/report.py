"""The report of a run: metrics, bins, summary and text, from its log, stages and manifest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.operators import metrics
from surelake.plans.plots import reliability_svg
from surelake.sources import checkpoints, sinks

# The signals of a report and where records keep them.
GREEDY = {
    "entropy_confidence": "greedy.entropy_confidence",
    "sequence_geometric_probability": "greedy.sequence_geometric_probability",
    "answer_token_geometric_probability": "greedy.answer_token_geometric_probability",
    "self_consistency_agreement": "self_consistency.greedy_agreement_share",
}
PRIMARY = ["entropy_confidence", "self_consistency_agreement"]
MAJORITY = "self_consistency.majority_vote_share"


def flat(records: DataFrame) -> DataFrame:
    """What the metrics need of each record; token arrays and texts are not read."""
    c = lambda n: F.col(f"self_consistency.{n}")
    return records.select(
        "example_id", F.col("source.dataset").alias("dataset"), "execution_origin", F.col("source.gold_status").alias("gold_status"), "gold_answer", F.col("greedy.correct").cast("int").alias("correct"),
        c("majority_correct").cast("int").alias("majority_correct"), F.col("greedy.prediction_parseable").alias("prediction_parseable"), c("sample_count").alias("sample_count"), c("sample_answer_parseable_count").alias("parseable_count"),
        c("sample_answer_parse_unknown_count").alias("parse_unknown"), c("greedy_agreement_unknown_count").alias("agreement_unknown"), c("majority_comparison_unknown_count").alias("comparison_unknown"),
        *(F.col(path).alias(name) for name, path in GREEDY.items()), F.col(MAJORITY).alias("share"),
    )


def scorable(rows: DataFrame) -> DataFrame:
    return rows.where("gold_status = 'parsed' AND gold_answer IS NOT NULL")


def report(records: DataFrame, selected: DataFrame) -> dict[str, DataFrame]:
    """metrics, bins, by_execution, summary and points. selected: example_id of all selected rows; its prefix is the dataset."""
    rows = flat(records)
    signals = {name: name for name in GREEDY}
    chosen = selected.select(F.substring_index("example_id", ":", 1).alias("dataset"))
    datasets = chosen.distinct()
    good = scorable(rows)
    long = metrics.report_rows(good, ["dataset"], signals, PRIMARY, "share")
    pairs = long.withColumn("score", metrics.valid_score("score")).where("score IS NOT NULL AND outcome IS NOT NULL")
    origins = rows.where("length(execution_origin) > 0").select("execution_origin").distinct()
    domain = datasets.agg(F.collect_set("dataset").alias("d")).join(origins.agg(F.collect_set("execution_origin").alias("o"))).select(F.explode("d").alias("dataset"), "o").select("dataset", F.explode("o").alias("execution_origin"))
    return {
        "metrics": metrics.report_metrics(good, ["dataset"], signals, PRIMARY, "share", datasets),
        "bins": metrics.calibration_bins(pairs, ["analysis", "dataset", "signal"]),
        "by_execution": metrics.report_metrics(good.where("length(execution_origin) > 0"), ["dataset", "execution_origin"], signals, PRIMARY, "share", domain),
        "summary": metrics.dataset_summary(rows, chosen.groupBy("dataset").agg(F.count("*").alias("selected_rows")), signals),
        "points": metrics.reliability_points(metrics.signals_to_rows(rows, ["dataset"], signals, "correct", "greedy").unionByName(metrics.signals_to_rows(rows, ["dataset"], {"majority_vote_share": "share"}, "majority_correct", "majority")), ["dataset", "signal"]),
    }


def execution_counts(records: DataFrame) -> dict[str, int]:
    """Records of each execution origin, all of which summary.json lists."""
    return {r[0]: r[1] for r in records.where("length(execution_origin) > 0").groupBy("execution_origin").count().collect()}


def with_hardware(rows: DataFrame, known: dict, origin: str = "execution_origin") -> DataFrame:
    """rows with the hardware that the manifest names for their origin, or else the origin itself."""
    named = [(k, v["gpu_name"]) for k, v in known.items() if isinstance(v, dict) and v.get("gpu_name")]
    table = rows.sparkSession.createDataFrame(named, f"{origin} string, __named string")  # as long as the manifest, so it may be broadcast
    return rows.join(F.broadcast(table), origin, "left").withColumn("hardware", F.coalesce("__named", origin)).drop("__named")


def executions(records: DataFrame, known: dict) -> dict[str, dict]:
    """Of each origin: its rows, its rows by dataset and its hardware."""
    counts = records.where("length(execution_origin) > 0").groupBy("execution_origin", F.col("source.dataset").alias("dataset")).count()
    out: dict[str, dict] = {}
    for r in with_hardware(counts, known).collect():
        one = out.setdefault(r.execution_origin, {"row_count": 0, "by_dataset": {}, "hardware": r.hardware})
        one["row_count"] += r["count"]
        one["by_dataset"][r.dataset] = r["count"]
    return out


def _shown(rows: list, fields: list[str]) -> str:
    """A table in which numbers have three digits."""
    return sinks.markdown_table([{f: f"{r[f]:.3f}" if isinstance(r[f], float) else r[f] for f in fields} for r in rows], fields)


def report_text(summary: dict, rows: list, by_execution: list) -> str:
    """report.md."""
    s, why = list(summary["datasets"].values()), summary["recommendation"]
    parts = [
        "# Reliability report", "",
        f"Run `{summary['run_id']}` of profile `{summary['profile']}`, status `{summary['run_status']}`: {summary['completed_count']} of {summary['selected_count']} rows completed, {summary['failed_count']} failed, {summary['pending_count']} pending.", "",
        f"Recommendation: **{why['status']}**, signal `{why['signal'] or 'none'}`. {why['reason']}", "",
        "Greedy rows predict whether the greedy answer is right, each signal on the rows that have it; paired_primary rows do so on the rows that have all primary signals; majority rows predict the majority's answer. Checks that ran out of time or failed are unknown and never count as wrong. Figures describe this run; there are no intervals.", "",
        "## Unknown checks", "", sinks.markdown_table(s, ["dataset", "sample_answer_parse_unknown_count", "greedy_agreement_unknown_count", "majority_comparison_unknown_count"]) if s else "", "",
        "## Coverage of outcomes", "",
        f"A signal can only be recommended if {metrics.MIN_SCORABLE_FRACTION:.0%} of the selected rows of every dataset are scorable and all of those have an outcome.", "",
        _shown(s, ["dataset", "selected_rows", "source_scorable_rows", "source_scorable_fraction", "scorable_rows", "outcome_label_coverage", "unknown_outcome_label_count"]) if s else "", "",
    ]
    if summary["executions"]:
        names = sorted({d for e in summary["executions"].values() for d in e["by_dataset"]})
        table = [{"execution": o, "hardware": e["hardware"], "rows": e["row_count"], **{d: e["by_dataset"].get(d, 0) for d in names}} for o, e in sorted(summary["executions"].items())]
        parts += ["## Where it ran", "", sinks.markdown_table(table, ["execution", "hardware", "rows", *names]), ""]
    parts += ["## Metrics", "", _shown(rows, sinks.METRIC_FIELDS), ""]
    if by_execution:
        parts += ["## Metrics by execution", "", _shown(by_execution, ["execution_origin", *sinks.METRIC_FIELDS]), ""]
    parts += ["## Limits", "", "Entropy confidence measures how concentrated the model's choices are, not how likely it is to be right. Whether a student would learn more from gated answers is not measured here.", ""]
    return "\n".join(parts)


def diagrams(points: DataFrame, datasets: list[str]) -> dict[str, str]:
    """A reliability diagram of every signal for each dataset. points: at most a few bins a signal."""
    rows = points.orderBy("dataset", "signal", "bin_index").collect()
    out = {}
    for d in datasets:
        panels = []
        for s in [*GREEDY, "majority_vote_share"]:
            own = [r.asDict() for r in rows if r["dataset"] == d and r["signal"] == s]
            n = sum(r["count"] for r in own)
            error = sum(r["count"] * abs(r["mean_confidence"] - r["accuracy"]) for r in own) / n if n else 0.0
            panels.append((s, own, f"ECE={error:.3f}, n={n}" if n else ""))
        out[d] = reliability_svg(f"Reliability: {d}", panels)
    return out


def run_report(spark: SparkSession, folder: str) -> dict:
    """Reads run_manifest.json, predictions.jsonl and stages/ of a run, and writes metrics.csv, calibration_bins.csv, metrics_by_execution.csv (if any), summary.json, report.md and reliability_<dataset>.svg beside them."""
    manifest = checkpoints.read_manifest(os.path.join(folder, "run_manifest.json"))
    ids = manifest.get("selected_example_ids", [])
    selected = spark.createDataFrame([(i,) for i in ids], "example_id string")
    records = checkpoints.read_predictions(spark, os.path.join(folder, "predictions.jsonl"))
    staged = os.path.join(folder, "stages")
    failed = selected.limit(0)
    if os.path.isdir(staged) and any(x.endswith(".json") for x in os.listdir(staged)):
        failed = checkpoints.staged_failures(checkpoints.read_stages(spark, staged), records, manifest.get("run_signature"))
    count = metrics.run_accounting(selected, records, failed).first()
    tables = report(records, selected)
    summaries = [r.asDict() for r in tables["summary"].orderBy("dataset").collect()]
    missing = [s["dataset"] for s in summaries if not s["total_rows"]]
    complete = bool(manifest.get("status") == "complete" and count.run_complete and not missing and count.selected == manifest.get("selected_example_count", count.selected))
    gate = tables["summary"].transform(metrics.coverage_gate).first().valid
    rows = tables["metrics"].orderBy("dataset", "ordinal").collect()
    macro = metrics.macro(spark.createDataFrame(rows, tables["metrics"].schema), len(summaries), gate).collect() if rows else []
    sinks.write_csv(tables["metrics"], os.path.join(folder, "metrics.csv"), sinks.METRIC_FIELDS, ["dataset", "ordinal"])
    sinks.write_csv(tables["bins"], os.path.join(folder, "calibration_bins.csv"), sinks.BIN_FIELDS, ["dataset", "analysis", "signal", "bin_index"])
    if tables["by_execution"].limit(1).count():
        sinks.write_csv(tables["by_execution"], os.path.join(folder, "metrics_by_execution.csv"), ["execution_origin", *sinks.METRIC_FIELDS], ["execution_origin", "dataset", "ordinal"])
    profile = (manifest.get("profile") or {}).get("name", "unknown")
    summary = {
        "run_status": manifest.get("status", "unknown"), "profile": profile, "run_complete": complete, "missing_datasets": missing, "selected_count": count.selected, "completed_count": count.completed, "failed_count": count.failed,
        "pending_count": count.pending, "coverage_gate_valid": gate, "datasets": {s["dataset"]: s for s in summaries}, "macro": {m.signal: m.asDict() for m in macro}, "recommendation": metrics.recommendation(complete, profile),
        "by_execution": execution_counts(records), "executions": executions(records, manifest.get("execution_origins") or {}), "run_id": manifest.get("run_id", os.path.basename(os.path.abspath(folder))),
    }
    sinks.atomic_json(os.path.join(folder, "summary.json"), summary)
    origins = tables["by_execution"].orderBy("execution_origin", "dataset", "ordinal").collect() if summary["executions"] else []
    for dataset, drawing in diagrams(tables["points"], sorted(summary["datasets"])).items():
        with open(os.path.join(folder, f"reliability_{dataset}.svg"), "w", encoding="utf-8") as f:
            f.write(drawing)
    text = report_text(summary, rows, origins)
    with open(os.path.join(folder, "report.md"), "w", encoding="utf-8") as f:
        f.write(text)
    return summary
