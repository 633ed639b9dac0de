"""Generations to records to a report, end to end."""

import csv
import json
import math
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from surelake.operators import validation
from surelake.plans import records, report
from surelake.sources import checkpoints, examples

GENERATIONS = f"example_id string, greedy struct<{checkpoints.GREEDY}>, samples array<struct<index:int,text:string,token_ids:array<int>,eos_generated:boolean,was_truncated:boolean,termination_reason:string>>"


def made(spark):
    ids = [f"{d}:c:test:{i}" for d in ("gsm8k", "math", "gsm_plus") for i in range(5)]
    rows = [(i, i.split(":")[0], "r", "c", "test", i[-1], "q", "7" if i[-1] != "4" else None, "s", "parsed" if i[-1] != "4" else "unanswerable", None, None, None) for i in ids]
    table = spark.createDataFrame(rows, examples.SCHEMA)
    generations = []
    for i in ids:
        k = int(i[-1])
        text = f"so \\boxed{{{7 if k % 2 == 0 else 8}}}"
        spans = [[0, 3], [3, len(text)], None]
        greedy = {"text": text, "token_ids": [1, 2, 3], "token_entropies_nats": [0.1 * k, 0.2, 9.0], "token_logprobs": [-0.1, -0.2 * (k + 1), -9.0], "token_char_spans": spans, "content_token_mask": [True, True, False], "token_alignment_status": "aligned", "eos_generated": True, "was_truncated": False, "termination_reason": "eos"}
        samples = [{"index": s, "text": f"\\boxed{{{7 if s <= k else 8}.0}}", "token_ids": [1], "eos_generated": True, "was_truncated": False, "termination_reason": "eos"} for s in range(4)]
        generations.append({"example_id": i, "greedy": greedy, "samples": samples})
    return ids, records.prediction_records(table, spark.createDataFrame(generations, GENERATIONS), 50, 42, "here")


def test_end_to_end(spark, tmp_path):
    ids, found = made(spark)
    checked = validation.violations(found, validation.record_rules(42, 4, 10))
    assert {tuple(r.violations) for r in checked.collect()} == {()}
    by = {r.example_id: r for r in found.collect()}
    r = by["math:c:test:0"]
    assert (r.greedy.predicted_answer, r.greedy.correct, r.greedy.answer_token_count, r.self_consistency.majority_answer, r.self_consistency.greedy_agreement_share) == ("7", True, 1, "8.0", 0.25)
    assert r.greedy.answer_token_geometric_probability == pytest.approx(math.exp(-0.2))
    assert (by["math:c:test:1"].greedy.correct, by["math:c:test:4"].greedy.correct, by["math:c:test:4"].greedy.grading_status) == (False, None, "missing_gold")

    receipts = records.receipts(found, "s")
    digests = receipts.select("example_id", "record_sha256")
    assert validation.digest_mismatches(digests, receipts).count() == 0

    stages = found.select("example_id", F.col("greedy").alias("g"), F.col("samples").alias("s")).select("example_id", F.struct(*(F.col(f"g.{c}").alias(c) for c in validation._GENERATED)).alias("greedy"), F.map_from_entries(F.transform("s", lambda x: F.struct(x["index"].cast("string"), F.struct(x["seed"].alias("seed"), F.struct(*(x[a].alias(b) for a, b in validation._SAMPLED.items())).alias("generation"))))).alias("samples"))
    assert validation.integrity(found, receipts, stages, 42, 4).count() == 0
    changed = found.withColumn("greedy", F.when(F.col("example_id") == ids[0], F.col("greedy").withField("predicted_answer", F.lit("9"))).otherwise(F.col("greedy")))
    assert [(r.example_id, r.violations) for r in validation.integrity(changed, receipts, stages, 42, 4).collect()] == [(ids[0], ["receipt", "greedy answer of the text"])]
    lost = validation.integrity(found, receipts.where(F.col("example_id") != ids[1]), stages.where(F.col("example_id") != ids[2]), 42, 4)
    assert {r.example_id: r.violations[0] for r in lost.collect()} == {ids[1]: "receipt", ids[2]: "stage"}
    table = found.sparkSession.createDataFrame([(i, i.split(":")[0], "r", "c", "test", i[-1], "q", "7" if i[-1] != "4" else None, "s", "parsed" if i[-1] != "4" else "unanswerable", None, None, None) for i in ids[:-1]], examples.SCHEMA)
    beside = validation.violations(validation.beside_examples(found, table), validation.source_rules("here")).where("size(violations) > 0").collect()
    assert [(r.example_id, r.violations[0]) for r in beside] == [(ids[-1], "example")]

    compact = records.compact_rows(found)
    assert [x.example_id for x in compact.collect()][:5] == ids[:5] and set(records.SAMPLE_FIELDS) < set(compact.columns)

    assert records.write_samples(found, str(tmp_path / "export"), "r1") == 15
    exported = list(csv.DictReader(open(tmp_path / "export" / "sample_rows.csv")))
    assert [r["example_id"] for r in exported] == [r.example_id for r in compact.collect()] and exported[0]["sample_answers"] == "7.0 | 8.0 | 8.0 | 8.0"
    assert len((tmp_path / "export" / "sample_rows.jsonl").read_text().splitlines()) == 15
    shown = (tmp_path / "export" / "SAMPLE.md").read_text()
    assert shown.index("### GSM8K") < shown.index("### MATH") < shown.index("### GSM-Plus") and "Sure and right" in shown and shown.count("| `") == 15

    log = tmp_path / "predictions.jsonl"
    log.write_text("".join(x.j + "\n" for x in found.select(F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}).alias("j")).collect()))
    manifest = {"status": "complete", "selected_example_ids": ids, "selected_example_count": 15, "run_signature": "s", "profile": {"name": "smoke"}, "execution_origins": {"here": {"gpu_name": "a card"}}}
    (tmp_path / "run_manifest.json").write_text(json.dumps(manifest))
    summary = report.run_report(spark, str(tmp_path))
    assert summary["run_complete"] and summary["datasets"]["math"]["source_scorable_rows"] == 4 and summary["recommendation"]["status"] == "exploratory"
    rows = list(csv.DictReader(open(tmp_path / "metrics.csv")))
    assert len(rows) == 21 and {r["n"] for r in rows if r["analysis"] == "greedy"} == {"4"}
    assert len(list(csv.DictReader(open(tmp_path / "metrics_by_execution.csv")))) == 21
    assert len(list(csv.DictReader(open(tmp_path / "calibration_bins.csv")))) == 21 * 15
    text = (tmp_path / "report.md").read_text()
    assert "| math | greedy |" in text.replace("greedy | math", "math | greedy") and "| here | a card | 15 | 5 | 5 | 5 |" in text and "## Metrics by execution" in text
    assert summary["executions"] == {"here": {"row_count": 15, "by_dataset": {d: 5 for d in ("gsm8k", "math", "gsm_plus")}, "hardware": "a card"}}
    assert json.load(open(tmp_path / "summary.json"))["completed_count"] == 15
    drawing = ElementTree.parse(tmp_path / "reliability_math.svg").getroot()
    titles = [t.text for t in drawing.iter("{http://www.w3.org/2000/svg}text")]
    assert len(list(drawing.iter("{http://www.w3.org/2000/svg}polyline"))) == 5 and "majority vote share" in titles and sum("n=4" in t for t in titles) == 5


EXPECTED = {"status": "complete", "profile": "smoke", "seed": 42, "revisions": {"gsm8k": "r", "math": "r", "gsm_plus": "r"}, "datasets": {"gsm8k": 5, "math": 5, "gsm_plus": 5}, "math_subjects": {"c": 5}, "sample_count": 4, "manifest": {"model": "m"}}


def test_what_keeps_a_run_from_being_training_input(spark):
    ids, found = made(spark)
    good = {"status": "complete", "seed": 42, "profile": {"name": "smoke"}, "revisions": EXPECTED["revisions"], "selected_example_ids": ids, "completed_example_count": 15, "model": "m"}
    found = spark.createDataFrame(found.collect(), found.schema)
    assert validation.check_teacher_run(good, found, EXPECTED) == []
    for change, wrong in [({"status": "partial"}, "status"), ({"model": "x"}, "manifest model"), ({"selected_example_ids": ids[:-1] + ids[:1]}, "selected ids"), ({"failed_example_count": 1}, "row accounting"), ({"selected_example_ids": ids[:-1] + ["z"]}, "row ids"), ({"seed": 7}, "seed")]:
        assert wrong in validation.check_teacher_run(good | change, found, EXPECTED)
    assert validation.check_teacher_run(good, found.unionByName(found.limit(1)), EXPECTED)[0] == "row ids"
    other = found.withColumn("samples", F.reverse("samples")).withColumn("source", F.col("source").withField("revision", F.lit("q")))
    assert validation.check_teacher_run(good, other, EXPECTED) == ["row revision", "row samples"]


def test_incomplete_run(spark, tmp_path):
    ids, found = made(spark)
    kept = found.where("example_id NOT LIKE '%:4'")
    (tmp_path / "predictions.jsonl").write_text("".join(x.j + "\n" for x in kept.select(F.to_json(F.struct(*found.columns)).alias("j")).collect()))
    (tmp_path / "run_manifest.json").write_text(json.dumps({"status": "partial", "selected_example_ids": ids, "run_signature": "s", "profile": {"name": "mini_12h"}}))
    (tmp_path / "stages").mkdir()
    (tmp_path / "stages" / "a.json").write_text(json.dumps({"run_signature": "s", "example_id": "math:c:test:4", "failure": "oom", "samples": {}}))
    summary = report.run_report(spark, str(tmp_path))
    assert (summary["completed_count"], summary["failed_count"], summary["pending_count"], summary["run_complete"]) == (12, 1, 2, False)
    assert summary["recommendation"]["status"] == "insufficient"


def test_more_origins_than_a_thousand(spark):
    rows = [(f"o{i % 1001}",) for i in range(1500)] + [("",), (None,)]
    found = report.execution_counts(spark.createDataFrame(rows, "execution_origin string"))
    assert found == {f"o{i}": 2 if i < 499 else 1 for i in range(1001)}
