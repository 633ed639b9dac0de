"""From generations to prediction records, and compact rows of those."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.functions import answers, grading
from surelake.operators import confidence
from surelake.operators.selection import sample_seed

SAMPLE_FIELDS = ["example_id", "dataset", "subject_or_perturbation", "gold_answer", "greedy_answer", "greedy_correct", "greedy_tokens", "greedy_truncated", "entropy_confidence", "sequence_probability", "answer_token_probability", "agreement_share", "majority_answer", "majority_share", "majority_correct", "sample_answers", "question"]


def prediction_records(examples: DataFrame, generations: DataFrame, vocab_size: int, base_seed: int, origin: str | None = None) -> DataFrame:
    """Graded records of examples with their generations: (example_id, greedy struct, samples array of structs with index, text, token_ids, eos_generated, was_truncated, termination_reason).

    One join by id; span, grade, confidence and votes are columns. A greedy answer is graded once, samples by their keys.
    """
    rows = examples.join(generations, "example_id")
    rows = rows.withColumn("span", answers.answer_span("greedy.text"))
    sample_answers = answers.answer_spans(F.transform("samples", lambda s: s["text"]))
    rows = rows.withColumn("answers", sample_answers)
    values = F.transform("answers", lambda a: a["value"])
    rows = rows.withColumns({"grade": grading.grade_answer(F.col("span.value"), F.col("gold_answer")), "votes": grading.summarize_consistency(F.col("span.value"), values, F.col("gold_answer"))})
    spans = F.transform("greedy.token_char_spans", lambda s: F.when(s.isNotNull(), F.struct(F.get(s, F.lit(0)).alias("start"), F.get(s, F.lit(1)).alias("end"))))
    scores = confidence.token_confidence(F.col("greedy.token_entropies_nats"), F.col("greedy.token_logprobs"), spans, F.col("greedy.content_token_mask"), F.col("span.start"), F.col("span.end"), vocab_size)
    rows = rows.withColumn("scores", scores)
    kept = ["text", "token_ids", "token_entropies_nats", "token_logprobs", "token_char_spans", "content_token_mask", "token_alignment_status", "eos_generated", "was_truncated", "termination_reason"]
    greedy = F.struct(
        *(F.col(f"greedy.{c}").alias(c) for c in kept), F.col("span.value").alias("predicted_answer"), F.col("span.method").alias("answer_method"), F.col("grade.prediction_parseable").alias("prediction_parseable"),
        F.col("grade.gold_parseable").alias("gold_parseable"), F.col("grade.correct").alias("correct"), F.col("grade.status").alias("grading_status"),
        *(F.col(f"scores.{c}").alias(c) for c in ("content_token_count", "mean_entropy_nats", "entropy_confidence", "sequence_logprob_sum", "sequence_geometric_probability", "answer_token_count", "answer_token_geometric_probability", "answer_alignment_status")),
    )
    samples = F.transform(
        F.arrays_zip("samples", "answers"),
        lambda z: F.struct(
            z["samples"]["index"].alias("index"), sample_seed(base_seed, F.col("example_id"), z["samples"]["index"]).alias("seed"), z["samples"]["text"].alias("text"), z["samples"]["token_ids"].alias("token_ids"),
            z["answers"]["value"].alias("answer"), z["answers"]["method"].alias("answer_method"), z["samples"]["eos_generated"].alias("eos_generated"), z["samples"]["was_truncated"].alias("was_truncated"), z["samples"]["termination_reason"].alias("termination_reason"),
        ),
    )
    source = F.struct(
        "dataset", F.col("source_config").alias("config"), "split", F.col("source_row_id").alias("row_id"), F.col("source_revision").alias("revision"), "gold_status", "subject", "perturbation_type", "seed_question_id"
    )
    return rows.select(
        "example_id", F.lit("complete").alias("status"), source.alias("source"), "question", "gold_answer", greedy.alias("greedy"), samples.alias("samples"), F.col("votes").alias("self_consistency"),
        F.size("samples").alias("requested_sample_count"), F.lit(origin).cast("string").alias("execution_origin"),
    )


def compact_rows(records: DataFrame) -> DataFrame:
    """A flat row for each record, scores rounded to 3 digits, ordered by dataset and id."""
    third = F.when(F.col("source.dataset") == "math", F.coalesce(F.nullif(F.col("source.subject"), F.lit("")), F.col("source.config"))).otherwise(F.col("source.perturbation_type"))
    g, c = (lambda n: F.col(f"greedy.{n}")), (lambda n: F.col(f"self_consistency.{n}"))
    rounded = answers.round_half_even
    rank = F.when(F.col("dataset") == "gsm8k", 0).when(F.col("dataset") == "math", 1).otherwise(2)
    return records.select(
        "example_id", F.col("source.dataset").alias("dataset"), third.alias("subject_or_perturbation"), "gold_answer", g("predicted_answer").alias("greedy_answer"), g("correct").alias("greedy_correct"),
        F.greatest(F.size(g("token_ids")), F.lit(0)).alias("greedy_tokens"), g("was_truncated").alias("greedy_truncated"), rounded(g("entropy_confidence")).alias("entropy_confidence"),
        rounded(g("sequence_geometric_probability")).alias("sequence_probability"), rounded(g("answer_token_geometric_probability")).alias("answer_token_probability"), rounded(c("greedy_agreement_share")).alias("agreement_share"),
        c("majority_answer").alias("majority_answer"), rounded(c("majority_vote_share")).alias("majority_share"), c("majority_correct").alias("majority_correct"), F.transform("samples", lambda s: s["answer"]).alias("sample_answers"),
        "question", g("text").alias("greedy_text"),
    ).orderBy(rank, "example_id")


def digests(records: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, record_sha256): the digest of each record's canonical JSON, with sorted keys, no blanks, no escapes and Python's shortest numbers; nulls are part of it."""

    def work(frames):
        for f in frames:
            yield f.assign(record_sha256=[answers.canonical_digest(json.loads(t)) for t in f["record"]])[[key, "record_sha256"]]

    texts = records.select(key, F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("record"))
    return texts.mapInPandas(work, f"`{key}` {dict(records.dtypes)[key]}, record_sha256 string")


def receipts(records: DataFrame, signature: str) -> DataFrame:
    """A row for each record with its digest, made by the same function that compares it later."""
    return digests(records).select(F.lit(1).alias("schema_version"), F.lit(signature).alias("run_signature"), "example_id", "record_sha256")


# How datasets are shown, in their order.
LABELS = {"gsm8k": "GSM8K", "math": "MATH", "gsm_plus": "GSM-Plus"}
_TABLE = ["subject_or_perturbation", "gold_answer", "greedy_answer", "greedy_correct", "entropy_confidence", "agreement_share", "majority_answer", "majority_share", "majority_correct", "greedy_tokens"]


def _worked(title: str, r, longest: int = 1200) -> list[str]:
    text = (r["greedy_text"] or "").strip()
    text = text if len(text) <= longest else text[:longest].rstrip() + "\n…(cut for display)"
    quoted = "> " + (r["question"] or "").strip().replace("\n", "\n> ")
    verdict = "right" if r["greedy_correct"] else "wrong"
    facts = f"Gold `{r['gold_answer']}`, answered `{r['greedy_answer']}` ({verdict}); entropy confidence {r['entropy_confidence']}, sequence probability {r['sequence_probability']}; {r['agreement_share']} of the samples agree, the majority says `{r['majority_answer']}` at {r['majority_share']}."
    return [f"### {title}", "", f"`{r['example_id']}` ({LABELS.get(r['dataset'], r['dataset'])})", "", quoted, "", facts, "", "Samples: " + ", ".join(f"`{a}`" for a in r["sample_answers"]), "", "```text", text, "```", ""]


def write_samples(records: DataFrame, folder: str, run_id: str) -> int:
    """sample_rows.csv, sample_rows.jsonl and SAMPLE.md of a run; returns the number of rows.

    For people to read, so for runs of a size that they can; rows pass through the driver one at a time, and overview and
    worked examples are aggregated by Spark.
    """
    from surelake.operators import training
    from surelake.sources.sinks import markdown_table

    rows = compact_rows(records).persist()  # read four times
    os.makedirs(folder, exist_ok=True)
    overview = {r["dataset"]: r.asDict() for r in training.overview(rows).collect()}
    order = [d for d in LABELS if d in overview] + sorted(set(overview) - set(LABELS))
    share = lambda r, n: f"{r[n]} ({r[n] / r['scorable']:.1%})" if r["scorable"] else str(r[n])
    shown = [{"dataset": LABELS.get(d, d), "questions": r["questions"], "scorable": r["scorable"], "greedy_right": share(r, "greedy_right"), "majority_right": share(r, "majority_right"), **{n: None if r[n] is None else f"{r[n]:.2f}" for n in ("agreement_right", "agreement_wrong")}} for d in order for r in [overview[d]]]
    text = [f"# Rows of run `{run_id}`", "", "## Overview", "", markdown_table(shown, list(shown[0]) if shown else ["dataset"]), "", "## Worked examples", ""]
    ordinal = F.struct(F.when(F.col("dataset") == "gsm8k", 0).when(F.col("dataset") == "math", 1).otherwise(2), F.col("example_id"))
    picked = training.exemplars(rows.withColumn("ordinal", ordinal)).first().asDict()
    found = {r["example_id"]: r for r in rows.where(F.col("example_id").isin([v for v in picked.values() if v])).collect()}
    for name, title in (("confident_right", "Sure and right"), ("flagged_wrong", "Wrong, and few samples agree"), ("confident_wrong", "Wrong though the samples agree")):
        if picked[name]:
            text += _worked(title, found[picked[name]])
    text += ["## All rows", "", "✓ right, ✗ wrong, — unknown.", ""]
    n, last = 0, None
    with open(os.path.join(folder, "sample_rows.csv"), "w", newline="", encoding="utf-8") as a, open(os.path.join(folder, "sample_rows.jsonl"), "w", encoding="utf-8") as b, open(os.path.join(folder, "SAMPLE.md"), "w", encoding="utf-8") as c:
        table = csv.writer(a)
        table.writerow(SAMPLE_FIELDS)
        c.write("\n".join(text))
        for r in rows.toLocalIterator():
            n += 1
            values = r.asDict()
            table.writerow([" | ".join(str(x) for x in values[f]) if f == "sample_answers" else "" if values[f] is None else values[f] for f in SAMPLE_FIELDS])
            b.write(json.dumps(values, ensure_ascii=False) + "\n")
            if r["dataset"] != last:
                last = r["dataset"]
                c.write(f"\n### {LABELS.get(last, last)}\n\n| example | " + " | ".join(_TABLE) + " |\n|" + "---|" * (len(_TABLE) + 1) + "\n")
            c.write(f"| `{r['example_id'].split(':')[-1]}` | " + " | ".join(answers.markdown_cell(values[f]) for f in _TABLE) + " |\n")
    rows.unpersist()
    return n
