"""Records held against tables of rules: each broken rule is named, none stops at the first."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surelake.operators.selection import sample_seed


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with ``violations``, the names of the rules that are false or unknown."""
    holds = {name: F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    broken = F.array(*(F.when(~ok, F.lit(name)) for name, ok in holds.items()))
    # Rows that break none, as nearly all do, are told by compiled code; names are looked for in the others only.
    return rows.withColumn("violations", F.when(reduce(and_, holds.values(), F.lit(True)), F.array().cast("array<string>")).otherwise(F.array_compact(broken)))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def generation_rules(g: str, max_new_tokens: int) -> dict[str, Column]:
    """What holds of every greedy generation: struct column ``g``."""
    tokens, spans = F.col(f"{g}.token_ids"), F.col(f"{g}.token_char_spans")
    vectors = [F.col(f"{g}.{c}") for c in ("token_entropies_nats", "token_logprobs", "content_token_mask")]
    good_span = lambda s: s.isNull() | (F.size(s) == 2) & (F.get(s, F.lit(0)) >= 0) & (F.get(s, F.lit(1)) >= F.get(s, F.lit(0)))
    return {
        "greedy token ids": F.col(f"{g}.text").isNotNull() & F.forall(tokens, lambda t: F.coalesce(t >= 0, F.lit(False))),
        "greedy length": F.size(tokens) <= max_new_tokens,
        "greedy scores per token": (F.size(vectors[0]) == F.size(tokens)) & (F.size(vectors[1]) == F.size(tokens)) & (F.size(vectors[2]) == F.size(tokens)),
        "greedy score range": F.forall(vectors[0], lambda x: _finite(x) & (x >= 0)) & F.forall(vectors[1], lambda x: _finite(x) & (x <= 1e-7)) & F.forall(vectors[2], lambda x: x.isNotNull()),
        "greedy character spans": spans.isNull() | (F.size(spans) == F.size(tokens)) & F.forall(spans, lambda s: F.coalesce(good_span(s), F.lit(False))),
        "greedy termination": F.col(f"{g}.token_alignment_status").isNotNull() & F.col(f"{g}.eos_generated").isNotNull() & F.col(f"{g}.was_truncated").isNotNull() & F.col(f"{g}.termination_reason").isNotNull(),
    }


def stage_rules(seed: int, sample_count: int, max_new_tokens: int) -> dict[str, Column]:
    """Of a saved stage: the greedy part may be missing, samples are keyed 0 to sample_count - 1 with derived seeds."""
    rules = {name: F.col("greedy").isNull() | ok for name, ok in generation_rules("greedy", max_new_tokens).items()}
    entries = F.map_entries("samples")
    index = lambda e: e["key"].try_cast("int")
    tokens = lambda e: e["value"]["generation"]["token_ids"]
    every = lambda f: F.forall(entries, lambda e: F.coalesce(f(e), F.lit(False)))
    return rules | {
        "sample map": F.col("samples").isNotNull(),
        "sample index": every(lambda e: (index(e).cast("string") == e["key"]) & index(e).between(0, sample_count - 1)),
        "sample seed": every(lambda e: e["value"]["seed"] == sample_seed(seed, F.col("example_id"), e["key"])),
        "sample generation": every(lambda e: e["value"]["generation"]["text"].isNotNull() & F.forall(tokens(e), lambda t: F.coalesce(t >= 0, F.lit(False)))),
        "sample length": every(lambda e: F.size(tokens(e)) <= max_new_tokens),
        "sample termination": every(lambda e: e["value"]["generation"]["eos_generated"].isNotNull() & e["value"]["generation"]["was_truncated"].isNotNull() & e["value"]["generation"]["reason"].isNotNull()),
    }


def consistency_rules(c: str, k: int) -> dict[str, Column]:
    """The algebra of vote counts of struct ``c`` over k samples."""
    v = lambda name: F.col(f"{c}.{name}")
    counts = ["sample_answer_parseable_count", "sample_answer_parse_unknown_count", "greedy_agreement_count", "greedy_agreement_unknown_count"]
    within = v("majority_comparison_unknown_count").between(0, k * (k - 1) // 2) & (v("sample_count") == k)
    for name in counts:
        within &= v(name).between(0, k)
    hidden = v("majority_answer").isNull() & v("majority_vote_count").isNull() & v("majority_vote_share").isNull() & v("majority_correct").isNull()
    incomplete = v("majority_grading_status").eqNullSafe(F.lit("majority_comparison_incomplete"))
    shares = F.lit(True)
    for name in ("greedy_agreement_share", "majority_vote_share"):
        shares &= v(name).isNull() | v(name).between(0.0, 1.0)
    return {
        "vote counts": within & (v("majority_vote_count").isNull() | v("majority_vote_count").between(1, k)),
        "vote sums": (v(counts[0]) + v(counts[1]) <= k) & (v(counts[2]) + v(counts[3]) <= k),
        "majority state": F.when(v("majority_comparison_unknown_count") > 0, hidden & incomplete).otherwise(v("majority_vote_count").isNotNull() & v("majority_vote_share").isNotNull() & ~incomplete),
        "vote shares": shares,
        "majority status": v("majority_grading_status").isNotNull(),
    }


def record_rules(seed: int, sample_count: int, max_new_tokens: int) -> dict[str, Column]:
    """Of a final record."""
    samples = F.col("samples")
    every = lambda f: F.forall(samples, lambda s: F.coalesce(f(s), F.lit(False)))
    nonnegative = lambda name: F.coalesce(F.col(f"greedy.{name}") >= 0, F.lit(False))
    scores = F.lit(True)
    for name in ("mean_entropy_nats", "entropy_confidence", "sequence_logprob_sum", "sequence_geometric_probability", "answer_token_geometric_probability"):
        scores &= F.col(f"greedy.{name}").isNull() | _finite(F.col(f"greedy.{name}"))
    return generation_rules("greedy", max_new_tokens) | {
        "identity": (F.length("example_id") > 0) & (F.col("status") == "complete"),
        "greedy grading": F.col("greedy.grading_status").isNotNull() & F.col("greedy.answer_alignment_status").isNotNull(),
        "greedy token counts": nonnegative("content_token_count") & nonnegative("answer_token_count"),
        "greedy confidence scores": scores,
        "requested sample count": F.col("requested_sample_count") == sample_count,
        "sample records": F.size(samples) == sample_count,
        "sample answers": every(lambda s: s["answer"].isNull() == s["answer_method"].isNull()),
        "greedy answer": F.col("greedy.predicted_answer").isNull() == F.col("greedy.answer_method").isNull(),
        "sample indices": F.array_sort(F.transform(samples, lambda s: s["index"])) == F.sequence(F.lit(0), F.lit(sample_count - 1)),
        "sample seeds": every(lambda s: s["seed"] == sample_seed(seed, F.col("example_id"), s["index"])),
        "sample generation": every(lambda s: s["text"].isNotNull() & F.forall(s["token_ids"], lambda t: F.coalesce(t >= 0, F.lit(False)))),
        "sample length": every(lambda s: F.size(s["token_ids"]) <= max_new_tokens),
        "sample termination": every(lambda s: s["eos_generated"].isNotNull() & s["was_truncated"].isNotNull() & s["termination_reason"].isNotNull()),
    } | consistency_rules("self_consistency", sample_count)


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right, and whether the sets are equal. One shuffle of both."""
    marks = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = marks.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = each.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def digest_mismatches(records: DataFrame, receipts: DataFrame, key: str = "example_id", digest: str = "record_sha256") -> DataFrame:
    """Records whose receipt is missing or names another digest."""
    r = receipts.select(F.col(key), F.col(digest).alias("__receipt"))
    return records.join(r, key, "left").where(~F.col(digest).eqNullSafe(F.col("__receipt"))).drop("__receipt")


def content_mismatches(records: DataFrame, examples: DataFrame, columns: list[str], key: str = "example_id") -> DataFrame:
    """Keys whose columns differ between two tables, null equal to null."""
    other = examples.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    equal = F.lit(True)
    for c in columns:
        equal &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return records.join(other, key).where(~equal).select(key)


def source_rules(origin: str | None = None) -> dict[str, Column]:
    """Of a record beside its example, whose columns come as struct ``example``; null equals null."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(f"example.{b}"))
    pairs = {"dataset": "dataset", "config": "source_config", "split": "split", "row_id": "source_row_id", "revision": "source_revision", "gold_status": "gold_status", "subject": "subject", "perturbation_type": "perturbation_type", "seed_question_id": "seed_question_id"}
    rules = {"example": F.col("example.example_id").isNotNull(), "question": same("question", "question"), "gold answer": same("gold_answer", "gold_answer")}
    rules |= {f"source {a}": same(f"source.{a}", b) for a, b in pairs.items()}
    return rules | ({"execution origin": F.col("execution_origin").eqNullSafe(F.lit(origin))} if origin else {})


def beside_examples(records: DataFrame, examples: DataFrame) -> DataFrame:
    return records.join(examples.select("example_id", F.struct(*examples.columns).alias("example")), "example_id", "left")


# What a stage has of a generation, and what a sample's record calls it.
_GENERATED = ("text", "token_ids", "token_entropies_nats", "token_logprobs", "token_char_spans", "content_token_mask", "token_alignment_status", "eos_generated", "was_truncated", "termination_reason")
_SAMPLED = {"text": "text", "token_ids": "token_ids", "eos_generated": "eos_generated", "was_truncated": "was_truncated", "termination_reason": "reason"}


def stage_agreement_rules(seed: int, sample_count: int) -> dict[str, Column]:
    """Of a record beside its stage, whose greedy part and samples come in the columns ``stage_greedy`` and ``stage_samples``."""
    equal = F.lit(True)
    for c in _GENERATED:
        equal &= F.col(f"greedy.{c}").eqNullSafe(F.col(f"stage_greedy.{c}"))
    staged = lambda s: F.try_element_at("stage_samples", s["index"].cast("string"))
    every = lambda f: F.forall("samples", lambda s: F.coalesce(f(s), F.lit(False)))

    def alike(s: Column) -> Column:
        out = F.lit(True)
        for mine, theirs in _SAMPLED.items():
            out &= s[mine].eqNullSafe(staged(s)["generation"][theirs])
        return out

    return {
        "stage": F.col("stage_greedy").isNotNull() & F.col("stage_samples").isNotNull(),
        "greedy as staged": equal,
        "staged samples": F.array_sort(F.map_keys("stage_samples")) == F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(sample_count - 1)), lambda i: i.cast("string"))),
        "sample order": F.transform("samples", lambda s: s["index"]) == F.sequence(F.lit(0), F.lit(sample_count - 1)),
        "sample seeds as staged": every(lambda s: (s["seed"] == staged(s)["seed"]) & (s["seed"] == sample_seed(seed, F.col("example_id"), s["index"]))),
        "samples as staged": every(alike),
    }


def answer_rules() -> dict[str, Column]:
    """Stored answers are those that their texts give: columns ``span`` (of the greedy text) and ``spans`` (of the samples)."""
    mine = lambda s: F.struct(s["answer"].alias("value"), s["answer_method"].alias("method"))
    theirs = F.transform("spans", lambda a: F.struct(a["value"].alias("value"), a["method"].alias("method")))
    return {
        "greedy answer of the text": F.col("greedy.predicted_answer").eqNullSafe(F.col("span.value")) & F.col("greedy.answer_method").eqNullSafe(F.col("span.method")),
        "sample answers of the texts": F.transform("samples", mine).eqNullSafe(theirs),
    }


def integrity(records: DataFrame, receipts: DataFrame, stages: DataFrame, seed: int, sample_count: int) -> DataFrame:
    """(example_id, violations) of records that their receipt, their stage or their own texts contradict.

    Left joins by id: a record without receipt or stage is named too.
    """
    from surelake.functions.answers import answer_span, answer_spans
    from surelake.plans.records import digests

    rows = records.join(digests(records).withColumnRenamed("record_sha256", "digest"), "example_id")
    rows = rows.join(receipts.select("example_id", "record_sha256"), "example_id", "left")
    rows = rows.join(stages.select("example_id", F.col("greedy").alias("stage_greedy"), F.col("samples").alias("stage_samples")), "example_id", "left")
    rows = rows.withColumn("span", answer_span(F.col("greedy.text"))).withColumn("spans", answer_spans(F.transform("samples", lambda s: s["text"])))
    rules = {"receipt": F.col("digest").eqNullSafe(F.col("record_sha256"))} | stage_agreement_rules(seed, sample_count) | answer_rules()
    return violations(rows, rules).where(F.size("violations") > 0).select("example_id", "violations")


def check_teacher_run(manifest: dict, records: DataFrame, expected: dict) -> list[str]:
    """What keeps a run from being training input, by name; nothing if it may be.

    expected: status, profile, seed, revisions, datasets and math_subjects (counts), sample_count, and what else the manifest must have,
    as ``manifest``.
    """
    wrong = [name for name in ("status", "seed") if manifest.get(name) != expected[name]]
    wrong += [f"manifest {name}" for name, value in expected.get("manifest", {}).items() if manifest.get(name) != value]
    if (manifest.get("profile") or {}).get("name") != expected["profile"]:
        wrong.append("profile")
    if manifest.get("revisions") != expected["revisions"]:
        wrong.append("manifest revisions")
    total = sum(expected["datasets"].values())
    ids = manifest.get("selected_example_ids")
    if not isinstance(ids, list) or len(ids) != total or len(set(ids)) != total or manifest.get("selected_example_count", total) != total:
        wrong.append("selected ids")
    if manifest.get("completed_example_count", total) != total or any(manifest.get(f"{k}_example_count", 0) for k in ("failed", "pending", "imported")):
        wrong.append("row accounting")
    chosen = records.sparkSession.createDataFrame([(i,) for i in ids or [] if isinstance(i, str)], "example_id string")
    twice = records.groupBy("example_id").count().where("count > 1 OR example_id IS NULL OR example_id = ''").limit(1).count()
    if twice or not same_keys(records, chosen, "example_id").first().equal:
        wrong.append("row ids")
    # One row more than what is expected is enough to tell that something else is there.
    counted = {r[0]: r[1] for r in records.groupBy("source.dataset").count().limit(len(expected["datasets"]) + 1).collect()}
    subjects = {r[0]: r[1] for r in records.where("source.dataset = 'math'").groupBy("source.config").count().limit(len(expected["math_subjects"]) + 1).collect()}
    if counted != expected["datasets"] or sum(counted.values()) != total:
        wrong.append("dataset counts")
    if subjects != expected["math_subjects"]:
        wrong.append("math subjects")
    k = expected["sample_count"]
    row_rules = {
        "row status": F.col("status") == "complete",
        "row samples": (F.transform("samples", lambda s: s["index"]) == F.sequence(F.lit(0), F.lit(k - 1))) & (F.col("requested_sample_count") == k),
        "row seeds": F.forall("samples", lambda s: F.coalesce(s["seed"] == sample_seed(expected["seed"], F.col("example_id"), s["index"]), F.lit(False))),
        "row revision": F.coalesce(F.create_map(*(F.lit(x) for kv in expected["revisions"].items() for x in kv))[F.col("source.dataset")] == F.col("source.revision"), F.lit(False)),
    }
    broken = violations(records, row_rules).select(F.explode("violations").alias("v")).distinct().limit(10).collect()
    return wrong + sorted(r.v for r in broken)
