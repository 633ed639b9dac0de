"""Sources, sinks, validation, training sets and streaming."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surelake.operators import training, validation, voting
from surelake.operators.selection import Profile, sample_seed, select_examples
from surelake.sources import checkpoints, examples, sinks
from surelake.streaming import ingest


def one(df):
    return df.first()


def test_normalize(spark):
    r = one(examples.normalize(spark.createDataFrame([(17, " Q ", "First try: #### 9\nRecheck: 20 - 8 = 12. #### 12")], "source_row_id int, question string, answer string"), "gsm8k", "main", "test", "r"))
    assert (r.gold_answer, r.example_id, r.gold_status, r.question, r.subject) == ("12", "gsm8k:main:test:17", "parsed", "Q", None)
    r = one(examples.normalize(spark.createDataFrame([(4, "Q", r"\boxed{1} so \boxed{\frac{3}{2}}")], "source_row_id int, problem string, solution string"), "math", "algebra", "test", "r"))
    assert (r.gold_answer, r.subject) == (r"\frac{3}{2}", "algebra")
    plus = "source_row_id int, question string, solution string, answer string, perturbation_type string, seed_question string"
    rows = examples.normalize(spark.createDataFrame([(9, "Q", "s", None, "p", "A b"), (10, "Q", "s", "NONE", "p", " a  B")], plus), "gsm_plus", "default", "test", "r").collect()
    assert {(r.gold_answer, r.gold_status, r.perturbation_type) for r in rows} == {(None, "unanswerable", "p")} and len({r.seed_question_id for r in rows}) == 1
    with pytest.raises(ValueError):
        examples.normalize(spark.range(1), "other", "c", "s", "r")
    with pytest.raises(Exception, match="blank"):
        examples.normalize(spark.createDataFrame([(1, " ", "a")], "source_row_id int, question string, answer string"), "gsm8k", "main", "test", "r").collect()


def test_read_examples(spark, tmp_path):
    sha = "a" * 40
    spark.createDataFrame([(0, "Q", "#### 1")], "source_row_id int, question string, answer string").write.parquet(f"{tmp_path}/gsm8k/main/revision={sha}")
    found = examples.read_examples(spark, str(tmp_path), {"gsm8k": sha}, requests=[("gsm8k", "main")])
    examples.require_all_sources(found, [("gsm8k", "main")])
    with pytest.raises(ValueError, match="no rows"):
        examples.require_all_sources(found)
    with pytest.raises(ValueError, match="revision"):
        examples.check_revisions({"gsm8k": "main"}, ["gsm8k"])


def test_load_selected(spark, tmp_path):
    """Reads the pinned folders offline, checks that every source has rows, and takes what the profile asks for."""
    sha = "b" * 40
    spark.createDataFrame([(i, f"Q{i}", f"#### {i}") for i in range(6)], "source_row_id int, question string, answer string").write.parquet(f"{tmp_path}/gsm8k/main/revision={sha}")
    found = examples.load_selected(spark, str(tmp_path), {"gsm8k": sha}, Profile("t", 2, 1, 1), 42, [("gsm8k", "main")])
    again = select_examples(examples.read_examples(spark, str(tmp_path), {"gsm8k": sha}, requests=[("gsm8k", "main")]), Profile("t", 2, 1, 1), 42)
    assert found.collect() == again.collect() and found.count() == 2
    spark.createDataFrame([], "source_row_id int, problem string, solution string").write.parquet(f"{tmp_path}/math/algebra/revision={sha}")
    with pytest.raises(ValueError, match="no rows"):
        examples.load_selected(spark, str(tmp_path), {"gsm8k": sha, "math": sha}, Profile("t", 2, 1, 1), 42, [("gsm8k", "main"), ("math", "algebra")])


def complete(i):
    return {"example_id": i, "status": "complete", "greedy": {"text": "t"}, "samples": []}


def test_checkpoint_log(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    for i in ("a", "b"):
        sinks.append_record(path, complete(i))
    with open(path, "ab") as f:
        f.write(b'{"example_id":"partial')
    assert {r.example_id for r in checkpoints.read_predictions(spark, path).collect()} == {"a", "b"}
    with open(path, "ab") as f:
        f.write(b"\n")
    with pytest.raises(Exception, match="corrupt"):
        checkpoints.read_predictions(spark, path).collect()
    for rows, message in [([complete("a"), complete("a")], "duplicate"), ([complete("a") | {"status": "open"}], "not a complete")]:
        path = str(tmp_path / f"{message[:3]}.jsonl")
        for r in rows:
            sinks.append_record(path, r)
        with pytest.raises(Exception, match=message):
            checkpoints.read_predictions(spark, path).collect()


def test_a_torn_line_that_reads_like_a_whole_one(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    for name, tail in (("x.jsonl", "a"), ("y.jsonl", None), ("z.jsonl", "c")):
        path = str(folder / name)
        for i in {"x.jsonl": "ab", "y.jsonl": "cd", "z.jsonl": "ef"}[name]:
            sinks.append_record(path, complete(i))
        if tail:
            with open(path, "ab") as f:
                f.write(open(str(folder / "x.jsonl"), "rb").read().split(b"\n")[0] if tail == "a" else b'{"example_id":"c')
    assert {r.example_id for r in checkpoints.read_predictions(spark, str(folder)).collect()} == set("abcdef")
    cut = checkpoints.repair(spark, str(folder))
    assert [c.rsplit("/", 1)[1] for c in cut] == ["x.jsonl", "z.jsonl"] and checkpoints.repair(spark, str(folder)) == []
    sinks.append_record(str(folder / "x.jsonl"), complete("g"))
    assert {r.example_id for r in checkpoints.read_predictions(spark, str(folder)).collect()} == set("abcdefg")


def test_blank_lines(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    sinks.append_record(path, complete("a"))
    with open(path, "ab") as f:
        f.write(b"\n")
    sinks.append_record(path, complete("b"))
    with pytest.raises(Exception, match="corrupt"):
        checkpoints.read_predictions(spark, path).collect()
    assert checkpoints.read_export(spark, path, {"selected_example_ids": ["a", "b"]}).count() == 2
    with pytest.raises(ValueError, match="3"):
        checkpoints.read_export(spark, path, {"completed_count": 3})


def test_stages(spark, tmp_path):
    for i, failure in (("a", "oom"), ("b", None), ("c", "oom")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"run_signature": "s", "example_id": i, "failure": failure, "samples": {}}, indent=1))
    stages = checkpoints.read_stages(spark, str(tmp_path))
    done = spark.createDataFrame([("c",)], "example_id string")
    assert [r.example_id for r in checkpoints.staged_failures(stages, done, "s").collect()] == ["a"]
    with pytest.raises(Exception, match="identity"):
        checkpoints.staged_failures(stages, done, "other").collect()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x.json")
    sinks.atomic_json(path, {2: {"b": None}, "a": [1]})
    assert json.load(open(path)) == {"2": {"b": None}, "a": [1]} and len(list(tmp_path.iterdir())) == 1
    for bad in ({1: 0, "1": 0}, {True: 0}):
        with pytest.raises((ValueError, TypeError)):
            sinks.atomic_json(path, bad)
    df = spark.createDataFrame([("b", 1.5, "x"), ("a", None, "y")], "k string, v double, extra string")
    sinks.write_csv(df, str(tmp_path / "x.csv"), ["k", "v"], ["k"])
    assert (tmp_path / "x.csv").read_text().split() == ["k,v", "a,", "b,1.5"]
    assert sinks.markdown_table([{"a": None, "b": True}], ["a", "b"]).endswith("| — | ✓ |\n")


def stage_row(spark, **changes):
    seeds = [r.s for r in spark.range(2).select(sample_seed(42, F.lit("e"), "id").alias("s")).collect()]
    generation = {"text": "t", "token_ids": [1], "eos_generated": True, "was_truncated": False, "reason": "eos"}
    greedy = {"text": "t", "token_ids": [1, 2], "token_entropies_nats": [0.1, 0.2], "token_logprobs": [-0.1, 0.0], "token_char_spans": [[0, 1], None], "content_token_mask": [True, False], "token_alignment_status": "aligned", "eos_generated": True, "was_truncated": False, "termination_reason": "eos"}
    row = {"run_signature": "s", "example_id": "e", "greedy": greedy, "samples": {str(k): {"seed": seeds[k], "generation": generation} for k in range(2)}, "failure": None, "failure_history": []}
    for path, value in changes.items():
        at = row
        *head, last = path.split("__")
        for p in head:
            at = at[p]
        at[last] = value
    df = spark.createDataFrame([row], checkpoints.STAGE)
    return validation.violations(df, validation.stage_rules(42, 2, 4)).first().violations


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"greedy": None}, None), ({"greedy__token_logprobs": [-0.1]}, "greedy scores per token"), ({"greedy__token_entropies_nats": [-1.0, 0.0]}, "greedy score range"),
        ({"greedy__token_ids": [1, -2]}, "greedy token ids"), ({"greedy__token_char_spans": [[2, 1], None]}, "greedy character spans"), ({"greedy__token_char_spans": None}, None),
        ({"samples__0__seed": 7}, "sample seed"), ({"samples__0__generation__token_ids": [1, 2, 3, 4, 5]}, "sample length"), ({"greedy__termination_reason": None}, "greedy termination"),
    ],
)
def test_stage_rules(spark, change, rule):
    assert stage_row(spark, **change) == ([rule] if rule else [])


def test_consistency_rules(spark):
    schema = f"c struct<{checkpoints.CONSISTENCY}>"
    good = (8, 8, 0, 6, 0, 0.75, "1", 6, 0.75, True, "graded", 0)
    hidden = (8, 8, 0, 6, 0, 0.75, None, None, None, None, "majority_comparison_incomplete", 3)
    rows = [good, hidden, (*good[:11], 3), (8, 8, 1, *good[3:]), (*good[:5], 1.5, *good[6:]), (*hidden[:11], 29)]
    df = spark.createDataFrame([(r,) for r in rows], schema)
    found = [r.violations for r in validation.violations(df, validation.consistency_rules("c", 8)).collect()]
    assert found == [[], [], ["majority state"], ["vote sums"], ["vote shares"], ["vote counts"]]


def test_joins_that_check(spark):
    a = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "example_id string, record_sha256 string, v string")
    b = spark.createDataFrame([("a", "1", None), ("b", "3", "y"), ("z", "0", None)], "example_id string, record_sha256 string, v string")
    assert [r.example_id for r in validation.digest_mismatches(a, b).collect()] == ["b"]
    assert [r.example_id for r in validation.content_mismatches(a, b, ["v"]).collect()] == ["b"]
    assert tuple(validation.same_keys(a, b, "example_id").first()) == (0, 1, False)


def predictions(spark):
    def sample(i, answer, reason="eos"):
        return {"index": i, "text": f"\\boxed{{{answer}}}", "answer": answer, "termination_reason": reason}

    def row(i, greedy, answers, majority, share, correct):
        return {"example_id": i, "question": "q", "gold_answer": "1", "status": "complete", "greedy": {"text": f"\\boxed{{{greedy}}}", "predicted_answer": greedy, "was_truncated": False, "correct": correct}, "samples": [sample(k, a) for k, a in enumerate(answers)], "self_consistency": {"majority_answer": majority, "majority_vote_share": share}}

    rows = [row("a", "1", ["1", "1.0", "2", None], "1", 0.75, True), row("b", "2", ["2", "2"], "2", 0.5, None)]
    rows[0]["samples"][0]["termination_reason"] = "max_new_tokens"
    return spark.createDataFrame(rows, checkpoints.PREDICTION)


def test_training_sets(spark):
    sets = training.training_sets(training.responses(predictions(spark)))
    found = sorted((r.example_id, r.ordinal, r.condition) for r in sets.collect())
    assert found == sorted([("a", 0, "kd_all"), ("a", 0, "kd_gated"), ("a", 2, "kd_all"), ("a", 3, "kd_all"), ("b", 0, "kd_all"), ("b", 1, "kd_all"), ("b", 2, "kd_all")])
    oracle = training.oracle_set(sets.where("condition = 'kd_all'"))
    assert sorted((r.example_id, r.ordinal) for r in oracle.collect()) == [("a", 0), ("a", 2)]
    assert {tuple(r) for r in training.set_sizes(sets).collect()} == {("kd_all", 6, 2), ("kd_gated", 1, 1)}


def test_comparison(spark):
    rows = [(f"e{i}", "d", c, (i * k) % 3 == 0, i % 2 == 0) for i in range(30) for k, c in ((1, "base"), (2, "kd_all"))]
    df = spark.createDataFrame(rows, "example_id string, dataset string, condition string, correct boolean, truncated boolean")
    diffs = training.paired(df, "base", "kd_all")
    r = training.bootstrap(diffs, 3, 200).first()
    assert r.delta == 0 and r.ci_low <= 0 <= r.ci_high
    again = training.bootstrap(diffs.repartition(5), 3, 200).first()
    assert tuple(r) == tuple(again)
    with pytest.raises(Exception, match="no paired"):
        training.paired(df.where("NOT (condition = 'kd_all' AND example_id = 'e1')"), "base", "kd_all").collect()
    s = {(x.condition, x.dataset): x for x in training.student_summary(df).collect()}
    assert s["base", "overall"].macro_accuracy == pytest.approx(10 / 30) and s["base", "d"].n == 30


def test_majority(spark):
    votes = spark.createDataFrame([("x", 0, "b"), ("x", 1, "a"), ("x", 2, "a"), ("x", 3, "b"), ("y", 0, None), ("y", 1, None), ("y", 2, "c")], "id string, i int, a string")
    found = {r.id: r for r in voting.majority_vote(votes, "id", "i", "a").collect()}
    assert (found["x"].majority_answer, found["x"].majority_vote_count) == ("b", 2)
    assert (found["y"].majority_answer, found["y"].majority_vote_count) == (None, 2)


def test_ingest_resumes(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "example_id string, v int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    def run(strict):
        q = ingest.ingest(spark, src, schema, out, log, strict=strict)
        q.awaitTermination()

    arrive([("a", 1), ("b", 2)])
    run(True)
    run(True)
    arrive([("c", 3)])
    run(True)
    assert sorted((r.example_id, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    arrive([("a", 9)])
    with pytest.raises(Exception, match="duplicate"):
        run(True)
    run(False)
    assert spark.read.parquet(out).count() == 3


def test_lenient_ingest_keeps_keys_in_its_state(spark, tmp_path):
    src, out, log, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), "example_id string, v int"

    def run(rows, folder=log, **options):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        ingest.ingest(spark, src, schema, out, folder, **options).awaitTermination()
        return sorted((r.example_id, r.v) for r in spark.read.parquet(out).collect())

    assert run([("a", 1), ("b", 2), ("a", 1)], strict=False) == [("a", 1), ("b", 2)]
    assert run([("b", 9), ("c", 3)], strict=False) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="without strict"):
        run([], strict=True)
    # another stream into the same table sees the rows that were there before it
    assert run([("d", 4), ("c", 8)], str(tmp_path / "log2"), strict=False) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_components_failures_and_signature(spark, tmp_path):
    rows = [("a", "greedy"), ("a", "0"), ("a", "1"), ("b", "greedy"), ("b", "0"), ("c", "0"), ("c", "1"), ("d", "greedy"), ("d", "0"), ("d", "7")]
    c = spark.createDataFrame(rows, "example_id string, component string")
    assert [r.example_id for r in ingest.complete_components(c, 2).collect()] == ["a"]
    assert ingest.new_components(c, spark.createDataFrame([("a", "0"), ("b", "1"), ("b", "1")], c.schema)).collect() == [("b", "1")]
    e = spark.createDataFrame([("a", 1, "oom"), ("a", 2, None), ("b", 1, "x"), ("b", 2, "y")], "example_id string, at int, failure string")
    assert [tuple(r) for r in ingest.open_failures(e).collect()] == [("b", "y", ["x", "y"])]
    folder = str(tmp_path / "run")
    assert ingest.resume_guard(folder, {"seed": 1}) == ingest.resume_guard(folder, {"seed": 1})
    with pytest.raises(ValueError):
        ingest.resume_guard(folder, {"seed": 2})


def test_event_time_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:00:50', 'a' UNION ALL SELECT timestamp'2024-01-01 00:01:10', 'b'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    q = ingest.windowed_counts(stream, "ts", "1 minute", "1 minute", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("w").collect()) == [1, 2]


def _conditions(spark):
    rows = [(i, c, None if (i + 3 * k) % 7 == 0 else (i * (k + 2)) % 5 < 3) for i in range(40) for k, c in enumerate(("base", "kd_all", "kd_gated", "kd_oracle"))]
    return spark.createDataFrame(rows, "example_id bigint, condition string, correct boolean")


def test_one_pass_compares_all_conditions(spark):
    results = _conditions(spark)
    plan = training.paired_delta(results)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan
    for r in training.paired_delta(results).collect():
        own = [x.diff for x in training.paired(results, r.left, r.right).collect()]
        assert (r.n, r.delta) == (40, pytest.approx(sum(own) / 40))
    with pytest.raises(Exception, match="two results"):
        training.paired_delta(results.unionByName(results.limit(1))).collect()


def test_the_table_of_comparisons_is_the_bootstrap_of_each(spark):
    results = _conditions(spark)
    table = {(r.left, r.right): r for r in training.comparison_table(results, 5, 300).collect()}
    assert set(table) == set(training.COMPARISONS)
    for pair, r in table.items():
        one = training.bootstrap(training.paired(results, *pair), 5, 300).first()
        assert (r.n, r.delta, r.ci_low, r.ci_high) == (one.n, pytest.approx(one.delta), pytest.approx(one.ci_low), pytest.approx(one.ci_high))
    fewer = results.where("condition <> 'base' OR example_id < 30")
    assert {r.n for r in training.comparison_table(fewer, 5, 50).collect()} == {30, 40}


def test_a_bootstrap_hashes_parts_of_a_round_and_no_row_for_each_draw(spark):
    """The draws are the built-in SHA-256 of seed, round and place, over more places than a part has; no row is made for each of them."""
    rounds, n = 6, 9000
    sizes = [[(-1, 2000), (0, 4001), (1, 2999)], [(-1, 0), (0, 1), (1, 8999)], [(0.5, 9000)]]
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("7"), (F.col("id") / n).cast("bigint").cast("string"), (F.col("id") % n).cast("string")), 256), 1, 12), 16, 10).cast("bigint") % n
    drawn = np.array([r.p for r in spark.range(rounds * n).select("id", place.alias("p")).orderBy("id").collect()]).reshape(rounds, n)
    found = sorted(map(tuple, training.drawn_sums(spark, 7, n, rounds, sizes).collect()))
    assert found == [(r, float((p >= 6001).sum() - (p < 2000).sum()), float((p >= 1).sum()), n / 2) for r, p in enumerate(drawn)]
    rows = [(i, c, (i * k) % 3 == 0) for i in range(n) for k, c in ((1, "a"), (2, "b"))]
    table = training.comparison_table(spark.createDataFrame(rows, "example_id bigint, condition string, correct boolean"), 7, rounds, [("a", "b")])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"Range \(0, (\d+),", plan)[1]) == rounds * 3


def test_a_bootstrap_by_counts_has_the_interval_of_one_by_rows(spark):
    """Within the error of 2,000 draws, for lopsided and even counts; the work does not grow with n."""
    for lost, won, n in ((30, 60, 400), (0, 9, 200), (5, 5, 50)):
        values = [-1] * lost + [1] * won + [0] * (n - lost - won)
        rows = [(str(i), c, v) for i, d in enumerate(values) for c, v in (("a", d < 0), ("b", d > 0))]
        found = training.comparison_intervals(spark.createDataFrame(rows, "example_id string, condition string, correct boolean"), 3, 2000, [("a", "b")]).first()
        means = np.sort(np.random.default_rng(5).choice(values, (20_000, n)).mean(1))
        assert (found.n, found.delta) == (n, pytest.approx(sum(values) / n))
        spread = 6 * np.std(values) / n**0.5 * 0.05 + 1 / n  # of a quantile of 2,000 draws, and the grid of means
        assert abs(found.ci_low - np.quantile(means, 0.025)) <= spread and abs(found.ci_high - np.quantile(means, 0.975)) <= spread
    sizes = [[(-1, 10**11), (0, 10**12), (1, 2 * 10**11)], [(-1, 0), (0, 5), (1, 0)]]
    one, two = (sorted(map(tuple, training.resampled_means(spark, sizes, 7, 300).repartition(k).collect())) for k in (1, 5))
    assert one == two and len(one) == 600
    large, none = np.array([m for k, m in one if k == 0]), [m for k, m in one if k == 1]
    assert set(none) == {0.0} and abs(large.mean() - 1 / 13) < 1e-6 and 0 < large.std() < 1e-6
    assert training.resampled_means(spark, sizes, 8, 300).collect() != training.resampled_means(spark, sizes, 7, 300).collect()
    with pytest.raises(ValueError, match="nothing to resample"):
        training.comparison_intervals(spark.createDataFrame([], "example_id string, condition string, correct boolean"), 3)
