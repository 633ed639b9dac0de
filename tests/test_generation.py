"""The generator hook, locks, status, progress and small files."""

import json
import os
import socket
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from surelake.plans import generation
from surelake.sources import sinks
from surelake.streaming import ingest


class Echo:
    """Holds three requests at most; some never fit, some need a new worker, once or always."""

    failed = set()

    def run(self, batch):
        if len(batch) > 3 or any("huge" in r["prompt"] for r in batch):
            raise MemoryError("full")
        for r in batch:
            if "broken" in r["prompt"] or "flaky" in r["prompt"] and r["prompt"] not in self.failed:
                self.failed.add(r["prompt"])
                raise generation.Restart("gone")
        return [{"text": r["prompt"].upper(), "n": len(r["prompt"])} for r in batch]


def test_every_request_comes_out_once(spark):
    prompts = [f"p{i}" * (i % 7 + 1) for i in range(40)] + ["huge", "broken one", "flaky one", None]
    df = spark.createDataFrame([(str(i), p or "") for i, p in enumerate(prompts)], "example_id string, prompt string").repartition(3)
    found = {r.example_id: r for r in generation.generated(df, Echo, "text string, n int", batch=1, window=10).collect()}
    assert len(found) == len(prompts)
    assert found["0"].generation.text == "P0" and found["5"].generation.n == 12 and found["5"].failure is None
    assert found["40"].generation is None and "out of memory: full" in found["40"].failure and found["41"].failure == "worker failed twice: gone"
    assert found["42"].generation.text == "FLAKY ONE" and found["43"].generation.text == ""


class Scripted:
    """Answers or raises what it is told to, call by call, and keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, batch):
        self.calls.append([r["id"] for r in batch])
        answer = self.answers.pop(0) if self.answers else [r["id"].upper() for r in batch]
        if isinstance(answer, Exception):
            raise answer
        return answer


def requests(ids, **more):
    return [{"id": i, **{k: f(i) for k, f in more.items()}} for i in ids]


def test_out_of_memory_runs_only_what_is_not_finished_again():
    run = Scripted(generation.OutOfMemory("full", {1: "saved"}))
    assert [g for _, g, _ in generation.run_all(requests("abcd"), run)] == ["A", "saved", "C", "D"]
    assert run.calls == [["a", "b", "c", "d"], ["a", "c"], ["d"]]
    run = Scripted(generation.OutOfMemory("full", {0: "x", 1: "y"}))
    assert [g for _, g, _ in generation.run_all(requests("ab"), run)] == ["x", "y"] and len(run.calls) == 1
    with pytest.raises(RuntimeError, match="outside the batch"):
        generation.run_all(requests("ab"), Scripted(generation.OutOfMemory("full", {2: "x"})))


def test_one_request_that_does_not_fit_fails_and_the_rest_goes_on():
    run = Scripted(MemoryError("1"), MemoryError("still"))
    found = generation.run_all(requests("ab"), run)
    assert [(g, e) for _, g, e in found] == [(None, "out of memory: still"), ("B", None)]


def test_any_other_error_is_raised():
    with pytest.raises(ValueError, match="protocol"):
        generation.run_all(requests("ab"), Scripted(ValueError("protocol")))
    with pytest.raises(RuntimeError, match="another number"):
        generation.run_all(requests("ab"), Scripted(["one"]))


def test_a_restart_is_tried_once_more():
    run = Scripted(generation.Restart("gone", {0: "x"}), generation.Restart("again"))
    found = generation.run_all(requests("abc"), run)
    assert [(g, e) for _, g, e in found] == [("x", None), (None, "worker failed twice: again"), (None, "worker failed twice: again")] and run.calls == [["a", "b", "c"], ["b", "c"]]


def test_requests_of_an_example_that_failed_are_not_run():
    run = Scripted(MemoryError("full"))
    failed = set()
    assert generation.run_all(requests(["a0"], example=lambda i: i[0]), run, "example", failed)[0][2] == "out of memory: full"
    found = generation.run_all(requests(["a1", "b0"], example=lambda i: i[0]), run, "example", failed)
    assert [(g, e) for _, g, e in found] == [(None, "skipped: another request of the example failed"), ("B0", None)] and run.calls == [["a0"], ["b0"]]


def test_an_error_of_the_generator_stops_the_query(spark):
    class Wrong:
        def run(self, batch):
            raise ValueError("protocol")

    df = spark.createDataFrame([("a", "p")], "example_id string, prompt string")
    with pytest.raises(Exception, match="protocol"):
        generation.generated(df, Wrong, "text string").collect()


def test_batches_of_equal_length():
    rows = [{"p": "x" * n} for n in (1, 9, 3, 9, 2, 0)]
    assert [[len(r["p"]) for r in b] for b in generation.by_length(rows, "p", 2)] == [[9, 9], [3, 2], [1, 0]]
    assert [r["p"] for r, _, _ in generation.run_all(rows, lambda b: [1] * len(b))] == [r["p"] for r in rows]


def test_requests_of_samples(spark):
    e = spark.createDataFrame([("gsm8k:main:test:17", "What?")], "example_id string, question string")
    rows = {r["index"]: r for r in generation.sample_requests(e, 4, 42).collect()}
    assert set(rows) == {None, 0, 1, 2, 3} and rows[None].seed is None and rows[3].seed == 5792900222203665036 and rows[0].prompt.endswith("What?")


def test_only_complete_predictions_are_appended(spark, tmp_path):
    from surelake.sources import checkpoints

    folder = str(tmp_path / "log")
    schema = "status string, samples array<struct<text:string>>, greedy struct<text:string>, example_id string"
    good = ("complete", [], ("t",), "x")
    sinks.append_predictions(spark.createDataFrame([good], schema), folder)
    sinks.append_predictions(spark.createDataFrame([("complete", [("s",)], ("t",), "y")], schema), folder)
    assert sorted(r.example_id for r in checkpoints.read_predictions(spark, folder).collect()) == ["x", "y"]
    lines = spark.read.text(folder).collect()
    assert sorted(r.value for r in lines)[0] == '{"example_id":"x","greedy":{"text":"t"},"samples":[],"status":"complete"}'
    for change in (("open", [], ("t",), "x"), ("complete", [], ("t",), ""), ("complete", [], None, "x"), ("complete", None, ("t",), "x")):
        with pytest.raises(Exception, match="only complete"):
            sinks.append_predictions(spark.createDataFrame([change], schema), folder)


def test_conditions(spark, tmp_path):
    df = spark.createDataFrame([("b", "base", True), ("a", "base", None), ("a", "kd_all", False)], "example_id string, condition string, correct boolean")
    assert sinks.write_conditions(df, str(tmp_path)) == {"base": 2, "kd_all": 1}
    assert [json.loads(x)["example_id"] for x in open(tmp_path / "eval_base.jsonl")] == ["a", "b"]
    assert json.load(open(tmp_path / "results.json"))["base"] == {"n": 2, "correct": 1, "accuracy": 0.5}


def test_tree_digest_frames_names_and_contents(tmp_path):
    for name, files in (("x", {"a.py": "bc"}), ("y", {"ab.py": "c"}), ("z", {"a.py": "bc", "n.txt": "t"})):
        (tmp_path / name).mkdir()
        for f, body in files.items():
            (tmp_path / name / f).write_text(body)
    a, b, c = (sinks.tree_digest(str(tmp_path / d)) for d in "xyz")
    assert a != b and a == c != sinks.tree_digest(str(tmp_path / "z"), ("**/*.py", "*.txt"))


def test_one_writer_at_a_time(tmp_path):
    with sinks.writer_lock(str(tmp_path)) as path:
        assert ingest.run_status(str(tmp_path))["being_written"]
        with pytest.raises(RuntimeError, match=f"being written by {socket.gethostname()} {os.getpid()}"), sinks.writer_lock(str(tmp_path)):
            pass
        assert os.path.exists(path)
    assert not os.path.exists(path)
    with open(path, "w") as f:
        f.write(f"{socket.gethostname()} 999999999")  # of a process of this host that is gone
    with sinks.writer_lock(str(tmp_path)):
        pass
    assert not os.path.exists(path)


def test_a_lock_of_another_host_is_never_taken_over(tmp_path):
    for owner in (f"elsewhere.example {os.getpid()}", "elsewhere.example 999999999", "999999999"):
        (tmp_path / "writer.lock").write_text(owner)
        with pytest.raises(RuntimeError, match=f"being written by {owner}"), sinks.writer_lock(str(tmp_path)):
            pass
        assert (tmp_path / "writer.lock").read_text() == owner


def test_a_writer_that_was_killed_leaves_a_lock_that_can_be_taken(tmp_path):
    code = f"import os, sys; sys.path.insert(0, {os.getcwd()!r}); from surelake.sources.sinks import writer_lock\nwith writer_lock({str(tmp_path)!r}):\n    print('held', flush=True); sys.stdin.read(1); os._exit(9)"
    other = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
    assert other.stdout.readline() == "held\n"
    with pytest.raises(RuntimeError, match=f" {other.pid}$"), sinks.writer_lock(str(tmp_path)):
        pass
    other.communicate("x")
    assert (tmp_path / "writer.lock").exists()
    with sinks.writer_lock(str(tmp_path)):
        assert (tmp_path / "writer.lock").read_text().endswith(f" {os.getpid()}")


def test_status_and_progress(spark, tmp_path):
    class Event:
        class progress:  # noqa: N801
            numInputRows, processedRowsPerSecond, batchId, timestamp = 5, 2.0, 1, "t"

    told = []
    listener = ingest.Progress(0.0, told.append, str(tmp_path / "progress.json"))
    listener.onQueryProgress(Event)
    listener.onQueryProgress(Event)
    assert told[1] == {"rows": 5, "total_rows": 10, "rows_per_hour": 7200.0, "batch": 1, "at": "t"}
    (tmp_path / "run_manifest.json").write_text(json.dumps({"status": "running", "selected_example_ids": ["a"]}))
    ingest.request_stop(str(tmp_path))
    found = ingest.run_status(str(tmp_path))
    assert found == {"status": "running", "selected": 1, "progress": told[1], "being_written": False, "stopping": True}
    assert sinks.environment()["packages"]["pyspark"] and sinks.shared_folder(spark)
    assert ingest.exists(spark, str(tmp_path)) and not ingest.exists(spark, str(tmp_path / "none"))
    assert spark.range(3).select(F.col("id")).count() == 3


@pytest.mark.parametrize("tasks", [2, 7, 16])
def test_tasks_of_balanced_requests_cost_the_same(spark, tasks):
    """A few long prompts among many short ones, whatever partition they come from; none is lost and long ones go with long ones."""
    text = F.repeat(F.lit("x"), F.when(F.col("id") % 50 == 0, 3000 + F.col("id") % 900).otherwise(F.col("id") % 40).cast("int"))
    rows = spark.range(20_000).repartition(3).select(F.col("id").cast("string").alias("example_id"), F.when(F.col("id") % 777 != 5, text).alias("prompt"), F.lit(1).alias("index"))
    found = generation.balanced(rows, tasks).select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")).collect()
    assert len(found) == 20_000 == len({r.example_id for r in found})
    cost = [sum(len(r.prompt or "") + 1 for r in found if r.task == t) for t in range(tasks)]
    assert max(cost) < 1.2 * sum(cost) / tasks
    for t in range(tasks):
        lengths = [len(r.prompt or "") for r in sorted(found, key=lambda r: r["at"]) if r.task == t]
        assert lengths == sorted(lengths, reverse=True)
    assert generation.balanced(rows.limit(0), tasks).count() == 0
    same = spark.createDataFrame([("a", "x" * 10)] * 320, "example_id string, prompt string").repartition(3)
    counts = [r["count"] for r in generation.balanced(same, tasks).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 320 and len(counts) == tasks and max(counts) <= 320 // tasks + 1
