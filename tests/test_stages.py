import datetime
import json

import pytest

from surelake.streaming.stages import EVENT, latest, read_staged, run_stages

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def event(key, kind, component=None, payload=None, hours=0):
    return {"example_id": key, "kind": kind, "component": component, "payload": payload, "at": (DAY + datetime.timedelta(hours=hours)).isoformat()}


class Run:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0
        (folder / "in").mkdir()

    def feed(self, *events):
        """The events as one more file, and what the table holds after a run over it, which starts the query anew."""
        (self.folder / "in" / f"{self.n:03}.json").write_text("".join(json.dumps(e) + "\n" for e in events))
        self.n += 1
        stream = self.spark.readStream.schema(EVENT).json(str(self.folder / "in"))
        run_stages(stream, str(self.folder / "out"), str(self.folder / "log"), **self.options).awaitTermination()
        rows = read_staged(self.spark, str(self.folder / "out"))
        return sorted((r.example_id, r.status, r.greedy, tuple(r.samples), r.failure, tuple(r.failure_history), tuple(r.missing)) for r in rows.collect())


def test_an_example_comes_out_once_it_is_whole_over_restarts(spark, tmp_path):
    run = Run(spark, tmp_path, samples=2, late="1 hour")
    assert run.feed(event("a", "component", "greedy", "g"), event("a", "component", "1", "s1"), event("b", "component", "greedy", "h")) == []
    whole = ("a", "complete", "g", ("s0", "s1"), None, (), ())
    assert run.feed(event("a", "component", "0", "s0"), event("a", "component", "1", "s1")) == [whole]  # the second one is there already, and the same
    assert run.feed(event("c", "component", "0", "x"), event(None, "component", "0", "x")) == [whole]
    with pytest.raises(Exception, match="component 0 of a is there already"):
        run.feed(event("a", "component", "0", "s0"))


def test_another_payload_stops_the_query_or_is_left_out(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    loose = Run(spark, tmp_path / "x", samples=1, late="1 hour", strict=False)
    assert loose.feed(event("a", "component", "0", "first"), event("a", "component", "0", "second", 0.1)) == []
    assert loose.feed(event("a", "component", "0", "third"), event("a", "component", "greedy", "g")) == [("a", "complete", "g", ("first",), None, (), ())]
    assert len(loose.feed(event("a", "component", "greedy", "again", 0.1))) == 1
    strict = Run(spark, tmp_path / "y", samples=1, late="1 hour")
    strict.feed(event("a", "component", "0", "first"))
    with pytest.raises(Exception, match="component 0 of a is there already"):
        strict.feed(event("a", "component", "0", "second"))


def test_failures_are_marked_and_cleared_and_components_stay(spark, tmp_path):
    run = Run(spark, tmp_path, samples=1, late="1 hour")
    failed = ("a", "failed", "g", (None,), "out of memory", (), ("0",))
    assert run.feed(event("a", "component", "greedy", "g"), event("a", "failed", payload="out of memory", hours=0.1)) == [failed]
    assert run.feed(event("a", "component", "0", "s", hours=0.2)) == [failed]  # kept, but the failure is open
    done = run.feed(event("a", "cleared", hours=0.3))
    assert done == sorted([failed, ("a", "complete", "g", ("s",), None, ("out of memory",), ())], key=lambda r: r[1])
    last = latest(read_staged(spark, str(tmp_path / "out"))).collect()
    assert [(r.example_id, r.status, r.failure_history) for r in last] == [("a", "complete", ["out of memory"])]


def test_a_timer_marks_what_does_not_become_whole(spark, tmp_path):
    run = Run(spark, tmp_path, samples=1, patience="2 hours", late="30 minutes")
    assert run.feed(event("a", "component", "greedy", "g", 0), event("b", "component", "0", "s", 1)) == []
    lost = ("a", "failed", "g", (None,), "timed out", (), ("0",))
    assert run.feed(event("c", "component", "greedy", "h", 3)) == [lost]  # time is now 2.5 hours: b has half an hour left
    assert run.feed(event("b", "component", "greedy", "t", 2.9)) == sorted([lost, ("b", "complete", "t", ("s",), None, (), ())])
    rows = run.feed(event("a", "component", "0", "u", 3), event("a", "cleared", None, None, 3))
    assert ("a", "complete", "g", ("u",), None, ("timed out",), ()) in rows and len(rows) == 3
    assert len(run.feed(event("d", "component", "greedy", "x", 20))) == 4  # c timed out; a and b have no timer any more


def test_by_the_clock_nothing_is_late(spark, tmp_path):
    run = Run(spark, tmp_path, samples=1, patience="10 days")
    assert run.feed(event("a", "component", "greedy", "g", 5000)) == []
    assert run.feed(event("a", "component", "0", "s", -5000)) == [("a", "complete", "g", ("s",), None, (), ())]


def test_unknown_components_stop_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="a has no component 7"):
        Run(spark, tmp_path, samples=2).feed(event("a", "component", "7", "x"))


def test_the_state_has_a_key_for_a_bucket_and_for_long_open_examples(spark, tmp_path, monkeypatch):
    from surelake.streaming import stages

    monkeypatch.setattr(stages, "_BUCKETS", 3)
    (tmp_path / "in").mkdir()
    stream, found = spark.readStream.schema(EVENT).json(str(tmp_path / "in")), []

    def feed(n, *events):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(e) + "\n" for e in events))
        query = run_stages(stream, str(tmp_path / "out"), str(tmp_path / "log"), samples=1, patience="2 hours", late="0 seconds")
        query.awaitTermination()
        found.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    ids = [f"e{i}" for i in range(60)]
    long = "x" * 1000
    feed(0, *(event(e, "component", "greedy", long if i < 2 else e) for i, e in enumerate(ids)), event("clock", "component", "0", "t", 1))
    feed(1, *(event(e, "component", "0", "s", 1.5) for e in ids[:1] + ids[10:]), event("clock", "component", "greedy", "t", 2.5))
    assert max(found) <= 3 + 2 + 3 * 2  # buckets, long ones, and a timer of each bucket with its index
    rows = {r.example_id: r for r in latest(read_staged(spark, str(tmp_path / "out"))).collect()}
    assert sorted(rows) == sorted([*ids, "clock"])
    assert all(rows[e].status == "complete" and rows[e].samples == ["s"] for e in ids[:1] + ids[10:])
    assert all(rows[e].failure == "timed out" and rows[e].missing == ["0"] for e in ids[1:10])
    assert rows["e0"].greedy == rows["e1"].greedy == long and rows["e2"].greedy == "e2"
