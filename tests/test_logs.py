import json
import os

import pytest

from surelake.sources.checkpoints import read_predictions
from surelake.sources.logs import ByteRange, log_lines, log_stream, offsets, parsed, read_range, whole_end
from surelake.streaming.ingest import ingest_log


def record(i, **more):
    return {"example_id": f"e{i}", "status": "complete", "greedy": {"text": "é" * (i % 5)}, "samples": [], **more}


def body(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode()


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_each_line_is_read_once_however_files_are_cut(tmp_path, size):
    lines = [b"", b"a", b"\xc3\xa9" * 40, b"x" * 300, b"", b"", b"last"]
    file = tmp_path / "a.jsonl"
    file.write_bytes(b"".join(x + b"\n" for x in lines) + b"torn")
    end = whole_end(str(file), room=3)
    assert end == sum(len(x) + 1 for x in lines)
    found = []
    for start in range(0, end, size):
        for batch in read_range(ByteRange(str(file), start, min(start + size, end), start == 0)):
            found += zip(batch.column("byte").to_pylist(), batch.column("value").to_pylist(), strict=True)
    at, want = 0, []
    for x in lines:
        want.append((at, x.decode()))
        at += len(x) + 1
    assert found == want


def test_a_range_in_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr("surelake.sources.logs._CHUNK", 16)
    file = tmp_path / "a"
    file.write_bytes(b"".join(b"%05d " % i + b"x" * (i % 40) + b"\n" for i in range(200)))
    for start in (0, 1, 77):
        batches = list(read_range(ByteRange(str(file), start, file.stat().st_size, start == 0)))
        values = [v for b in batches for v in b.column("value").to_pylist()]
        assert len(batches) > 20 and [int(v[:5]) for v in values] == list(range(200 - len(values), 200))
        assert [n for b in batches for n in b.column("line").to_pylist()] == list(range(1, len(values) + 1))


def test_a_large_file_is_split_and_columns_are_pruned(spark, tmp_path):
    file = tmp_path / "log.jsonl"
    file.write_bytes(body(record(i) for i in range(5000)) + b'{"example_id": "torn')
    lines = log_lines(spark, str(file), split_bytes=20_000)
    assert lines.rdd.getNumPartitions() == -(-whole_end(str(file)) // 20_000) > 10
    assert lines.count() == 5000 and lines.select("byte").distinct().count() == 5000
    assert read_predictions(spark, str(file)).select("example_id").distinct().count() == 5000


def test_errors_name_line_and_file(spark, tmp_path):
    for name, rows, what in (("bad.jsonl", body([record(0), record(1)]) + b"{oops\n" + body([record(2)]), "corrupt: line 3 of "), ("part.jsonl", body([record(0), record(1, status="failed")]), "not a complete prediction: line 2 of "), ("blank.jsonl", body([record(0)]) + b"\n", "corrupt: line 2 of ")):
        (tmp_path / name).write_bytes(rows)
        with pytest.raises(Exception, match=what) as e:
            read_predictions(spark, str(tmp_path / name)).collect()
        assert name in str(e.value)
    assert read_predictions(spark, str(tmp_path / "blank.jsonl"), blank=True).count() == 1
    (tmp_path / "bytes.jsonl").write_bytes(body([record(0)]) + b"\xff\xfe\n")
    with pytest.raises(Exception, match="line 2 after byte 0 of .*bytes.jsonl is not UTF-8"):
        read_predictions(spark, str(tmp_path / "bytes.jsonl")).collect()
    with pytest.raises(Exception, match="a range has a byte"):
        log_lines(spark, str(tmp_path / "bytes.jsonl"), split_bytes=0).collect()
    (tmp_path / "long.jsonl").write_bytes(body(record(i) for i in range(100)) + b"[\n")
    with pytest.raises(Exception, match="line [0-9]+ after byte [0-9]+ of"):
        parsed(log_lines(spark, str(tmp_path / "long.jsonl"), split_bytes=500), "example_id string").collect()


def test_a_folder_empty_files_and_hidden_ones(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_bytes(body([record(0)]))
    (tmp_path / "in" / "sub" / "b.jsonl").write_bytes(body([record(1)]) + b"torn")
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"x\n")
    (tmp_path / "in" / ".crc").write_bytes(b"x\n")
    found = log_lines(spark, f"file://{tmp_path}/in").collect()
    assert sorted(os.path.basename(r.file) for r in found) == ["a.jsonl", "b.jsonl"]
    assert [tuple(r)[2:] for r in found] == [(0, 0, 1)] * 2
    with pytest.raises(Exception, match="none.jsonl"):
        log_lines(spark, str(tmp_path / "none.jsonl")).collect()


def test_a_stream_reads_a_torn_line_once_it_is_whole(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    schema = "example_id string, status string"

    def run(**options):
        query = ingest_log(spark, str(folder), schema, out, str(tmp_path / "log"), **options)
        query.awaitTermination()
        return query, sorted((r.example_id, r["__batch"]) for r in spark.read.parquet(out).collect())

    first, second = body([record(0), record(1)]), body([record(2)])
    (folder / "a.jsonl").write_bytes(first + second[:9])
    query, rows = run(split_bytes=40)
    assert rows == [("e0", 0), ("e1", 0)] and list(offsets(query.lastProgress).values()) == [len(first)]
    with open(folder / "a.jsonl", "ab") as f:
        f.write(second[9:])
    (folder / "b.jsonl").write_bytes(body([record(3)]))
    assert run()[1] == [("e0", 0), ("e1", 0), ("e2", 1), ("e3", 1)]
    assert run()[1] == [("e0", 0), ("e1", 0), ("e2", 1), ("e3", 1)]  # nothing new
    with open(folder / "b.jsonl", "ab") as f:
        f.write(body([record(0)]))
    with pytest.raises(Exception, match="duplicate checkpoint for e0"):
        run()


def test_a_stream_stops_at_a_corrupt_line_and_at_a_file_that_got_shorter(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(body([record(0)]))
    run = lambda: ingest_log(spark, str(folder), "example_id string", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    run()
    (folder / "a.jsonl").write_bytes(body([record(0)]) + b"{no\n")
    with pytest.raises(Exception, match="corrupt: line 1 after byte .*a.jsonl"):
        run()
    (folder / "a.jsonl").write_bytes(b"{}\n")
    with pytest.raises(Exception, match="shorter|corrupt"):
        run()
    assert log_stream(spark, str(folder)).isStreaming


def test_records_are_not_shuffled_to_look_for_repeated_keys(spark):
    from surelake.sources.checkpoints import without_duplicates

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = without_duplicates(spark.range(20).selectExpr("cast(id as string) AS k", "repeat('x', 100) AS body"), "k")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(Exception, match="duplicate checkpoint for a"):
        without_duplicates(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k").collect()


def test_packed_files_are_read_whole(spark, tmp_path):
    import gzip

    rows = [json.dumps({"k": i, "body": "x" * 100}) for i in range(2000)]
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(("\n".join(rows) + "\n").encode()) + gzip.compress(b"torn"))
    (tmp_path / "b.json").write_text("plain\n")
    found = log_lines(spark, str(tmp_path), split_bytes=500).collect()
    assert sorted(r.value for r in found) == sorted([*rows, "plain"])
    (tmp_path / "a.json.gz").write_bytes(gzip.compress("\n".join(rows).encode())[:-40])
    with pytest.raises(Exception):  # noqa: B017
        log_lines(spark, str(tmp_path)).collect()


def test_a_line_is_parsed_once_and_for_its_key_alone(spark, tmp_path):
    from surelake.sources.checkpoints import PREDICTION, is_complete

    (tmp_path / "a.jsonl").write_bytes(body(record(i) for i in range(3)))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    rows = parsed(log_lines(spark, str(tmp_path)), PREDICTION, is_complete()).where("greedy.text IS NOT NULL AND length(example_id) > 1")
    assert plan(rows).count("from_json(") == 1 and rows.count() == 3
    whole = plan(read_predictions(spark, str(tmp_path)))
    assert whole.count("from_json(") == 2 and whole.count("from_json(StructField(example_id,StringType,true), value") == 1
