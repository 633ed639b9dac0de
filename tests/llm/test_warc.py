import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from surelake.llm import warc

PAGES = "text string, page_id bigint, url string, html string, digest string"


def page_rows():
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u\r\nx", ""), (7, "u", other), (7, "u", other), (None, "n", other), (8, "u", "z" * 300_000), (None, None, None), (12, "w", "WARC/1.1\r\n\r\n\r\n\x1f\x8b" * 90)]
    return [("t", i, u, h, "d") for i, u, h in pages]


def expected():
    rows = page_rows()
    out = []
    for _, i, _, h, _ in rows:
        data = (h or "").encode()
        kept = max((r[1] for r in rows if r[3] == h and r[1] is not None), default=None) if len(data) >= 1000 else None
        revisit = kept is not None and i != kept
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return out


def test_round_trip(spark):
    found = warc.round_trip(spark.createDataFrame(page_rows(), PAGES)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected()))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_payloads_and_filters(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_pages(spark.createDataFrame(page_rows(), PAGES), path)
    rows = warc.read_archive(spark, path)
    assert rows.count() == len(page_rows())
    assert {r.payload.decode() for r in rows.where("record_type = 'response'").collect()} == {r[3] or "" for r in page_rows()}
    revisits = warc.read_archive(spark, path, pushdown=True).where("record_type = 'revisit'")
    assert "Filter (" not in revisits._jdf.queryExecution().executedPlan().toString()  # the source took it over
    assert {(r.payload, r.headers["warc-profile"]) for r in revisits.collect()} == {(None, warc._REVISIT)}
    for predicate, condition, n in [
        (("target_uri", "starts", "http://a/"), F.col("target_uri").startswith("http://a/"), 2),
        (("target_uri", "none", None), F.col("target_uri").isNull(), 2),
        (("record_type", "in", ["request", "revisit"]), F.col("record_type").isin("request", "revisit"), 3),
        (("record_id", "ends", ":9>"), F.col("record_id").endswith(":9>"), 1),
        (("record_type", "eq", "metadata"), F.col("record_type") == "metadata", 0),
    ]:
        assert warc.read_archive(spark, path, predicates=[predicate]).count() == n
        assert warc.read_archive(spark, path, pushdown=True).where(condition).count() == n
        assert rows.where(condition).count() == n
    assert {r.payload for r in warc.read_archive(spark, path, payload=False).collect()} == {None}
    warc.write_pages(spark.createDataFrame(page_rows()[:2], PAGES), path)
    assert warc.read_archive(spark, path).count() == len(page_rows()) + 2


def test_unwanted_records_are_not_inflated():
    parts = [warc.member(warc.record(i, "u", b"p" * 500_000, "00" * 20, None)) for i in range(5)]
    data = b"".join(parts)
    seen: dict = {}
    wanted = lambda f: f["warc-record-id"] == "<urn:page:3>"
    found = list(warc.records(pa.BufferReader(data), len(data), wanted, True, seen))
    assert [b for _, b in found] == [b"p" * 500_000]
    assert seen["skipped"] == sum(map(len, parts)) - len(parts[3]) and seen["inflated"] < 510_000


def test_foreign_archives():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    plain = info + record + record
    packed = gzip.compress(info) + gzip.compress(record) + gzip.compress(record)
    for data in (plain, packed):
        found = list(warc.records(pa.BufferReader(data), len(data), lambda f: f["warc-type"] == "resource", True))
        assert [b for _, b in found] == [b"hello"] * 2
        assert found[0][0]["x-long"] == "a b"
    assert gzip.GzipFile(fileobj=io.BytesIO(warc.member(record))).read() == record


def test_the_round_trip_skips_what_each_read_does_not_want(spark, tmp_path):
    path = tmp_path / "archive"
    rows = [("t", i, f"http://a/{i}", "<p>" + "x" * 40_000 + str(i // 4), "d") for i in range(40)]  # three of four revisit
    warc.write_pages(spark.createDataFrame(rows, PAGES), str(path))
    skipped, inflated = {}, {}
    for kind, payloads in (("response", True), ("revisit", False)):
        reader = warc.WarcReader({"path": str(path), "payload": str(payloads), "predicates": f'[["record_type", "eq", "{kind}"]]'})
        seen: dict = {}
        found = 0
        for file in path.glob("*.warc.gz"):
            data = file.read_bytes()
            found += len(list(warc.records(pa.BufferReader(data), len(data), reader.wanted, payloads, seen)))
        assert found == (10 if payloads else 30)
        skipped[kind], inflated[kind] = seen.get("skipped", 0), seen.get("inflated", 0)
    assert inflated["revisit"] == 0 and skipped["revisit"] > skipped["response"] > 0
    assert inflated["response"] < 10 * 41_000


def test_a_commit_leaves_other_writers_files(spark, tmp_path):
    other = tmp_path / ".part-ffff-1.warc.gz"
    other.write_bytes(b"in flight")
    warc.write_pages(spark.createDataFrame(page_rows(), PAGES), str(tmp_path))
    assert other.exists() and [f.name for f in tmp_path.glob(".part-*")] == [other.name]
    failed = warc.WarcWriter({"path": str(tmp_path)})
    failed.write(iter([pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "payload": b"x", "digest": "00" * 20, "refers_to": None}])]))
    assert len(list(tmp_path.glob(".part-*"))) == 2
    failed.abort([])
    assert [f.name for f in tmp_path.glob(".part-*")] == [other.name]
