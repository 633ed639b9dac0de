"""WARC archives as a Spark data source, for reading and writing.

Registered as ``warc``. A read plans one partition for each archive file. Predicates
on record type and the other header columns come with the read's options, or, with
the option ``pushdown``, from the query's own filters. They are
decided on the headers alone, which are parsed first: of a gzip member only the first
few kB are inflated, and a record that is not wanted, or whose payload is not, is
passed over by its length (the member's ``sl`` extra field, or Content-Length in a
plain archive) without decoding the rest. Members without that field are inflated and
dropped. A write gives each task a hidden file that the commit renames, so a task that
is run again leaves no second copy. Paths may be URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from surelake.llm.shared import shared_folder

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, headers map<string,string>, payload binary"
_ROWS = "page_id bigint, url string, payload binary, digest string, refers_to bigint"
_HEADERS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # an archive is the same each time it is written
_FIRST, _READ, _BATCH = 1 << 12, 1 << 20, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def name_of(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload as an HTTP body, or a revisit record without."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id, url, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines.append(f"WARC-Payload-Length: {len(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {name_of(refers_to, None, digest)}", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own length and that of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(head: bytes) -> int | None:
    """The whole length of the gzip member that begins so, if its header tells."""
    if len(head) < 12 or not head[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    p = 12
    while p + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, p + 2)[0]
        if head[p : p + 2] == b"sl" and size == 8 and p + 12 <= len(head):
            return struct.unpack_from("<I", head, p + 4)[0] or None
        p += 4 + size
    return None


def headers_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's header fields by lower-case name, and where its block begins; None if the header is not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    last = ""
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields, end + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The HTTP body of a response, nothing of a revisit, any other record's block."""
    if fields.get("warc-type") == "revisit":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


def columns_of(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest")
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        try:
            digest = base64.b32decode(digest[5:]).hex()
        except ValueError:
            digest = digest[5:]
    elif digest and digest.startswith("sha1:"):
        digest = digest[5:].lower()
    size = fields.get("warc-payload-length", "")
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest, "payload_length": int(size) if size.isdigit() else None}


class _Window:
    """A forward-only view of a file that can skip without reading."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def peek(self, n: int) -> bytes:
        if len(self.held) < n and self.at + len(self.held) < self.size:
            self.held += self.file.read_at(max(n - len(self.held), _READ), self.at + len(self.held))
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def records(file, size: int, wanted, payloads: bool, seen: dict | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields, payload or None) of each wanted record; seen counts inflated and skipped bytes."""
    seen = seen if seen is not None else {}
    w = _Window(file, size)
    while head := w.peek(_FIRST):
        if head[:3] == b"\x1f\x8b\x08":
            length = _member_length(head)
            unpack = zlib.decompressobj(31)
            data, fed = unpack.decompress(head, _FIRST), len(head)
            while (got := headers_of(data)) is None and not unpack.eof:
                more = unpack.unconsumed_tail
                if not more:
                    chunk = w.peek(fed + _FIRST)[fed:]
                    if not chunk:
                        break
                    fed += len(chunk)
                    more = chunk
                data += unpack.decompress(more, _FIRST)
            if got is None:
                if data.strip():
                    raise ValueError("a record has no complete header")
                w.skip(_ended(w, unpack, fed))
                continue
            fields, block = got
            want = wanted(fields)
            if length and not (want and payloads):
                seen["skipped"] = seen.get("skipped", 0) + length
                w.skip(length)
            else:
                parts = [data]
                while not unpack.eof:
                    more = unpack.unconsumed_tail
                    if not more:
                        chunk = w.peek(fed + _READ)[fed:]
                        if not chunk:
                            raise ValueError("the archive ends within a record")
                        fed += len(chunk)
                        more = chunk
                    parts.append(unpack.decompress(more, _READ))
                    if not (want and payloads):
                        parts = parts[:1]
                whole = b"".join(parts)
                seen["inflated"] = seen.get("inflated", 0) + len(whole)
                w.skip(fed - len(unpack.unused_data))
                data = whole
            if want:
                body = None
                if payloads:
                    body = payload_of(fields, data[block : block + int(fields.get("content-length", len(data) - block - 4))])
                yield fields, body
        elif head[:5] == b"WARC/":
            n = _FIRST
            while (got := headers_of(w.peek(n))) is None:
                if len(w.peek(n)) < n:
                    raise ValueError("a record has no complete header")
                n *= 2
            fields, block = got
            size_of = int(fields.get("content-length", 0))
            if wanted(fields):
                body = payload_of(fields, w.peek(block + size_of)[block:]) if payloads else None
                yield fields, body
            else:
                seen["skipped"] = seen.get("skipped", 0) + size_of
            w.skip(block + size_of)
        elif head[:2] in (b"\r\n", b"\n\n") or head[:1] in (b"\r", b"\n"):
            w.skip(len(head) - len(head.lstrip(b"\r\n")))
        else:
            raise ValueError(f"no WARC record at byte {w.at}")


def _ended(w: _Window, unpack, fed: int) -> int:
    while not unpack.eof:
        chunk = w.peek(fed + _FIRST)[fed:]
        if not chunk:
            return fed
        fed += len(chunk)
        unpack.decompress(chunk)
    return fed - len(unpack.unused_data)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.rules: list[tuple[str, str, object]] = [tuple(r) for r in json.loads(options.get("predicates", "[]"))]
        self.takes_filters = str(options.get("pushdown", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        if not self.takes_filters:
            yield from filters
            return
        kinds = {EqualTo: "eq", EqualNullSafe: "same", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNotNull: "some", IsNull: "none"}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in kinds and column in _HEADERS:
                self.rules.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool:
        if not self.rules:
            return True
        row = columns_of(fields)
        for column, kind, value in self.rules:
            x = row[column]
            ok = x is None if kind == "none" else x == value if kind == "same" else x is not None and (
                kind == "some" or kind == "eq" and x == value or kind == "in" and x in value or kind == "starts" and x.startswith(value) or kind == "ends" and x.endswith(value) or kind == "contains" and value in x
            )
            if not ok:
                return False
        return True

    def partitions(self):
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [_File(path)]
        files = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and f.size]

    def read(self, partition):
        if partition is None:
            return
        fs, _ = opened(self.path)
        kinds = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))

        with fs.open_input_file(partition.value) as file:
            for fields, body in records(file, file.size(), self.wanted, self.payloads):
                rows.append(columns_of(fields) | {"headers": list(fields.items()), "payload": body})
                size += 1000 + len(body or b"")
                if size >= _BATCH or len(rows) >= 5000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, hidden: str | None):
        self.hidden = hidden


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, payload, digest, refers_to): a record each, gzip members on end, one file for each task."""

    def __init__(self, options):
        self.path = options["path"]
        self.job = uuid.uuid4().hex  # made once, on the driver, and known to all tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = opened(self.path)
        hidden, out = None, None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        hidden = f"{path}/.part-{self.job}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(hidden, compression=None)
                    out.write(member(record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["refers_to"])))
        finally:
            if out is not None:
                out.close()
        return _Written(hidden)

    def commit(self, messages) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        for k, m in enumerate(messages):
            if m is not None and m.hidden:
                fs.move(m.hidden, f"{path}/part-{k:05d}-{m.hidden.rsplit('-', 1)[1]}")
        for f in fs.get_file_info(pafs.FileSelector(path)):
            if f.base_name.startswith(f".part-{self.job}-"):  # of tasks that were run again; other writers' files are theirs
                fs.delete_file(f.path)

    def abort(self, messages) -> None:
        fs, path = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f".part-{self.job}-"):
                fs.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> None:
    """Writes a record for each row of ``pages``, the html in UTF-8 as payload (null: empty).

    Of rows with equal payloads of ``least`` bytes or more, that with the largest key is a response and the others revisit it;
    rows that tie on it are all responses, a null key is the smallest, and copies that all lack a key are all responses.
    An empty table makes an empty archive. Other columns are not read.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    copies = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "kept")
    # Small payloads need no partner and get keys of their own, so that equal ones do not meet in one task.
    on = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.xxhash64("url"))))
    joined = rows.withColumn("on", on).join(copies, F.col("on") == F.col("of"), "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, predicates: list[tuple[str, str, object]] | None = None, pushdown: bool = False) -> DataFrame:
    """The records of an archive, or of a folder of them, for which all predicates (column, kind, value) hold.

    Kinds: eq, same (null-safe), in, starts, ends, contains, some (not null), none (null). With ``pushdown`` the filters of
    the query do the same. Spark 4.1 keeps what a read took over with the data frame, so such a frame must serve one query
    with one set of filters; read anew for each other one.
    """
    register(spark)
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", str(pushdown).lower())
    return reader.option("predicates", json.dumps(predicates or [])).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to an archive in the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, of which size and digest are taken anew; revisits by their headers alone. Each
    read's predicate on the record type passes over the other records by their length. Nulls, repeats and an empty table
    are as ``write_pages`` has them; a row without page_id comes back without.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    responses = read_archive(spark, path, predicates=[("record_type", "eq", "response")])
    revisits = read_archive(spark, path, payload=False, predicates=[("record_type", "eq", "revisit")])
    facts = lambda rows, size, digest: rows.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    full = facts(responses, F.octet_length("payload").cast("bigint"), F.sha1("payload"))
    return full.unionByName(facts(revisits, F.col("payload_length"), F.col("payload_digest")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM k
"""
