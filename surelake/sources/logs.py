"""Append-only logs of lines as a Spark data source, for batches and streams.

``spark.read.format("lines_log").load(path)`` cuts files into byte ranges, so one large file is read by many tasks; a line
belongs to the range in which it begins. ``spark.readStream.format("lines_log")`` has the byte behind the last line end of each file as its
offset. A last line that no line end follows was torn off in writing: it is not read, and a stream reads it once it is whole.
Files ending in .gz are written once as a whole: each is one range, read by one task, and bytes are counted unpacked.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINES = "value string, file string, byte bigint, range bigint, line bigint"
FORMAT = "lines_log"
_CHUNK = 4 << 20
_BAD = "__corrupt"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def packed(file: str) -> bool:
    return file.endswith(".gz")


def whole_end(file: str, room: int = 1 << 16) -> int:
    """The byte behind a file's last line end; 0 if it has none. Reads backwards from the end as far as it must. A packed file's size."""
    system, path = opened(file)
    if packed(file):
        return system.get_file_info(path).size
    with system.open_input_file(path) as f:
        end = f.size()
        while end:
            start = max(0, end - room)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end, room = start, room * 4
    return 0


def log_files(path: str) -> list[str]:
    """A file, or the files in and below a folder, in order; hidden ones are left out."""
    system, at = opened(path)
    scheme = path.split("://", 1)[0] + "://" + path.split("://", 1)[1].split("/", 1)[0] if "://" in path and not path.startswith("file:") else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    below = at.rstrip("/") + "/"
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + i.path for i in found if i.is_file and not any(p[:1] in "._" for p in i.path.removeprefix(below).split("/")))


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that begin from ``start`` on and before ``end``; ``aligned``: a line begins at start."""

    file: str
    start: int
    end: int
    aligned: bool


def ranges(file: str, start: int, end: int, size: int) -> list[ByteRange]:
    if packed(file) and 0 < start < end:
        raise ValueError(f"{file} is packed and was written to after it was read")
    return [ByteRange(file, a, min(a + size, end), a == start) for a in range(start, end, max(1, end - start) if packed(file) else size)]


def _batch(part: ByteRange, body: bytes, starts: np.ndarray, begin: int, first: int) -> pa.RecordBatch:
    """The lines of a body that ends with one, from where they start in it; the body begins at byte ``begin``."""
    n = len(starts)
    text = body[starts[0] :].replace(b"\n", b"")
    ends = np.append(starts - starts[0] - np.arange(n), len(text)).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(text)])
    try:
        values = lines.cast(pa.string())
    except pa.ArrowInvalid:
        bad = next(i for i, b in enumerate(lines.to_pylist()) if b.decode("utf-8", "replace").encode() != b)
        raise ValueError(f"line {first + bad} after byte {part.start} of {part.file} is not UTF-8") from None
    return pa.RecordBatch.from_arrays([values, pa.repeat(part.file, n), pa.array(starts + begin), pa.repeat(pa.scalar(part.start, pa.int64()), n), pa.array(np.arange(first, first + n))], names=["value", "file", "byte", "range", "line"])


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The range's lines, a few MB at a time; a line may be longer."""
    system, path = opened(part.file)
    whole = packed(part.file)
    with system.open_input_stream(path, compression="gzip") if whole else system.open_input_file(path) as f:
        if not whole and f.size() < part.end:
            raise ValueError(f"{part.file} is shorter than what was read of it")
        at = part.start if part.aligned else part.start - 1
        if not whole:
            f.seek(at)
        end = float("inf") if whole else part.end
        skip, rest, begin, first = not part.aligned, [], at, 1
        while begin < end or skip:
            chunk = f.read(_CHUNK)
            if not chunk:
                break  # a line that is not whole; the range's end is never behind one
            cut = chunk.rfind(b"\n") + 1
            if not cut:
                rest.append(chunk)
                continue
            body = b"".join([*rest, chunk[:cut]])
            rest = [chunk[cut:]]
            starts = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1  # of the next line each
            starts = np.concatenate([[0], starts])[int(skip) :]  # with skip, the first line begins in the range before
            skip = False
            many = int((starts[:-1] + begin < end).sum())
            if many:
                yield _batch(part, body[: starts[many]], starts[:many], begin, first)
            first, begin = first + many, begin + len(body)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[ByteRange]:
        files = log_files(self.path)
        with ThreadPoolExecutor(16) as pool:
            return [r for f, end in zip(files, pool.map(whole_end, files), strict=True) for r in ranges(f, 0, end, self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = log_files(self.path)
        with ThreadPoolExecutor(16) as pool:
            return dict(zip(files, pool.map(whole_end, files), strict=True))

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        short = [f for f, at in end.items() if at < start.get(f, 0)]
        if short:
            raise ValueError(f"{short[0]} is shorter than what was read of it")
        return [r for f, at in sorted(end.items()) for r in ranges(f, start.get(f, 0), at, self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class LinesLog(DataSource):
    """Options: path, and split_bytes, the size of a range (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def _made(self, kind):
        size = int(self.options.get("split_bytes", 64 << 20))
        if size < 1:
            raise ValueError("a range has a byte at least")
        return kind(self.options["path"], size)

    def reader(self, schema) -> _Reader:
        return self._made(_Reader)

    def streamReader(self, schema) -> _StreamReader:
        return self._made(_StreamReader)


def log_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """LINES: each whole line, its file, the byte at which it begins, the range it was read in and its number there, from 1."""
    spark.dataSource.register(LinesLog)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)


def log_stream(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream: each run reads what lines were added, to new files and old ones."""
    spark.dataSource.register(LinesLog)
    return spark.readStream.format(FORMAT).option("split_bytes", split_bytes).load(path)


def place() -> Column:
    """Names a line in errors: its number in the file or, where the file was cut, after the byte at which its range begins."""
    return F.concat(F.lit("line "), F.col("line").cast("string"), F.when(F.col("range") > 0, F.concat(F.lit(" after byte "), F.col("range").cast("string"))).otherwise(""), F.lit(" of "), F.col("file"))


def once(value: Column) -> Column:
    """The value, computed once a row: Spark copies an expression into every filter and column that names it, but none out of a generator."""
    return F.explode(F.array(value))


def parsed(lines: DataFrame, schema: str, complete: Column | None = None, blank: bool = False) -> DataFrame:
    """The lines as JSON objects of a schema, strictly: a corrupt line stops the query, and so does one that is not ``complete``; the error names line and file.

    Blank lines are corrupt, unless ``blank`` lets them pass. Works on batches and streams, in built-in functions.
    """
    if blank:
        lines = lines.where(F.length(F.trim("value")) > 0)
    rows = lines.select("file", "range", "line", once(F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})).alias("r"))
    stop = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("__at"))).cast("boolean")
    rows = rows.select(place().alias("__at"), "r")
    fine = F.when(F.col(f"r.{_BAD}").isNotNull() | F.col("r").isNull(), stop("a checkpoint row is corrupt")).otherwise(F.lit(True))
    rows = rows.where(fine).select("__at", "r.*").drop(_BAD)
    if complete is not None:
        rows = rows.where(F.when(F.coalesce(complete, F.lit(False)), F.lit(True)).otherwise(stop("a checkpoint row is not a complete prediction")))
    return rows.drop("__at")


def offsets(query_progress: dict) -> dict[str, int]:
    """What a stream's last progress says it has read of each file."""
    end = query_progress["sources"][0]["endOffset"]
    return ast.literal_eval(end) if isinstance(end, str) else dict(end or {})
