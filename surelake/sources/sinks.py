"""Small result files, written by the driver; tables go through Spark's own writers."""

from __future__ import annotations

import csv
import fcntl
import json
import os
import socket
import tempfile
from contextlib import contextmanager
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.functions.answers import markdown_cell


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session on one machine may do without, as in tests: it gets a temporary folder, once.

    On a cluster a machine's own folder would scatter a table's parts over the machines, so an unset one is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().get().rstrip("/")


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


METRIC_FIELDS = ["analysis", "dataset", "signal", "n", "scorable_n", "coverage", "accuracy", "ece", "auroc"]
BIN_FIELDS = ["analysis", "dataset", "signal", "bin_index", "lower", "upper", "count", "mean_confidence", "accuracy"]


def document(value: object) -> str:
    """Indented JSON with sorted keys. Keys are text or whole numbers, which become text; an object where two become the same is refused."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            strange = {type(k) for k in x} - {str, int}
            if strange or len(set(map(str, x))) < len(x):
                raise ValueError(f"an object's keys are no distinct texts and whole numbers: {list(x)}")
        todo += x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ()
    return json.dumps(json.loads(json.dumps(value)), ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def atomic_json(path: str, value: object) -> None:
    """Writes a document beside the file and renames it over it, so that a reader finds the old one or the new one."""
    folder, name = os.path.split(os.path.abspath(path))
    with tempfile.TemporaryDirectory(prefix=f".{name}-", dir=folder) as own:
        part = Path(own, name)
        with part.open("w", encoding="utf-8") as f:
            f.write(document(value))
            f.flush()
            os.fsync(f.fileno())
        part.replace(path)


def append_predictions(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Adds complete predictions to a log, a folder of JSON lines, columns in the order of their names; one that is not complete stops the query. ``compression``: none or gzip, as the log's reader knows; packed files are of 20,000 records at most, as one task reads a whole one."""
    from surelake.sources.checkpoints import is_complete

    # As a column, not a filter: Spark would copy what makes greedy and samples into a filter.
    status = F.when(F.coalesce(is_complete(), F.lit(False)), F.col("status")).otherwise(F.raise_error(F.lit("only complete predictions can be appended")).cast("string"))
    records.withColumn("status", status).select(*sorted(records.columns)).write.mode("append").option("ignoreNullFields", "false").option("compression", compression).option("maxRecordsPerFile", 0 if compression == "none" else 20_000).json(folder)


def append_record(path: str, record: dict) -> None:
    """One line, keys sorted, on disk before this returns."""
    with open(path, "ab") as f:
        f.write(json.dumps(record, ensure_ascii=False, sort_keys=True).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None) -> None:
    """A report's small table as one file with a header; null is empty."""
    rows = df.select(*dict.fromkeys([*fields, *(order or [])]))
    if order:
        rows = rows.orderBy(*order)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(fields)
        for r in rows.toLocalIterator():
            out.writerow(["" if r[c] is None else r[c] for c in fields])


def markdown_table(rows: list, fields: list[str]) -> str:
    lines = ["| " + " | ".join(fields) + " |", "|" + "---|" * len(fields)]
    return "\n".join(lines + ["| " + " | ".join(markdown_cell(r[f]) for f in fields) + " |" for r in rows]) + "\n"


def write_conditions(results: DataFrame, folder: str) -> dict[str, int]:
    """eval_<condition>.jsonl for each condition, a file each, and results.json with counts and shares; returns the counts.

    Rows are streamed through the driver partition by partition: these are files for people, of one study.
    """
    os.makedirs(folder, exist_ok=True)
    out, counts = {}, {}
    for c in sorted(r[0] for r in results.select("condition").distinct().collect()):
        right = 0
        with open(os.path.join(folder, f"eval_{c}.jsonl"), "w", encoding="utf-8") as f:
            for r in results.where(F.col("condition") == c).drop("condition").orderBy("example_id").toLocalIterator():
                f.write(json.dumps(r.asDict(True), ensure_ascii=False, sort_keys=True) + "\n")
                counts[c] = counts.get(c, 0) + 1
                right += bool(r["correct"])
        out[c] = {"n": counts[c], "correct": right, "accuracy": right / counts[c]}
    atomic_json(os.path.join(folder, "results.json"), out)
    return counts


def tree_digest(root: str, patterns: tuple[str, ...] = ("**/*.py",)) -> str:
    """One digest of the files that match: names and contents with their lengths before them, so that no two trees read alike."""
    base, digest = Path(root), sha256()
    for path in sorted({p for pattern in patterns for p in base.glob(pattern) if p.is_file()}):
        name, body = path.relative_to(base).as_posix().encode(), path.read_bytes()
        for part, width in ((name, 4), (body, 8)):
            digest.update(len(part).to_bytes(width, "big") + part)
    return digest.hexdigest()


@contextmanager
def writer_lock(folder: str):
    """Only one writer at a time. The file is locked by the system while it is held, and names host and process.

    A file that its writer left behind, as its process ended, is taken over on the same host only, where the system's lock tells that it is gone; one of
    another host is never, as nothing here can tell: it has to be removed by hand.
    """
    path, host = os.path.join(folder, "writer.lock"), socket.gethostname()
    os.makedirs(folder, exist_ok=True)
    while True:
        handle = os.open(path, os.O_CREAT | os.O_RDWR)
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            owner = os.read(handle, 1000).decode("utf-8", "replace")
            if owner and owner.rpartition(" ")[0] != host:
                raise BlockingIOError
            if os.path.exists(path) and os.path.samestat(os.fstat(handle), os.stat(path)):
                break
            os.close(handle)  # the one before removed it just now
        except BlockingIOError:
            owner = os.pread(handle, 1000, 0).decode("utf-8", "replace")
            os.close(handle)
            raise RuntimeError(f"{folder} is being written by {owner or 'another process'}") from None
    try:
        os.truncate(handle, 0)
        os.pwrite(handle, f"{host} {os.getpid()}".encode(), 0)
        yield path
    finally:
        os.remove(path)
        os.close(handle)


def environment() -> dict:
    """What a run was made with."""
    import platform
    from importlib import metadata

    versions = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "math-verify"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = "not-installed"
    return {"python": platform.python_version(), "platform": platform.platform(), "cpus": os.cpu_count(), "packages": versions}
