"""Result logs as streams: resumable ingest, completeness of components, and control."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from surelake.sources.logs import log_stream, parsed
from surelake.sources.sinks import atomic_json


def run_signature(identity: dict) -> str:
    """Digest of what a run depends on; a resumed run must have the same."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def resume_guard(folder: str, identity: dict) -> str:
    """Writes the signature beside the checkpoint on the first run and compares it on each later one."""
    signature, path = run_signature(identity), os.path.join(folder, "run_signature")
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() != signature:
                raise ValueError("the run's identity differs from the one that is resumed")
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(signature)
    return signature


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "example_id", fmt: str = "json", files_per_trigger: int = 8, strict: bool = True) -> StreamingQuery:
    """Appends new rows of a folder to a Parquet table, then stops; what was read before is not read again.

    strict: a key that is already there stops the query. Each batch is then held against the key column of the table, of which
    nothing else is read. Otherwise such a row is left out, and the stream's state store has the keys that it let pass, so a
    batch costs as much as its own rows; the table is looked at only if it had rows before the stream's first run, or if that
    run was strict. A stream that began without ``strict`` stays so. A batch that is written again after a failure
    replaces its own rows and no others.
    """
    return ingest_rows(spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(source), target, checkpoint, key, strict)


def ingest_log(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "example_id", strict: bool = True, split_bytes: int = 64 << 20) -> StreamingQuery:
    """As ``ingest``, from JSON-lines logs that grow: each run reads what whole lines were added. A torn last line waits, any other corrupt one stops the query."""
    return ingest_rows(parsed(log_stream(spark, source, split_bytes), schema), target, checkpoint, key, strict)


def ingest_rows(rows: DataFrame, target: str, checkpoint: str, key: str, strict: bool) -> StreamingQuery:
    """A stream of rows into a table, as ``ingest`` has it."""
    spark, schema = rows.sparkSession, ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    older, mark = exists(spark, target), f"{checkpoint.rstrip('/')}.keyed"
    keyed = exists(spark, mark)
    if strict and keyed:
        raise ValueError("the stream began without strict")
    if not strict and not keyed and not exists(spark, checkpoint):
        keyed = True
        spark.createDataFrame([(older,)], "older boolean").write.json(mark)
    look = strict or not keyed or spark.read.schema("older boolean").json(mark).first()[0]
    if keyed:
        rows = rows.dropDuplicates([key])

    def append(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        done = own.read.schema(f"{schema}, __batch int").option("basePath", target).parquet(target).where(F.col("__batch") != number).select(key) if look and exists(own, target) else None
        if strict:
            fresh = batch
            repeated = batch.groupBy(key).count().where("count > 1").select(key)
            again = repeated if done is None else repeated.unionByName(batch.join(done, key, "left_semi").select(key))
            if first := again.first():
                raise ValueError(f"duplicate checkpoint for {first[0]}")
        else:
            fresh = batch if keyed else batch.dropDuplicates([key])
            fresh = fresh if done is None else fresh.join(done, key, "left_anti")
        fresh.withColumn("__batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(target)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(selected: DataFrame, completed: DataFrame, failed: DataFrame | None = None, key: str = "example_id") -> DataFrame:
    """Selected rows that are not completed, nor given up."""
    out = selected.join(completed.select(key), key, "left_anti")
    return out if failed is None else out.join(failed.select(key), key, "left_anti")


def new_components(stored: DataFrame, arriving: DataFrame, keys: tuple[str, str] = ("example_id", "component")) -> DataFrame:
    """Arriving components that are not stored yet: each is written once."""
    return arriving.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def complete_components(components: DataFrame, sample_count: int, key: str = "example_id", component: str = "component") -> DataFrame:
    """Keys that have their greedy part and every sample from 0 to sample_count - 1."""
    number = F.when(F.col(component).rlike(r"^\d+$"), F.col(component).try_cast("int"))
    each = components.groupBy(key).agg(F.max(F.col(component) == "greedy").alias("greedy"), F.count_distinct(F.when(number.between(0, sample_count - 1), number)).alias("samples"))
    return each.where(F.col("greedy") & (F.col("samples") == sample_count)).select(key)


def open_failures(events: DataFrame, key: str = "example_id") -> DataFrame:
    """Keys whose last event is a failure, with all their failures in order; events: key, at, failure (null: cleared)."""
    last = F.max_by("failure", "at")
    history = F.transform(F.sort_array(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("at", "failure")))), lambda e: e["failure"])
    return events.groupBy(key).agg(last.alias("failure"), history.alias("failure_history")).where("failure IS NOT NULL")


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).count()


class Progress(StreamingQueryListener):
    """Rows and rate of each batch, at least ``seconds`` apart, to ``sink``; with a path, also as progress.json, replaced at once."""

    def __init__(self, seconds: float = 30.0, sink=print, path: str | None = None):
        self.seconds, self.sink, self.path, self.last, self.rows = seconds, sink, path, -seconds, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        import time

        self.rows += event.progress.numInputRows
        if time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            found = {"rows": event.progress.numInputRows, "total_rows": self.rows, "rows_per_hour": (event.progress.processedRowsPerSecond or 0.0) * 3600, "batch": event.progress.batchId, "at": event.progress.timestamp}
            self.sink(found)
            if self.path:
                atomic_json(self.path, found)

    def onQueryTerminated(self, event):
        pass


def stop_when(query: StreamingQuery, stop_file: str, deadline_seconds: float, poll: float = 1.0) -> str:
    """Waits until the query ends, the file appears or time is up; what is left can be resumed."""
    import time

    end = time.monotonic() + deadline_seconds
    while query.isActive:
        if os.path.exists(stop_file) or time.monotonic() >= end:
            query.stop()
            return "partial"
        query.awaitTermination(poll)
    return "complete"


def request_stop(folder: str) -> str:
    """Leaves the file that ``stop_when`` looks for."""
    path = os.path.join(folder, "stop")
    with open(path, "w", encoding="utf-8"):
        return path


def run_status(folder: str) -> dict:
    """What a run's folder tells of it: its manifest's status and counts, the last progress, whether a writer holds it and whether it is asked to stop."""

    def read(name: str) -> dict:
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    manifest = read("run_manifest.json")
    return {
        "status": manifest.get("status", "unknown"), "selected": len(manifest.get("selected_example_ids", [])), "progress": read("progress.json"),
        "being_written": os.path.exists(os.path.join(folder, "writer.lock")), "stopping": os.path.exists(os.path.join(folder, "stop")),
    }
