"""A keyed stream of an example's components: each is written once, and the example comes out once it is whole.

Events have example_id, kind (component, failed or cleared), component (greedy, or a sample's number), payload (the component's, or
the reason of a failure) and at. Per example the state store holds the components so far, an open failure and those before it, and
when its time runs out. When the greedy part and all samples are there and no failure is open, the example is given out and its components are
dropped from the state. Time that runs out first opens a failure that names what is missing. A failure, too, is given out;
clearing it keeps the components, and what is then whole is given out at once.

The state's keys are buckets of examples by hash, as each key costs Python some calls to the state store: a bucket's entry has the ids of its
examples, when the first one's time runs out as a timer, and what is short of the open ones. What is longer has an entry of its own, so it is read and written only
when its example has events.
"""

from __future__ import annotations

import collections
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from surelake.streaming.ingest import exists

EVENT = "example_id string, kind string, component string, payload string, at timestamp"
STAGED = "example_id string, status string, greedy string, samples array<string>, failure string, failure_history array<string>, missing array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in STAGED.split(", ")]
_ORDER = {"component": 0, "failed": 1, "cleared": 2}  # of events of one time
_BUCKETS = 1 << 14  # a checkpoint's state holds for this number only
_SHORT = 256  # characters of an open example that are kept in its bucket's entry


class Stage(StatefulProcessor):
    """The events of the examples of a bucket, each example's in the order of their times, those of one batch before anything is decided."""

    def __init__(self, samples: int, patience_ms: int, strict: bool):
        self.wanted = ["greedy", *map(str, range(samples))]
        self.patience, self.strict = patience_ms, strict

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "body string")
        self.long = handle.getMapState("long", "example_id string", "body string")

    def _saved(self) -> tuple[dict[str, None], dict[str, list], int]:
        """The ids of whole examples; [due, components, failure, history] of open ones, or [due, None] if that has an entry of its own; the timer."""
        found = self.bucket.get()
        done, opened, timer = json.loads(found[0]) if found else ([], {}, 0)
        return dict.fromkeys(done), opened, timer

    def _save(self, done: dict[str, None], opened: dict[str, list], before: int) -> None:
        timer = min((x[0] for x in opened.values() if x[0]), default=0)
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            if timer:
                self.handle.registerTimer(timer)
        self.bucket.update((json.dumps([list(done), opened, timer]),))

    def _take(self, opened: dict[str, list], key: str) -> tuple[list, bool]:
        """An example's part of the state, and whether it has an entry of its own."""
        x = opened.get(key, [0, {}, None, []])
        return (x, False) if x[1] is not None else ([x[0], *json.loads(self.long.getValue((key,))[0])], True)

    def _put(self, opened: dict[str, list], key: str, due: int, body: list | None, own: bool) -> None:
        """Keeps an example's part of the state, or drops it if there is no body."""
        text = json.dumps(body)
        if body is not None and len(text) > _SHORT:
            self.long.updateValue((key,), (text,))
            opened[key] = [due, None]
            return
        if own:
            self.long.removeKey((key,))
        if body is None:
            opened.pop(key, None)
        else:
            opened[key] = [due, *body]

    def _out(self, key: str, status: str, parts: dict, failure: str | None, history: list) -> tuple:
        return (key, status, parts.get("greedy"), [parts.get(n) for n in self.wanted[1:]], failure, history, [n for n in self.wanted if n not in parts])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, opened, timer = self._saved()
        events, out = collections.defaultdict(list), []
        for f in rows:
            for e, *r in zip(*(f[c].tolist() for c in ("example_id", "at_ms", "kind", "component", "payload", "seen_ms")), strict=True):
                events[e].append(r)
        for e, found in events.items():
            out += self._follow(e, found, done, opened)
        self._save(done, opened, timer)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _follow(self, key: str, events: list, done: dict[str, None], opened: dict[str, list]) -> list[tuple]:
        """What one example's events of a batch bring about."""
        whole = key in done
        (due, parts, failure, history), own = self._take(opened, key)
        failed = failure
        for _, kind, component, payload, start in sorted(events, key=lambda r: (r[0], _ORDER.get(r[1], 3), r[2] or "", r[3] or "")):
            if kind == "component":
                if component not in self.wanted:
                    raise ValueError(f"{key} has no component {component}")
                if whole or component in parts:
                    if self.strict and (whole or parts[component] != payload):
                        raise ValueError(f"component {component} of {key} is there already")
                    continue
                parts[component] = payload
                due = due or (0 if failure is not None else start + self.patience)
            elif kind == "failed" and not whole:
                failure, due = payload or "failed", 0
            elif kind == "cleared" and failure is not None:
                history, failure, due = [*history, failure], None, start + self.patience
        if whole:
            return []
        if failure is None and len(parts) == len(self.wanted):
            done[key] = None
            self._put(opened, key, 0, None, own)
            return [self._out(key, "complete", parts, None, history)]
        self._put(opened, key, due, [parts, failure, history], own)
        return [self._out(key, "failed", parts, failure, history)] if failure is not None and failure != failed else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, opened, timer = self._saved()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for e in [e for e, x in opened.items() if 0 < x[0] <= now]:
            (_, parts, _, history), own = self._take(opened, e)
            self._put(opened, e, 0, [parts, "timed out", history], own)
            out.append(self._out(e, "failed", parts, "timed out", history))
        if out:
            self._save(done, opened, timer)
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def staged(events: DataFrame, samples: int, patience: str = "1 day", late: str | None = None, strict: bool = True) -> DataFrame:
    """A stream of STAGED from a stream of EVENT; one row for each example that is whole, and one for each failure.

    patience: how long after its first component (or after a failure was cleared) an example may stay incomplete. With ``late``, time
    is that of the events, and Spark drops an event that is later than that behind the newest, its component too. Without, it is
    that of the batch in which an event arrives, and nothing is dropped; timers are then looked at whenever something arrives. A component that comes again as it was is the same write; another one stops the query, and so
    does any component of an example that was given out; with strict=False the first one holds.
    The session's state store must be RocksDB (``STORE``), which ``run_stages`` sets.
    """
    spark = events.sparkSession
    patience_ms = int(spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00 UTC' + INTERVAL {patience})").first()[0])
    seen = events.withColumn("seen", F.current_timestamp() if late is None else F.col("at")).withWatermark("seen", late or "0 seconds")
    millis = lambda c: F.coalesce(F.unix_millis(c), F.lit(0))
    rows = seen.where("example_id IS NOT NULL").select(F.pmod(F.xxhash64("example_id"), F.lit(_BUCKETS)).cast("int").alias("bucket"), "example_id", "kind", "component", "payload", millis("at").alias("at_ms"), millis("seen").alias("seen_ms"), "seen")
    return rows.groupBy("bucket").transformWithStateInPandas(Stage(samples, patience_ms, strict), STAGED, "append", "EventTime")


def run_stages(events: DataFrame, target: str, checkpoint: str, samples: int, patience: str = "1 day", late: str | None = None, strict: bool = True) -> StreamingQuery:
    """Runs ``staged`` over what is there now, appends to a Parquet table and stops; the next run goes on from there.

    A batch that is written again after a failure replaces its own rows and no others.
    """
    spark = events.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(target)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        return staged(events, samples, patience, late, strict).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_staged(spark: SparkSession, target: str) -> DataFrame:
    """What ``run_stages`` has written so far; nothing before its first row."""
    if not exists(spark, target):
        return spark.createDataFrame([], STAGED)
    return spark.read.schema(f"{STAGED}, __batch int").parquet(target)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each example: that it is complete, or its open failure."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("example_id", "__batch")]), F.struct("__batch", F.size("failure_history"), F.col("status") == "complete"))
    return rows.groupBy("example_id").agg(last.alias("r")).select("example_id", "r.*")
