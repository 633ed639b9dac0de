"""Where a model comes in: a hook that runs a generator over examples, a partition at a time, and never loses a request.

The generator is the caller's: ``make()`` is called once for each partition and returns an object with
``run(requests)``, which takes a list of dicts and returns as many generations. Long prompts go with long ones. A batch
that runs out of memory is run again in smaller ones, without what it had finished; a single request that fails so is
recorded as failed, and the rest goes on. A request whose worker had to be started anew is tried once more. Any other error is no request's fault and stops the query.
"""

from __future__ import annotations

import collections
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surelake.sources import sinks


def by_length(requests: list[dict], text: str, size: int) -> Iterator[list[dict]]:
    """Batches of up to ``size`` requests of about equal length, the longest first; equal lengths keep their order."""
    ordered = sorted(requests, key=lambda r: -len(r[text] or ""))
    for p in range(0, len(ordered), size):
        yield ordered[p : p + size]


class Unfinished(Exception):
    """A batch that ended before its end; ``finished`` has the generations of some of its requests, by their place in the batch."""

    def __init__(self, message: str = "", finished: dict[int, object] | None = None):
        super().__init__(message)
        self.finished = finished or {}


class OutOfMemory(Unfinished, MemoryError):
    """Smaller batches may do."""


class Restart(Unfinished):
    """The generator has to be made anew; what is left is tried once more."""


def run_all(batch: list[dict], run: Callable[[list[dict]], list], together: str | None = None, failed: set | None = None) -> list[tuple[dict, object, str | None]]:
    """(request, generation, failure) of each request, once each and in order.

    Out of memory (any MemoryError) runs what is not finished again in halves; of one request it is its failure. ``Restart`` runs what is not finished once more,
    and a second one is its failure. Any other error is raised. ``together`` names what requests of one example share: after one failed,
    those that have not run yet are not run but recorded as failed too; ``failed`` keeps such examples from batch to batch.
    """
    out: dict[int, tuple[object, str | None]] = {}
    failed = set() if failed is None else failed
    restarted: set[int] = set()
    todo = [list(range(len(batch)))]
    while todo:
        part = todo.pop(0)
        skipped = [i for i in part if together and batch[i][together] in failed]
        out |= {i: (None, "skipped: another request of the example failed") for i in skipped}
        part = [i for i in part if i not in out]
        if not part:
            continue
        try:
            found = run([batch[i] for i in part])
            if len(found) != len(part):
                raise RuntimeError("the generator returned another number of generations")
            out |= {i: (g, None) for i, g in zip(part, found, strict=True)}
        except (MemoryError, Restart) as e:
            finished = getattr(e, "finished", {})
            if not set(finished) <= set(range(len(part))):
                raise RuntimeError("a finished request is outside the batch") from e
            out |= {part[k]: (g, None) for k, g in finished.items()}
            left = [i for i in part if i not in out]
            again = [i for i in left if i not in restarted] if isinstance(e, Restart) else left if len(part) > 1 else []
            for i in (i for i in left if i not in again):
                out[i] = (None, f"{'out of memory' if isinstance(e, MemoryError) else 'worker failed twice'}: {e}")
                failed.add(batch[i].get(together))
            if isinstance(e, Restart):
                restarted.update(again)
                todo = [again, *todo]
            else:
                half = (len(again) + 1) // 2
                todo = [again[:half], again[half:], *todo]
    return [(r, *out[i]) for i, r in enumerate(batch)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's task, and its number among those of its class there; a task keeps a count for each class."""
    task, seen = TaskContext.get().partitionId(), collections.Counter()
    for batch in batches:
        classes = batch.column("__class").to_numpy()
        order = np.argsort(classes, kind="stable")
        found, begin, many = np.unique(classes[order], return_index=True, return_counts=True)
        nth = np.empty(len(classes), np.int64)
        nth[order] = np.arange(len(classes)) - np.repeat(begin - np.array([seen[c] for c in found.tolist()], np.int64), many)
        seen.update(dict(zip(found.tolist(), many.tolist(), strict=True)))
        yield batch.append_column("__task", pa.array(np.full(len(classes), task), pa.int32())).append_column("__nth", pa.array(nth))


def balanced(requests: DataFrame, tasks: int, text: str = "prompt", grain: float = 1.1) -> DataFrame:
    """The same requests dealt to that many tasks of about equal cost, the length of the text and one, with requests of about equal length together, the longest first.

    Lengths fall into classes that grow by ``grain``. Each class takes a stretch of the tasks as long as its share of the cost, and its requests
    are laid along it by rank, which is a request's number in the task that wrote it and the counts of the tasks before: nothing is sorted as a
    whole, and equal requests are spread like others. The driver gets a count for each class. The requests are written to the shared folder
    first, so that ranks hold. No task can be smaller than its longest request.
    """
    spark = requests.sparkSession
    size = (F.coalesce(F.length(F.col(text)), F.lit(0)) + 1).cast("bigint")
    rows = requests.withColumns({"__cost": size, "__class": F.floor(F.log(size) / math.log(grain)).cast("int")})
    at, schema = f"{sinks.shared_folder(spark)}/requests-{uuid.uuid4().hex}", ", ".join(f"`{c}` {kind}" for c, kind in [*rows.dtypes, ("__task", "int"), ("__nth", "bigint")])
    rows.mapInArrow(_numbered, schema).write.parquet(at)
    rows = spark.read.schema(schema).parquet(at)
    sizes = rows.groupBy("__class", "__task").agg(F.count("*").alias("n"), F.sum("__cost").alias("cost"))
    classes = sizes.groupBy("__class").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).orderBy(F.desc("__class")).collect()
    total, reached, stretch = sum(r.cost for r in classes) or 1, 0, []
    for r in classes:
        stretch.append((r["__class"], r.n, reached / total * tasks, r.cost / total * tasks))
        reached += r.cost
    known = spark.createDataFrame(stretch, "__class int, __n bigint, __from double, __wide double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__class").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    ranked = rows.join(sizes.select("__class", "__task", before), ["__class", "__task"]).join(F.broadcast(known), "__class")
    place = F.col("__from") + (F.col("__before") + F.col("__nth") + 0.5) / F.col("__n") * F.col("__wide")
    placed = ranked.withColumn("__place", F.greatest(F.lit(0), F.least(F.floor(place), F.lit(tasks - 1))).cast("int"))
    return placed.repartitionById(tasks, "__place").sortWithinPartitions(F.desc("__cost")).select(*requests.columns)


def generated(requests: DataFrame, make: Callable[[], object], schema: str, key: str = "example_id", text: str = "prompt", batch: int = 8, window: int = 256, together: str | None = None) -> DataFrame:
    """(key, generation, failure): what a generator makes of each request; generation is a struct of ``schema``, null where it failed.

    A window of that many requests is sorted by length at a time, so memory is bounded by it. ``together``: as in ``run_all``, within a partition.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        failed: set = set()

        def run(part: list[dict]) -> list:
            nonlocal generator
            try:
                return generator.run(part)
            except Restart:
                generator = make()
                raise

        for frame in frames:
            for p in range(0, len(frame), window):
                rows = [r for part in by_length(frame.iloc[p : p + window].to_dict("records"), text, batch) for r in run_all(part, run, together, failed)]
                yield pd.DataFrame({key: [r[key] for r, _, _ in rows], "generation": [g for _, g, _ in rows], "failure": [e for _, _, e in rows]})

    kind = dict(requests.dtypes)[key]
    return requests.mapInPandas(work, f"`{key}` {kind}, generation struct<{schema}>, failure string")


def sample_requests(examples: DataFrame, count: int, base_seed: int) -> DataFrame:
    """A request for the greedy answer (index null) and each sample of every example, with its derived seed."""
    from surelake.functions.answers import chat_messages
    from surelake.operators.selection import sample_seed

    index = F.explode_outer(F.concat(F.array(F.lit(None).cast("int")), F.sequence(F.lit(0), F.lit(count - 1))))
    rows = examples.select("example_id", F.get(chat_messages(F.col("question")), F.lit(0))["content"].alias("prompt"), index.alias("index"))
    return rows.withColumn("seed", F.when(F.col("index").isNotNull(), sample_seed(base_seed, "example_id", "index")))
