"""Metrics that a stream keeps up to date: counts per distinct score, added up batch by batch.

A batch writes its own counts (``metrics.score_counts``), so it costs what its rows cost. After every ``fan`` batches their counts are
merged into one part, ``fan`` of those into one, and so on: a batch's rows are merged as often as the number of batches has digits to
that base, and who reads the state reads at most ``fan`` parts a digit. Parts are named by level and last batch, so a batch that is written again after a failure
replaces its own parts and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surelake.operators import metrics
from surelake.streaming.ingest import exists


def parts_of(batches: int, fan: int) -> list[tuple[int, int]]:
    """(level, last batch) of the parts that together hold that many batches: the digits of their number."""
    out, reached, width, level = [], 0, 1, 0
    while width * fan <= batches:
        width, level = width * fan, level + 1
    while width:
        while reached + width <= batches:
            reached += width
            out.append((level, reached - 1))
        width, level = width // fan if width > 1 else 0, level - 1
    return out


def _schema(kinds: dict[str, str], groups: list[str]) -> str:
    return ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "s double, pos bigint, neg bigint, __level int, __batch bigint"])


def _among(parts: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for level in sorted({x for x, _ in parts}):
        out |= (F.col("__level") == level) & F.col("__batch").isin(*(b for x, b in parts if x == level))
    return out


def _added(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _write(rows: DataFrame, level: int, number: int, target: str) -> None:
    rows.withColumns({"__level": F.lit(level), "__batch": F.lit(number).cast("bigint")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__level", "__batch").parquet(target)


def follow(rows: DataFrame, groups: list[str], target: str, checkpoint: str, fan: int = 16) -> StreamingQuery:
    """Counts a stream of groups, score and outcome into ``target``, then stops; the next run goes on from there.

    As in ``metrics.metric_table``, rows without a known outcome do not count, and a score that is not valid counts as none.
    """
    if fan < 2:
        raise ValueError("a merge takes two parts at least")
    kinds = dict(rows.dtypes)

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write(metrics.score_counts(batch.withColumn("score", metrics.valid_score("score")), groups), 0, number, target)
        level, width = 1, fan
        while (number + 1) % width == 0 and exists(spark, target):
            below = [(level - 1, number - k * (width // fan)) for k in range(fan)]
            state = spark.read.schema(_schema(kinds, groups)).parquet(target).where(_among(below))
            _write(_added(state, groups), level, number, target)
            level, width = level + 1, width * fan

    return rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, target: str, groups: list[str], fan: int = 16, kinds: dict[str, str] | None = None) -> DataFrame:
    """``metrics.score_counts`` of all batches so far. kinds: of the groups, text by default."""
    schema = _schema({g: "string" for g in groups} | (kinds or {}), groups)
    if not exists(spark, target):
        return _added(spark.createDataFrame([], schema), groups)
    rows = spark.read.schema(schema).parquet(target)
    last = rows.where("__level = 0").agg(F.max("__batch")).first()[0]
    return _added(rows.where(_among(parts_of(0 if last is None else last + 1, fan))), groups)


def current_metrics(spark: SparkSession, target: str, groups: list[str], fan: int = 16, kinds: dict[str, str] | None = None, n_bins: int = metrics.BINS) -> DataFrame:
    """The metric table of all rows that the stream has counted, from the counts alone."""
    return metrics.metrics_of_counts(current_counts(spark, target, groups, fan, kinds), groups, n_bins=n_bins)
