"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.sources.sinks import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder. Its plan starts anew there, so it hangs on no executor."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored = path
    return found


_MOST_BROADCAST = 1 << 20  # numbers of 8 bytes


def repeated(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The keys that rows have more than once, as a stored table, and how many those are. Counted on each task before they are shuffled."""
    found = stored(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key))
    return found, found.count()


def apart(rows: DataFrame, key: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is not among those n keys, and the others. Up to 2**20 keys are broadcast, more are joined by shuffles."""
    keys = F.broadcast(keys) if n <= _MOST_BROADCAST else keys
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def forget(*tables: DataFrame | None) -> None:
    """Removes stored tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
