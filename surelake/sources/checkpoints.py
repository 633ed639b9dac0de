"""Append-only logs of results, their stages, receipts and manifests."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surelake.sources.logs import log_lines, once, parsed

GREEDY = "text:string,token_ids:array<int>,token_entropies_nats:array<double>,token_logprobs:array<double>,token_char_spans:array<array<int>>,content_token_mask:array<boolean>,token_alignment_status:string,eos_generated:boolean,was_truncated:boolean,termination_reason:string"
GRADED = "predicted_answer:string,answer_method:string,prediction_parseable:boolean,gold_parseable:boolean,correct:boolean,grading_status:string,content_token_count:int,mean_entropy_nats:double,entropy_confidence:double,sequence_logprob_sum:double,sequence_geometric_probability:double,answer_token_count:int,answer_token_geometric_probability:double,answer_alignment_status:string"
SOURCE = "dataset:string,config:string,split:string,row_id:string,revision:string,gold_status:string,subject:string,perturbation_type:string,seed_question_id:string"
SAMPLE = "index:int,seed:bigint,text:string,token_ids:array<int>,answer:string,answer_method:string,eos_generated:boolean,was_truncated:boolean,termination_reason:string"
CONSISTENCY = "sample_count:int,sample_answer_parseable_count:int,sample_answer_parse_unknown_count:int,greedy_agreement_count:int,greedy_agreement_unknown_count:int,greedy_agreement_share:double,majority_answer:string,majority_vote_count:int,majority_vote_share:double,majority_correct:boolean,majority_grading_status:string,majority_comparison_unknown_count:int"
PREDICTION = f"example_id string, status string, source struct<{SOURCE}>, question string, gold_answer string, greedy struct<{GREEDY},{GRADED}>, samples array<struct<{SAMPLE}>>, self_consistency struct<{CONSISTENCY}>, requested_sample_count int, execution_origin string"
STAGE = f"run_signature string, example_id string, greedy struct<{GREEDY}>, samples map<string,struct<seed:bigint,generation:struct<text:string,token_ids:array<int>,eos_generated:boolean,was_truncated:boolean,reason:string>>>, failure string, failure_history array<string>"


def is_complete():
    """A record that counts: an id, status complete, a greedy object and a list of samples."""
    return (F.length("example_id") > 0) & (F.col("status") == "complete") & F.col("greedy").isNotNull() & F.col("samples").isNotNull()


def _path(spark: SparkSession, file: str):
    """A file as Spark names it, which is as a URI."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))


def torn_tail(spark: SparkSession, file: str) -> tuple[str, int] | None:
    """A file's last line, if no line end follows it, and the byte at which it begins."""
    path = _path(spark, file)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size, room = fs.getFileStatus(path).getLen(), 1 << 16
    while size:
        stream = fs.open(path)
        try:
            stream.seek(max(0, size - room))
            tail = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        if tail.endswith(b"\n"):
            return None
        if b"\n" in tail or room >= size:
            last = tail.rpartition(b"\n")[2]
            return last.decode("utf-8", "replace"), size - len(last)
        room *= 16
    return None


def torn_tails(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, int]]:
    """torn_tail of each file that has one; many files are looked at together."""
    with ThreadPoolExecutor(16) as pool:
        return {f: t for f, t in zip(files, pool.map(lambda f: torn_tail(spark, f), files), strict=True) if t}


def repair(spark: SparkSession, path: str) -> list[str]:
    """Cuts torn last lines off a log's files on disk, so that what is appended next begins a line. Returns the files that were cut.

    Local files are truncated by Python, others by their file system, if it can.
    """
    tails = torn_tails(spark, spark.read.text(path).inputFiles())
    for file, (_, at) in tails.items():
        if file.startswith("file:"):
            with open(unquote(urlparse(file).path), "r+b") as f:
                f.truncate(at)
                f.flush()
                os.fsync(f.fileno())
        else:
            where = _path(spark, file)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).truncate(where, at)
    return sorted(tails)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTION, blank: bool = False) -> DataFrame:
    """Complete records of a JSON-lines log, strictly.

    A last line without line end was torn off in writing and is left out; any other row that is corrupt or not complete, and an
    id that is there twice, stops the query, which names line and file; so does a blank line, unless ``blank`` lets them pass. Large
    files are read by many tasks, the driver reads no more of a file than its last line.
    """
    lines = log_lines(spark, path)
    keys = lines.select(once(F.from_json("value", "example_id string")).alias("r")).select("r.example_id")  # what is wrong with a line stops its row, not its key
    return without_duplicates(parsed(lines, schema, is_complete(), blank), "example_id", keys)


def read_export(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """Records for export: blank lines pass, and there must be as many records as the manifest says."""
    records = read_predictions(spark, path, blank=True)
    n, expected = records.count(), manifest.get("completed_count", len(manifest.get("selected_example_ids", [])))
    if n != expected:
        raise ValueError(f"{n} records where the manifest has {expected}")
    return records


def without_duplicates(rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """The same rows; a key that is there twice stops the query. Only keys are shuffled: those that are there twice are none, and are broadcast.

    ``keys``: a cheaper way to the keys of the rows; a null there is none.
    """
    twice = (rows if keys is None else keys.where(F.col(key).isNotNull())).groupBy(key).agg(F.count("*").alias("__n")).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate checkpoint for "), F.col(key))).cast("boolean")).otherwise(F.lit(False)))
    return rows.join(F.broadcast(twice), key, "left_anti")


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGE).option("multiLine", True).json(path)


def staged_failures(stages: DataFrame, completed: DataFrame, signature: str) -> DataFrame:
    """Ids with a failure in their stage and no completed record; a stage of another run stops the query."""
    own = F.when(F.col("run_signature").eqNullSafe(F.lit(signature)), F.col("failure").isNotNull()).otherwise(F.raise_error(F.lit("stage identity differs from the run manifest")).cast("boolean"))
    return stages.where(own).select("example_id").join(completed.select("example_id"), "example_id", "left_anti").distinct()


def read_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("a manifest must be an object")
    return found


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    """Student results of eval_<condition>.jsonl files, with the condition; an unknown outcome counts as wrong."""
    rows = spark.read.schema("example_id string, dataset string, correct boolean, grading_status string, truncated boolean, response string").json(path)
    return rows.withColumn("condition", F.regexp_extract(F.input_file_name(), r"eval_([^/]*)\.jsonl", 1)).withColumn("correct", F.coalesce("correct", F.lit(False)))
