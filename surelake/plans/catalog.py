"""The registered queries for the analytics operators, with their SQL.

The driver's tables hold no model records, so scores, outcomes, answers and ids are derived from
their columns; the SQL derives them alike. Doubles are rounded to 6 digits, since sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surelake.functions import answers, grading
from surelake.operators import confidence, detokenise, metrics, reconcile, selection, training, validation, voting
from surelake.plans import records
from surelake.sources import checkpoints, examples, sinks
from surelake.streaming import ingest, live, stages

SIGNALS = {"length": "s_length", "hashed": "s_hashed", "source": "s_source", "mixed": "s_mixed"}
PRIMARY = ["length", "hashed"]
_registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _query(sql: str | None = None):
    def register(f):
        _registered[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes))


# documents with labels as scored records: the language is the dataset, quality the outcome.
_RECORDS = """records AS (
  SELECT d.doc_id, d.lang AS dataset, d.source AS origin, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE l.quality END AS correct,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE l.toxic END AS majority_correct, d.n_chars,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE least(1.0::DOUBLE, d.n_chars / 4000.0::DOUBLE) END AS s_length, (d.doc_id % 101) / 100.0::DOUBLE AS s_hashed,
    (d.doc_id % 5) / 4.0::DOUBLE AS s_source, CASE WHEN d.doc_id % 3 = 0 THEN 1.5 ELSE (d.doc_id % 17) / 16.0::DOUBLE END AS s_mixed, (d.doc_id % 9) / 8.0::DOUBLE AS s_share
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = _read(spark, sf_dir, "documents").drop("text"), F.col("doc_id")
    return d.join(_read(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("lang").alias("dataset"), F.col("source").alias("origin"), F.when(i % 11 != 0, F.col("quality")).alias("correct"), F.when(i % 13 != 0, F.col("toxic")).alias("majority_correct"), "n_chars",
        F.when(i % 7 != 0, F.least(F.lit(1.0), F.col("n_chars") / 4000.0)).alias("s_length"), (i % 101 / 100.0).alias("s_hashed"), (i % 5 / 4.0).alias("s_source"),
        F.when(i % 3 == 0, 1.5).otherwise(i % 17 / 16.0).alias("s_mixed"), (i % 9 / 8.0).alias("s_share"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("dataset", F.col("s_length").alias("score"), F.col("correct").alias("outcome")).where("score IS NOT NULL AND outcome IS NOT NULL")


_PAIRS = f"WITH {_RECORDS}, pairs AS (SELECT dataset, s_length AS score, correct AS outcome FROM records WHERE s_length IS NOT NULL AND correct IS NOT NULL)"
_BINS = """bins AS (
  SELECT g.dataset, i.bin_index, count(p.score) AS n, avg(p.score) AS c, avg(p.outcome) AS a
  FROM (SELECT DISTINCT dataset FROM pairs) g CROSS JOIN (SELECT CAST(unnest(generate_series(0, 14)) AS INTEGER) AS bin_index) i
  LEFT JOIN pairs p ON p.dataset = g.dataset AND least(CAST(floor(p.score * 15) AS INTEGER), 14) = i.bin_index GROUP BY ALL)"""


@_query(f"{_PAIRS}, {_BINS} SELECT dataset, bin_index, round(bin_index / 15.0::DOUBLE, 6) AS lower, round((bin_index + 1) / 15.0::DOUBLE, 6) AS upper, n AS count, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy FROM bins")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration_bins(_pairs(spark, sf_dir), ["dataset"]))


@_query(f"{_PAIRS}, {_BINS} SELECT dataset, CAST(sum(n) AS BIGINT) AS n, round(sum(n * a) / sum(n), 6) AS accuracy, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM bins GROUP BY dataset")
def ece_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ece(_pairs(spark, sf_dir), ["dataset"]))


_AUROC = "SELECT {g}, round((sum(r * o) - sum(o) * (sum(o) + 1) / 2) / nullif(sum(o) * sum(1 - o), 0), 6) AS auroc FROM (SELECT {g}, outcome::DOUBLE AS o, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0::DOUBLE AS r FROM {t}) GROUP BY {g}"


@_query(f"{_PAIRS} " + _AUROC.format(g="dataset", t="pairs"))
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auroc(_pairs(spark, sf_dir), ["dataset"]))


@_query("WITH e AS (SELECT user_id % 8 AS shard, value AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS outcome FROM events WHERE value IS NOT NULL) " + _AUROC.format(g="shard", t="e"))
def auroc_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beyond [0, 1]."""
    e = _read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("shard"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("outcome"))
    return _rounded(metrics.auroc(e, ["shard"]))


def _long_sql(keep: str) -> str:
    ok = lambda s: f"CASE WHEN {s} BETWEEN 0 AND 1 THEN {s} END"
    parts = [f"SELECT {keep}, 'greedy' AS analysis, '{n}' AS signal, {k} AS ordinal, {ok(c)} AS score, correct AS outcome FROM records" for k, (n, c) in enumerate(SIGNALS.items())]
    whole = " AND ".join(f"{SIGNALS[p]} BETWEEN 0 AND 1" for p in PRIMARY)
    parts += [f"SELECT {keep}, 'paired_primary', '{p}', {4 + k}, {ok(SIGNALS[p])}, correct FROM records WHERE {whole}" for k, p in enumerate(PRIMARY)]
    parts.append(f"SELECT {keep}, 'majority', 'majority_vote_share', 6, {ok('s_share')}, majority_correct FROM records")
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def _metric_sql(keep: str, domain: str) -> str:
    key = f"{keep}, analysis, signal, ordinal"
    return f"""WITH {_RECORDS}, {_long_sql(keep)}, names AS (SELECT DISTINCT analysis, signal, ordinal FROM long), domain AS ({domain}),
      known AS (SELECT {keep}, count(correct) AS known FROM records GROUP BY ALL),
      pairs AS (SELECT * FROM long WHERE score IS NOT NULL AND outcome IS NOT NULL),
      sizes AS (SELECT {key}, count(outcome) AS own_n FROM long GROUP BY ALL),
      b AS (SELECT {key}, least(CAST(floor(score * 15) AS INTEGER), 14) AS bin, count(*) AS n, avg(score) AS c, avg(outcome) AS a FROM pairs GROUP BY ALL),
      e AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS n, sum(n * a) / sum(n) AS accuracy, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY ALL),
      k AS (SELECT {key}, outcome::DOUBLE AS o, rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0::DOUBLE AS r FROM pairs),
      u AS (SELECT {key}, (sum(r * o) - sum(o) * (sum(o) + 1) / 2) / nullif(sum(o) * sum(1 - o), 0) AS auroc FROM k GROUP BY ALL),
      m AS (SELECT d.*, names.analysis, names.signal, CAST(names.ordinal AS INTEGER) AS ordinal FROM domain d CROSS JOIN names),
      t AS (SELECT {key}, coalesce(e.n, 0) AS n, CASE WHEN analysis = 'paired_primary' THEN coalesce(known, 0) ELSE coalesce(own_n, 0) END AS scorable_n, accuracy, ece, auroc
            FROM m LEFT JOIN e USING ({key}) LEFT JOIN u USING ({key}) LEFT JOIN sizes USING ({key}) LEFT JOIN known USING ({keep}))"""


_METRICS = _metric_sql("dataset", "SELECT DISTINCT dataset FROM records")
_METRIC_COLUMNS = "n, scorable_n, round(coalesce(n / nullif(scorable_n, 0)::DOUBLE, 0), 6) AS coverage, round(accuracy, 6) AS accuracy, round(ece, 6) AS ece, round(auroc, 6) AS auroc"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report_metrics(_records(spark, sf_dir), ["dataset"], SIGNALS, PRIMARY, "s_share")


@_query(f"{_METRICS} SELECT dataset, analysis, signal, ordinal, {_METRIC_COLUMNS} FROM t")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir))


@_query(_metric_sql("dataset, origin", "SELECT * FROM (SELECT DISTINCT dataset FROM records) CROSS JOIN (SELECT DISTINCT origin FROM records)") + f" SELECT dataset, origin, analysis, signal, ordinal, {_METRIC_COLUMNS} FROM t")
def metrics_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    datasets, origins = r.select("dataset").distinct(), r.select("origin").distinct()
    domain = datasets.agg(F.collect_set("dataset").alias("d")).join(origins.agg(F.collect_set("origin").alias("o"))).select(F.explode("d").alias("dataset"), "o").select("dataset", F.explode("o").alias("origin"))
    return _rounded(metrics.report_metrics(r, ["dataset", "origin"], SIGNALS, PRIMARY, "s_share", domain))


@_query(f"""{_METRICS}, w AS (SELECT signal, count(auroc) = count(*) AND count(ece) = count(*) AND count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM records) AS ok, avg(auroc) AS a, avg(ece) AS e, min(auroc) AS m,
  bool_and(n = scorable_n AND scorable_n > 0) AS whole FROM t WHERE analysis = 'greedy' GROUP BY signal)
  SELECT signal, CASE WHEN ok THEN round(a, 6) END AS macro_auroc, CASE WHEN ok THEN round(e, 6) END AS macro_ece, CASE WHEN ok THEN round(m, 6) END AS minimum_dataset_auroc, ok AS all_datasets_defined, ok AND whole AS eligible_for_recommendation FROM w""")
def macro_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _metrics(spark, sf_dir)
    datasets = _records(spark, sf_dir).select("dataset").distinct().count()
    return _rounded(metrics.macro(table, datasets, True))


@_query(f"{_PAIRS}, {_BINS} SELECT dataset, bin_index, round(bin_index / 15.0::DOUBLE, 6) AS lower, round((bin_index + 1) / 15.0::DOUBLE, 6) AS upper, n AS count, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy FROM bins WHERE n > 0")
def reliability_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reliability_points(_pairs(spark, sf_dir), ["dataset"]))


@_query("""SELECT l_returnflag, l_linestatus, CASE WHEN count(*) FILTER (v IS NULL OR v < 0) = 0 THEN CAST(coalesce(sum(v), 0) AS BIGINT) END AS total
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' AND l_orderkey % 97 = 0 THEN NULL ELSE l_linenumber END AS v FROM lineitem) GROUP BY ALL""")
def null_poison_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(~((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 97 == 0)), F.col("l_linenumber"))
    return _read(spark, sf_dir, "lineitem").withColumn("v", v).groupBy("l_returnflag", "l_linestatus").agg(metrics.null_poisoned_sum("v").alias("total"))


_SUMMARY = f"""WITH {_RECORDS}, r AS (SELECT *, doc_id % 19 <> 0 AS ok, CASE WHEN doc_id % 19 <> 0 THEN correct END AS outcome FROM records),
  x AS (SELECT lang AS dataset, count(*) AS selected_rows FROM documents GROUP BY lang),
  s AS (SELECT dataset, count(*) AS total_rows, count(outcome) AS scorable_rows, count(*) FILTER (ok) AS source_scorable_rows, sum(outcome) AS r, count(*) FILTER (doc_id % 4 <> 0) AS parsed, count(*) * 8 AS sample_count,
    CAST(sum(doc_id % 9) AS BIGINT) AS sample_answer_parseable_count, CASE WHEN count(*) FILTER (doc_id % 1000 = 999) = 0 THEN CAST(sum(doc_id % 2) AS BIGINT) END AS p, {', '.join(f'count(*) FILTER (ok AND {c} BETWEEN 0 AND 1) AS c_{n}' for n, c in SIGNALS.items())} FROM r GROUP BY dataset)
  SELECT dataset, coalesce(total_rows, 0) AS total_rows, selected_rows, coalesce(scorable_rows, 0) AS scorable_rows, coalesce(total_rows - scorable_rows, 0) AS unscorable_rows, coalesce(source_scorable_rows, 0) AS source_scorable_rows,
    coalesce(total_rows - source_scorable_rows, 0) AS source_unscorable_rows, round(coalesce(source_scorable_rows, 0) / selected_rows::DOUBLE, 6) AS source_scorable_fraction, round(coalesce(scorable_rows / nullif(source_scorable_rows, 0)::DOUBLE, 0), 6) AS outcome_label_coverage,
    coalesce(source_scorable_rows - scorable_rows, 0) AS unknown_outcome_label_count, round(r / nullif(scorable_rows, 0)::DOUBLE, 6) AS greedy_accuracy, round(coalesce(parsed / nullif(total_rows, 0)::DOUBLE, 0), 6) AS prediction_parse_coverage,
    coalesce(sample_answer_parseable_count, 0) AS sample_answer_parseable_count, p AS sample_answer_parse_unknown_count, coalesce(sample_count, 0) AS sample_count, p AS greedy_agreement_unknown_count, p AS majority_comparison_unknown_count,
    round(coalesce(sample_answer_parseable_count / nullif(sample_count, 0)::DOUBLE, 0), 6) AS sample_answer_parse_coverage, {', '.join(f'round(coalesce(c_{n} / nullif(source_scorable_rows, 0)::DOUBLE, 0), 6) AS coverage_{n}' for n in SIGNALS)} FROM x LEFT JOIN s USING (dataset)"""


@_query(_SUMMARY)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    r = _records(spark, sf_dir).withColumns(
        {"gold_status": F.when(i % 19 != 0, "parsed").otherwise("unanswerable"), "gold_answer": F.lit("1"), "prediction_parseable": i % 4 != 0, "sample_count": F.lit(8), "parseable_count": i % 9}
        | {c: F.when(i % 1000 != 999, i % 2) for c in ("parse_unknown", "agreement_unknown", "comparison_unknown")}
    )
    selected = _read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("selected_rows"))
    return _rounded(metrics.dataset_summary(r, selected, SIGNALS))


@_query(f"WITH s AS ({_SUMMARY}) SELECT bool_and(source_scorable_fraction >= 0.95 AND outcome_label_coverage = 1.0) AS valid FROM s")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage_gate(dataset_summary(spark, sf_dir))


@_query("""SELECT count(*) AS selected, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending, count(*) FILTER (o_orderstatus <> 'F') = 0 AS run_complete FROM orders""")
def run_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), "o_orderstatus")
    return metrics.run_accounting(o, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


@_query("SELECT o_orderstatus AS origin, o_orderpriority AS dataset, count(*) AS row_count FROM orders GROUP BY ALL")
def execution_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("origin"), F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("row_count"))


@_query("""WITH r AS (SELECT p_type, 'part:' || p_partkey AS example_id FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY sha256('42' || chr(0) || example_id), example_id) AS n FROM r)
  SELECT p_type, example_id FROM k WHERE n <= 3""")
def stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_type", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("example_id"))
    return selection.take_ranked(p, ["p_type"], "example_id", 42, 3)


_EXAMPLES = """ex AS (SELECT *, dataset || ':' || source_config || ':test:' || doc_id AS example_id FROM (SELECT doc_id,
  CASE lang WHEN 'en' THEN 'gsm8k' WHEN 'de' THEN 'math' ELSE 'gsm_plus' END AS dataset, CASE lang WHEN 'en' THEN 'main' WHEN 'de' THEN source ELSE 'default' END AS source_config,
  CASE WHEN lang NOT IN ('en', 'de') AND doc_id % 6 <> 0 THEN 'seed' || (doc_id % 40) END AS seed_question_id, CASE WHEN doc_id % 8 = 0 THEN 'unanswerable' ELSE 'parsed' END AS gold_status, 'a' AS gold_answer FROM documents))"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pick = lambda a, b, c: F.when(F.col("lang") == "en", a).when(F.col("lang") == "de", b).otherwise(c)
    d = d.select(
        "doc_id", pick(F.lit("gsm8k"), F.lit("math"), F.lit("gsm_plus")).alias("dataset"), pick(F.lit("main"), F.col("source"), F.lit("default")).alias("source_config"),
        F.when(~F.col("lang").isin("en", "de") & (F.col("doc_id") % 6 != 0), F.concat(F.lit("seed"), (F.col("doc_id") % 40).cast("string"))).alias("seed_question_id"),
        F.when(F.col("doc_id") % 8 == 0, "unanswerable").otherwise("parsed").alias("gold_status"), F.lit("a").alias("gold_answer"),
    )
    return d.withColumn("example_id", answers.example_id(F.col("dataset"), F.col("source_config"), F.lit("test"), F.col("doc_id")))


@_query(f"""WITH {_EXAMPLES}, o AS (SELECT *, sha256('42' || chr(0) || example_id) AS h FROM ex),
  p AS (SELECT *, row_number() OVER (PARTITION BY coalesce(seed_question_id, 'missing-seed:' || example_id) ORDER BY h, example_id) AS s FROM o WHERE dataset = 'gsm_plus'),
  r AS (SELECT example_id, dataset, row_number() OVER (PARTITION BY dataset, CASE WHEN dataset = 'math' THEN source_config END ORDER BY h, example_id) AS n FROM (SELECT *, 1 AS s FROM o WHERE dataset <> 'gsm_plus' UNION ALL SELECT * FROM p WHERE s = 1))
  SELECT example_id, dataset FROM r WHERE n <= CASE dataset WHEN 'gsm8k' THEN 40 WHEN 'math' THEN 3 ELSE 50 END""")
def select_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_examples(_examples(spark, sf_dir), selection.PROFILES["mini_12h"], 42).select("example_id", "dataset")


_SEED_SQL = "'gsm8k-test-seed:' || substr(sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))), 1, 16)"


@_query(f"SELECT doc_id, {_SEED_SQL} AS seed_key FROM documents")
def seed_question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact key of every text, in four languages: letters beyond ASCII are folded as well."""
    return _read(spark, sf_dir, "documents").select("doc_id", answers.seed_question_id(F.col("text")).alias("seed_key"))


@_query(f"""WITH d AS (SELECT doc_id, {_SEED_SQL} AS seed_group FROM documents),
  k AS (SELECT *, row_number() OVER (PARTITION BY seed_group ORDER BY sha256('42' || chr(0) || doc_id), doc_id) AS n FROM d) SELECT doc_id, seed_group FROM k WHERE n = 1""")
def one_per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seed_question_keys(spark, sf_dir).withColumnRenamed("seed_key", "seed_group")
    return selection.take_ranked(d, ["seed_group"], "doc_id", 42, 1)


_HELDOUT = f"""WITH {_EXAMPLES}, tr AS (SELECT example_id, seed_question_id AS leak_group FROM ex WHERE doc_id % 9 = 0 AND dataset <> 'math'),
  c AS (SELECT *, sha256('7' || chr(0) || example_id) AS h FROM ex WHERE gold_status = 'parsed' AND example_id NOT IN (SELECT example_id FROM tr) AND (seed_question_id IS NULL OR seed_question_id NOT IN (SELECT leak_group FROM tr WHERE leak_group IS NOT NULL))),
  p AS (SELECT *, row_number() OVER (PARTITION BY seed_question_id ORDER BY h) AS s FROM c WHERE dataset = 'gsm_plus'),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset, CASE WHEN dataset = 'math' THEN source_config END ORDER BY h) AS INTEGER) AS place FROM (SELECT *, 1 AS s FROM c WHERE dataset <> 'gsm_plus' UNION ALL SELECT * FROM p WHERE s = 1))
  SELECT example_id, dataset, place FROM k WHERE place <= CASE dataset WHEN 'gsm8k' THEN 300 WHEN 'math' THEN 20 ELSE 200 END"""


@_query(_HELDOUT)
def heldout_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir).withColumn("leak_group", F.col("seed_question_id"))
    return selection.select_heldout(e, e.where("doc_id % 9 = 0 AND dataset <> 'math'"), 7).select("example_id", "dataset", "place")


@_query(f"WITH {_EXAMPLES} SELECT example_id FROM ex WHERE doc_id % 9 <> 0 AND (seed_question_id IS NULL OR seed_question_id NOT IN (SELECT seed_question_id FROM ex WHERE doc_id % 90 = 0 AND seed_question_id IS NOT NULL))")
def leakage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir).withColumn("leak_group", F.col("seed_question_id"))
    training_rows = e.where("doc_id % 9 = 0").withColumn("leak_group", F.when(F.col("doc_id") % 90 == 0, F.col("leak_group")))
    return selection.without_leaks(e, training_rows).select("example_id")


@_query("SELECT o_orderkey, i AS sample_index, CAST(('0x' || substr(sha256('42' || chr(0) || 'order:' || o_orderkey || chr(0) || i), 1, 16))::UHUGEINT % 9223372036854775808::UHUGEINT AS BIGINT) AS seed FROM orders CROSS JOIN (SELECT CAST(unnest(generate_series(0, 7)) AS INTEGER) AS i)")
def sample_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample_index"))
    return o.withColumn("seed", selection.sample_seed(42, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), "sample_index"))


_VOTES = "votes AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag || (l_partkey % 2) END AS answer FROM lineitem)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in order: their place is their rank within an order."""
    l = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    answer = F.when(F.col("l_linenumber") % 5 != 0, F.concat("l_returnflag", (F.col("l_partkey") % 2).cast("string")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return l.select("l_orderkey", place.alias("i"), answer.alias("answer"))


_MAJORITY = f"""WITH {_VOTES}, g AS (SELECT l_orderkey, answer, count(*) AS n, min(i) AS first_at FROM votes GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_at) AS r, sum(n) OVER (PARTITION BY l_orderkey) AS sample_count FROM g)"""


@_query(f"{_MAJORITY} SELECT l_orderkey, CAST(sample_count AS BIGINT) AS sample_count, answer AS majority_answer, n AS majority_vote_count, round(n / sample_count::DOUBLE, 6) AS majority_vote_share FROM k WHERE r = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(voting.majority_vote(_votes(spark, sf_dir), "l_orderkey", "i", "answer"))


@_query(f"WITH {_VOTES}, f AS (SELECT l_orderkey, answer AS first FROM votes WHERE i = 1) SELECT l_orderkey, count(*) AS sample_count, count(*) FILTER (answer = first) AS greedy_agreement_count, round(count(*) FILTER (answer = first) / count(*)::DOUBLE, 6) AS greedy_agreement_share FROM votes JOIN f USING (l_orderkey) GROUP BY l_orderkey")
def agreement_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _votes(spark, sf_dir)
    first = v.where("i = 1").select("l_orderkey", F.col("answer").alias("first"))
    return _rounded(voting.agreement(v.join(first, "l_orderkey"), "l_orderkey", "answer", "first"))


_TOKENS = """t AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e, list_transform(generate_series(0, len(embedding) - 1), lambda i: i % 3 <> 0) AS m FROM embeddings),
  u AS (SELECT vec_id, unnest(e) AS e, unnest(m) AS m, unnest(generate_series(0, len(e) - 1)) AS i FROM t)"""


@_query(f"""WITH {_TOKENS}, a AS (SELECT vec_id, count(*) FILTER (m) AS n, sum(e) FILTER (m) AS s, count(*) FILTER (m AND i % 10 <> 9 AND 2 * i < 41 AND 2 * i + 2 > 20) AS k, sum(e) FILTER (m AND i % 10 <> 9 AND 2 * i < 41 AND 2 * i + 2 > 20) AS p FROM u GROUP BY vec_id)
  SELECT vec_id, CAST(n AS INTEGER) AS content_token_count, round(s / n, 6) AS mean_entropy_nats, round(least(1.0, greatest(0.0, 1 - s / n / ln(50))), 6) AS entropy_confidence, round(-s, 6) AS sequence_logprob_sum, round(exp(-s / n), 6) AS sequence_geometric_probability,
    CAST(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE k END AS INTEGER) AS answer_token_count, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round(exp(-p / k), 6) END AS answer_token_geometric_probability, CASE WHEN vec_id % 4 = 0 THEN 'no_answer_span' ELSE 'aligned' END AS answer_alignment_status FROM a""")
def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    spans = F.transform("embedding", lambda x, i: F.when(i % 10 != 9, F.struct((2 * i).alias("start"), (2 * i + 2).alias("end"))))
    answered = F.col("vec_id") % 4 != 0
    c = confidence.token_confidence(e, F.transform(e, lambda x: -x), spans, F.transform(e, lambda x, i: i % 3 != 0), F.when(answered, 20), F.when(answered, 41), 50)
    return _rounded(_read(spark, sf_dir, "embeddings").select("vec_id", c.alias("c")).select("vec_id", "c.*"))


@_query("""WITH t AS (SELECT conv_id, array_agg(len(text) ORDER BY turn, role, text) AS v FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(v[-1] % 3 = 0, false) AS eos_generated, NOT coalesce(v[-1] % 3 = 0, false) AND len(v) >= 4 AS was_truncated,
  CASE WHEN v[-1] % 3 = 0 THEN 'eos' WHEN len(v) >= 4 THEN 'max_new_tokens' ELSE 'other_stop' END AS termination_reason FROM t""")
def termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.length("text") % 3, F.struct("turn", "role", "text"))
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(last.alias("last"), F.count("*").alias("n"))
    return turns.select("conv_id", confidence.termination_of(F.col("last"), F.col("n"), [0], 4).alias("t")).select("conv_id", "t.*")


def _solutions() -> Column:
    n = (F.col("o_orderkey") % 50).cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("So \\boxed{0} then \\boxed{ "), n, F.lit(" }."))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Work.\nFinal answer: "), n, F.lit("  \nEnd")))
    return text.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Thus \\boxed{\\frac{"), n, F.lit("}{7}} is it \\boxed{1+"))).otherwise(F.lit("no answer here"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 50 AS VARCHAR) WHEN 1 THEN CAST(o_orderkey % 50 AS VARCHAR) WHEN 2 THEN '\\frac{' || (o_orderkey % 50) || '}{7}' END AS value,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 26 WHEN 1 THEN 20 WHEN 2 THEN 12 END AS INTEGER) AS start, CAST(CASE o_orderkey % 4 WHEN 0 THEN 26 + len(CAST(o_orderkey % 50 AS VARCHAR)) WHEN 1 THEN 20 + len(CAST(o_orderkey % 50 AS VARCHAR)) WHEN 2 THEN 22 + len(CAST(o_orderkey % 50 AS VARCHAR)) END AS INTEGER) AS "end",
  CASE o_orderkey % 4 WHEN 0 THEN 'boxed' WHEN 1 THEN 'answer_label' WHEN 2 THEN 'boxed' END AS method FROM orders""")
def answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", answers.answer_span(_solutions()).alias("s")).select("o_orderkey", "s.value", "s.start", "s.end", "s.method")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'x \\boxed{' || (o_orderkey % 50) || '}' ELSE 'no box' END AS cut FROM orders")
def cut_after_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x \\boxed{"), (F.col("o_orderkey") % 50).cast("string"), F.lit("} and \\boxed{2} more"))).otherwise(F.lit("no box"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", answers.cut_after_first_answer(text).alias("cut"))


@_query("""WITH a AS (SELECT p_partkey, p_size, p_name, p_brand FROM part)
  SELECT 'gsm8k:main:test:' || p_partkey AS example_id, 'gsm8k' AS dataset, p_name AS question, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS gold_answer, CASE WHEN p_size % 3 = 2 THEN 'missing_final_marker' WHEN p_size % 3 = 1 THEN 'missing_final_answer' ELSE 'parsed' END AS gold_status, NULL::VARCHAR AS seed_question_id FROM a
  UNION ALL SELECT 'math:algebra:test:' || p_partkey, 'math', p_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END, CASE WHEN p_size % 2 = 0 THEN 'parsed' ELSE 'missing_boxed_answer' END, NULL FROM a
  UNION ALL SELECT 'gsm_plus:default:test:' || p_partkey, 'gsm_plus', p_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END, CASE WHEN p_size % 2 = 0 THEN 'parsed' ELSE 'unanswerable' END, 'gsm8k-test-seed:' || substr(sha256(lower(p_brand)), 1, 16) FROM a""")
def normalize_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").withColumn("source_row_id", F.col("p_partkey"))
    size = F.col("p_size").cast("string")
    marker = F.when(F.col("p_size") % 3 == 2, "no marker").when(F.col("p_size") % 3 == 1, "steps #### 3 ####  ").otherwise(F.concat(F.lit("first #### 0 then #### "), size, F.lit(" \n")))
    parts = [
        examples.normalize(p.select("source_row_id", F.concat(F.lit(" "), "p_name").alias("question"), marker.alias("answer")), "gsm8k", "main", "test", "r"),
        examples.normalize(p.select("source_row_id", F.col("p_name").alias("problem"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("so \\boxed{"), size, F.lit("}"))).otherwise(F.concat(F.lit("Answer: "), size)).alias("solution")), "math", "algebra", "test", "r"),
        examples.normalize(p.select("source_row_id", F.col("p_name").alias("question"), F.lit("s").alias("solution"), F.when(F.col("p_size") % 2 == 0, size).otherwise(" Not answerable ").alias("answer"), F.lit("x").alias("perturbation_type"), F.concat(F.lit(" "), F.upper("p_brand")).alias("seed_question")), "gsm_plus", "default", "test", "r"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("example_id", "dataset", "question", "gold_answer", "gold_status", "seed_question_id")


@_query("""WITH g AS (SELECT o_orderkey, o_orderkey % 6 AS c, o_orderkey % 10 AS v FROM orders) SELECT o_orderkey,
  CASE c WHEN 0 THEN true WHEN 1 THEN v = 5 WHEN 2 THEN false WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE false END AS correct, c <> 2 AND c <> 5 AS prediction_parseable, c NOT IN (3, 4) AS gold_parseable,
  CASE c WHEN 2 THEN 'missing_prediction_answer' WHEN 3 THEN 'missing_gold' WHEN 4 THEN 'unparseable_gold' WHEN 5 THEN 'unparseable_prediction' ELSE 'graded' END AS status FROM g""")
def grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 10).cast("string")
    prediction = F.when(c == 2, F.lit(None)).when(c == 5, "\\frac{1}{").when(c == 0, F.concat(v, F.lit(".0"))).otherwise(v)
    gold = F.when(c == 3, " ").when(c == 4, "\\frac{1}{").when(c == 0, F.concat(F.lit("\\frac{"), (F.col("o_orderkey") % 10 * 2).cast("string"), F.lit("}{2}"))).otherwise("5")
    return _read(spark, sf_dir, "orders").select("o_orderkey", grading.grade_answer(prediction, gold).alias("g")).select("o_orderkey", "g.*")


_RESPONSES = f"""{_MAJORITY}, rows AS (SELECT v.l_orderkey AS example_id, v.i, v.answer, k.answer AS majority, k.n / k.sample_count::DOUBLE AS share, v.i % 4 = 0 AS truncated FROM votes v JOIN k ON v.l_orderkey = k.l_orderkey AND k.r = 1)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _votes(spark, sf_dir)
    m = voting.majority_vote(v, "l_orderkey", "i", "answer").select("l_orderkey", F.col("majority_answer").alias("majority"), F.col("majority_vote_share").alias("share"))
    return v.join(m, "l_orderkey").select(F.col("l_orderkey").alias("example_id"), "i", "answer", "majority", "share", (F.col("i") % 4 == 0).alias("truncated"))


@_query(f"{_RESPONSES} SELECT example_id, CAST(i AS INTEGER) AS i, answer, condition FROM (SELECT *, 'kd_all' AS condition FROM rows UNION ALL SELECT *, 'kd_gated' FROM rows WHERE share >= 0.75 AND answer = majority) WHERE NOT truncated AND answer IS NOT NULL")
def training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_sets(_responses(spark, sf_dir)).select("example_id", F.col("i").cast("int").alias("i"), "answer", "condition")


@_query(f"{_RESPONSES} SELECT condition, count(*) AS responses, count(DISTINCT example_id) AS questions FROM (SELECT *, 'kd_all' AS condition FROM rows UNION ALL SELECT *, 'kd_gated' FROM rows WHERE share >= 0.75 AND answer = majority) WHERE NOT truncated AND answer IS NOT NULL GROUP BY condition")
def training_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.set_sizes(training.training_sets(_responses(spark, sf_dir)))


_RESULTS = """res AS (SELECT l.doc_id AS example_id, d.lang AS dataset, c.condition, CASE WHEN (l.doc_id + 3 * c.k) % 7 = 0 THEN NULL ELSE (l.doc_id * (c.k + 2)) % 5 < 3 END AS correct, (l.doc_id + c.k) % 6 = 0 AS truncated
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (VALUES ('base', 0), ('kd_all', 1), ('kd_gated', 2), ('kd_oracle', 3)) c(condition, k))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    names = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for k, c in enumerate(("base", "kd_all", "kd_gated", "kd_oracle"))))
    rows = rows.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("dataset"), F.explode(names).alias("c")).select("example_id", "dataset", "c.*")
    i, k = F.col("example_id"), F.col("k")
    return rows.select("example_id", "dataset", "condition", F.when((i + 3 * k) % 7 != 0, (i * (k + 2)) % 5 < 3).alias("correct"), ((i + k) % 6 == 0).alias("truncated"))


@_query(f"""WITH {_RESULTS}, e AS (SELECT condition, dataset, count(*) AS n, count(*) FILTER (correct) AS r, count(*) FILTER (truncated) AS t FROM res GROUP BY ALL)
  SELECT condition, dataset, n, round(r / n::DOUBLE, 6) AS accuracy, NULL::DOUBLE AS macro_accuracy, NULL::DOUBLE AS truncated_fraction FROM e
  UNION ALL SELECT condition, 'overall', CAST(sum(n) AS BIGINT), round(sum(r) / sum(n)::DOUBLE, 6), round(avg(r / n::DOUBLE), 6), round(sum(t) / sum(n)::DOUBLE, 6) FROM e GROUP BY condition""")
def student_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.student_summary(_results(spark, sf_dir)))


@_query(f"""WITH {_RESULTS} SELECT p.l AS "left", p.r AS "right", count(*) AS n, round(avg(coalesce(b.correct, false)::INT - coalesce(a.correct, false)::INT), 6) AS delta
  FROM (VALUES ('base', 'kd_all'), ('base', 'kd_gated'), ('base', 'kd_oracle'), ('kd_all', 'kd_gated'), ('kd_oracle', 'kd_gated')) p(l, r) JOIN res a ON a.condition = p.l JOIN res b ON b.condition = p.r AND a.example_id = b.example_id GROUP BY p.l, p.r""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.paired_delta(_results(spark, sf_dir)))


def _bootstrap_sql(rounds: int, lo: int, hi: int) -> str:
    return f"""WITH {_RESULTS}, f AS (SELECT coalesce(b.correct, false)::INT - coalesce(a.correct, false)::INT AS diff FROM res a JOIN res b ON a.example_id = b.example_id AND a.condition = 'kd_all' AND b.condition = 'kd_gated'),
  n AS (SELECT count(*) AS n, count(*) FILTER (diff = -1) AS lo, count(*) FILTER (diff <= 0) AS mid, avg(diff) AS delta FROM f), i AS (SELECT unnest(generate_series(0, (SELECT n - 1 FROM n))) AS i), r AS (SELECT unnest(generate_series(0, {rounds - 1})) AS round),
  d AS (SELECT r.round, CAST('0x' || substr(sha256('11:' || r.round || ':' || i.i), 1, 12) AS BIGINT) % n.n AS p, n.* FROM r CROSS JOIN i CROSS JOIN n),
  m AS (SELECT round, sum(CASE WHEN p < lo THEN -1 WHEN p < mid THEN 0 ELSE 1 END) / any_value(n)::DOUBLE AS mean FROM d GROUP BY round), s AS (SELECT array_agg(mean ORDER BY mean) AS v FROM m)
  SELECT n.n, round(delta, 6) AS delta, round(v[{lo}], 6) AS ci_low, round(v[{hi}], 6) AS ci_high FROM s CROSS JOIN n"""


@_query(_bootstrap_sql(200, 6, 195))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.bootstrap(training.paired(_results(spark, sf_dir), "kd_all", "kd_gated"), 11, 200))


@_query(_bootstrap_sql(5000, 126, 4875))
def bootstrap_ci_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bootstrap_ci, with the operator's default of 5,000 resamples."""
    return _rounded(training.bootstrap(training.paired(_results(spark, sf_dir), "kd_all", "kd_gated"), 11))


@_query(f"""WITH {_RESULTS}, pairs(l, r) AS (VALUES ('base', 'kd_all'), ('base', 'kd_gated'), ('base', 'kd_oracle'), ('kd_all', 'kd_gated'), ('kd_oracle', 'kd_gated')),
  f AS (SELECT p.l, p.r, coalesce(b.correct, false)::INT - coalesce(a.correct, false)::INT AS diff FROM pairs p JOIN res a ON a.condition = p.l JOIN res b ON b.condition = p.r AND a.example_id = b.example_id),
  n AS (SELECT l, r, count(*) AS n, count(*) FILTER (diff = -1) AS lo, count(*) FILTER (diff <= 0) AS mid, avg(diff) AS delta FROM f GROUP BY l, r), i AS (SELECT unnest(generate_series(0, (SELECT max(n) - 1 FROM n))) AS i), t AS (SELECT unnest(generate_series(0, 4999)) AS round),
  d AS (SELECT t.round, CAST('0x' || substr(sha256('11:' || t.round || ':' || i.i), 1, 12) AS BIGINT) % (SELECT max(n) FROM n) AS p FROM t CROSS JOIN i),
  m AS (SELECT l, r, round, sum(CASE WHEN p < lo THEN -1 WHEN p < mid THEN 0 ELSE 1 END) / any_value(n)::DOUBLE AS mean FROM d CROSS JOIN n GROUP BY l, r, round), s AS (SELECT l, r, array_agg(mean ORDER BY mean) AS v FROM m GROUP BY l, r)
  SELECT n.l AS "left", n.r AS "right", n.n, round(delta, 6) AS delta, round(v[126], 6) AS ci_low, round(v[4875], 6) AS ci_high FROM s JOIN n ON s.l = n.l AND s.r = n.r""")
def comparisons_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five comparisons with their intervals, by 5,000 resamples each; every example has a result of every condition."""
    return _rounded(training.comparison_table(_results(spark, sf_dir), 11))


_COMPACT = f"WITH {_RECORDS}, c AS (SELECT doc_id, dataset, correct = 1 AS right, majority_correct = 1 AS majority, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE s_source END AS agreement, s_hashed AS sure, doc_id % 12 <> 0 AS answered FROM records)"


def _compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _records(spark, sf_dir).select(
        i.alias("example_id"), i.alias("ordinal"), "dataset", (F.col("correct") == 1).alias("greedy_correct"), (F.col("majority_correct") == 1).alias("majority_correct"), F.when(i % 10 != 0, F.col("s_source")).alias("agreement_share"),
        F.col("s_hashed").alias("entropy_confidence"), F.when(i % 12 != 0, F.lit("x")).alias("greedy_answer"),
    )


@_query(f"""{_COMPACT} SELECT (SELECT doc_id FROM c WHERE "right" AND dataset = 'de' ORDER BY coalesce(agreement, 0) DESC, sure DESC, doc_id LIMIT 1) AS confident_right,
  (SELECT doc_id FROM c WHERE NOT "right" AND answered ORDER BY coalesce(agreement, 1), doc_id LIMIT 1) AS flagged_wrong, (SELECT doc_id FROM c WHERE NOT "right" ORDER BY coalesce(agreement, 0) DESC, sure DESC, doc_id LIMIT 1) AS confident_wrong""".replace("correct = 1 AS right", 'correct = 1 AS "right"'))
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.exemplars(_compact(spark, sf_dir), math="de")


@_query(f"""{_COMPACT} SELECT dataset, count(*) AS questions, count("right") AS scorable, count(*) FILTER ("right") AS greedy_right, count(*) FILTER ("right" IS NOT NULL AND majority) AS majority_right,
  round(avg(agreement) FILTER ("right"), 6) AS agreement_right, round(avg(agreement) FILTER (NOT "right"), 6) AS agreement_wrong FROM c GROUP BY dataset""".replace("correct = 1 AS right", 'correct = 1 AS "right"'))
def sample_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.overview(_compact(spark, sf_dir)))


@_query("SELECT count(*) FILTER (l.k IS NULL) AS only_left, count(*) FILTER (o.k IS NULL) AS only_right, count(*) FILTER (l.k IS NULL OR o.k IS NULL) = 0 AS equal FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.same_keys(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@_query("""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), r AS (SELECT o_orderkey, [CASE WHEN NOT coalesce(n BETWEEN 1 AND 5, false) THEN 'line count' END, CASE WHEN NOT coalesce(q <= 100, false) THEN 'quantity' END, CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price' END] AS v FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
  SELECT o_orderkey, array_to_string(list_filter(v, lambda x: x IS NOT NULL), ',') AS violations FROM r WHERE len(list_filter(v, lambda x: x IS NOT NULL)) > 0""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rules = {"line count": F.col("n").between(1, 5), "quantity": F.col("q") <= 100, "price": F.col("o_totalprice") > 1000}
    checked = validation.violations(_read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left"), rules)
    return checked.where(F.size("violations") > 0).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@_query("SELECT l_orderkey AS example_id FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 1) AND count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 2 AND 4) = 3")
def stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_linenumber") == 1, "greedy").otherwise((F.col("l_linenumber") - 2).cast("string"))
    return ingest.complete_components(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), part.alias("component")), 3)


@_query("SELECT event_id FROM events WHERE event_type <> 'click' AND event_id % 3 <> 0")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "event_type")
    return ingest.pending(e, e.where("event_type = 'click'"), e.where("event_id % 3 = 0"), "event_id").select("event_id")


_PROMPT_SQL = answers.PROMPT.replace("'", "''")


@_query(f"SELECT conv_id, turn, role AS turn_role, text, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 THEN 'user' END AS role, '{_PROMPT_SQL}' || nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') AS content FROM conversations")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every turn; a blank one has none."""
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]", "")) == 0  # a prompt of nothing stops the operator
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("role").alias("turn_role"), "text", F.when(~blank, F.get(answers.chat_messages(F.col("text")), F.lit(0))).alias("m")).select("conv_id", "turn", "turn_role", "text", "m.role", "m.content")


def _streamed(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    import uuid

    at = f"{sinks.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    events = _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    events.write.parquet(f"{at}/in")
    for _ in range(2):
        ingest.ingest(spark, f"{at}/in", "event_id bigint, event_type string, user_id bigint", f"{at}/out", f"{at}/log", "event_id", "parquet", strict=strict).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "user_id")


@_query("SELECT event_id, event_type, user_id FROM events")
def checkpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, ingested into a table that is resumed once without repeats."""
    return _streamed(spark, sf_dir, False)


@_query("SELECT event_id, event_type, user_id FROM events")
def strict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a repeated id would stop the stream."""
    return _streamed(spark, sf_dir, True)


@_query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'view') THEN event_type || event_id END AS failure FROM events),
  l AS (SELECT user_id, failure FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM e) WHERE n = 1)
  SELECT user_id, any_value(l.failure) AS failure, string_agg(e.failure, ',' ORDER BY event_id) AS failure_history FROM e JOIN l USING (user_id) WHERE l.failure IS NOT NULL GROUP BY user_id""")
def failure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event is a failure, with all of theirs."""
    failure = F.when(F.col("event_type").isin("error", "view"), F.concat("event_type", F.col("event_id").cast("string")))
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), failure.alias("failure"))
    return ingest.open_failures(e, "user_id").withColumn("failure_history", F.array_join("failure_history", ","))


@_query("SELECT CAST(epoch(time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS begin_at, event_type, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the streaming count, over all events at once."""
    w = ingest.windowed_counts(_read(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "event_type")
    return w.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("begin_at"), "event_type", "count")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'a card' ELSE o_orderstatus END AS hardware FROM orders")
def origin_hardware(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surelake.plans.report import with_hardware

    origin = F.when(F.col("o_orderkey") % 50 == 0, "known").otherwise(F.col("o_orderstatus"))
    return with_hardware(_read(spark, sf_dir, "orders").select("o_orderkey", origin.alias("execution_origin")), {"known": {"gpu_name": "a card"}, "bad": "x"}).select("o_orderkey", "hardware")


@_query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"é' || o_orderstatus || '"' END || '}') AS record_sha256 FROM orders""")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surelake.plans.records import digests

    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("é"), "o_orderstatus")).alias("o_orderstatus"))
    return digests(o, "o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 10 = 4")
def content_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose rows differ from a copy in which some values changed and some became null."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 10 != 5, F.col("o_orderpriority")).alias("p"))
    k = F.col("o_orderkey") % 10
    other = o.select("o_orderkey", F.when(k == 3, "changed").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k != 4, F.col("p")).alias("p"))
    return validation.content_mismatches(o, other, ["o_orderstatus", "p"], "o_orderkey").select("o_orderkey")


@_query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * 4 AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT vec_id, max(x) AS top FROM v GROUP BY vec_id),
  m AS (SELECT vec_id, any_value(top) AS top, ln(sum(exp(x - top))) AS mass FROM v JOIN t USING (vec_id) GROUP BY vec_id)
  SELECT vec_id, round(-sum(exp(x - top - mass) * (x - top - mass)), 6) AS entropy, round(max(x) FILTER (i = 4) - any_value(top) - any_value(mass), 6) AS logprob FROM v JOIN m USING (vec_id) GROUP BY vec_id""")
def logit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double") * 4)
    return _rounded(_read(spark, sf_dir, "embeddings").select("vec_id", confidence.logit_scores(logits, F.lit(3)).alias("s")).select("vec_id", "s.*"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'token_roundtrip_mismatch' WHEN 2 THEN 'invalid_offsets' ELSE 'offsets_unavailable' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN '-,0:1,-,1:3' END AS spans FROM orders""")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    offsets = F.when(k == 2, F.array(pair(0, 1), pair(1, 9))).when(k != 3, F.array(pair(0, 1), pair(1, 3)))
    encoded = F.when(k == 1, F.array(F.lit(5), F.lit(6))).when(k != 3, F.array(F.lit(5), F.lit(7)))
    a = confidence.alignment(F.array(F.lit(9), F.lit(5), F.lit(9), F.lit(7)), [9], encoded, offsets, F.lit(3))
    shown = F.transform("a.spans", lambda s: F.when(s.isNull(), "-").otherwise(F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return _read(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.status", F.array_join(shown, ",").alias("spans"))


_EXACT = "n AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS a, o_orderkey % 5 + 2 AS b FROM orders)"


@_query(f"WITH {_EXACT} SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN a = b ELSE NULL END AS same FROM n")
def exact_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surds that are equal in another form, tuples that are only if their parts are, and relations, which nothing here decides."""
    a, b, k = (F.col("o_orderkey") % 7 + 1).cast("string"), (F.col("o_orderkey") % 5 + 2).cast("string"), F.col("o_orderkey") % 3
    square = ((F.col("o_orderkey") % 7 + 1) * (F.col("o_orderkey") % 7 + 1) * (F.col("o_orderkey") % 5 + 2)).cast("string")
    left = F.when(k == 0, F.concat(a, F.lit("\\sqrt{"), b, F.lit("}"))).when(k == 1, F.concat(F.lit("("), a, F.lit(", x+1)"))).otherwise(F.concat(F.lit("x<"), a))
    right = F.when(k == 0, F.concat(F.lit("\\sqrt{"), square, F.lit("}"))).when(k == 1, F.concat(F.lit("("), b, F.lit(",1+x)"))).otherwise(F.concat(b, F.lit("5>x")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", grading.answers_equivalent(left, right).alias("same"))


@_query("""WITH v AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_partkey % 3 AS VARCHAR) END AS answer FROM lineitem),
  g AS (SELECT l_orderkey, answer, count(*) AS n, min(i) AS first_at FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_at) AS r FROM g),
  s AS (SELECT l_orderkey, count(*) AS sample_count, count(answer) AS parseable, count(*) FILTER (answer = CAST(l_orderkey % 3 AS VARCHAR)) AS agreed FROM v GROUP BY l_orderkey)
  SELECT l_orderkey, CAST(sample_count AS INTEGER) AS sample_count, CAST(parseable AS INTEGER) AS sample_answer_parseable_count, CAST(agreed AS INTEGER) AS greedy_agreement_count, round(agreed / sample_count::DOUBLE, 6) AS greedy_agreement_share,
    answer AS majority_answer, CAST(n AS INTEGER) AS majority_vote_count, round(n / sample_count::DOUBLE, 6) AS majority_vote_share, coalesce(answer = '1', false) AS majority_correct, CASE WHEN answer IS NULL THEN 'missing_prediction_answer' ELSE 'graded' END AS majority_grading_status
  FROM s JOIN k USING (l_orderkey) WHERE r = 1""")
def sample_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary of a question's samples, by the operator that compares answers in order."""
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    answer = F.when(F.col("l_linenumber") % 5 != 0, F.concat((F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, ".0").otherwise("")))
    samples = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", answer.alias("answer")))), lambda x: x["answer"]).alias("answers"))  # a question's few samples
    c = grading.summarize_consistency((F.col("l_orderkey") % 3).cast("string"), "answers", F.lit("1"))
    rows = samples.select("l_orderkey", c.alias("c")).select("l_orderkey", "c.*").withColumn("majority_answer", F.regexp_replace("majority_answer", r"\.0$", ""))
    return _rounded(rows).drop("sample_answer_parse_unknown_count", "greedy_agreement_unknown_count", "majority_comparison_unknown_count")


@_query("""SELECT o_orderkey AS example_id, o_orderkey % 5 AS ordinal FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 5 = 2 AND o_orderkey % 4 = 0 OR o_orderkey % 5 = 3""")
def oracle_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses known to be right, and unknown ones whose answer grades as right."""
    k, half = F.col("o_orderkey") % 5, F.when(F.col("o_orderkey") % 4 == 0, "\\frac{1}{2}").otherwise("0.25")
    text = F.concat(F.lit("so \\boxed{"), F.when(k == 3, "0.5").otherwise(half), F.lit("}"))
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), k.alias("ordinal"), text.alias("response"), F.lit("\\frac{2}{4}").alias("gold"), F.when(k == 0, True).when(k.isin(1, 4), False).alias("correct"))
    return training.oracle_set(o).select("example_id", "ordinal")


@_query(f"WITH {_EXAMPLES} SELECT example_id, CASE dataset WHEN 'gsm8k' THEN 'gsm8k-test-seed:' || substr(sha256('question ' || doc_id || ' ss'), 1, 16) WHEN 'gsm_plus' THEN seed_question_id END AS leak_group FROM ex WHERE doc_id % 9 = 0")
def training_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir).withColumn("question", F.concat(F.lit(" QUESTION  "), F.col("doc_id").cast("string"), F.lit(" ß")))
    ids = e.where("doc_id % 9 = 0").select("example_id").unionByName(spark.createDataFrame([("missing",)], "example_id string"))
    return selection.training_groups(ids, e)


# Lines of an order as events of an example: 1 is the greedy part, 2 to 4 are samples, 5 is a failure if it was returned, 6 clears it.
@_query("""WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS example_id, l_linenumber AS n, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_partkey AS VARCHAR) AS payload FROM lineitem WHERE l_linenumber <= 4 OR l_linenumber = 6 OR l_linenumber = 5 AND l_returnflag = 'R'),
  p AS (SELECT example_id, n, min_by(payload, (ts, payload)) AS payload, min(ts) AS ts FROM e WHERE n <= 4 GROUP BY ALL),
  c AS (SELECT example_id, count(*) AS have, min(ts) AS ts, string_agg(n || '=' || payload, ',' ORDER BY n) AS parts FROM p GROUP BY example_id),
  m AS (SELECT example_id, n, ts, lag(n) OVER (PARTITION BY example_id ORDER BY ts, n) AS before, row_number() OVER (PARTITION BY example_id ORDER BY ts DESC, n DESC) AS r FROM e WHERE n > 4),
  f AS (SELECT example_id, bool_or(r = 1 AND n = 5) AS failed, count(*) FILTER (n = 6 AND before = 5) AS cleared, max(ts) FILTER (n = 6 AND before = 5) AS cleared_at FROM m GROUP BY example_id),
  s AS (SELECT coalesce(c.example_id, f.example_id) AS example_id, coalesce(have, 0) AS have, coalesce(parts, '') AS parts, coalesce(failed, false) AS failed, coalesce(cleared, 0) AS cleared, coalesce(cleared_at, c.ts) + INTERVAL 30 DAY AS due FROM c FULL JOIN f ON c.example_id = f.example_id),
  o AS (SELECT *, due <= (SELECT max(ts) FROM e) AS late FROM s)
  SELECT example_id, CASE WHEN NOT failed AND have = 4 THEN 'complete' ELSE 'failed' END AS status, CAST(4 - have AS INTEGER) AS n_missing, parts, CASE WHEN failed THEN 'returned' WHEN have < 4 THEN 'timed out' END AS failure, CAST(cleared AS INTEGER) AS n_cleared
  FROM o WHERE failed OR have = 4 OR late""")
def component_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as a keyed stream: whole examples, open failures, and those whose time ran out."""
    import uuid

    at = f"{sinks.shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    lines = _read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    kind = F.when(n <= 4, "component").when((n == 5) & (F.col("l_returnflag") == "R"), "failed").when(n == 6, "cleared")
    part = F.when(n == 1, "greedy").when(n <= 4, (n - 2).cast("string"))
    payload = F.when(kind == "failed", "returned").otherwise(F.col("l_partkey").cast("string"))
    events = lines.select(F.col("l_orderkey").cast("string").alias("example_id"), kind.alias("kind"), part.alias("component"), payload.alias("payload"), F.col("l_shipdate").cast("timestamp").alias("at")).where("kind IS NOT NULL")
    events.write.parquet(f"{at}/in")
    stages.run_stages(spark.readStream.schema(stages.EVENT).parquet(f"{at}/in"), f"{at}/out", f"{at}/log", 3, "30 days", "0 seconds", strict=False).awaitTermination()
    rows = stages.read_staged(spark, f"{at}/out")
    parts = F.array_compact(F.transform(F.concat(F.array("greedy"), "samples"), lambda p, i: F.when(p.isNotNull(), F.concat((i + 1).cast("string"), F.lit("="), p))))
    return rows.select("example_id", "status", F.size("missing").alias("n_missing"), F.array_join(parts, ",").alias("parts"), "failure", F.size("failure_history").alias("n_cleared"))


@_query("SELECT event_id, event_type, user_id, CASE WHEN event_id % 2 = 0 AND event_id < (SELECT max(event_id) FROM events) THEN 0 ELSE 1 END AS batch FROM events")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows: half of the events and a torn line, then the others and the rest of that line, each read once, by byte ranges."""
    import uuid

    at = f"{sinks.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    schema = "event_id bigint, event_type string, user_id bigint"
    e = _read(spark, sf_dir, "events").select(*(c.split()[0] for c in schema.split(", ")))
    last = e.orderBy(F.desc("event_id")).limit(1).select(F.to_json(F.struct("*")).alias("value")).collect()
    rest = e.where(F.col("event_id") < (e.agg(F.max("event_id")).first()[0] or 0))
    torn = (last[0].value if last else "").encode()

    def run(rows: DataFrame, part: str, tail: bytes) -> None:
        rows.select(F.to_json(F.struct("*"))).write.text(f"{at}/in/{part}")
        sinks.write_bytes(spark, f"{at}/in/tail.jsonl", tail)
        ingest.ingest_log(spark, f"{at}/in", schema, f"{at}/out", f"{at}/log", "event_id", split_bytes=1 << 20).awaitTermination()

    run(rest.where("event_id % 2 = 0"), "even", torn[: len(torn) // 2])
    run(rest.where("event_id % 2 <> 0"), "odd", torn + b"\n" * bool(torn))
    return spark.read.schema(f"{schema}, __batch int").parquet(f"{at}/out").withColumnRenamed("__batch", "batch")


@_query("""WITH t AS (SELECT conv_id, turn, text, hex(encode(text)) AS h FROM conversations WHERE text IS NOT NULL),
  p AS (SELECT conv_id, turn, text, list_transform(range(0, len(h) // 2, 3), lambda i: h[2 * i + 1 : 2 * i + 6]) AS pieces FROM t),
  l AS (SELECT conv_id, turn, text, pieces, list_transform(pieces, lambda p: len(list_filter(range(0, len(p) // 2), lambda j: p[2 * j + 1] NOT IN ('8', '9', 'A', 'B')))) AS leads FROM p),
  s AS (SELECT conv_id, turn, text, list_transform(range(1, len(pieces) + 1), lambda i: CAST(greatest(0, coalesce(list_sum(leads[1 : i - 1]), 0) - CASE WHEN pieces[i][1] IN ('8', '9', 'A', 'B') THEN 1 ELSE 0 END) AS BIGINT) || ':' || CAST(coalesce(list_sum(leads[1 : i]), 0) AS BIGINT)) AS spans FROM l)
  SELECT conv_id, turn, text, coalesce(array_to_string(spans, ','), '') AS offsets, true AS same FROM s""")
def detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together from token ids, with the offsets of tokens; here a token is up to three bytes, so many begin within a character."""
    rows = _read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text", F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(.{1,6})")).alias("pieces"))
    number = lambda p: F.conv(F.concat(F.lit("1"), p), 16, 10).cast("bigint")
    vocabulary = rows.select(F.explode("pieces").alias("p")).distinct().select(number(F.col("p")).alias("id"), F.unhex("p").alias("piece"), F.lit(False).alias("special"))
    tokens = rows.select("conv_id", "turn", F.transform("pieces", number).alias("token_ids"))
    found = detokenise.decoded(tokens, vocabulary, ["conv_id", "turn"])
    shown = F.array_join(F.transform("offsets", lambda o: F.concat_ws(":", o["start"].cast("string"), o["end"].cast("string"))), ",")
    given = rows.select("conv_id", "turn", F.col("text").alias("given"))
    return found.join(given, ["conv_id", "turn"]).select("conv_id", "turn", "text", shown.alias("offsets"), (F.col("text") == F.col("given")).alias("same"))


@_query(f"""WITH {_RESULTS}, f AS (SELECT p.l, p.r, coalesce(b.correct, false)::INT - coalesce(a.correct, false)::INT AS diff FROM (VALUES ('base', 'kd_all'), ('base', 'kd_gated'), ('base', 'kd_oracle'), ('kd_all', 'kd_gated'), ('kd_oracle', 'kd_gated')) p(l, r) JOIN res a ON a.condition = p.l JOIN res b ON b.condition = p.r AND a.example_id = b.example_id)
  SELECT l AS "left", r AS "right", count(*) AS n, round(avg(diff), 6) AS delta, true AS low_as_expected, true AS high_as_expected FROM f GROUP BY l, r""")
def comparison_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap by counts. Its bounds are draws, which SQL can't repeat: they are held against the normal interval, within a tenth of its width and one example."""
    found = training.comparison_intervals(_results(spark, sf_dir), 11)
    spread = training.paired_wide(_results(spark, sf_dir), training.COMPARISONS).agg(*(F.stddev_pop(f"d{k}").alias(f"s{k}") for k in range(len(training.COMPARISONS))))
    rows = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(training.COMPARISONS)))
    error = spread.select(F.explode(rows).alias("r")).select("r.*")
    half = 1.959964 * F.col("s") / F.sqrt("n")
    near = lambda c, sign: F.abs(F.col(c) - F.col("delta") - sign * half) <= 0.2 * half + 1 / F.col("n")
    return _rounded(found.join(error, ["left", "right"]).select("left", "right", "n", "delta", near("ci_low", -1).alias("low_as_expected"), near("ci_high", 1).alias("high_as_expected")))


@_query("""WITH r AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 500 = 3 THEN 'changed' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 500 <> 7 UNION ALL SELECT -o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 500 = 11)
  SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey, CAST(o.o_orderkey IS NOT NULL AS BIGINT) AS "left", CAST(r.o_orderkey IS NOT NULL AS BIGINT) AS "right" FROM orders o FULL JOIN r ON o.o_orderkey = r.o_orderkey WHERE o.o_orderkey IS NULL OR r.o_orderkey IS NULL OR o.o_orderstatus <> r.s""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a table and a copy with rows changed, lost and added, by digests of key ranges."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey") % 500
    copy = o.where(k != 7).withColumn("o_orderstatus", F.when(k == 3, "changed").otherwise(F.col("o_orderstatus"))).unionByName(o.where(k == 11).withColumn("o_orderkey", -F.col("o_orderkey")))
    return reconcile.differences(o, copy, "o_orderkey").drop("equal")


@_query(f"{_PAIRS}, {_BINS}, e AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS n, sum(n * a) / sum(n) AS accuracy, sum(n * abs(c - a)) / sum(n) AS ece FROM bins GROUP BY dataset), u AS ({_AUROC.format(g='dataset', t='pairs')}) SELECT dataset, n, round(accuracy, 6) AS accuracy, round(ece, 6) AS ece, auroc FROM e JOIN u USING (dataset)")
def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics kept up to date by a stream of seven batches, read from the counts that it keeps."""
    import uuid

    at = f"{sinks.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = _pairs(spark, sf_dir).select("dataset", F.col("score").cast("double").alias("score"), F.col("outcome").cast("int").alias("outcome"))
    rows.repartition(7).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("dataset string, score double, outcome int").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    live.follow(stream, ["dataset"], f"{at}/counts", f"{at}/log", fan=2).awaitTermination()
    return _rounded(live.current_metrics(spark, f"{at}/counts", ["dataset"], fan=2).select("dataset", "n", "accuracy", "ece", "auroc"))


@_query("""WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'math' ELSE 'gsm_plus' END AS dataset FROM orders),
  v AS (SELECT k, dataset, s, CAST((k + s * s) % 3 AS VARCHAR) AS answer FROM o, (SELECT unnest(range(4)) AS s)),
  c AS (SELECT k, answer, count(*) AS n, min(s) AS first_at FROM v GROUP BY ALL), m AS (SELECT k, min_by(answer, (-n, first_at)) AS majority, max(n) AS votes FROM c GROUP BY k),
  g AS (SELECT k, count(*) FILTER (answer = CAST(k % 5 AS VARCHAR)) AS agreed FROM v GROUP BY k),
  r AS (SELECT o.dataset, CASE WHEN k % 7 <> 0 THEN k % 5 = k % 4 END AS correct, CASE WHEN k % 7 <> 0 THEN m.majority = CAST(k % 4 AS VARCHAR) END AS majority_correct, 1 - (0.5 + (k % 10) / 10.0::DOUBLE) / 2 / ln(50) AS entropy, g.agreed / 4.0 AS share, m.votes FROM o JOIN m USING (k) JOIN g USING (k))
  SELECT dataset, count(*) AS n, count(correct) AS scorable, count(*) FILTER (correct) AS n_correct, count(*) FILTER (majority_correct) AS n_majority, round(avg(entropy), 6) AS confidence, round(avg(share), 6) AS agreement, CAST(sum(votes) AS BIGINT) AS votes, CAST(0 AS BIGINT) AS broken FROM r GROUP BY dataset""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of every order's question to graded records, appended to a log, read back strictly, held against all rules of records, and summed up by dataset."""
    import uuid

    at = f"{sinks.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    dataset = F.when(k % 3 == 0, "gsm8k").when(k % 3 == 1, "math").otherwise("gsm_plus")
    null, text = F.lit(None).cast("string"), lambda c: F.concat(F.lit("so \\boxed{"), c.cast("string"), F.lit("}"))
    orders = _read(spark, sf_dir, "orders")
    o = orders.select("o_orderkey", F.concat_ws(":", dataset, F.lit("c"), F.lit("test"), k.cast("string")).alias("example_id"))
    # Dealt and sorted while rows are small, once for both sides of the join by id, in tasks that write a packed file each.
    o = o.repartition(-(-orders.count() // 16_000) or 1, "example_id").sortWithinPartitions("example_id")
    table = o.select(
        "example_id", dataset.alias("dataset"), F.lit("r").alias("source_revision"), F.lit("c").alias("source_config"), F.lit("test").alias("split"), k.cast("string").alias("source_row_id"), F.concat(F.lit("question "), k.cast("string")).alias("question"),
        F.when(k % 7 != 0, (k % 4).cast("string")).alias("gold_answer"), F.lit("s").alias("gold_solution"), F.when(k % 7 != 0, "parsed").otherwise("unanswerable").alias("gold_status"), null.alias("subject"), null.alias("perturbation_type"), null.alias("seed_question_id"),
    )
    ends = [F.lit(True).alias("eos_generated"), F.lit(False).alias("was_truncated"), F.lit("eos").alias("termination_reason")]
    spans = F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(3), F.lit(12)), F.lit(None).cast("array<int>"))
    greedy = F.struct(
        text(k % 5).alias("text"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("token_ids"), F.array(F.lit(0.5), (k % 10) / 10.0, F.lit(9.0)).alias("token_entropies_nats"), F.array(F.lit(-0.5), F.lit(-0.25), F.lit(-9.0)).alias("token_logprobs"),
        spans.alias("token_char_spans"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("content_token_mask"), F.lit("aligned").alias("token_alignment_status"), *ends,
    )
    samples = F.array(*(F.struct(F.lit(s).alias("index"), text((k + s * s) % 3).alias("text"), F.array(F.lit(1)).alias("token_ids"), *ends) for s in range(4)))
    found = records.prediction_records(table, o.select("example_id", greedy.alias("greedy"), samples.alias("samples")), 50, 42, "here")
    sinks.append_predictions(found, f"{at}/predictions", "gzip")
    log = checkpoints.read_predictions(spark, f"{at}/predictions")
    rows = validation.violations(log, validation.record_rules(42, 4, 10))
    return _rounded(rows.groupBy("source.dataset").agg(
        F.count("*").alias("n"), F.count("greedy.correct").alias("scorable"), F.count_if("greedy.correct").alias("n_correct"), F.count_if("self_consistency.majority_correct").alias("n_majority"), F.avg("greedy.entropy_confidence").alias("confidence"),
        F.avg("self_consistency.greedy_agreement_share").alias("agreement"), F.sum("self_consistency.majority_vote_count").alias("votes"), F.count_if(F.size("violations") > 0).alias("broken"),
    ))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
