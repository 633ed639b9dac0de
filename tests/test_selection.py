import hashlib

import pytest
from pyspark.sql import functions as F

from surelake.functions import answers
from surelake.operators import selection

SCHEMA = "example_id string, dataset string, source_config string, seed_question_id string, gold_status string, gold_answer string"


def pool(spark, n, per_subject, plus, seeds):
    rows = [(f"gsm8k:main:test:{i}", "gsm8k", "main", None, "parsed", "1") for i in range(n)]
    rows += [(f"math:{s}:test:{i}", "math", s, None, "parsed", "1") for s, k in per_subject.items() for i in range(k)]
    rows += [(f"gsm_plus:default:test:{i}", "gsm_plus", "default", seeds(i), "parsed", "1") for i in range(plus)]
    return spark.createDataFrame(rows, SCHEMA)


def test_select_examples(spark):
    p = pool(spark, 4, {"algebra": 3, "geometry": 2}, 4, lambda i: "aabc"[i])
    profile = selection.Profile("t", 2, 1, 2)
    found = [r.example_id for r in selection.select_examples(p, profile, 42).collect()]
    assert found == ["gsm8k:main:test:1", "gsm8k:main:test:3", "gsm_plus:default:test:2", "gsm_plus:default:test:3", "math:algebra:test:2", "math:geometry:test:0"]
    again = selection.select_examples(p.orderBy(F.desc("example_id")).repartition(3), profile, 42)
    assert [r.example_id for r in again.collect()] == found


def test_mini_profile(spark):
    p = pool(spark, 100, {f"s{k}": 10 for k in range(7)}, 160, lambda i: f"q{i % 80}")
    found = selection.select_examples(p, selection.PROFILES["mini_12h"], 42)
    assert {r.dataset: r["count"] for r in found.groupBy("dataset").count().collect()} == {"gsm8k": 40, "math": 21, "gsm_plus": 50}
    assert {r["count"] for r in found.where("dataset = 'math'").groupBy("source_config").count().collect()} == {3}
    assert found.where("dataset = 'gsm_plus'").select("seed_question_id").distinct().count() == 50


def test_missing_seeds(spark):
    p = pool(spark, 0, {}, 6, lambda i: None)
    assert selection.select_examples(p, selection.Profile("t", 1, 1, 10), 1).count() == 6
    e = p.withColumn("leak_group", F.lit(None).cast("string"))
    assert selection.select_heldout(e, e.limit(0), 1).count() == 1  # here missing seeds are one group


def test_seed_constant(spark):
    row = spark.range(1).select(selection.sample_seed(42, F.lit("gsm8k:main:test:17"), F.lit(3)).alias("s")).first()
    assert row.s == 5792900222203665036
    found = spark.range(40).select("id", selection.sample_seed(1, F.lit("x"), "id").alias("s")).collect()
    assert all(r.s == int(hashlib.sha256(f"1\0x\0{r.id}".encode()).hexdigest()[:16], 16) & ((1 << 63) - 1) for r in found)


def test_leaks(spark):
    c = spark.createDataFrame([("a", "g1"), ("b", None), ("c", "g2"), ("d", None)], "example_id string, leak_group string")
    t = spark.createDataFrame([("d", None), ("x", "g1")], "example_id string, leak_group string")
    assert {r.example_id for r in selection.without_leaks(c, t).collect()} == {"b", "c"}


def test_checks(spark):
    with pytest.raises(Exception, match="duplicate"):
        selection.check_examples(spark.createDataFrame([("a", "math"), ("a", "math")], "example_id string, dataset string")).collect()
    with pytest.raises(Exception, match="unsupported"):
        selection.check_examples(spark.createDataFrame([("a", "other")], "example_id string, dataset string")).collect()
    for bad in ({"gsm8k": 0}, {"gsm_plus": True}, {"sample_count": 0}, {"name": ""}):
        with pytest.raises(ValueError):
            selection.Profile(**({"name": "t", "gsm8k": 1, "math_per_subject": 1, "gsm_plus": 1} | bad))


def test_the_limit_reaches_the_map_side(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), F.col("id").cast("string").alias("k"))
    assert "WindowGroupLimit" in selection.take_ranked(df, ["g"], "k", 42, 3)._jdf.queryExecution().executedPlan().toString()


def test_selection_stops_on_repeated_ids(spark):
    twice = pool(spark, 3, {}, 0, None).unionByName(pool(spark, 1, {}, 0, None))
    with pytest.raises(Exception, match="duplicate"):
        selection.select_examples(twice, selection.Profile("t", 2, 1, 1), 1).collect()


def test_a_leak_is_seen_in_every_script(spark):
    """A question and its perturbed copy, whose seed is named by the exact key, are one group."""
    rows = [("g", "gsm8k", "Straße  ΣΊΣΥΦΟΣ?", None), ("p", "gsm_plus", "other", answers.seed_question_key("STRASSE σίσυφος?")), ("q", "gsm_plus", "other", None)]
    e = spark.createDataFrame(rows, "example_id string, dataset string, question string, seed_question_id string")
    groups = {r.example_id: r.leak_group for r in selection.training_groups(e, e).collect()}
    assert groups["g"] == groups["p"] is not None and groups["q"] is None
    trained = spark.createDataFrame([("g",), ("unknown",)], "example_id string")
    marked = e.withColumn("leak_group", answers.leak_group(F.col("dataset"), F.col("question"), F.col("seed_question_id")))
    assert {r.example_id for r in selection.without_leaks(marked, selection.training_groups(trained, e)).collect()} == {"q"}


def test_heldout_limits_reach_the_map_side(spark):
    p = pool(spark, 50, {"a": 30, "b": 30}, 40, lambda i: f"q{i}").withColumn("leak_group", F.lit(None).cast("string"))
    found = selection.select_heldout(p, p.limit(0), 1, 5, 3, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 8  # partial and final, of four rankings
    assert {r.dataset: r["count"] for r in found.groupBy("dataset").count().collect()} == {"gsm8k": 5, "math": 6, "gsm_plus": 4}
    assert sorted(r.place for r in found.where("dataset = 'gsm8k'").collect()) == [1, 2, 3, 4, 5]


def test_checked_examples(spark):
    rows = [(f"gsm8k:main:test:{i}", "gsm8k", "main", None, "parsed", "1") for i in range(5)]
    assert selection.check_examples(spark.createDataFrame(rows, SCHEMA)).count() == 5
    with pytest.raises(Exception, match="duplicate example id"):
        selection.check_examples(spark.createDataFrame([*rows, rows[2]], SCHEMA)).collect()
    for unknown in ("other", None):
        with pytest.raises(Exception, match="unsupported dataset"):
            selection.check_examples(spark.createDataFrame([*rows, ("x", unknown, "main", None, "parsed", "1")], SCHEMA)).collect()
