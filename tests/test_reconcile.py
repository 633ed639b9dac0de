import random

import pytest
from pyspark.sql import functions as F

from surelake.operators import reconcile
from surelake.operators.reconcile import differences, narrowed, same_tables




def test_equals_a_comparison_row_by_row(spark):
    rng = random.Random(3)
    a = [(i, rng.choice(["x", "y", None]), rng.choice([1.5, None])) for i in range(2000)]
    b = [list(r) for r in a if r[0] % 97]
    for i in (5, 600, 1500):
        b[i][1] = "changed"
    b[7][2] = None if b[7][2] else 2.0
    b += [[5000, "new", None], b[20], [None, None, None]]
    a.append((None, None, None))
    left, right = (spark.createDataFrame(t, "k int, s string, leaf double") for t in (a, b))
    found = {r.k: (r.left, r.right) for r in differences(left, right, "k").collect()}
    want = {}
    for k in {r[0] for r in a} | {r[0] for r in b}:
        mine, theirs = sorted(map(repr, (tuple(r) for r in a if r[0] == k))), sorted(map(repr, (tuple(r) for r in b if r[0] == k)))
        if mine != theirs:
            want[k] = (len(mine), len(theirs))
    assert found == want
    r = same_tables(left, right, "k").first()
    assert (r.only_left, r.only_right, r.changed, r.equal) == (21, 1, len(want) - 22, False)


@pytest.mark.parametrize("levels", [1, 3])
def test_equal_tables_and_empty_ones(spark, levels):
    t = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    assert differences(t, t.repartition(5).orderBy("v"), "id", levels=levels).collect() == []
    assert same_tables(t, t, ["id"]).first().equal and same_tables(t.limit(0), t.limit(0), "id").first().equal
    assert len(differences(t.limit(0), t, "id", ["v"], levels).collect()) == 3000


def test_what_is_compared_follows_the_difference(spark):
    n = 200_000
    left = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    for changed in (1, 10):
        right = left.withColumn("v", F.when(F.col("id") % (n // changed) == 3, "other").otherwise(F.col("v")))
        a, b, leaves = narrowed(left, right, ["id"], ["id", "v"])
        assert leaves == changed and a.count() == b.count() == changed
        assert differences(left, right, "id").count() == changed
    one = reconcile.leaf_digests(left, ["id"], ["id", "v"], 12)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_bit_xor" in plan and one.count() <= 4096
