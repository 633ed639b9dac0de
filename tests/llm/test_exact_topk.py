import math
from fractions import Fraction

import numpy as np
import pytest

from surelake.llm.exact_topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def brute(rows, k, every=2):
    good = [(i, [math.floor(64 * Fraction(float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for n, (q, a) in enumerate(good):
        if q % every == 0 and (q, tuple(a)) not in asked:
            asked.add((q, tuple(a)))
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(good) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sparse,ragged", [(False, False), (True, False), (True, True)])
def test_equals_brute_force(spark, sparse, ragged):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        v = rng.normal(0, 0.2, 9 + (i % 3 if ragged else 0))
        if sparse:
            v *= rng.random(len(v)) < 0.3
        rows.append((i, [float(x) for x in v], 1, 0.0))
    rows += [(61, None, 1, 0.0), (62, [float("nan")] * 9, 1, 0.0), (63, [float("inf")] * 9, 1, 0.0), (64, [None] * 9, 1, 0.0), (None, [0.5] * 9, 1, 0.0), (65, [], 1, 0.0), (67, [0.0] * 9, 1, 0.0), rows[5], rows[4], (4, [0.25] * 9, 1, 0.0)]
    found = top_k(spark.createDataFrame(rows, SCHEMA), every=2, k=7, query_block=10, candidate_block=13)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 7)


def test_fewer_candidates_than_k_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0], 1, 0.0), (1, [2.0], 1, 0.0)], SCHEMA)
    assert [tuple(r) for r in top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert top_k(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("large", [3e6, 2e7, 1e9])
def test_large_components(spark, large):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, large if i % 5 == 1 else 0.2, 9)], 1, 0.0) for i in range(60)]
    rows += [(60, [large] * 4 + [0.0] * 5, 1, 0.0), (61, [-large] * 9, 1, 0.0)]
    most = [r for r in rows if r[0] % 2 or r[0] == 60 and large < 1e9]  # an even one is a query
    most += [(2 * i, [0.25 * (-1) ** j * (i % 3) for j in range(9)], 1, 0.0) for i in range(20)]
    found = top_k(spark.createDataFrame(most, SCHEMA), every=2, k=7, query_block=10, candidate_block=13)
    assert sorted(map(tuple, found.collect())) == brute(most, 7, 2)
    assert {r[0] for r in most if abs(r[1][0]) > 1 << 20} & {r.vec_id for r in found.collect()}


def test_wide_blocks(spark):
    """Sums pass 2**63 on the way and among the scores, but the best ones are longs."""
    rows = [(0, [1e9, 1e9, 1.0], 1, 0.0), (1, [1e9, -1e9, 5.0], 1, 0.0), (3, [-1e9, -1e9, 1.0], 1, 0.0), (5, [-1e9, 1e9, 7.0], 1, 0.0)]
    found = top_k(spark.createDataFrame(rows, SCHEMA), every=2, k=2, candidate_block=1)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 5, 7 * 4096), (0, 2, 1, 5 * 4096)]


@pytest.mark.parametrize("x", [1e9, -1e9])
def test_score_that_is_no_long(spark, x):
    rows = [(0, [1e9, 1e9], 1, 0.0), (1, [x, x], 1, 0.0)]
    with pytest.raises(Exception, match="no long"):
        top_k(spark.createDataFrame(rows, SCHEMA)).collect()


def test_components_that_are_no_longs_take_part(spark):
    """The contract leaves out only null and non-finite ones."""
    rows = [(0, [0.0, 1.0], 1, 0.0), (1, [3e30, 0.5], 1, 0.0), (3, [-3.0e38, 2.0], 1, 0.0), (5, [1e30, -1.0], 1, 0.0), (7, [3e6, 0.0], 1, 0.0)]
    for options in ({}, {"candidate_block": 1}):
        found = top_k(spark.createDataFrame(rows, SCHEMA), every=2, k=4, **options)
        assert sorted(map(tuple, found.collect())) == [(0, 1, 3, 64 * 128), (0, 2, 1, 32 * 64), (0, 3, 7, 0), (0, 4, 5, -64 * 64)]
    doubles = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.7e308, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in top_k(doubles).collect()] == [(0, 1, 1, 4096)]


def test_several_vectors_of_one_key(spark):
    rows = [(0, [1.0], 1, 0.0), (0, [2.0], 1, 0.0), (0, [1.0], 1, 0.0)]
    found = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), candidate_block=1).collect()))
    assert found == sorted([(0, 1, 0, 8192), (0, 2, 0, 4096), (0, 1, 0, 8192), (0, 2, 0, 8192)])
