import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from surelake.llm.centroids import Round, cluster_report, clusters, grouped

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, v string"


def brute(rows, dims, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        members = [[v for (_, v), m in zip(kept, mine, strict=True) if m == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(x) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, c, d, sum(x[2] for x in found if x[1] == c), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def table(seed, n, dims, scale=0.2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dims) + (i % 5)], 1, "x") for i in range(n)]
    odd = [(n, None, 1, "x"), (n + 1, [float("nan")] * dims, 1, "x"), (n + 2, [float("-inf")] + [0.0] * (dims - 1), 1, "x"), (n + 3, [None] * dims, 1, "x"), (n + 4, [0.5] * (dims + 1), 1, "x"), (n + 5, [], 1, "x")]
    return rows + odd + [(None, [0.25] * dims, 1, "x"), rows[3], rows[3], (4, rows[5][1], 1, "x"), (n + 6, rows[7][1], 1, "x")]


@pytest.mark.parametrize("dims,k,rounds", [(3, 7, 5), (6, 12, 2), (1, 4, 3), (4, 500, 2)])
def test_equals_brute_force(spark, dims, k, rounds):
    rows = table(dims, 120, dims)
    found = cluster_report(spark.createDataFrame(rows, SCHEMA).repartition(3), dims=dims, k=k, rounds=rounds, groups=3)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows, dims, k, rounds), key=repr)


def test_one_vector_may_be_most_of_the_table(spark):
    rows = [(i, [1.0, 2.0], 1, "x") for i in range(3000)] + [(5000 + i, [float(i), 0.0], 1, "x") for i in range(30)]
    found = cluster_report(spark.createDataFrame(rows, SCHEMA), dims=2, k=5, rounds=3)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 2, 5, 3))


def test_empty_and_large(spark):
    assert cluster_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [1e6 * ((-1) ** i), float(2**20 * i)], 1, "x") for i in range(8)]
    found = cluster_report(spark.createDataFrame(rows, SCHEMA), dims=2, k=3, rounds=2)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 2, 3, 2))
    for large in (1e18, 1e9):
        with pytest.raises(Exception, match="too large|no long"):
            cluster_report(spark.createDataFrame([(1, [large, large, large], 1, "x"), (2, [0.0, 0.0, 0.0], 1, "x")], SCHEMA), dims=3, k=1).collect()


@pytest.mark.parametrize("size", [40, 300_000, 1 << 30])
def test_bounds_spare_distances_and_change_nothing(size):
    rng = np.random.default_rng(size)
    n, k = 600, 16
    v = np.concatenate([rng.integers(-size, size, (k, 1, 6)) * 4 + rng.integers(-size, size, (k, n // k, 6)) for _ in (0,)]).reshape(-1, 6)
    v[10:40] = v[40:70]
    c, before, taken = v[:: len(v) // k][:k].copy(), None, 0
    group = grouped(c, 4)
    cluster, upper, lower = np.full(len(v), -1), np.zeros(len(v)), np.zeros((len(v), group.max() + 1))
    for _ in range(6):
        cluster, distance, upper, lower, looked = Round(c, group, before).assign(v, cluster, upper, lower)
        exact = np.square(v.astype(object)[:, None, :] - c.astype(object)[None]).sum(2)
        assert (cluster == [min(range(k), key=lambda j, row=row: (row[j], j)) for row in exact]).all()
        assert (distance == exact[np.arange(len(v)), cluster]).all()
        taken += looked.sum()
        before, c = c, np.array([v[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else c[j] for j in range(k)])
    assert taken < 0.5 * 6 * len(v) * k


def test_looked_falls_on_spark(spark):
    rows = [(i, [float(i % 10) * 8 + (i % 7) / 16, float(i % 10)], 1, "x") for i in range(2000)]
    state, centroids = clusters(spark.createDataFrame(rows, SCHEMA), dims=2, k=10, rounds=5)
    assert state.agg({"looked": "sum"}).first()[0] < 0.6 * 6 * 2000 * 10
    assert len(centroids) == 10
