"""Centroid clustering by Yinyang grouping, exact in integers.

Centroids are put into groups once, by their starting places. Every row carries an upper bound of the distance to its own
centroid and, for each group, one lower bound of the distance to the group's other centroids. When centroids move,
bounds follow by how far they moved. A row whose upper bound is below all lower ones keeps its centroid without a look
(the global filter); else only groups whose lower bound is not above the upper one are scanned (the group filter),
exactly, in integers. Rows and bounds are a table in the shared folder, written once a round, so a lost executor
costs a part of one round. Only centroids, sums by cluster and component, and counts come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm.exact_topk import finite
from surelake.llm.shared import forget, stored

_STATE = "vec_id bigint, v array<bigint>, cluster int, distance bigint, upper double, lower array<double>, looked bigint"
_SUMS = "cluster int, n bigint, high array<bigint>, low array<bigint>"
_WIDE = 1 << 53  # components are below
_HALF = 26  # bits of the lower half of a component; sums of halves stay below 2**63 for 2**36 rows
_SLACK = 1e-9  # relative; rounding of bounds is far below


def _kind(largest: int, dims: int) -> type:
    """Numbers that hold all squared distances between components of that size."""
    return np.float64 if 8 * dims * largest * largest < 1 << 53 else np.int64 if 4 * dims * largest * largest < 1 << 63 else object


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [rows, centroids] of integer arrays; Python integers where a long is too small."""
    kind = _kind(max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))), v.shape[1])
    a, b = v.astype(kind), c.astype(kind)
    if kind is np.float64:
        return (np.square(a).sum(1)[:, None] + np.square(b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([np.square(a - x).sum(1) for x in b], 1) if len(b) else np.zeros((len(a), 0), kind)


def own_squares(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its centroid."""
    mine = c[cluster]
    kind = _kind(max(int(np.abs(v).max(initial=0)), int(np.abs(mine).max(initial=0))), v.shape[1])
    found = np.square(v.astype(kind) - mine.astype(kind)).sum(1)
    return found.astype(np.int64) if kind is np.float64 else found


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering the centroids themselves. Which groups they form changes no result."""
    groups = max(1, min(groups, len(centroids)))
    middle = centroids[:groups].astype(np.float64)
    for _ in range(rounds):
        group = np.square(centroids[:, None, :].astype(np.float64) - middle[None]).sum(2).argmin(1)
        for g in range(groups):
            if (group == g).any():
                middle[g] = centroids[group == g].mean(0)
    return group


class Round:
    """One round's centroids, their groups, and how far they and the farthest of each group moved since the round before."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.centroids, self.members = centroids, [np.flatnonzero(group == g) for g in range(group.max(initial=0) + 1)]
        self.group = group
        moved = np.array([float(x) ** 0.5 for x in own_squares(centroids, before, np.arange(len(centroids)))]) if before is not None else np.zeros(len(centroids))
        self.moved = moved * (1 + _SLACK)
        self.farthest = np.array([self.moved[m].max(initial=0) for m in self.members])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each row (on a tie the first), its distance, both bounds, and how many distances to centroids were taken.

        A cluster of -1 is a row's first round.
        """
        n = len(v)
        known = cluster >= 0
        cluster, old = cluster.copy(), np.where(known, cluster, 0)
        upper = np.where(known, upper + self.moved[old], np.inf)
        lower = np.where(known[:, None], lower - self.farthest, 0.0)
        looked = np.zeros(n, np.int64)
        best = np.zeros(n, object)
        may = np.flatnonzero(~known | (lower.min(1) <= upper * (1 + _SLACK)))  # the global filter, with the bound as it is
        own = may[known[may]]
        best[own] = own_squares(v[own], self.centroids, old[own])
        looked[own] += 1
        upper[own] = np.sqrt(best[own].astype(np.float64))
        may = may[~known[may] | (lower[may].min(1) <= upper[may] * (1 + _SLACK))]  # and with the tightened one
        before, limit = cluster.copy(), upper[may] * (1 + _SLACK)
        scanned: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g, members in enumerate(self.members):
            rows = may[lower[may, g] <= limit]
            if not len(rows) or not len(members):
                continue
            found = squares(v[rows], self.centroids[members])
            looked[rows] += len(members) - (self.group[before[rows]] == g) * (before[rows] >= 0)
            scanned.append((g, rows, found))
            at = found.argmin(1)
            near, which = found[np.arange(len(rows)), at], members[at]
            closer = (cluster[rows] < 0) | (near < best[rows]) | (near == best[rows]) & (which < cluster[rows])
            cluster[rows[closer]], best[rows[closer]] = which[closer], near[closer]
        left = may[(before[may] >= 0) & (before[may] != cluster[may])]  # what was its own is now one of its group's others
        for g, rows, found in scanned:
            others = np.where(self.members[g][None, :] == cluster[rows][:, None], np.inf, np.sqrt(found.astype(np.float64)))
            lower[rows, g] = others.min(1) if others.shape[1] else np.inf
        home = self.group[before[left]]
        lower[left, home] = np.minimum(lower[left, home], upper[left])
        upper[may] = np.sqrt(best[may].astype(np.float64))
        return cluster, own_squares(v, self.centroids, cluster), upper, lower, looked

    def scan(self, dims: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, groups = batch.num_rows, len(self.members)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
                cluster, upper = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper"))
                lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if (cluster >= 0).any() else np.zeros((n, groups))
                cluster, distance, upper, lower, looked = self.assign(v, cluster.astype(np.int64), upper, lower)
                if distance.dtype == object and max(distance, default=0) >= 1 << 63:
                    raise OverflowError("a squared distance is no long")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance.astype(np.int64)), pa.array(upper), pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), groups).cast(pa.list_(pa.float64())), pa.array(looked + batch.column("looked").to_numpy())],
                    ["vec_id", "v", "cluster", "distance", "upper", "lower", "looked"],
                )

        return run


def _sums(dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v, cluster = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            at, begin = np.unique(cluster[order], return_index=True)
            if len(at):
                count[at] += np.bincount(cluster, minlength=k)[at]
                high[at] += np.add.reduceat(v[order] >> _HALF, begin)
                low[at] += np.add.reduceat(v[order] & ((1 << _HALF) - 1), begin)
        some = np.flatnonzero(count)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[some].ravel()), dims).cast(pa.list_(pa.int64())) for x in (high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), *lists], ["cluster", "n", "high", "low"])

    return run


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the clusters; empty ones stay. Each task sends a row for a cluster, the driver gets one for a cluster and component."""
    k, dims = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(dims, k), _SUMS).select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("d", "s"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).collect():
        out[r.cluster, r.d] = ((r.high << _HALF) + r.low) // r.n
    return out


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, groups: int = 4, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """Each row's cluster after ``rounds`` rounds and a last assignment, and the final centroids.

    Rows with exactly ``dims`` components, none null or non-finite, take part, as floor(scale * x). Centroids start as the k
    rows with the smallest sha256 of ``salt:key`` (rows without key come last, ties go by components; all rows, if they are
    fewer than k). A round gives every row to the nearest centroid (on a tie the first) and makes every centroid the floor
    of its rows' mean; one without rows stays. Returns vec_id, v (the components), cluster, distance (squared), the bounds and looked,
    the distances to centroids that its bounds did not spare. Repeated rows are rows of their own; an empty table gives none; other
    columns are not read. A component of 2**53 or more after scaling, or a squared distance that is no long, stops the query.
    """
    scaled = F.transform(finite(vector), lambda x: F.when(F.abs(x * scale) < _WIDE, F.floor(x * scale).cast("bigint")).otherwise(F.raise_error(F.lit("a component is too large")).cast("bigint")))
    rows = vectors.where(F.size(vector) == dims).select(F.col(key).cast("bigint").alias("vec_id"), scaled.alias("v")).where("v IS NOT NULL")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    state = rows.selectExpr("*", "-1 AS cluster", "0L AS distance", "0D AS upper", "CAST(array() AS array<double>) AS lower", "0L AS looked")
    if not len(first):
        return state, centroids
    group, before, last = grouped(centroids, groups), None, None
    for n in range(rounds + 1):
        state = stored(state.mapInArrow(Round(centroids, group, before).scan(dims), _STATE))
        forget(last)
        last = state
        if n < rounds:
            before, centroids = centroids, _updated(state, centroids)
    return state, centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia and inertia (distance summed over its cluster and over all) and centroid_sha256 of each row of ``clusters``.

    A sum of distances that is no long stops the query.
    """
    state, centroids = clusters(vectors, **options)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # at most k rows
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia is no long")
    sums = vectors.sparkSession.createDataFrame([(i, d, sum(inertia.values())) for i, d in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(sums.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The same in SQL, without bounds: every row meets every centroid in every round."""
    near = "SELECT r, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT r, cluster, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) AS d FROM x, c{n}) GROUP BY r"
    steps = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) AS INTEGER) - 1 AS cluster, v AS c FROM (SELECT sha256('{salt}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        if n < rounds:
            mean = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS m FROM (SELECT cluster, i, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range({dims})) AS i, unnest(v) AS y FROM x JOIN a{n} USING (r)) GROUP BY cluster, i)) GROUP BY cluster"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN ({mean}) m USING (cluster))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM x JOIN a{rounds} USING (r) JOIN c{rounds} USING (cluster)"
    )


ORACLE_SQL = _sql()
