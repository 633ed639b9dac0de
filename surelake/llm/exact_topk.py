"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are integer rows over terms, their components; sums are float32, float64, int64 or
Python integers, whichever is exact for a pair of blocks. Queries and candidates are dealt into blocks and every query block meets every candidate block once. There,
each term has postings, the candidates with a weight for it; a query's non-zero
terms scatter their weighted postings into dense score arrays, a tile of queries
at a time. Partition selection keeps a block's k best per query, and the blocks'
lists are merged by rank. Only rows of at most k per query and block come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb

_PART = "query_id bigint, q_row bigint, vec_id bigint, score bigint"
_LARGEST = 1 << 63  # a score is a long


def finite(vector: str) -> Column:
    """The components as doubles; null if the vector or a component is null or not finite."""
    fine = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(F.col(vector), lambda x: x.cast("double")))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers if one of them is 2**53 or more."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled.astype(np.int64)
    return np.array([int(y) if np.isfinite(y) else int(z) * scale for y, z in zip(scaled.tolist(), x.tolist(), strict=True)], object)


def _sparse(rows: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components, by row."""
    column = rows["v"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths()).astype(np.int64)
    flat = quantised(column.flatten().to_numpy(zero_copy_only=False), scale)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    some = flat != 0
    return row[some], term[some], flat[some]


class Postings:
    """Per term, the candidates that have it and their weights; a term that a quarter of them have is kept as a whole row of weights."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.ids, self.largest = ids, int(max(np.abs(weight), default=0)) if weight.dtype == object else int(np.abs(weight).max(initial=0))
        order = np.argsort(term, kind="stable")
        terms, begin = np.unique(term[order], return_index=True)
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, part in zip(terms.tolist(), np.split(order, begin[1:]), strict=True):
            if 4 * len(part) >= len(ids):
                whole = np.zeros(len(ids), weight.dtype)
                whole[row[part]] = weight[part]
                self.lists[t] = (None, whole)
            else:
                self.lists[t] = (row[part], weight[part])

    def of_kind(self, kind: np.dtype) -> None:
        self.lists = {t: (at, weight.astype(kind)) for t, (at, weight) in self.lists.items()}

    def accumulate(self, queries: np.ndarray) -> np.ndarray:
        """Scores of a tile of dense query rows [queries, terms], of the weights' kind, against every candidate."""
        out = np.zeros((len(queries), len(self.ids)), queries.dtype)
        part = np.empty_like(out)
        for t, (at, weight) in self.lists.items():
            if t >= queries.shape[1]:
                continue
            mine = queries[:, t]
            if at is None:
                np.multiply(mine[:, None], weight[None, :], out=part)
                out += part
            elif mine.any():
                has = np.flatnonzero(mine)
                out[np.ix_(has, at)] += mine[has][:, None] * weight[None, :]
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend. Minus infinity or the least value marks what takes no part."""
    n = len(scores)
    if n > k:
        least = np.partition(scores, n - k)[n - k]
        over, even = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        at = np.concatenate([over, even[: k - len(over)]])
    else:
        at = np.arange(n)
    return at[np.lexsort((ids[at], -scores[at].astype(np.float64) if scores.dtype.kind == "f" else -scores[at]))]


def _longs(scores: np.ndarray) -> np.ndarray:
    """A score above all longs stops the query, as no lower one can take its rank; one below them becomes the least, which another block's may outrank."""
    if scores.dtype.kind == "O":
        if max(scores, default=0) >= _LARGEST:
            raise OverflowError("a score among the k best is no long")
        scores = np.maximum(scores, -_LARGEST)
    return scores.astype(np.int64)


def search_block(rows: pa.Table, k: int, scale: int, tile: int = 16) -> pa.Table:
    """The k best candidates of each query of a block pair."""
    side = rows["query"].to_numpy().astype(bool)
    queries, cands = rows.filter(pa.array(side)), rows.filter(pa.array(~side))
    cands = cands.take(pa.array(np.argsort(cands["id"].to_numpy(), kind="stable")))
    out: dict[str, list] = {"query_id": [], "q_row": [], "vec_id": [], "score": []}
    if queries.num_rows and cands.num_rows:
        ids, crows, qids, qrows = cands["id"].to_numpy(), cands["row"].to_numpy(), queries["id"].to_numpy(), queries["row"].to_numpy()
        post = Postings(ids, *_sparse(cands, scale))
        row, term, weight = _sparse(queries, scale)
        dense = np.zeros((queries.num_rows, int(term.max(initial=0)) + 1), weight.dtype)
        dense[row, term] = weight
        reach = int(np.abs(dense).max(initial=0)) * post.largest * dense.shape[1]
        kind = np.dtype(np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64 if reach < _LARGEST else object)  # each exact
        post.of_kind(kind)
        dense = dense.astype(kind)
        none = np.iinfo(np.int64).min if kind.kind == "i" else -np.inf
        for p in range(0, len(dense), tile):
            scores = post.accumulate(dense[p : p + tile])
            for i, s in enumerate(scores):
                lo, hi = np.searchsorted(ids, qids[p + i], "left"), np.searchsorted(ids, qids[p + i], "right")
                s[lo + np.flatnonzero(crows[lo:hi] == qrows[p + i])[:1]] = none  # its own row, once
                at = best(s, ids, k)
                at = at[s[at] != none]
                out["query_id"].append(np.full(len(at), qids[p + i]))
                out["q_row"].append(np.full(len(at), qrows[p + i]))
                out["vec_id"].append(ids[at])
                out["score"].append(_longs(s[at]))
    return tb.table_of(_PART, {c: np.concatenate(v) if v else [] for c, v in out.items()})


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, scale: int = 64, query_block: int = 2048, candidate_block: int = 4096) -> DataFrame:
    """The k highest integer inner products of each row whose key is divisible by ``every``, against every other row.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id and score, ties to the smaller vec_id; fewer
    rows than k if there are fewer candidates. Rows without key, vector or a finite value in every component take no part;
    every other row does, whatever the size of its components. A score that is no long stops the query if it is among the
    k highest. A query's own row is no candidate, but every other one is, with the same key too: rows of one key and
    different vectors are queries of their own, each with its own ranks; a row that is there several times is asked once and
    has its copies as candidates, each listed. Vectors of unequal length are multiplied over the terms that both have. An
    empty table gives no rows; other columns are not read.
    """
    base = vectors.select(F.col(key).cast("bigint").alias("id"), finite(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    base = base.withColumn("row", F.xxhash64("id", "v"))
    is_query = F.col("id") % every == 0
    n, asked = base.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    across, down = max(1, -(-n // candidate_block)), max(1, -(-asked // query_block))
    queries = base.where(is_query).dropDuplicates(["id", "row"]).select(F.lit(True).alias("query"), "id", "row", "v", F.pmod("row", F.lit(down)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    cands = base.select(F.lit(False).alias("query"), "id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(across)).cast("int").alias("c"))
    found = queries.unionByName(cands).groupBy("q", "c").applyInArrow(lambda rows: search_block(rows, k, scale), _PART)
    order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score") > -_LARGEST, F.col("score")).otherwise(F.raise_error(F.lit("a score among the k best is no long")).cast("bigint"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT min(r) AS r, vec_id, e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, e
), s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.r <> c.r
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
"""
