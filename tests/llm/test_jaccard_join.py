import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surelake.llm.components import components
from surelake.llm import jaccard_join as module
from surelake.llm.jaccard_join import branches, estimated_recall, forest, meets, near_duplicates, next_length, one_of_each, shortest
from tests.llm.cases import DOCS, awkward, frame, prose


def sets(rows, n=5):
    out = []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[2] or "")) if x]
        out.append((tuple(w), {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    return out


def brute(rows):
    own = sets(rows)
    near = [[a != b and len(x & y) * 5 >= 4 * len(x | y) > 0 for b, (_, y) in enumerate(own)] for a, (_, x) in enumerate(own)]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, links in enumerate(near):
            for b, yes in enumerate(links):
                if yes and label[b] < label[a]:
                    label[a], changed = label[b], True
    out = []
    for a, r in enumerate(rows):
        ids = [rows[b][1] for b in range(len(rows)) if label[b] == label[a] and (own[a][0] or rows[b] == r) and rows[b][1] is not None]
        out.append((r[1], min(ids, default=None), sum(near[a]), len(own[a][0])))
    return out


def near_copies(k: int, base: int, seed: int, words: int = 120):
    rng = np.random.default_rng(seed)
    first = prose(seed, words, 2000).split()
    out = []
    for i in range(k):
        w = list(first)
        for at in rng.integers(0, words, int(rng.integers(0, 4))):
            w[at] = f"edit{rng.integers(1000)}"
        out.append(("s", base + i, " ".join(w), "en", 1, 1, "k"))
    return out


@pytest.mark.parametrize("options", [{}, {"part_nodes": 7, "group_bytes": 2000}, {"part_bytes": 3000}])
def test_equals_brute_force(spark, options):
    rows = awkward() + near_copies(40, 1000, 5) + near_copies(3, 2000, 6) + [("s", 3000 + i, prose(i, 40 + i), "en", 1, 1, "k") for i in range(20)] + near_copies(1, 990, 5)
    found = near_duplicates(frame(spark, rows), **options).select("doc_id", "class_id", "n_links", "n_words").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_one_of_each_stays(spark):
    rows = awkward() + near_copies(20, 1000, 5)
    kept = one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    expected = {(i, c) for i, c, *_ in brute(rows) if i == c}
    found = [(r.doc_id, r.doc_id) for r in kept.collect()]
    assert len(found) == len(set(found)) and set(found) - {(None, None)} == expected - {(None, None)}


def test_empty(spark):
    assert near_duplicates(frame(spark, [], DOCS)).collect() == []
    assert one_of_each(frame(spark, [], DOCS)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 9), (9, 7)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {a: b for a, b in label.items() if a != b}


def test_links_of_two_parts_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    grams = [np.unique(np.where(rng.random(200) < 0.05, rng.integers(0, 1 << 60, 200).astype(np.uint64), base)) for _ in range(4096)]
    tracemalloc.start()
    link, bins = module.similarities(np.arange(2048), np.arange(2048, 4096), grams, (4, 5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 85e6
    assert bins.sum() == link.sum() > 2048 * 1024
    few = [set(g.tolist()) for g in (*grams[:20], *grams[2048:2068])]
    same = [[5 * len(a & b) >= 4 * len(a | b) for b in few[20:]] for a in few[:20]]
    assert link[:20, :20].tolist() == same


def test_components_broadcast_nothing(spark, monkeypatch):
    from surelake.llm import components as rounds

    plans = []

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(rounds, "stored", stored)
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") - F.col("id") % 4).alias("v"))
    assert components(edges).count() == 150
    assert len(plans) > 1 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_prefixes_shorten_until_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        for recall in (0.9, 0.99, 0.9995):
            k = shortest(threshold, recall, 16, 10)
            assert meets(threshold, k, 16) >= recall or k == 1
            assert k == 10 or meets(threshold, k + 1, 16) < recall
    alike, apart = {19: 1000}, {0: 1000}
    assert next_length(alike, 0.8, 0.9995, 10, 4, 16) == 10 and next_length(apart, 0.8, 0.9995, 10, 4, 16) == 4
    assert 10 > next_length({19: 1000, 3: 60}, 0.8, 0.9995, 10, 4, 16) > 4
    assert next_length({}, 0.8, 0.9995, 10, 4, 16) == 4 and next_length(apart, 0.8, 0.9995, 4, 4, 16) == 4


def test_shared_depth_and_ties_across_partitions(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, (60, 4, 5))  # few values, so that paths share prefixes
    raw = [(int(i), 1, b"".join(values[i, t].astype(">u2").tobytes() for t in range(4))) for i in range(60)]
    signed = spark.createDataFrame(raw, "node bigint, n_words bigint, paths binary").repartition(3)
    found = {(min(r.u, r.v), max(r.u, r.v), r.depth) for r in forest(signed, 4, 1).collect()}
    label = {k: {i: i for i in range(60)} for k in range(1, 6)}
    for k in label:  # nodes tied at k are those that share a prefix of k
        near = {(a, b) for a, b, d in found if d >= k}
        for _ in range(60):
            for a, b in near:
                label[k][a] = label[k][b] = min(label[k][a], label[k][b])
        for t in range(4):
            for a in range(60):
                for b in range(a):
                    if (values[a, t, :k] == values[b, t, :k]).all():
                        assert label[k][a] == label[k][b]
        assert all(any((values[a, t, :k] == values[b, t, :k]).all() for t in range(4)) for a, b in near)


def test_branches_over_batches_are_those_in_one_go():
    rng = np.random.default_rng(3)
    depth, node = rng.integers(0, 6, 200), rng.permutation(200)
    depth[0] = 0
    whole = sorted(zip(*(x.tolist() for x in branches(depth, node, {k: int(node[0]) for k in range(1, 7)}, 1)), strict=True))
    begun, parts = {k: int(node[0]) for k in range(1, 7)}, []
    for lo in range(0, 200, 7):
        parts += zip(*(x.tolist() for x in branches(depth[lo : lo + 7], node[lo : lo + 7], begun, 1)), strict=True)
    assert sorted(parts) == whole and len(whole) == int((depth > 0).sum())


def test_lengths_are_not_shortened_more_than_the_pairs_ask(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(module, "estimated_recall", lambda *a: asked.append(a[2]) or estimated_recall(*a))
    rows = [("s", i, prose(i, 300, 5000), "en", 1, 1, "k") for i in range(20)]
    close = [("s", 100 + i, prose(i, 300, 5000) + " end", "en", 1, 1, "k") for i in range(20)]
    assert {r.n_links for r in near_duplicates(frame(spark, rows + close)).collect()} == {1} and set(asked) == {10}
    far = [("s", 100 + i, prose(i, 270, 5000) + " " + prose(900 + i, 33, 5000), "en", 1, 1, "k") for i in range(20)]
    found = near_duplicates(frame(spark, rows + far)).select("doc_id", "class_id", "n_links", "n_words").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows + far))) and min(asked) < 10


@pytest.mark.parametrize("threshold", [(1, 2), (7, 10), (4, 5), (9, 10)])
def test_recall_against_brute_force(spark, threshold):
    rows = [r for seed in range(25) for r in near_copies(5, 1000 + 10 * seed, seed)]
    up, down = threshold
    own = [x for _, x in sets(rows)]
    texts = [r[2] for r in rows]
    expected = sum(len(x & y) * down >= up * len(x | y) and a != b for a, x in enumerate(own) for b, y in enumerate(own))
    found = sum(r.n_links for r in near_duplicates(frame(spark, rows), threshold=threshold).collect())
    assert len(set(texts)) > 80 and expected > 50 and found <= expected and found >= 0.995 * expected


@pytest.mark.parametrize("keyed", [False, True])
def test_a_row_that_is_there_100_000_times_is_verified_once(spark, keyed):
    from surelake.llm.jaccard_join import one_text

    text = prose(41, 60)
    near = text + " more"
    copies = spark.range(100_000).select(F.lit(5 if keyed else None).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).repartition(6)
    docs = copies.unionByName(spark.createDataFrame([(9, near), (11, prose(42, 60)), (12, prose(42, 60))], "doc_id bigint, text string"))
    signed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    assert one_text(signed, signed).count() == 4
    found = near_duplicates(docs).groupBy("doc_id", "class_id", "n_links").count().collect()
    key = 5 if keyed else None
    assert {(r.doc_id, r.class_id, r.n_links, r["count"]) for r in found} == {(key, 5 if keyed else 9, 100_000, 100_000), (9, 5 if keyed else 9, 100_000, 1), (11, 11, 1, 1), (12, 11, 1, 1)}
    assert one_of_each(docs).count() == 2
