import numpy as np
import pytest
from pyspark.sql import functions as F

from surelake.llm import mixing
from tests.llm.cases import DOCS, frame, prose


def many():
    rng = np.random.default_rng(0)
    return [(f"s{min(int(rng.integers(0, 9)), 4)}", i, prose(i, int(rng.integers(5, 60))) + (" License" if i % 5 == 0 else ""), ["en", "de", None][int(rng.integers(0, 3))], 1, 1, "k") for i in range(600)]


def filled(size: dict, weight: dict, budget: float) -> dict:
    """What each value is to give: in proportion to the weights, no more than it has."""
    whole: set = set()
    while True:
        rest = sum(weight[v] for v in weight if v not in whole)
        level = (budget - sum(size[v] for v in whole)) / rest if rest else 0.0
        more = {v for v in weight if v not in whole and level * weight[v] >= size[v]}
        if not more:
            return {v: size[v] if v in whole else level * weight[v] for v in weight}
        whole |= more


def bounded(cells: dict, targets: list[dict], keep: float, rounds: int) -> dict:
    w = {c: keep * n for c, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            new = {}
            for value in {c[d] for c in cells}:
                own = [c for c in cells if c[d] == value]
                full = [c for c in own if w[c] >= cells[c] * (1 - 1e-12)]
                have, target = sum(w[c] for c in own), targets[d].get(value, 0.0)
                free = sum(w[c] for c in own if c not in full)
                for c in own:
                    if target > have:
                        new[c] = w[c] if c in full else min(cells[c], w[c] * (target - sum(w[x] for x in full)) / free if free else w[c])
                    else:
                        new[c] = w[c] * target / have if have else 0.0
            w = new
    return w


GIVEN = {"source": {f"s{k}": 1.0 for k in range(5)}, "lang": {"en": 3.0, "de": 2.0, mixing.NONE: 1.0}, "topic": {"legal": 1.0, "prose": 1.0}}


@pytest.mark.parametrize("given", [GIVEN, None, {"source": {"s0": 5.0, "s1": 1.0}}])
@pytest.mark.parametrize("few", [True, False])
def test_weights_and_probabilities(spark, given, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "_MOST_BROADCAST", 3)
    marked = mixing.described(frame(spark, many()), "doc_id", "text", "source", "lang", None)
    found = mixing.cell_probabilities(marked, 0.4, 4, given).collect()
    cells = {(r.source, r.lang, r.topic): r.tokens for r in found}
    targets = []
    for k, d in enumerate(mixing.DIMS):
        size: dict = {}
        for c, n in cells.items():
            size[c[k]] = size.get(c[k], 0) + n
        weight = {v: x for v, x in given[d].items() if v in size} if given and d in given else {v: n ** mixing.TEMPER[d] for v, n in size.items()}
        targets.append(filled(size, weight, 0.4 * sum(cells.values())))
    weights = bounded(cells, targets, 0.4, 4)
    for r in found:
        assert r.w == pytest.approx(weights[r.source, r.lang, r.topic], rel=1e-9, abs=1e-9)
        assert r.p == pytest.approx(r.w / r.tokens, abs=1e-8) and 0 <= r.p <= 1


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.8])
def test_tokens_times_probabilities_meet_the_targets(spark, keep):
    marked = mixing.described(frame(spark, many()), "doc_id", "text", "source", "lang", None)
    cells = mixing.cell_probabilities(marked, keep)
    found = mixing.gaps(cells).collect()
    assert {r.dim for r in found} == set(mixing.DIMS) and max(abs(r.gap) for r in found) < 0.01
    drawn = cells.agg(F.sum(F.col("tokens") * F.col("p")), F.sum("tokens")).first()
    assert drawn[0] == pytest.approx(keep * drawn[1], rel=0.01)


def test_sample(spark):
    docs = frame(spark, many())
    kept = mixing.sampled(docs, 0.5)
    assert kept.columns == ["__source", "__lang", "__topic", *docs.columns, "__tokens", "__p"]
    again = mixing.sampled(docs.repartition(7), 0.5)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in again.collect()}
    share = kept.agg(F.sum("__tokens")).first()[0] / mixing.described(docs, "doc_id", "text", "source", "lang", None).agg(F.sum("__tokens")).first()[0]
    assert 0.4 < share < 0.6
    assert mixing.sampled(docs, 1.0).count() == 600


def test_awkward_rows(spark):
    assert mixing.sampled(frame(spark), 1.0).where("doc_id = 5").count() == 1
    assert mixing.sampled(frame(spark, [], DOCS)).collect() == []
    assert mixing.sampled(frame(spark, [("s", 1, None, None, 0, 0, "k")])).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = mixing.sampled(frame(spark, many()).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
