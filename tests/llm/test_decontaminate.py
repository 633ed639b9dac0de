import hashlib
import re

import pyarrow as pa
import pytest

from surelake.llm import decontaminate as module
from surelake.llm.decontaminate import decontaminate
from tests.llm.cases import DOCS, awkward, frame, prose


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, window=13):
    keyed = [(name, words(t)) for name, t in items]
    out = []
    for r in rows:
        w, hit, met = words(r[2]), set(), set()
        for name, s in keyed:
            k = min(window, len(s))
            if not k:
                continue
            windows = {tuple(s[i : i + k]) for i in range(len(s) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    if name is not None:
                        met.add(str(name))
        out.append((r[1], len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    items = [(i, prose(1000 + i, 40, 60)) for i in range(12)] + [(20, prose(30, 5)), (21, "solo"), (22, None), (23, "... "), (None, prose(1001, 40, 60)), (3, prose(1003, 40, 60)), (24, prose(1004, 40, 60)[20:])]
    rows = awkward()
    for i in range(30):
        rows.append(("s", 200 + i, prose(i, 50, 60) + " " + prose(1000 + i % 12, 40, 60)[3 * i :].upper() + ". " + prose(i + 50, 10 * i), "en", 1, 1, "k"))
    rows.append(("s", 300, "Well, SOLO then " + prose(30, 5), "en", 1, 1, "k"))
    return rows, items


@pytest.mark.parametrize("slice_words,pass_words", [(200_000, 1 << 23), (60, 1 << 23), (60, 150)])
@pytest.mark.parametrize("single", [False, True])
def test_equals_brute_force(spark, slice_words, pass_words, single):
    rows, items = cases()
    items = items if single else [x for x in items if x[0] != 21]
    found = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), with_text=False, slice_words=slice_words, pass_words=pass_words)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows, items)))


def test_cuts_the_hit_span(spark):
    item = prose(7, 20)
    rows = [("s", 1, f"Before it. {item} After it!", "en", 1, 1, "k"), ("s", 2, "Clean,  text.", "en", 1, 1, "k")]
    found = decontaminate(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r.doc_id: r.kept_text for r in found.collect()} == {1: "Before it.  After it!", 2: "Clean,  text."}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(frame(spark, [], DOCS), none).collect() == []
    assert {r.n_hit for r in decontaminate(frame(spark), none).collect()} == {0}


def test_several_passes_cut_the_same_text(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    once, often = (decontaminate(frame(spark, rows), bench, carry=("source", "bid"), slice_words=60, pass_words=n).collect() for n in (1 << 23, 100))
    assert sorted(map(repr, once)) == sorted(map(repr, often))


class _Held:
    """A stand-in for a broadcast."""

    def __init__(self, value):
        self.value = value


class _Context:
    broadcast = _Held


def test_each_automaton_is_built_once_in_a_worker(monkeypatch):
    monkeypatch.setattr(module, "builds", 0)
    module._built.clear()
    texts = pa.RecordBatch.from_arrays([pa.array([prose(i, 50, 60) for i in range(8)])], ["text"])
    for call in range(4):  # four queries, two of them with the same benchmark as one before
        slices = [module.Slice(_Context, [(f"{k}", [k * 100 + call % 2 + j for j in range(20)])]) for k in range(1)]
        list(module._searched(iter([texts] * 5), slices, 13))
    assert module.builds == 2
    slices = [module.Slice(_Context, [(f"{k}", [7000 + k * 100 + j for j in range(20)])]) for k in range(6)]
    list(module._searched(iter([texts] * 5), slices, 13))
    assert module.builds == 2 + 6 and len(module._built) <= module._KEPT_AUTOMATA
