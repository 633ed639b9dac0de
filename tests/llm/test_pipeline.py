"""The pipeline's stages on a small corpus with planted cases, each held against what must stay and go."""

import hashlib
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from surelake.llm import language_id
from tests.llm.cases import prose
from tests.llm.test_decontaminate import words as item_words
from tests.llm.test_jaccard_join import brute as brute_classes
from tests.llm.test_mixing import bounded, filled
from tests.llm.test_substring_dedup import brute as brute_repeats
from tests.llm.test_classifiers import ALIEN, text_in

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    """Distinct clean documents; planted ones from id 1000 on."""
    docs = {i: (text_in(("aa", "bb", "cc")[i % 3], i, 60 + i), ("aa", "bb", "cc")[i % 3], f"s{i % 4}") for i in range(120)}
    passage, item = text_in("aa", 777, 60), text_in("bb", 888, 30)
    docs[1000] = (docs[5][0], "cc", "s9")  # a copy
    docs[1001] = (docs[50][0] + " end", "cc", "s9")  # a near copy
    docs[1002] = (text_in("aa", 1002, 80) + " " + passage + " " + text_in("aa", 1003, 80), "aa", "s0")
    docs[1003] = (text_in("aa", 1004, 90) + " " + passage + " " + text_in("aa", 1005, 70), "aa", "s0")
    docs[1004] = (text_in("bb", 1006, 50) + " " + item, "bb", "s1")  # contaminated
    docs[1005] = (text_in("bb", 1007, 2000) + " " + item, "bb", "s1")  # too little to be
    docs[1006] = (None, "aa", "s1")
    docs[1007] = ("12 34 !!", "aa", "s1")
    rows = [(i, t, lang, s, len(t or "")) for i, (t, lang, s) in docs.items()]
    return rows, passage, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, item = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(5, 20))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_stage(spark, folder):
    rows, passage, item = corpus()
    clean = set(range(120))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns and docs.dtypes == [(f.name, f.dataType.simpleString()) for f in docs.schema]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = kept["language ID"]
    assert {1006, 1007}.isdisjoint(first) and len(clean - set(first)) <= 1
    assert set(kept["n-gram Jaccard join"]) == set(first) - {1000, 1001}
    third = kept["substring dedup"]
    assert set(third) == set(first) - {1000, 1001}
    original = {r[0]: r[1] for r in rows}
    assert all(third[i] == original[i] for i in third if i < 1000)
    assert passage not in third[1002] and passage not in third[1003]
    item_words = item.split()
    last = kept["benchmark decontamination"]
    assert set(last) == set(third) - {1004}
    assert " ".join(item_words[-13:]) not in last[1005]


def brute_pipeline(spark, rows, items):
    """run() in plain Python, a stage at a time; only language ID uses the operator's own model, on one text after another."""
    from surelake.llm import mixing

    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    kept = [r for r in rows if not language_id.decide(model, pa.array([r[1]], pa.string()))[2][0]]
    wide = [(r[3], r[0], r[1], r[2], 0, 0, "k") for r in kept]
    first = {i: c for i, c, *_ in brute_classes(wide)}
    kept = sorted({r for r in kept if first[r[0]] == r[0]})
    texts = {i: (n > gone, t) for i, n, gone, _, t in brute_repeats([(r[3], r[0], r[1], r[2], 0, 0, "k") for r in kept], 35)}
    kept = [(r[0], texts[r[0]][1], r[2], r[3]) for r in kept if texts[r[0]][0]]
    out, windows = [], set()
    for _, item in items:
        w = item_words(item)
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(max(1, len(w) - 12))} if w else set()
    for i, text, lang, source in kept:
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        w, hit = item_words(text), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if hit and 20 * len(hit) >= len(w):
            continue
        gone = sorted(hit)
        for end in reversed([k for k in gone if k + 1 not in hit]):
            begin = end
            while begin - 1 in hit:
                begin -= 1
            text = text[: spans[begin][0]] + text[spans[end][1] :]
        out.append((i, text, lang, source))
    topic = lambda t: "legal" if "icense" in t or "opyright" in t else "web" if "http" in t or "@" in t else "layout" if " | " in t or "{" in t else "prose"
    cell = {i: (source, lang, topic(t)) for i, t, lang, source in out}
    size = {i: len(re.findall(mixing.WORD, t)) for i, t, *_ in out}
    cells: dict = {}
    for i, c in cell.items():
        cells[c] = cells.get(c, 0) + size[i]
    targets = []
    for d, name in enumerate(mixing.DIMS):
        tokens: dict = {}
        for c, n in cells.items():
            tokens[c[d]] = tokens.get(c[d], 0) + n
        targets.append(filled(tokens, {v: n ** mixing.TEMPER[name] for v, n in tokens.items()}, 0.5 * sum(cells.values())))
    weight = bounded(cells, targets, 0.5, 12)
    u = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return sorted((i, t, lang, source, len(t)) for i, t, lang, source in out if u(i) < weight[cell[i]] / cells[cell[i]])


def test_run_equals_brute_force(spark, folder):
    rows, _, item = corpus()
    found = corpus_pipeline.run(spark, folder).collect()
    expected = brute_pipeline(spark, rows, [(1, item), (2, prose(5, 20))])
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found) == expected and 20 < len(expected) < 115


def test_stages_on_nulls_repeats_ties_and_other_columns(spark, folder):
    """Rows without id, source or language, repeated rows, one very long text, and columns named like the operators' own."""
    rows, _, _ = corpus()
    rows += rows[:3] + [(None, text_in("aa", 4000, 70), "aa", None, 0), (None, None, None, None, None), (4001, "", None, "s0", 0), (4002, text_in("aa", 4002, 30000), None, "s1", 0), (4002, text_in("bb", 4003, 70), "bb", "s1", 0)]
    extra = [(*r, "x", 7, "b", 0.5) for r in rows]
    docs = spark.createDataFrame(extra, SCHEMA + ", row string, bid int, key string, __tokens double")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        found = docs.collect()
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(docs.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame([(*r, "x", 7, "b", 0.5) for r in found], SCHEMA + ", row string, bid int, key string, __tokens double")
            ids = [r.doc_id for r in found]
            assert {4002, None} <= set(ids) and 4001 not in ids
            if name != "language ID":
                assert ids.count(0) == 1 and ids.count(4002) in (1, 2)  # repeated rows stay once


def test_run_and_its_sample(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    found = out.collect()
    assert "doc_id" in out.columns and 20 < len(found) < 115
    assert len({r.doc_id for r in found}) == len(found)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rejection_is_calibrated():
    """Own texts that training did not see stay; what is in no learned language goes."""
    model = language_id.train([(text_in(x, i), x) for i in range(60) for x in ("aa", "bb", "cc")])
    own = pa.array([text_in(x, 500 + i) for i in range(60) for x in ("aa", "bb", "cc")])
    assert language_id.decide(model, own)[2].mean() <= 0.02
    assert language_id.decide(model, pa.array(ALIEN))[2].all()
