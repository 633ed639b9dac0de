import zlib

import numpy as np
import pyarrow as pa
import pytest

from surelake.llm import language_id, quality_cnn
from surelake.llm import textblocks as tb
from tests.llm.cases import DOCS, awkward, frame

SYLLABLES = {"aa": "ka lo mi te ru pa".split(), "bb": "sch ung ein ver ach ich".split(), "cc": "tion eux re le ou ai".split()}


def text_in(lang, seed, words=30):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(words))


def documents(n=300):
    rng = np.random.default_rng(1)
    langs = rng.choice(list(SYLLABLES), n)
    return [("s", i, text_in(x, i, 1 + i % 40), str(x), 1, 1, "k") for i, x in enumerate(langs)]


def test_language(spark):
    docs = frame(spark, documents())
    model = language_id.fit(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in documents() if zlib.crc32(str(r[1]).encode()) % 5 == 0]
    assert all(found[r[1]].held_out for r in held) and sum(x.held_out for x in found.values()) == len(held)
    assert np.mean([found[r[1]].lang_pred == r[3] for r in held]) > 0.9
    kept = language_id.recognised(frame(spark, documents() + [("s", 900, "123 !", "aa", 1, 1, "k"), ("s", 901, None, "aa", 1, 1, "k")]), model)
    assert kept.schema == docs.schema and {900, 901}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() > 290


def test_language_of_awkward_rows(spark):
    model = language_id.fit(frame(spark, documents(60)))
    rows = awkward() + [("s", 70, "ー", "aa", 1, 1, "k"), ("s", 71, "4 5", "aa", 1, 1, "k")]
    found = language_id.identify(frame(spark, rows), model).collect()
    assert len(found) == len(rows)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {0, 1, 2, 71} <= und and 3 not in und and 70 not in und
    assert all(0 <= r.score <= 1 for r in found)
    nothing = language_id.fit(frame(spark, [], DOCS))
    assert {r.lang_pred for r in language_id.identify(frame(spark, rows), nothing).collect()} == {"und"}
    assert language_id.identify(frame(spark, [], DOCS), model).collect() == []


def test_language_of_a_long_text_in_pieces():
    model = language_id.train([(text_in(x, i), x) for i in range(40) for x in SYLLABLES])
    data = np.frombuffer(f" {text_in('bb', 3, 4000)} ".encode(), np.uint8)
    bounds = np.array([0, len(data)])
    np.testing.assert_allclose(language_id.logits(model, data, bounds, piece=1000), language_id.logits(model, data, bounds))


def quality_rows(n=300):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(n):
        good = bool(rng.random() < 0.7)
        text = text_in("aa", i, 20 + i % 90)
        docs.append(("s", i, text if good else text.replace(" ", "%% ").upper(), "en", 1, 1, "k"))
        labels.append((i, int(good), 0, "x"))
    return docs, labels


def test_quality(spark):
    docs, labels = quality_rows()
    table = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0, "x"), (1000, None, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    net = quality_cnn.fit(frame(spark, docs), table)
    found = {r.doc_id: r for r in quality_cnn.score(frame(spark, docs), net).collect()}
    held = [y for y in labels if zlib.crc32(str(y[0]).encode()) % 3 == 1]
    assert all(found[y[0]].held_out for y in held)
    assert np.mean([found[y[0]].predicted == y[1] for y in held]) > 0.95
    rows = quality_cnn.score(frame(spark), net).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality_cnn.score(frame(spark, [], DOCS), net).collect() == []


def test_quality_with_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_cnn.score(frame(spark), quality_cnn.fit(frame(spark), none)).collect()} == {0.5}


@pytest.mark.parametrize("length", [0, 1, 7, 511, 512, 513, 5000])
def test_chunks_cover_the_whole_text(length):
    data = np.ones(length, np.uint8)
    flat, spans, first = quality_cnn._laid_out(np.concatenate([data, data]), np.array([0, length, 2 * length]))
    for d in range(2):
        own = spans[first[d] : first[d + 1]]
        steps = max(1, -(-length // quality_cnn.STRIDE))
        assert own[-1, 1] - own[0, 0] == steps and (own[1:, 0] < own[:-1, 1]).all()


@pytest.mark.parametrize("shift", range(9))
def test_a_pattern_is_seen_at_every_byte(shift):
    net = quality_cnn.train([], {})
    net.filters[:] = 0
    net.filters[np.arange(8), np.frombuffer(b"spammers", np.uint8)] = 1
    net.weights[:] = 1
    data = np.frombuffer(b"." * (40 + shift) + b"spammers" + b"." * 40, np.uint8)
    assert quality_cnn.scores(net, data, np.array([0, len(data)]))[0] == 3 * 8 * quality_cnn.FILTERS


def test_a_long_text_scores_as_in_one_go():
    net = quality_cnn.train([(text_in("aa", i), i % 2) for i in range(40)], {}, epochs=1)
    data = np.frombuffer(text_in("bb", 1, 3000).encode(), np.uint8)
    bounds = np.array([0, len(data)])
    np.testing.assert_allclose(quality_cnn.scores(net, data, bounds, group=1 << 10), quality_cnn.scores(net, data, bounds), rtol=1e-4)


ALIEN = [
    "Zażółć gęślą jaźń, a potem wróć do domu, bo wszyscy czekają na ciebie przy stole i nikt nie chce zaczynać bez ciebie.",
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "asdkjh qwlekj zxmcnb qpwoei lskdjf mznxbc vbnghf ytrueiw oqpwlsk djfhgy tbvncm xzasqw erfdcv tgbnhy ujmkio plokij",
]


def test_texts_in_languages_never_learned_are_rejected():
    rows = [(text_in(x, i, 40), x) for i in range(80) for x in SYLLABLES]
    model = language_id.train(rows)
    assert 0.0005 < model.temperature < 20 and 0 < model.most_unknown < 0.5
    assert language_id.decide(model, pa.array(ALIEN))[2].all()
    own = [text_in(x, 1000 + i, 1 + i) for i in range(60) for x in SYLLABLES]
    lang, _, rejected = language_id.decide(model, pa.array(own))
    assert rejected.mean() < 0.02


def test_unknown_share_does_not_depend_on_pieces_or_neighbours():
    model = language_id.train([(text_in(x, i), x) for i in range(40) for x in SYLLABLES])
    texts = [ALIEN[0], text_in("aa", 900, 50), "", "x"]
    data, bounds = language_id.padded(*tb.text_buffer(pa.array(texts)))
    every = language_id.unknown_share(model.known, data, bounds)
    np.testing.assert_allclose(every, language_id.unknown_share(model.known, data, bounds, piece=11))
    for k, t in enumerate(texts):
        own = language_id.padded(*tb.text_buffer(pa.array([t])))
        assert abs(language_id.unknown_share(model.known, *own)[0] - every[k]) < 0.03


def test_contradicting_labels_teach_nothing(spark):
    docs, labels = quality_rows(60)
    both = [(i, 1 - y, 0, "x") for i, y, _, _ in labels]
    table = spark.createDataFrame(labels + both, "doc_id bigint, quality int, toxic int, text string")
    assert {r.score for r in quality_cnn.score(frame(spark, docs), quality_cnn.fit(frame(spark, docs), table)).collect()} == {0.5}


def test_fitting_quality_leaves_no_python_workers_behind(spark, monkeypatch):
    """What was picked goes to the join without a list that executors pickle in Python."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz qqq xx ") * 5) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("a list was dealt out"))
    net = quality_cnn.fit(docs, labels)
    monkeypatch.undo()
    found = quality_cnn.score(docs, net).collect()
    assert len(found) == 60 and all(r.predicted == r.doc_id % 2 for r in found)
