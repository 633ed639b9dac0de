import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from surelake.llm import textblocks as tb
from surelake.llm.elias_fano import BOOK, Sequence, Trie
from surelake.llm.lm_scoring import NONE, joined, lm_scores, narrowed, pack_codes, pack_paths, pack_tokens, split_up, unpack_codes, unpack_paths, unpack_tokens
from tests.llm.cases import DOCS, awkward, frame, prose


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*(w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w), None]


def brute(rows, mu):
    learned = [r for r in rows if r[1] is not None and zlib.crc32(str(r[1]).encode()) % 7 != 2]
    one, two, three = Counter(), Counter(), Counter()
    for r in learned:
        t = tokens(r[2])
        one.update(t)
        two.update(zip(["<s>", *t[:-1]], t, strict=True))
        three.update(zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=False))
    n, v, begins = sum(one.values()), len(one), len(learned)
    out = []
    for r in rows:
        t = tokens(r[2])
        base = [(one[w] + 1) / (n + v + 1) for w in t]
        score = 0.0
        for k, (w, b) in enumerate(zip(t, base, strict=True)):
            u = t[k - 1] if k else "<s>"
            p = (two[u, w] + mu[0] * b) / ((begins if u == "<s>" else one[u]) + mu[0])
            if k:
                s = t[k - 2] if k > 1 else "<s>"
                p = (three[s, u, w] + mu[1] * p) / (two[s, u] + mu[1])
            score += math.log10(p)
        held = r[1] is not None and zlib.crc32(str(r[1]).encode()) % 7 == 2
        out.append((r[1], held, len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, base)), score))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "bucket_keys": 100}, {"block_bytes": 3000, "bucket_keys": 100, "fan": 5}])
def test_equals_brute_force(spark, options):
    rows = awkward() + [("s", 500 + i, prose(i, 30 * i, 60).title(), "en", 1, 1, "k") for i in range(30)]
    found = sorted(map(tuple, lm_scores(frame(spark, rows), mu=(20.0, 5.0), **options).collect()), key=repr)
    expected = sorted(brute(rows, (20.0, 5.0)), key=repr)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    np.testing.assert_allclose([f[5] for f in found], [e[5] for e in expected], rtol=1e-9)
    np.testing.assert_allclose([f[6] for f in found], [e[6] for e in expected], rtol=5e-3, atol=0.02)


def test_scores_do_not_depend_on_blocks_and_buckets(spark):
    rows = awkward() + [("s", 500 + i, prose(i, 30 * i, 60), "en", 1, 1, "k") for i in range(20)]
    every = [sorted(map(repr, ((r.doc_id, r.train_tokens, round(r.score, 9)) for r in lm_scores(frame(spark, rows), **o).collect()))) for o in ({}, {"block_bytes": 2000, "bucket_keys": 1 << 19}, {"block_bytes": 5000, "fan": 3})]
    assert every[0] == every[1] == every[2]


def test_a_text_that_is_there_twice_scores_higher(spark):
    texts = [prose(i, 80, 3000) for i in range(60)]
    rows = [("s", 2 * i, t, "en", 1, 1, "k") for i, t in enumerate(texts)]
    copies = [("s", 2 * i + 1, texts[i], "en", 1, 1, "k") for i in range(0, 60, 4)]
    once, twice = ({r.doc_id: r.score - r.base_score for r in lm_scores(frame(spark, t)).collect()} for t in (rows, rows + copies))
    learned = {r[1] - 1 for r in copies if zlib.crc32(str(r[1]).encode()) % 7 != 2}
    gain = {i: twice[i] - x for i, x in once.items()}
    assert len(learned) > 8 and min(gain[i] for i in learned) > max(x for i, x in gain.items() if i not in learned and i + 1 not in twice)


def test_nothing_to_learn(spark):
    assert lm_scores(frame(spark, [], DOCS)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scores(frame(spark, [("s", held, "a b", "en", 1, 1, "k")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("top", [1, 50, 1 << 20, 1 << 45])
def test_sequence(top):
    rng = np.random.default_rng(top)
    values = np.sort(rng.integers(0, top, 3000, dtype=np.uint64))
    s = Sequence(values)
    assert (s.access(np.arange(3000)) == values).all()
    asked = np.concatenate([values[::7], rng.integers(0, top + 5, 500, dtype=np.uint64)])
    assert (s.successor(asked) == np.searchsorted(values, asked)).all() and (s.every() == values).all()
    at, there = s.search(asked)
    assert (there == np.isin(asked, values)).all() and (s.values(np.arange(0, 3000, 50)) == values[::50]).all()
    assert Sequence(np.zeros(0, np.uint64)).successor(np.array([3], np.uint64)).tolist() == [0]


def _paths(n: int, seed: int):
    rng = np.random.default_rng(seed)
    raw = np.column_stack([rng.integers(0, 300, n), rng.integers(0, 40, n) * 977, rng.integers(0, 1 << 32, n)]).astype(np.uint64)
    raw[::5, 2] = NONE
    return np.unique(raw, axis=0).T


def test_trie_is_compact_and_finds_paths():
    u, v, w = _paths(40000, 1)
    rng = np.random.default_rng(2)
    half = rng.random(len(u)) < 0.5
    count, of_u = rng.integers(1, 50, half.sum()), np.full(half.sum(), 9000)
    trie = Trie(u[half] << np.uint64(20), v[half], w[half], count, of_u, (20.0, 5.0), NONE)
    code = trie.find(u << np.uint64(20), v, w)
    pairs = Counter()
    for a, b, c in zip(u[half].tolist(), v[half].tolist(), count.tolist(), strict=True):
        pairs[a, b] += c
    three = dict(zip(zip(u[half].tolist(), v[half].tolist(), w[half].tolist(), strict=True), count.tolist(), strict=True))
    for k, (a, b, c) in enumerate(zip(u.tolist(), v.tolist(), w.tolist(), strict=True)):
        assert (code[k, 0] > 0) == ((a, b) in pairs) and (code[k, 1] > 0) == ((a, b, c) in three and c != NONE)
        if code[k, 0]:
            assert BOOK[code[k, 0]] == pytest.approx(math.log10(pairs[a, b] / 9020), rel=1e-3, abs=1e-4)
        if code[k, 1]:
            assert BOOK[code[k, 1]] == pytest.approx(math.log10(three[a, b, c] / (pairs[a, b] + 5)), rel=1e-3, abs=1e-4)
    assert trie.nbytes() < 8 * half.sum()
    assert Trie(u[:0], v[:0], w[:0], count[:0], of_u[:0], (20.0, 5.0), NONE).find(u, v, w).max() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_packed_paths(n):
    u, v, w = _paths(n, n)
    rng = np.random.default_rng(n)
    of_u = u.astype(np.int64) * 400  # some contexts are frequent
    v, w = narrowed(v << np.uint64(8), w, of_u)
    keys = tb.united(*joined(u, v, w, rng.integers(0, 400, len(u)), of_u))[0]
    for a, b in zip(keys, unpack_paths(pack_paths(keys)), strict=True):
        assert (a == b).all()
    u, v, w = split_up(keys)
    for a, b in zip(keys[:2], joined(u, v, w, keys.value, keys.extra)[:2], strict=True):
        assert (a == b).all()
    codes = rng.integers(0, 4096, (n, 2)).astype(np.uint16)
    assert (unpack_codes(pack_codes(codes)) == codes).all()
    tokens = tb.united(rng.integers(0, 1 << 64, n, dtype=np.uint64) & ~np.uint64(0xFFFF), None)[0]
    assert all((a == b).all() for a, b in zip(tokens, unpack_tokens(pack_tokens(tokens)), strict=True))


def test_a_row_counts_as_often_as_it_is_there(spark):
    """Written out or as copies of other rows' texts, the model is the same."""
    texts = [prose(i, 30, 40) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 500 + [(4, texts[4])] * 2
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    assert learned(3)
    apart = [(i, t) for i, t in enumerate(texts)] + [(k, texts[3]) for k in range(1000, 9000) if learned(k)][:500] + [(4, texts[4])] * 2
    one, two = ({(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm_scores(spark.createDataFrame(x, "doc_id bigint, text string").repartition(3)).where("doc_id < 20").collect()} for x in (rows, apart))
    assert one == two and lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(rows)
