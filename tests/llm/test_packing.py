import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surelake.llm.packing import by_chunks, pack, plan, sequences, whole
from tests.llm.cases import awkward, frame

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def checked(steps, counts, capacity, opened):
    """How full each sequence is: no gap, no overlap, every piece placed once."""
    used = np.zeros((opened, capacity), int)
    for length, n in counts.items():
        rank = 0
        for s in (s for s in steps if s.length == length):
            assert s.rank == rank
            rank += s.pieces
            for i in range(s.pieces):
                at = s.offset + i % s.each * length
                assert at + length <= capacity
                used[s.first + i // s.each, at : at + length] += 1
        assert rank == n
    filled = used.sum(1)
    assert used.max(initial=0) <= 1 and all((used[b, : filled[b]] == 1).all() for b in range(opened)) and (filled > 0).all()
    return filled


def one_by_one(counts, capacity):
    """Best fit, longest first, a document at a time."""
    room = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(40))
def test_a_plan_over_counts_is_best_fit_over_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 60])
    counts = {n: rng.randint(1, 12) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 20)))}
    steps, opened = plan(counts, capacity)
    checked(steps, counts, capacity, opened)
    assert opened == one_by_one(counts, capacity)
    assert opened * capacity >= sum(n * c for n, c in counts.items())


def test_a_plan_does_not_grow_with_the_counts():
    small, large = ({n: 1 + (n * 7919 % 13) * 10**e for n in range(1, 2049)} for e in (2, 12))
    sizes = [len(plan(c, 2048)[0]) for c in (small, large)]
    assert max(sizes) < 12 * 4 * 2048 and sizes[1] < 2 * sizes[0]
    assert plan({}, 2048) == ([], 0)
    with pytest.raises(ValueError, match="fits into no"):
        plan({9: 1}, 8)


def test_chunks_give_the_ids_of_the_whole_text():
    rng = random.Random(1)
    signs = [*"abXYZé12.,;:!?'´́Σς \t\n\r\x0b\x0c\x1c\x85\xa0　 \x00", "'s", "'RE", "don't", "<|endoftext|>", "<|startoftext|>", "word ", "naïve, ", "中文", "\U0001d4b3", "ﬁ", "≠", ".̸"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(4000)] + ["", " ", "a" * 5000, "a b " * 5000]
    for a, b, t in zip(by_chunks(PATH)(pa.array(texts)), whole(PATH)(pa.array(texts)), texts, strict=True):
        assert a.tolist() == b.tolist(), repr(t)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    text = "Some words, more. " * 400 + "x" * 700 + " end"
    want = whole(PATH)(pa.array([text]))[0].tolist()
    monkeypatch.setattr("surelake.llm.packing._LONG", 100)
    monkeypatch.setattr("surelake.llm.packing._MOST_CACHED", 3)
    assert [x.tolist() for x in by_chunks(PATH)(pa.array([text, "", "a b"]))] == [want, [], whole(PATH)(pa.array(["a b"]))[0].tolist()]


@pytest.mark.parametrize("encode", [by_chunks, whole])
@pytest.mark.parametrize("capacity", [2048, 50, 1])
def test_round_trip(spark, encode, capacity):
    docs = frame(spark, [r for r in awkward() if capacity > 1 or len(r[2] or "") < 500])
    rows = pack(docs.repartition(3), encode(PATH), capacity=capacity, with_ids=True)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    placed = rows.collect()
    want = Counter()
    for r in docs.collect():
        ids = [*whole(PATH)(pa.array([r.text or ""]))[0].tolist(), 0]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[r.doc_id, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in placed) == want
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by_sequence) == one_by_one(Counter(r.length for r in placed), capacity)
    for r in sequences(rows).collect():
        assert len(r.ids) == sum(n for _, n in by_sequence[r.sequence_id]) and [d.offset for d in r.docs] == sorted(o for o, _ in by_sequence[r.sequence_id])


def test_many_equal_rows_and_none(spark):
    docs = spark.range(30_000).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "if(id < 25000, 'one two three', concat('w', id)) AS text", "id AS length", "id AS rank").repartition(7)
    placed = pack(docs, by_chunks(PATH), capacity=64)
    totals = placed.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).toPandas()
    assert placed.count() == 30_000 and totals["sum(length)"].max() <= 64
    tokens = placed.agg({"length": "sum"}).first()[0]
    counts = {r.length: r["count"] for r in placed.groupBy("length").count().collect()}
    assert len(totals) == plan(counts, 64)[1] == placed.agg({"sequence_id": "max"}).first()[0] + 1 <= 1.01 * tokens / 64
    assert pack(docs.limit(0), by_chunks(PATH)).collect() == []


def test_pieces_are_not_sorted_or_collected_by_length(spark):
    plan_text = pack(frame(spark), by_chunks(PATH))._jdf.queryExecution().toString()
    assert "Window" not in plan_text and "CartesianProduct" not in plan_text and "BroadcastHashJoin" in plan_text
