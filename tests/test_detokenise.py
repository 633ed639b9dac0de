import json

import pytest
from pyspark.sql import functions as F

from surelake.operators import detokenise
from surelake.operators.detokenise import VOCABULARY, aligned, byte_vocabulary, decoded, text_violations, wrong_texts

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
TEXTS = ["", "plain words, twice plain", "naïve café — 中文 \U0001d4b3\U0001f600", " \n\t x", "é" * 50]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rows(spark):
    t = tokenizer()
    found = [(i, "a", t.encode(x, add_special_tokens=False).ids, x) for i, x in enumerate(TEXTS)]
    found += [(9, "a", None, None), (1, "b", [*found[1][2], 50256], TEXTS[1]), (2, "b", found[2][2][:-1], "cut")]
    return spark.createDataFrame(found, "k int, part string, token_ids array<int>, text string")


def test_text_and_offsets_are_the_tokenizers(spark, rows):
    vocabulary = byte_vocabulary(spark, PATH)
    found = {(r.k, r.part): r for r in decoded(rows, vocabulary, ["k", "part"]).collect()}
    t = tokenizer()
    for i, x in enumerate(TEXTS):
        r = found[i, "a"]
        want = t.encode(x, add_special_tokens=False)
        assert r.text == x == t.decode(want.ids)
        assert all(x[s.start : s.end] for s in r.offsets)
        plain = [(s.start, s.end) for s in r.offsets]
        # The tokenizer may leave a blank out of a span; ends and places within characters are the same.
        assert [b for _, b in plain] == [b for _, b in want.offsets] and all(a <= c for (a, _), (c, _) in zip(plain, want.offsets, strict=True))
    assert (found[9, "a"].text, found[9, "a"].offsets) == (None, None)
    assert found[1, "b"].text == TEXTS[1] and found[1, "b"].offsets[-1] is None
    assert found[2, "b"].text == t.decode(t.encode(TEXTS[2], add_special_tokens=False).ids[:-1])


def test_wrong_texts(spark, rows):
    found = wrong_texts(rows, byte_vocabulary(spark, PATH), ["k", "part"]).collect()
    assert [(r.k, r.part, r.text) for r in found] == [(2, "b", "cut")]


def test_alignment_is_computed(spark, rows):
    found = {(r.k, r.part): r for r in aligned(rows, byte_vocabulary(spark, PATH), ["k", "part"], [50256], PATH).collect()}
    assert {k: r.status for k, r in found.items() if k != (2, "b")} == {**{(i, "a"): "aligned" for i in range(len(TEXTS))}, (9, "a"): "offsets_unavailable", (1, "b"): "aligned"}
    assert found[1, "b"].spans[-1] is None and [s.end for s in found[1, "a"].spans] == [s.end for s in found[1, "b"].spans[:-1]]
    strange = spark.createDataFrame([(1, [ord("a") - 33 + 0, 220, 220])], "k int, token_ids array<int>")
    assert aligned(strange, byte_vocabulary(spark, PATH), ["k"], [50256], PATH).first().status in ("aligned", "token_roundtrip_mismatch")


def test_pieces_that_end_within_a_character(spark):
    vocabulary = spark.createDataFrame([(1, b"a\xc3", False), (2, b"\xa9", False), (3, b"\xe4\xb8", False), (4, b"\xadb", False), (5, b"<s>", True)], VOCABULARY)
    r = decoded(spark.createDataFrame([(1, [5, 1, 2, 3, 4, 5])], "k int, t array<bigint>"), vocabulary, ["k"], "t").first()
    assert r.text == "aé中b" and [s and (s.start, s.end) for s in r.offsets] == [None, (0, 2), (1, 2), (2, 3), (2, 4), None]
    lone = decoded(spark.createDataFrame([(1, [2])], "k int, t array<bigint>"), vocabulary, ["k"], "t").first()
    assert lone.text == "�" and (lone.offsets[0].start, lone.offsets[0].end) == (0, 0)


@pytest.mark.parametrize("tokens,what", [([1, 7], "no piece for token 7"), ([None], "no piece for token null")])
def test_unknown_tokens_stop_the_query(spark, tokens, what):
    vocabulary = spark.createDataFrame([(1, b"a", False)], VOCABULARY)
    with pytest.raises(Exception, match=what):
        decoded(spark.createDataFrame([(1, tokens)], "k int, t array<bigint>"), vocabulary, ["k"], "t").collect()


def test_keys_name_a_row(spark):
    vocabulary = spark.createDataFrame([(1, b"a", False)], VOCABULARY)
    with pytest.raises(Exception, match="two rows have the same keys"):
        decoded(spark.createDataFrame([(1, [1, 1]), (1, [1])], "k int, t array<bigint>"), vocabulary, ["k"], "t").collect()
    assert decoded(spark.createDataFrame([], "k int, t array<bigint>"), vocabulary, ["k"], "t").collect() == []


def test_a_large_vocabulary_is_not_broadcast(spark, rows, monkeypatch):
    vocabulary = byte_vocabulary(spark, PATH)
    few = decoded(rows, vocabulary, ["k", "part"])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(detokenise, "_MOST_BROADCAST", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = decoded(rows, vocabulary, ["k", "part"])
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and plan.count("hashpartitioning(__k") == 1
        assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stages(spark):
    t = tokenizer()
    good = {"text": "ok then", "token_ids": t.encode("ok then").ids}
    stages = [{"example_id": "a", "greedy": good, "samples": {"0": {"generation": good}, "1": {"generation": {**good, "text": "other"}}}}, {"example_id": "b", "greedy": {**good, "text": "x"}, "samples": None}, {"example_id": "c", "greedy": None, "samples": {}}]
    schema = "example_id string, greedy struct<text:string,token_ids:array<int>>, samples map<string,struct<generation:struct<text:string,token_ids:array<int>>>>"
    frame = spark.createDataFrame([(json.dumps(s),) for s in stages], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
    found = {r.example_id: r.violations for r in text_violations(frame, byte_vocabulary(spark, PATH)).collect()}
    assert found == {"a": ["text of 1"], "b": ["text of greedy"]}
