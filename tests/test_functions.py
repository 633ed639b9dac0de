import math

import pytest
from pyspark.sql import functions as F

from surelake.functions import answers, grading, verifier
from surelake.operators import confidence


@pytest.mark.parametrize(
    "text,value,method",
    [
        (r"Work gives \boxed{2}; therefore \boxed{\frac{1}{2}}.", r"\frac{1}{2}", "boxed"),
        ("Reasoning line.\nFinal answer: 42", "42", "answer_label"),
        (r"The result is \boxed{1+", None, None),
        (r"Final: \boxed{\{1,2\}}", r"\{1,2\}", "boxed"),
        (r"\boxed {3} and \boxed{ }", "3", "boxed"),
        (r"\boxed{1+ \boxed{2}", "2", "boxed"),
        (r"x \\boxed{5}", "5", "boxed"),
        (r"} { \boxed{a \{ b}", r"a \{ b", "boxed"),
        ("ANSWER = 7 \nanswer: \n", "7", "answer_label"),
        ("the answer: 7", None, None),
        ("answer: 1\rx", "1\rx", "answer_label"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_final_answer(text, value, method):
    found = answers.final_answer(text)
    assert (found and (found[0], found[3])) == (value and (value, method))
    if found:
        assert text[found[1] : found[2]] == value


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("😀 \\boxed{ é }",), (None,)], "t string")
    rows = df.select(answers.answer_span("t").alias("s")).collect()
    assert tuple(rows[0].s) == ("é", 10, 11, "boxed") and rows[1].s.value is None


def test_cut_and_keys():
    assert answers.cut_after_answer(r"a \boxed{1{2}} b \boxed{3}") == r"a \boxed{1{2}}"
    assert answers.cut_after_answer(r"a \boxed {1} b") == r"a \boxed {1} b"
    assert answers.cut_after_answer(r"a \boxed{1 b") == r"a \boxed{1 b"
    assert answers.seed_question_key("Straße  A　b") == answers.seed_question_key(" strasse a B ")
    assert answers.seed_question_key(None) is None
    assert answers.markdown_cell(None) == "—" and answers.markdown_cell(True) == "✓" and answers.markdown_cell("a|b\nc") == "a\\|b c"
    assert answers.markdown_cell("x" * 29) == "x" * 25 + "…"
    assert answers.canonical_digest({"b": None, "a": 1.0e-5}) == answers.canonical_digest({"a": 0.00001, "b": None})
    assert answers.console_safe("é", "ascii") == "\\xe9"


def test_rounding_and_ascii_key(spark):
    df = spark.createDataFrame([(0.0625, "A  b"), (2.6755, "a B"), (None, None)], "x double, t string")
    rows = df.select(answers.round_half_even("x").alias("r"), answers.ascii_seed_question_id(F.col("t")).alias("k"), answers.seed_question_id("t").alias("e")).collect()
    assert [r.r for r in rows] == [0.062, round(2.6755, 3), None] and all(r.k == r.e for r in rows)


GRADES = [
    ("12", "12", True, "graded"),
    (None, "12", False, "missing_prediction_answer"),
    ("12", r"\frac{1}{", None, "unparseable_gold"),
    ("12", None, None, "missing_gold"),
    ("12", " ", None, "missing_gold"),
    (r"\frac{1}{", "12", False, "unparseable_prediction"),
    (r"\frac{1}{2}", "0.5", True, "graded"),
    ("1", r"\frac{2}{2}", True, "graded"),
    ("1,200", "1200.0", True, "graded"),
    ("-1/4", r"-\frac{1}{4}", True, "graded"),
    ("3", "4", False, "graded"),
    ("x+1", "x+1", True, "graded"),
    ("9" * 3000, "1", False, "unparseable_prediction"),
]


@pytest.mark.parametrize("prediction,gold,correct,status", GRADES)
def test_grades(prediction, gold, correct, status):
    found = grading.grade(prediction, gold)
    assert (found[0], found[3]) == (correct, status)


def test_unknown_is_not_wrong():
    if verifier.worker() is None:
        assert grading.equivalent("x<1", "1>x") is None and grading.grade("x<1", "1>x")[3] == "unsupported_expression"
    assert grading.equivalent("x+1", "1+x") is True
    assert grading.equivalent(None, "1") is False and grading.equivalent("1", r"\frac{1}{") is False


def test_consistency():
    def run(greedy, samples, gold, same=grading.equivalent):
        names = [c.split()[0] for c in grading.CONSISTENCY.split(", ")]
        return dict(zip(names, grading.consistency(greedy, samples, gold, same), strict=True))

    r = run("1", ["1", "1.0", r"\frac{2}{2}", "2"], "1")
    assert (r["greedy_agreement_share"], r["majority_answer"], r["majority_vote_count"], r["majority_vote_share"], r["majority_correct"]) == (0.75, "1", 3, 0.75, True)
    r = run("1", ["2", "1"], "1")
    assert (r["majority_answer"], r["majority_vote_count"], r["majority_correct"]) == ("2", 1, False)
    r = run(None, [None, None, "2"], None)
    assert (r["greedy_agreement_count"], r["greedy_agreement_share"], r["majority_answer"], r["majority_vote_count"], r["majority_correct"]) == (0, 0.0, None, 2, None)
    assert run("12", ["12", r"\frac{1}{", None], "12")["sample_answer_parseable_count"] == 1
    r = run("12", ["12"] * 8, "12", lambda a, b: None)
    assert (r["greedy_agreement_count"], r["greedy_agreement_unknown_count"], r["greedy_agreement_share"], r["majority_answer"], r["majority_grading_status"]) == (0, 8, None, None, "majority_comparison_incomplete")
    assert r["majority_comparison_unknown_count"] == 28
    with pytest.raises(ValueError):
        run("1", [], "1")


def test_consistency_in_spark(spark):
    df = spark.createDataFrame([("1", ["1", None, "2"], "1"), (None, [None], None)], "g string, s array<string>, t string")
    rows = df.select(grading.summarize_consistency("g", "s", "t").alias("c")).collect()
    assert (rows[0].c.majority_answer, rows[0].c.sample_count, rows[1].c.majority_correct) == ("1", 3, None)


TOKENS = "e array<double>, p array<double>, s array<struct<start:int,end:int>>, m array<boolean>, a int, b int"


def token_row(spark, **changes):
    ln2 = math.log(2)
    row = {"e": [ln2, ln2, 100.0], "p": [math.log(0.5), math.log(0.25), -100.0], "s": [(0, 2), (2, 4), None], "m": [True, True, False], "a": 1, "b": 3} | changes
    df = spark.createDataFrame([tuple(row.values())], TOKENS)
    return df.select(confidence.token_confidence(*(F.col(c) for c in "epsmab"), 2).alias("c")).select("c.*").first()


def test_token_confidence(spark):
    r = token_row(spark)
    assert (r.content_token_count, r.answer_token_count, r.answer_alignment_status) == (2, 2, "aligned")
    assert r.mean_entropy_nats == pytest.approx(math.log(2)) and r.entropy_confidence == pytest.approx(0)
    assert r.sequence_logprob_sum == pytest.approx(math.log(0.125)) and r.sequence_geometric_probability == pytest.approx(0.125**0.5)
    assert r.answer_token_geometric_probability == pytest.approx(0.125**0.5)
    r = token_row(spark, s=None)
    assert (r.answer_token_geometric_probability, r.answer_alignment_status) == (None, "token_alignment_unavailable")
    assert token_row(spark, a=None, b=None).answer_alignment_status == "no_answer_span"
    assert token_row(spark, a=9, b=10).answer_alignment_status == "no_answer_tokens"
    r = token_row(spark, m=[False] * 3)
    assert (r.content_token_count, r.mean_entropy_nats, r.entropy_confidence, r.sequence_logprob_sum) == (0, None, None, None)
    for bad in ({"p": [0.0]}, {"e": [-1.0, 0.0, 0.0]}, {"p": [1.0, 0.0, 0.0]}, {"e": [float("nan"), 0.0, 0.0]}):
        with pytest.raises(Exception, match="token"):
            token_row(spark, **bad)


def test_termination_alignment_logits(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([],), ([5, 6, 7],)], "t array<int>")
    assert [tuple(r.x) for r in df.select(confidence.termination(F.col("t"), [2], 3).alias("x")).collect()] == [(True, False, "eos"), (False, True, "max_new_tokens"), (False, False, "other_stop"), (False, True, "max_new_tokens")]
    df = spark.createDataFrame([([9, 1, 2], [1, 2], [(0, 1), (1, 3)], 3), ([9, 1, 2], [1, 3], [(0, 1), (1, 3)], 3), ([1], [1], [(0, 9)], 3), ([1], None, None, 3)], "t array<int>, e array<int>, o array<struct<start:int,end:int>>, n int")
    rows = [r.x for r in df.select(confidence.alignment(F.col("t"), [9], F.col("e"), F.col("o"), F.col("n")).alias("x")).collect()]
    assert [r.status for r in rows] == ["aligned", "token_roundtrip_mismatch", "invalid_offsets", "offsets_unavailable"]
    assert [s and tuple(s) for s in rows[0].spans] == [None, (0, 1), (1, 3)]
    r = spark.createDataFrame([([0.0, 0.0], 1)], "l array<double>, c int").select(confidence.logit_scores(F.col("l"), F.col("c")).alias("x")).first().x
    assert r.entropy == pytest.approx(math.log(2)) and r.logprob == pytest.approx(-math.log(2))


def test_alignment_of_many_tokens(spark):
    """Offsets go to visible tokens in order, in time about linear in the tokens."""
    n = 20000
    tokens = [9 if i % 7 == 0 else i % 5 for i in range(n)]
    visible = [t for t in tokens if t != 9]
    offsets = [(i, i + 1) for i in range(len(visible))]
    df = spark.createDataFrame([(tokens, visible, offsets, n)], "t array<int>, e array<int>, o array<struct<start:int,end:int>>, n int")
    x = df.select(confidence.alignment(F.col("t"), [9], F.col("e"), F.col("o"), F.col("n")).alias("x")).first().x
    assert x.status == "aligned" and len(x.spans) == n
    given = iter(offsets)
    assert all(s is None if t == 9 else tuple(s) == next(given) for t, s in zip(tokens, x.spans, strict=True))


def test_casefold_equals_pythons_for_every_code_point(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[p : p + 500]) for p in range(0, len(every), 500)] + ["ΣΊΣΥΦΟΣ ὈΔΥΣΣΕΎΣ", "İstanbul Straße ﬃ ŉ", "plain ASCII", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", answers.casefold(F.col("t")).alias("f"), answers.seed_question_id("t").alias("k")).collect()
    assert {r.i: r.f for r in rows} == {i: t.casefold() for i, t in enumerate(texts)}
    assert {r.i: r.k for r in rows} == {i: answers.seed_question_key(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(answers.seed_question_id("t").alias("k")).first().k is None


def test_seed_keys_stay_in_the_jvm(spark):
    plan = spark.range(1).select(answers.seed_question_id(F.col("id").cast("string")).alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


class Parser:
    """An engine whose parser fails on what the exact values can't read."""

    def grade(self, prediction, gold):
        return None, None, None, "parser_error"

    def parseable(self, value):
        return None


def test_a_parser_that_fails_on_the_prediction_comes_before_a_missing_gold():
    for gold in (None, " ", "{", "7"):
        assert grading.grade("x < 5", gold, Parser()) == (None, None, None, "parser_error")
    assert grading.grade("7", None, Parser()) == (None, True, False, "missing_gold")
    assert grading.grade("{", None, Parser())[3] == "missing_gold" and grading.grade("{", "{", Parser())[3] == "unparseable_gold"
    assert grading.grade("x < 5", None) == (None, True, False, "missing_gold")


def test_logit_scores_of_a_large_vocabulary(spark):
    import time

    began = time.time()
    rows = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: ((i * (F.col("id") + 3)) % 17).cast("double")).alias("l"))
    found = [r.x for r in rows.select(confidence.logit_scores(F.col("l"), F.lit(3)).alias("x")).collect()]
    for k, r in enumerate(found):
        v = [float(i * (k + 3) % 17) for i in range(2000)]
        mass = math.log(sum(math.exp(x) for x in v))
        assert r.entropy == pytest.approx(-sum(math.exp(x - mass) * (x - mass) for x in v)) and r.logprob == pytest.approx(v[3] - mass)
    assert time.time() - began < 60


def test_equal_arguments_are_worked_on_once_a_batch(spark):
    import pyarrow as pa

    from surelake.functions import types

    seen = []

    def work(a, b):
        seen.append((a, b))
        return a, None if b is None else len(b)

    texts = pa.array(["x", None, "", "x", "y", None])[1:]
    lists = pa.array([["q"], None, [], ["p", None], ["pN"], None])[1:]
    want = [(None, None), ("", 0), ("x", 2), ("y", 1), (None, None)]
    found = types.by_distinct("a string, n int", work, pa.concat_arrays([texts, texts]), pa.concat_arrays([lists, lists]))
    assert [(r["a"], r["n"]) for r in found.to_pylist()] == want * 2 and len(seen) == 4
    assert types.by_distinct("a string, n int", work, texts, lists).to_pylist() == found.to_pylist()[:5]
    assert len(types.by_distinct("a string, n int", work, texts[:0], lists[:0])) == 0
    rows = spark.createDataFrame([(["\\boxed{1}", None, "x"],), (None,), ([],), (["answer: 2"],)], "t array<string>").coalesce(1)
    assert [None if r.s is None else [(a.value, a.start, a.method) for a in r.s] for r in rows.select(answers.answer_spans("t").alias("s")).collect()] == [[("1", 7, "boxed"), (None, None, None), (None, None, None)], None, [], [("2", 8, "answer_label")]]
