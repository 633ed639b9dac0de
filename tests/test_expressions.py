"""Exact equivalence of answers, and the isolated worker for the rest."""

import time

import pytest

from surelake.functions import grading, verifier
from surelake.functions.grading import canonical, equivalent, grade


@pytest.mark.parametrize(
    "left,right,expected",
    [
        ("\\frac{1}{2}", "0.5", True), ("2\\sqrt{3}", "\\sqrt{12}", True), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}", True), ("\\sqrt{2}", "\\sqrt{3}", False), ("\\sqrt{2}+\\sqrt{3}", "\\sqrt{3}+\\sqrt2", True),
        ("1\\frac{1}{2}", "\\frac{3}{2}", True), ("3\\pi", "\\pi \\cdot 3", True), ("\\pi", "3.14", False), ("2^{10}", "1024", True), ("8^{1/3}", "2", True), ("x^2-1", "(x-1)(x+1)", True), ("\\frac{x^2-1}{x-1}", "x+1", True),
        ("x+1", "x+2", False), ("x = 5", "5", True), ("(1, 2)", "\\left(1,\\,2\\right)", True), ("(1,2)", "(2,1)", False), ("\\{1,2\\}", "\\{2,1\\}", True), ("1, 2", "2, 1", True), ("1,2", "1,3", False), ("[0,1)", "[0, 1)", True),
        ("[0,1)", "(0,1)", False), ("(-\\infty, 2)\\cup(3,\\infty)", "(3,\\infty)\\cup(-\\infty,2)", True), ("\\text{Monday}", "\\text{monday.}", True), ("\\text{yes}", "\\text{no}", False), ("5\\text{ cm}", "5", True),
        ("5\\text{ cm}", "5\\text{ m}", None), ("30^\\circ", "30", True), ("30^{\\circ}", "31", False), ("\\$12", "12", True), ("50\\%", "50\\%", True), ("50\\%", "0.5", None), ("\\sin(x)", "\\sin x", True), ("\\sin(x)", "\\cos(x)", None),
        ("\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&\\frac{8}{2}\\end{pmatrix}", True), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "\\begin{pmatrix}1\\\\3\\end{pmatrix}", False),
        ("-\\frac{3}{4}", "\\frac{-3}{4}", True), ("1,000", "1000", True), ("i^2", "-1", True), ("\\frac{1}{1+\\sqrt{2}}", "\\sqrt{2}-1", True), ("\\sqrt[3]{27}", "3", True), ("|{-3}|", "3", True), ("1.5\\times 10^3", "1500", True),
        ("\\frac12", "0.5", True), ("a_1+b", "b+a_{1}", True), ("\\pm 2", "2", None), ("x<5", "5", None), ("1e5", "100000", None), ("3e", "e+2e", True), ("\\frac{1}{", "1", False), (None, "1", False), ("", "", False), ("2^{100000}", "2", None), ("1/0", "1", None), ("(" * 900 + "1", "1", None),
    ],
)
def test_exact_values(left, right, expected):
    assert equivalent(left, right) is expected and equivalent(right, left) is expected


def test_keys_of_votes():
    assert canonical("0.50") == ("number", "1/2")
    key = lambda x: grading.expressions.key(grading.value_of(x))
    assert key("2\\sqrt{3}") == key("\\sqrt{12}") != key("\\sqrt{3}") and key("\\{2,1\\}") == key("\\{1,2\\}")


class Engine:
    """Stalls, fails or answers as the texts ask."""

    def parse(self, text):
        if "sleep" in text:
            time.sleep(60)
        if "crash" in text:
            raise ValueError("parser crash")
        if "exit" in text:
            import os

            os._exit(3)
        return None if "none" in text else text

    def verify(self, a, b):
        if "stall" in a + b:
            time.sleep(60)
        if "fail" in a + b:
            raise RuntimeError("verifier crash")
        return a.replace("alias", "x") == b.replace("alias", "x")


@pytest.fixture
def worker():
    w = verifier.Worker(Engine, 4.0)  # a new child imports modules for two seconds on a slow machine
    assert w.parseable("warm") is True or w.parseable("warm")  # the first start imports modules
    yield w
    w.close()


def test_statuses(worker):
    assert worker.grade("x<1", "alias<1") == (True, True, True, "graded")
    assert worker.grade("x<1", "y<1") == (False, True, True, "graded")
    assert worker.grade("crash", "1") == (None, None, None, "parser_error")
    assert worker.grade("1", "crash") == (None, True, None, "parser_error")
    assert worker.grade("1", " ") == (None, True, False, "missing_gold")
    assert worker.grade("1", "none") == (None, True, False, "unparseable_gold")
    assert worker.grade(None, "1") == (False, False, True, "missing_prediction_answer")
    assert worker.grade("none", "1") == (False, False, True, "unparseable_prediction")
    assert worker.grade("fail", "1") == (None, True, True, "verifier_error")
    assert worker.equivalent("fail", "1") is None and worker.equivalent("none", "1") is False and worker.equivalent("", "1") is False


def test_what_hangs_is_bounded_and_the_worker_replaced(worker):
    starts = worker.starts
    for pair, expected in ((("sleep", "1"), (None, None, None, "parse_timeout")), (("1", "sleep"), (None, True, None, "parse_timeout")), (("stall", "1"), (None, True, True, "verifier_timeout"))):
        begin = time.monotonic()
        worker.seconds = 0.5
        assert worker.grade(*pair) == expected and time.monotonic() - begin < 5 and not worker.alive
        worker.seconds = 20
        assert worker.parseable("again") is True
    assert worker.starts == starts + 3
    assert worker.grade("exit", "1") == (None, None, None, "grading_worker_error")
    assert worker.parseable("exit") is None and worker.equivalent("exit", "1") is None and worker.parseable("x") is True


def test_the_engine_is_asked_only_for_what_exact_values_leave_open(worker):
    worker.seconds = 20
    assert grade("x<1", "alias<1", worker) == (True, True, True, "graded")
    assert grade("2", "3", worker) == (False, True, True, "graded") and grade("x<1", "y<1") == (None, True, True, "unsupported_expression")
    assert equivalent("x<fail", "y<1", worker) is None and grading.is_equivalent("x<1", "y<1") is False and grading.is_parseable("x<1")


def test_unknown_parses_are_counted():
    found = grading.consistency("1", ["1", "x<1", None], "1", parses=lambda v: None if v == "x<1" else v is not None)
    assert found[:3] == (3, 1, 1)
