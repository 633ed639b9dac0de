"""Grading of answers by exact values.

Numbers have the reduced fraction as key; other expressions are read as exact values
(``expressions``), which are compared exactly. What can't be read so is only known to equal itself; comparing it with
anything else is left to the optional engine (``verifier``), in an isolated process with a deadline, and is unknown (null)
without it, never wrong.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from surelake.functions import expressions, types, verifier

LONGEST = 2048
GRADE = "correct boolean, prediction_parseable boolean, gold_parseable boolean, status string"
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
_PLAIN = re.compile(rf"({_NUMBER})(?:\s*/\s*({_NUMBER}))?")
_FRACTION = re.compile(rf"([+-]?)\\[dt]?frac\s*\{{\s*({_NUMBER})\s*\}}\s*\{{\s*({_NUMBER})\s*\}}")

def _balanced(text: str) -> bool:
    depth, p = 0, 0
    while p < len(text):
        c = text[p]
        p += 2 if c == "\\" else 1
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return False
    return depth == 0


@lru_cache(8192)
def canonical(value: str | None) -> tuple[str, str] | None:
    """(kind, key) of an answer, kind ``number`` or ``other``; None if it can't be parsed."""
    text = (value or "").strip()
    if not text or len(text) > LONGEST or not _balanced(text):
        return None
    core = text.strip("$ ").replace(",\\!", "").replace("{,}", "")
    if re.fullmatch(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", core):
        core = core.replace(",", "")
    try:
        if m := _PLAIN.fullmatch(core):
            number = Fraction(m[1]) / Fraction(m[2] or "1")
        elif m := _FRACTION.fullmatch(core):
            number = Fraction(m[2]) / Fraction(m[3]) * (-1 if m[1] == "-" else 1)
        else:
            return "other", text
    except ZeroDivisionError:
        return "other", text
    return "number", f"{number.numerator}/{number.denominator}"


@lru_cache(8192)
def value_of(text: str):
    """The exact value of an answer, or None."""
    try:
        return expressions.read(text.strip())
    except expressions.Unsupported:
        return None


def exactly(left: str, right: str) -> bool | None:
    """Are two parseable answers equal? None if exact values don't tell."""
    a, b = canonical(left), canonical(right)
    if a == b:
        return True
    if a[0] == b[0] == "number":
        return False
    x, y = value_of(left), value_of(right)
    try:
        return None if x is None or y is None else expressions.same(x, y)
    except expressions.Unsupported:
        return None


def equivalent(left: str | None, right: str | None, engine: verifier.Worker | None = None) -> bool | None:
    """True, False (also if either is missing or can't be parsed), or None: unknown."""
    if canonical(left) is None or canonical(right) is None:
        return False
    verdict = exactly(left, right)
    engine = engine or verifier.worker()
    return engine.equivalent(left, right) if verdict is None and engine else verdict


def is_equivalent(left: str | None, right: str | None) -> bool:
    """For callers that have no word for unknown."""
    return equivalent(left, right) is True


def parseable(value: str | None, engine: verifier.Worker | None = None) -> bool | None:
    """Can it be parsed? None if the engine that was asked gave no answer."""
    if canonical(value) is None:
        return False
    engine = engine or verifier.worker()
    return True if engine is None or canonical(value)[0] == "number" or value_of(value) is not None else engine.parseable(value)


def is_parseable(value: str | None) -> bool:
    return parseable(value) is True


def grade(prediction: str | None, gold: str | None, engine: verifier.Worker | None = None) -> tuple[bool | None, bool | None, bool | None, str]:
    """(correct, prediction_parseable, gold_parseable, status) of an extracted answer.

    What exact values tell is graded; the rest is the engine's, whose parser goes first, so that a prediction on which it fails is ``parser_error`` whatever the
    gold answer is. Without it a comparison that exact values don't decide is ``unsupported_expression``, a status of its own.
    """
    p, g = canonical(prediction) is not None, canonical(gold) is not None
    engine = engine or verifier.worker()
    if engine and p and not g and canonical(prediction)[0] == "other" and value_of(prediction) is None:
        return engine.grade(prediction, gold)  # its parser sees the prediction first, and may fail
    if gold is None or not gold.strip():
        return None, p, False, "missing_gold"
    if not g:
        return None, p, False, "unparseable_gold"
    if prediction is None:
        return False, False, True, "missing_prediction_answer"
    if not p:
        return False, False, True, "unparseable_prediction"
    correct = exactly(prediction, gold)
    if correct is None and engine:
        return engine.grade(prediction, gold)
    return correct, True, True, "graded" if correct is not None else "unsupported_expression"


@F.arrow_udf(types.struct(GRADE))
def grade_answer(predictions: pa.Array, golds: pa.Array) -> pa.Array:
    return types.by_distinct(GRADE, grade, predictions, golds)


@F.pandas_udf(types.BOOLEAN)
def answers_equivalent(lefts: pd.Series, rights: pd.Series) -> pd.Series:
    return pd.Series([equivalent(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(lefts, rights, strict=True)], dtype="boolean")


@F.pandas_udf(types.BOOLEAN)
def answer_parseable(values: pd.Series) -> pd.Series:
    return pd.Series([parseable(None if pd.isna(v) else v) for v in values], dtype="boolean")


@F.pandas_udf(types.STRING)
def answer_key(values: pd.Series) -> pd.Series:
    """A key for votes: equal for equal numbers and exact values, the text itself for what has none; null if missing."""
    return values.map(lambda v: None if v is None or canonical(v) is None else canonical(v)[1] if canonical(v)[0] == "number" or value_of(v) is None else expressions.key(value_of(v)))


CONSISTENCY = (
    "sample_count int, sample_answer_parseable_count int, sample_answer_parse_unknown_count int, greedy_agreement_count int, greedy_agreement_unknown_count int, greedy_agreement_share double, "
    "majority_answer string, majority_vote_count int, majority_vote_share double, majority_correct boolean, majority_grading_status string, majority_comparison_unknown_count int"
)


def consistency(greedy: str | None, samples: list[str | None], gold: str | None, same=equivalent, parses=parseable) -> tuple:
    """Greedy agreement and the majority of the samples, taken in order.

    A sample joins the first cluster whose first member it equals; missing answers are one cluster; of equally large
    clusters the earliest wins. If any comparison is unknown, so is the majority.
    """
    if not samples:
        raise ValueError("at least one sample answer is required")
    matches = [False if a is None or greedy is None else same(greedy, a) for a in samples]
    heads: list[str | None] = []
    votes: list[int] = []
    unknown = 0
    for a in samples:
        for k, head in enumerate(heads):
            verdict = head is None if a is None else None if head is None else same(head, a)
            if verdict:
                votes[k] += 1
                break
            unknown += verdict is None and head is not None and a is not None
        else:
            heads.append(a)
            votes.append(1)
    n, agreed, unsure = len(samples), sum(m is True for m in matches), sum(m is None for m in matches)
    most = max(votes)
    winner = heads[votes.index(most)]
    verdicts = [parses(a) for a in samples]
    known, dark = sum(v is True for v in verdicts), sum(v is None for v in verdicts)
    share = None if unsure else agreed / n
    if unknown:
        return n, known, dark, agreed, unsure, share, None, None, None, None, "majority_comparison_incomplete", unknown
    correct, _, _, status = grade(winner, gold)
    return n, known, dark, agreed, unsure, share, winner, most, most / n, correct, status, 0


@F.arrow_udf(types.struct(CONSISTENCY))
def summarize_consistency(greedy: pa.Array, samples: pa.Array, gold: pa.Array) -> pa.Array:
    return types.by_distinct(CONSISTENCY, consistency, greedy, samples, gold)
