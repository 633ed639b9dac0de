"""Exact values of mathematical answers: rational functions over square roots and symbols, and what is built of them.

A value is a numerator and a denominator; both are sums of terms, a rational times the root of a
square-free number times powers of symbols. Sums of that form are equal as numbers only if they are
equal term by term, so two values are compared exactly, by cross-multiplication. Functions and roots of other
things are symbols named by their argument; if such a one is involved, values that differ may
still be equal, and the comparison is unknown. Tuples, intervals, sets, unions, matrices and words are compared part by part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, isqrt

LONGEST_POWER, MOST_TERMS, LARGEST_ROOT = 64, 400, 10**12


class Unsupported(ValueError):
    """Text that is no expression of the kinds above."""


Term = tuple[int, tuple[tuple[str, int], ...]]  # square-free radicand, powers of symbols
Sum = dict[Term, Fraction]
ONE: Term = (1, ())


@dataclass(frozen=True)
class Value:
    top: tuple[tuple[Term, Fraction], ...]
    bottom: tuple[tuple[Term, Fraction], ...]
    opaque: bool = False  # a function or a root of something else is in it
    unit: str = ""

    def number(self) -> Fraction | None:
        if not self.top:
            return Fraction(0)
        if len(self.top) == len(self.bottom) == 1 and self.top[0][0] == self.bottom[0][0] == ONE:
            return self.top[0][1] / self.bottom[0][1]
        return None

    def key(self) -> str:
        side = lambda s: "+".join(f"{c}*{r}*{p}" for (r, p), c in s)
        return f"{side(self.top)}/{side(self.bottom)}{self.unit}"


@dataclass(frozen=True)
class Parts:
    """tuple, interval (with its brackets), set, union, matrix row or word."""

    kind: str
    items: tuple


def _frozen(s: Sum) -> tuple[tuple[Term, Fraction], ...]:
    return tuple(sorted((t, c) for t, c in s.items() if c))


def _add(a: Sum, b: Sum, sign: int = 1) -> Sum:
    out = dict(a)
    for t, c in b.items():
        out[t] = out.get(t, Fraction(0)) + sign * c
    return {t: c for t, c in out.items() if c}


def _times(a: Sum, b: Sum) -> Sum:
    if len(a) * len(b) > MOST_TERMS:
        raise Unsupported("too many terms")
    out: Sum = {}
    for (ra, pa), ca in a.items():
        for (rb, pb), cb in b.items():
            g = gcd(ra, rb)
            powers = dict(pa)
            for s, e in pb:
                powers[s] = powers.get(s, 0) + e
            c = ca * cb * g
            if "i" in powers:  # its square is -1
                c, powers["i"] = c * (-1 if powers["i"] % 4 > 1 else 1), powers["i"] % 2
            t = (ra // g * (rb // g), tuple(sorted((s, e) for s, e in powers.items() if e)))
            out[t] = out.get(t, Fraction(0)) + c
    return {t: c for t, c in out.items() if c}


def _value(top: Sum, bottom: Sum, opaque: bool = False) -> Value:
    if not bottom:
        raise Unsupported("division by zero")
    if len(bottom) == 1:  # by one term: its root goes up, its symbols too
        (r, powers), c = next(iter(bottom.items()))
        top = _times(top, {(r, tuple((s, -e) for s, e in powers)): 1 / (c * r)})
        bottom = {ONE: Fraction(1)}
    else:
        lead = _frozen(bottom)[0][1]
        top, bottom = {t: c / lead for t, c in top.items()}, {t: c / lead for t, c in bottom.items()}
    return Value(_frozen(top), _frozen(bottom), opaque)


def _number(x: Fraction) -> Value:
    return _value({ONE: x} if x else {}, {ONE: Fraction(1)})


def _symbol(name: str, opaque: bool = False) -> Value:
    return _value({(1, ((name, 1),)): Fraction(1)}, {ONE: Fraction(1)}, opaque)


def _join(op: str, a: Value, b: Value) -> Value:
    ta, ba, tb, bb = dict(a.top), dict(a.bottom), dict(b.top), dict(b.bottom)
    if op == "*":
        top, bottom = _times(ta, tb), _times(ba, bb)
    elif op == "/":
        top, bottom = _times(ta, bb), _times(ba, tb)
    else:
        top, bottom = _add(_times(ta, bb), _times(tb, ba), 1 if op == "+" else -1), _times(ba, bb)
    return _value(top, bottom, a.opaque or b.opaque)


def _power(a: Value, b: Value) -> Value:
    e = b.number()
    if e is None:
        return _symbol(f"({a.key()})^({b.key()})", True)
    if e.denominator == 1 and abs(e) <= LONGEST_POWER:
        out = _number(Fraction(1))
        for _ in range(abs(int(e))):
            out = _join("*", out, a)
        return out if e >= 0 else _join("/", _number(Fraction(1)), out)
    if e.denominator > 1 and abs(e.numerator) <= LONGEST_POWER:
        return _power(_root(a, e.denominator), _number(Fraction(e.numerator)))
    return _symbol(f"({a.key()})^{e}", True)


def _root(a: Value, n: int) -> Value:
    x = a.number()
    if x is None or n < 2 or n > LONGEST_POWER or max(abs(x.numerator), x.denominator) > LARGEST_ROOT or x < 0 and n % 2 == 0 and n != 2:
        return _symbol(f"root{n}({a.key()})", True)
    sign = _symbol("i") if x < 0 and n == 2 else _number(Fraction(-1 if x < 0 else 1))
    whole = abs(x.numerator) * x.denominator ** (n - 1)  # the root of p / q is that of p * q**(n - 1), over q
    if whole > LARGEST_ROOT:
        return _symbol(f"root{n}({a.key()})", True)
    outside, inside, p = 1, whole, 2
    while p**n <= inside and p <= 10**4:
        while inside % p**n == 0:
            inside //= p**n
            outside *= p
        p += 1
    if n == 2:
        if (s := isqrt(inside)) ** 2 == inside:
            outside, inside = outside * s, 1
        return _join("*", sign, _value({(inside, ()): Fraction(outside, x.denominator)} if whole else {}, {ONE: Fraction(1)}))
    if inside > 1:
        return _join("*", sign, _join("*", _number(Fraction(outside, x.denominator)), _symbol(f"root{n}({inside})", True)))
    return _join("*", sign, _number(Fraction(outside, x.denominator)))


# Names and spellings of TeX.
_TOKEN = re.compile(r"\s+|(\d+(?:\.\d*)?|\.\d+)|(\\[a-zA-Z]+|\\.)|(.)", re.S)
_DROPPED = frozenset(("\\left", "\\right", "\\,", "\\!", "\\;", "\\:", "\\ ", "\\quad", "\\qquad", "\\displaystyle", "\\$", "$", "\\limits", "\\big", "\\Big", "~"))
_GREEK = frozenset("alpha beta gamma delta epsilon theta lambda mu nu rho sigma tau phi varphi omega pi Delta Omega".split())
_FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan log ln exp".split())
_WORDY = frozenset(("\\text", "\\mathrm", "\\textbf", "\\mbox", "\\mathbf", "\\operatorname"))
_TIMES = frozenset(("*", "\\times", "\\cdot", "×", "·"))
_OPENING, _CLOSING = {"(": ")", "[": "]", "\\{": "\\}", "\\lbrace": "\\rbrace"}, frozenset((")", "]", "\\}", "\\rbrace"))
_ENDS = frozenset((",", "&", "\\\\", "}", "=", "|", "\\cup", "\\end")) | _CLOSING


class _Reader:
    def __init__(self, text: str):
        self.tokens = [m[0] for m in _TOKEN.finditer(text) if not m[0].isspace() and m[0] not in _DROPPED]
        self.at, self.unit = 0, ""

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted is not None and t != wanted:
            raise Unsupported(f"{wanted or 'more'} expected at {t!r}")
        self.at += 1
        return t

    def group(self) -> Value:
        """The braces after a command, or its next token."""
        if self.peek() != "{":
            t = self.take()
            return _number(Fraction(t[0])) if t[0].isdigit() and (self.back(t[1:]) or True) else self.atom_of(t)
        self.take("{")
        out = self.sum()
        self.take("}")
        return out

    def back(self, rest: str) -> None:
        if rest:
            self.tokens.insert(self.at, rest)

    def raw(self) -> str:
        """The text in braces."""
        self.take("{")
        depth, out = 1, []
        while depth:
            t = self.take()
            depth += (t == "{") - (t == "}")
            out.append(t)
        return "".join(out[:-1])

    def sum(self) -> Value:
        sign = 1
        while self.peek() in ("+", "-"):
            sign *= -1 if self.take() == "-" else 1
        out = self.product()
        if sign < 0:
            out = _join("*", _number(Fraction(-1)), out)
        while self.peek() in ("+", "-"):
            out = _join(self.take(), out, self.product())
        return out

    def product(self) -> Value:
        out = self.signed()
        while (t := self.peek()) and t not in _ENDS and t not in ("+", "-"):
            if t in _TIMES:
                self.take()
                out = _join("*", out, self.signed())
            elif t in ("/", "\\div"):
                self.take()
                out = _join("/", out, self.signed())
            elif t in ("\\%", "%") or t in _WORDY or t == "^" and self.peek(1) in ("\\circ", "{") and "\\circ" in (self.peek(1), self.peek(2)):
                self.units()
            else:
                out = _join("*", out, self.power())
        return out

    def units(self) -> None:
        t = self.take()
        if t == "^":
            if self.peek() == "{":
                self.raw()
            else:
                self.take()
            return  # degrees
        word = "%" if "%" in t else self.raw().strip(" .").lower()
        if self.unit and word:
            raise Unsupported("two units")
        self.unit = word
        if self.peek() == "^":  # of a unit, such as square metres
            self.take()
            self.unit += "^" + (self.raw() if self.peek() == "{" else self.take())

    def signed(self) -> Value:
        if self.peek() in ("+", "-"):
            return _join("*", _number(Fraction(-1 if self.take() == "-" else 1)), self.signed())
        return self.power()

    def power(self) -> Value:
        out = self.atom_of(self.take())
        while self.peek() == "^" and not (self.peek(1) == "\\circ" or self.peek(1) == "{" and self.peek(2) == "\\circ"):
            self.take()
            out = _power(out, self.group())
        return out

    def atom_of(self, t: str) -> Value:
        if t[0].isdigit() or t[0] == ".":
            x = Fraction(t if t[-1] != "." else t[:-1])
            if self.peek() in ("\\frac", "\\dfrac", "\\tfrac") and "." not in t:  # a mixed number, if the fraction is one of numbers
                at, unit = self.at, self.unit
                part = self.atom_of(self.take()).number()
                if part is not None and 0 <= part < 1:
                    return _number(x + part)
                self.at, self.unit = at, unit
            return _number(x)
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            return _join("/", self.group(), self.group())
        if t == "\\sqrt":
            n = 2
            if self.peek() == "[":
                self.take()
                n = int(self.take())
                self.take("]")
            return _root(self.group(), n)
        if t in ("(", "["):
            out = self.sum()
            self.take(_OPENING[t])
            return out
        if t == "{":
            out = self.sum()
            self.take("}")
            return out
        if t == "|":
            out = self.sum()
            self.take("|")
            x = out.number()
            return _number(abs(x)) if x is not None else _symbol(f"abs({out.key()})", True)
        if t == "π" or t[0] == "\\" and t[1:] in _GREEK:
            return _symbol("pi" if t == "π" else t[1:])
        if t == "\\infty" or t == "∞":
            return _symbol("infinity", True)
        if t[0] == "\\" and t[1:] in _FUNCTIONS:
            name = t[1:]
            while self.peek() in ("^", "_"):
                name += self.take() + self.group().key()
            return _symbol(f"{name}({self.power().key()})", True)
        if len(t) == 1 and t.isalpha():
            name = t
            if self.peek() == "_":
                self.take()
                name += "_" + (self.raw() if self.peek() == "{" else self.take())
            return _symbol(name)
        raise Unsupported(f"no value at {t!r}")

    def items(self) -> list:
        out = [self.whole()]
        while self.peek() == ",":
            self.take()
            out.append(self.whole())
        return out

    def whole(self):
        """A value, or brackets with several."""
        t = self.peek()
        if t == "\\begin":
            self.take()
            if "matrix" not in (kind := self.raw()):
                raise Unsupported(kind)
            rows = [[self.sum()]]
            while (sep := self.take()) != "\\end":
                if sep == "&":
                    rows[-1].append(self.sum())
                elif sep == "\\\\":
                    rows.append([self.sum()])
                else:
                    raise Unsupported(sep)
            self.raw()
            return Parts("matrix", tuple(Parts("row", tuple(r)) for r in rows))
        if t in _WORDY:
            self.take()
            return Parts("word", (" ".join(self.raw().lower().split()).strip(" ."),))
        if t in _OPENING:
            at, unit = self.at, self.unit
            self.take()
            if t in ("\\{", "\\lbrace"):
                inner = [] if self.peek() in _CLOSING else self.items()
                self.take()
                return Parts("set", tuple(inner))
            try:
                inner = self.items()
                end = self.take()
            except Unsupported:
                inner, end = [], ""
            if len(inner) > 1 and end in _CLOSING:
                return Parts("tuple" if (t, end) == ("(", ")") else f"interval{t}{end}", tuple(inner))
            self.at, self.unit = at, unit
        return self.sum()

    def answer(self):
        out = self.items()
        while self.peek() == "=":  # x = 5: the value is what comes last
            if len(out) > 1:
                raise Unsupported("an equation in a list")
            self.take()
            out = self.items()
        if self.peek() == "\\cup":
            while self.peek() == "\\cup":
                self.take()
                out.append(self.whole())
            out = [Parts("union", tuple(out))]
        if self.peek():
            raise Unsupported(f"more at {self.peek()!r}")
        found = out[0] if len(out) == 1 else Parts("set", tuple(out))
        return Value(found.top, found.bottom, found.opaque, self.unit) if self.unit and isinstance(found, Value) else found


def read(text: str):
    """The value of an answer; Unsupported if it is none of those this module knows."""
    if re.search(r"\d[eE][+-]?\d", text):
        raise Unsupported("a power of ten, or a product with e")
    try:
        return _Reader(text).answer()
    except (RecursionError, ValueError, ZeroDivisionError, IndexError) as e:
        raise Unsupported(str(e)) from e


def key(x) -> str:
    """Equal for equal values, but for unreduced fractions of sums."""
    if isinstance(x, Value):
        return x.key()
    inner = [y if isinstance(y, str) else key(y) for y in x.items]
    return f"{x.kind}({';'.join(sorted(inner) if x.kind in ('set', 'union') else inner)})"


def same(a, b) -> bool | None:
    """Are two values equal? None if that can't be decided."""
    if isinstance(a, Value) and isinstance(b, Value):
        if a.unit and b.unit and a.unit != b.unit or "%" in (a.unit, b.unit) and a.unit != b.unit:
            return None
        equal = _frozen(_times(dict(a.top), dict(b.bottom))) == _frozen(_times(dict(b.top), dict(a.bottom)))
        return equal or (None if a.opaque or b.opaque else False)
    if isinstance(a, Value) or isinstance(b, Value):
        return None if "word" in (getattr(a, "kind", ""), getattr(b, "kind", "")) else False
    if a.kind == b.kind == "word":
        return a.items == b.items
    if a.kind in ("set", "union") and b.kind == a.kind:
        return _matched(list(a.items), list(b.items))
    if a.kind != b.kind or len(a.items) != len(b.items):
        return None if "word" in (a.kind, b.kind) or {a.kind, b.kind} == {"tuple", "set"} else False
    verdicts = [same(x, y) for x, y in zip(a.items, b.items, strict=True)]
    return False if False in verdicts else None if None in verdicts else True


def _matched(a: list, b: list) -> bool | None:
    """Is every member of either among those of the other?"""
    unsure = False
    for xs, ys in ((a, b), (b, a)):
        for x in xs:
            verdicts = [same(x, y) for y in ys]
            if True not in verdicts:
                if None not in verdicts:
                    return False
                unsure = True
    return None if unsure else True
