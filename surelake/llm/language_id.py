"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte 3- and 4-grams, after ASCII letters are lower-cased
and all other ASCII becomes a blank; each is hashed to one of 2**16 embeddings.
Their average, over the whole text, goes through a linear softmax. Both layers
are trained by stochastic gradient descent in numpy on a bounded sample; then the
product of both layers is one table, so that scoring a text is a sum of look-ups.
A temperature fitted on rows that training did not see calibrates the
probabilities. A softmax is as sure of a language it never saw as of its own, so
rejection rests on two limits, both calibrated on those rows: a probability that
only a small share of them falls below, and a share of subwords that training never
met which none of them comes near. The latter is shrunk for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm import samples
from surelake.llm import textblocks as tb

BUCKETS = 1 << 16
KNOWN_BITS = 21
_SHRINK = 40.0  # 4-grams that a text is taken to have beside its own, all known
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # float64 [labels, BUCKETS]
    bias: np.ndarray
    temperature: float
    threshold: float
    known: np.ndarray  # bool [1 << KNOWN_BITS]: 4-grams that the training rows have
    most_unknown: float  # limit of the shrunk share of 4-grams that are not known


def _fours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4-grams of folded bytes whose second byte is no blank, and where they are."""
    at = np.flatnonzero(x[1:-2] != 32)
    wide = x.astype(np.uint32)
    four = (wide[at] << 24) | (wide[at + 1] << 16) | (wide[at + 2] << 8) | wide[at + 3]
    return (((four ^ (four >> 13)) * np.uint32(0xC2B2AE35)) >> (32 - KNOWN_BITS)).astype(np.int64), at


def unknown_share(known: np.ndarray, data: np.ndarray, bounds: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Per text, the shrunk share of 4-grams that are not known."""
    unknown, every = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for a in range(0, max(len(data) - 3, 0), piece):
        x = _FOLD[data[a : a + piece + 3]]
        if len(x) < 4:
            continue
        four, at = _fours(x)
        first = np.searchsorted(at, bounds - a)
        every += np.diff(first)
        unknown += np.diff(np.append(0, np.cumsum(~known[four]))[first])
    return unknown / (every + _SHRINK)


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of texts that begin and end with a blank, and where each text's begin. Their second byte is no blank."""
    x = _FOLD[data]
    n = len(x)
    if n < 4:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    at = np.flatnonzero(x[1:-2] != 32)
    wide = x.astype(np.uint32)
    three = (wide[at] << 16) | (wide[at + 1] << 8) | wide[at + 2]
    four = (three << 8) | wide[at + 3]
    out = np.empty(2 * len(at), np.uint16)
    out[::2] = ((three * np.uint32(0x9E3779B1)) >> 16).astype(np.uint16)
    out[1::2] = (((four ^ (four >> 15)) * np.uint32(0x85EBCA77)) >> 16).astype(np.uint16)
    return out, 2 * np.searchsorted(at, bounds)


def logits(model: Model, data: np.ndarray, bounds: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Per text and label, the bias plus the average of the table's entries."""
    docs = len(bounds) - 1
    sums, counts = np.zeros((len(model.labels), docs)), np.zeros(docs)
    p = 0
    while p < docs:  # texts of about a piece in bytes, longer ones cut with an overlap of the widest subword
        q = max(p + 1, int(np.searchsorted(bounds, bounds[p] + piece, "right")) - 1)
        lo, hi = int(bounds[p]), int(bounds[q])
        cuts = [lo, *range(lo + piece, hi - 3, piece), hi] if q == p + 1 else [lo, hi]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = data[a : min(b + 3, hi)] if b < hi else data[a:b]
            own = np.array([0, len(part)]) if q == p + 1 else bounds[p : q + 1] - lo
            f, first = subwords(part, own)
            if not len(f):
                continue
            n = np.diff(first)
            counts[p:q] += n
            some = n > 0
            for k in range(len(model.labels)):
                sums[k, p:q][some] += np.add.reduceat(model.table[k][f], first[:-1][some])
        p = q
    return (sums / np.maximum(counts, 1)).T + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], dim: int = 16, epochs: int = 8, batch: int = 32, rate: float = 1.0, seed: int = 5, reject: float = 0.001, slack: float = 2.0) -> Model:
    """SGD over both layers; every eighth row only calibrates. No rows: a model that names nothing; fewer than 16: no calibration apart."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0, 1.0, np.zeros(1 << KNOWN_BITS, bool), 1.0)
    rng = np.random.default_rng(seed)
    index = {y: k for k, y in enumerate(labels)}
    features, ys, texts = [], [], []
    for text, y in rows:
        data = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)
        f, n = np.unique(subwords(data, np.array([0, len(data)]))[0], return_counts=True)
        if len(f):
            features.append((f.astype(np.int64), (n / n.sum()).astype(np.float32)))
            ys.append(index[y])
            texts.append(data)
    y = np.array(ys, np.int64)
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    fit = np.array([i for i in range(len(y)) if i % 8 or len(y) < 16], np.int64)
    check = np.array([i for i in range(len(y)) if i % 8 == 0], np.int64)
    steps, done = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for p in range(0, len(order), batch):
            ids = order[p : p + batch]
            step = rate * (1 - done / steps)
            done += 1
            f = np.concatenate([features[i][0] for i in ids])
            w = np.concatenate([features[i][1] for i in ids])
            n = np.array([len(features[i][0]) for i in ids])
            mean = np.add.reduceat(embed[f] * w[:, None], np.append(0, np.cumsum(n)[:-1]))
            error = softmax(mean @ out + bias)
            error[np.arange(len(ids)), y[ids]] -= 1
            back = np.repeat(error @ out.T, n, axis=0) * w[:, None]
            out -= step * (mean.T @ error) / len(ids) * 4
            bias -= step * error.mean(axis=0) * 0.1
            for d in range(dim):  # a frequent subword gets its whole gradient at once
                embed[:, d] -= step * np.bincount(f, back[:, d], BUCKETS).astype(np.float32)
    known = np.zeros(1 << KNOWN_BITS, bool)
    for i in fit:
        known[_fours(_FOLD[texts[i]])[0]] = True
    model = Model(labels, np.ascontiguousarray((embed @ out).T.astype(np.float64)), bias.astype(np.float64), 1.0, 0.0, known, 1.0)
    if len(check):
        z = np.stack([(model.table[:, features[i][0]] * features[i][1]).sum(axis=1) for i in check]) + model.bias
        grid = np.geomspace(0.0005, 20, 120)
        # Platt's targets: as if one row more of each outcome had been met, or rows all named right would call for certainty.
        aim = np.full(z.shape, 1 / (len(check) + 2) / max(len(labels) - 1, 1))
        aim[np.arange(len(check)), y[check]] = (len(check) + 1) / (len(check) + 2)
        loss = [-(aim * np.log(np.maximum(softmax(z / t), 1e-300))).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(0.5, np.quantile(sure, reject)))
        strange = np.array([unknown_share(known, texts[i], np.array([0, len(texts[i])]))[0] for i in check])
        model.most_unknown = float(min(1.0, slack * np.quantile(strange, 1 - reject) + 0.05))
    for i in check:  # limits are set; what is met later may be known from these too
        known[_fours(_FOLD[texts[i]])[0]] = True
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 5, held: int = 0, max_rows: int = 1600) -> Model:
    """Learns from about ``max_rows`` labelled rows at most, evenly over the languages, whose crc32 remainder is not ``held``.

    Rows with more than 256 kB of text are not among them (``samples.balanced``), and neither are languages beyond the
    ``max_rows`` most frequent ones.
    """
    return train(samples.balanced(docs.where(samples.learns(key, modulus, held)), key, text, lang, max_rows, salt="lang")[0])


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before and after each."""
    docs = len(bounds) - 1
    out = np.full(len(data) + 2 * docs, 32, np.uint8)
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[a + 2 * d + 1 : b + 2 * d + 1] = data[a:b]
    return out, bounds + 2 * np.arange(docs + 1)


def decide(model: Model, column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, calibrated probability and rejection of each text of an Arrow column."""
    n = len(column)
    data, bounds = tb.text_buffer(column)
    sums = np.append(0, np.cumsum(_ASCII_LETTERS[data], dtype=np.int64))
    letters = sums[bounds[1:]] > sums[bounds[:-1]]
    for i in np.flatnonzero(~letters).tolist():
        letters[i] = bool(_LETTER.search(data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")))
    score, best = np.zeros(n), np.zeros(n, np.int64)
    strange = np.zeros(n, bool)
    if not model.labels:
        letters[:] = False
    elif n:
        wide = padded(data, bounds)
        p = softmax(logits(model, *wide) / model.temperature)
        best = p.argmax(axis=1)
        score = np.where(letters, np.clip(p[np.arange(n), best], 0, 1), 0.0)
        strange = unknown_share(model.known, *wide) > model.most_unknown
    return [model.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score, ~letters | strange | (score < model.threshold)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 0) -> DataFrame:
    """Predicts every row's language from its whole text alone.

    Returns doc_id (null stays null), held_out, lang_pred, score (the calibrated probability) and rejected (score below
    the model's threshold, or more unknown subwords than its limit; lang_pred is then the likeliest language all the same).
    A text that is null or has no letter is ``und`` with score 0 and rejected, and so is every text if the model has no
    language. Of languages that tie, the first by name; a text of any length is read whole, in pieces. Repeated rows are
    repeated; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.sliced(batches, "text"):
            lang, score, rejected = decide(shared.value, batch.column("text"))
            yield from tb.table_of(OUT, {"doc_id": batch.column("key"), "held_out": batch.column("held"), "lang_pred": lang, "score": score, "rejected": rejected}).to_batches()

    return docs.select(F.col(key).cast("bigint").alias("key"), samples.held_out(key, modulus, held).alias("held"), F.col(text).alias("text")).mapInArrow(scan, OUT)


def recognised(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.sliced(batches, place):
            yield batch.filter(pa.array(~decide(shared.value, batch.column(place))[2]))

    return docs.mapInArrow(scan, docs.schema)
