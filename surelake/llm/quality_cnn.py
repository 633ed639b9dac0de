"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned
filters, each as wide as a few bytes, slide over every chunk; each filter's best
response in a chunk is its max-pooled feature. Mean, maximum and minimum of the
features over the chunks go into one logistic unit: one probability for the whole text.
Filters and unit are trained together by back-propagation with Adam, on a bounded
sample of labelled rows, balanced over the labels; the true label shares then set
the final bias.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm import samples
from surelake.llm import textblocks as tb

OUT = "doc_id bigint, held_out boolean, score double, predicted int"
WIDTH, STRIDE, FILTERS = 8, 1, 32
CHUNK, OVERLAP = 512, 64  # bytes


@dataclass
class Network:
    filters: np.ndarray  # float32 [WIDTH, 256, FILTERS]
    shift: np.ndarray  # float32 [FILTERS]
    weights: np.ndarray  # float32 [3 * FILTERS], of mean, maximum and minimum
    bias: float


def _laid_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts on end, zeros between them; the filter steps [from, to) of each chunk; and each text's first chunk."""
    size = np.diff(bounds)
    room = -(-np.maximum(size, 1) // STRIDE) * STRIDE + WIDTH
    at = np.append(0, np.cumsum(room))
    flat = np.zeros(at[-1], np.uint8)
    flat[np.repeat(at[:-1] - bounds[:-1], size) + np.arange(bounds[0], bounds[-1])] = data[bounds[0] : bounds[-1]]
    steps = (room - WIDTH) // STRIDE
    hop, span = (CHUNK - OVERLAP) // STRIDE, CHUNK // STRIDE
    chunks = np.maximum(1, -(-(steps - OVERLAP // STRIDE) // hop))
    first = np.append(0, np.cumsum(chunks))
    base = at[:-1] // STRIDE
    begin = np.repeat(base - first[:-1] * hop, chunks) + np.arange(first[-1]) * hop
    begin = np.minimum(begin, np.repeat(base + np.maximum(steps - span, 0), chunks))  # the last chunk is as long as the others
    end = np.minimum(begin + span, np.repeat(base + steps, chunks))
    return flat, np.column_stack([begin, end]), first


def _doubled(net: Network) -> np.ndarray:
    """The filters' values of two bytes at once, [WIDTH / 2, 1 << 16, FILTERS]: half the look-ups for texts that are only scored."""
    return (net.filters[0::2, :, None, :] + net.filters[1::2, None, :, :]).reshape(WIDTH // 2, 1 << 16, FILTERS)


def _responses(tables: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Each filter at each step, from tables of one byte or of two: float32 [steps, FILTERS]."""
    n, width = (len(flat) - WIDTH) // STRIDE + 1, WIDTH // len(tables)
    codes = flat if width == 1 else (flat[:-1].astype(np.uint16) << 8) | flat[1:]
    out = np.empty((n, FILTERS), np.float32)
    part = np.empty_like(out)
    for k, table in enumerate(tables):
        at = codes[k * width : k * width + (n - 1) * STRIDE + 1 : STRIDE]
        np.take(table, at, axis=0, out=part if k else out, mode="clip")  # raising would go through a buffer
        if k:
            out += part
    return out


def _pooled(net: Network, flat: np.ndarray, spans: np.ndarray, tables: np.ndarray) -> np.ndarray:
    response = _responses(tables, flat)
    return np.maximum.reduceat(response, np.minimum(spans.ravel(), len(response) - 1), axis=0)[::2] + net.shift


def _best(tables: np.ndarray, flat: np.ndarray, spans: np.ndarray, group: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's highest response in each chunk, and the step at which it is; about ``group`` steps at a time."""
    most, where = np.empty((len(spans), FILTERS), np.float32), np.empty((len(spans), FILTERS), np.int64)
    own, p = np.arange(FILTERS), 0
    while p < len(spans):
        q = max(p + 1, int(np.searchsorted(spans[:, 1], spans[p, 0] + group, "right")))
        lo = int(spans[p, 0])
        response = _responses(tables, flat[lo * STRIDE : (int(spans[q - 1, 1]) - 1) * STRIDE + WIDTH])
        for c in range(p, q):
            begin = int(spans[c, 0]) - lo
            part = response[begin : int(spans[c, 1]) - lo]
            at = part.argmax(axis=0)
            most[c], where[c] = part[at, own], at + begin + lo
        p = q
    return most, where


def scores(net: Network, data: np.ndarray, bounds: np.ndarray, group: int = 1 << 13, tables: np.ndarray | None = None) -> np.ndarray:
    """The logit of each text; about ``group`` bytes at a time, whose responses fit a cache."""
    out = np.empty(len(bounds) - 1)
    tables = _doubled(net) if tables is None else tables
    p = 0
    while p < len(out):
        q = max(p + 1, int(np.searchsorted(bounds, bounds[p] + group, "right")) - 1)
        if q == p + 1 and bounds[q] - bounds[p] > 4 * group:
            out[p] = _long(net, data[bounds[p] : bounds[q]], group, tables)
        else:
            flat, spans, first = _laid_out(data, bounds[p : q + 1])
            feature = np.maximum(_pooled(net, flat, spans, tables), 0)
            mean = np.add.reduceat(feature, first[:-1], axis=0) / np.diff(first)[:, None]
            out[p:q] = _logit(net, mean, np.maximum.reduceat(feature, first[:-1], axis=0), np.minimum.reduceat(feature, first[:-1], axis=0))
        p = q
    return out


def _long(net: Network, data: np.ndarray, group: int, tables: np.ndarray) -> float:
    """One very long text, some of its chunks at a time."""
    hop, span, count = (CHUNK - OVERLAP) // STRIDE, CHUNK // STRIDE, 0
    total, most, least = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), np.full(FILTERS, np.inf, np.float32)
    steps = -(-len(data) // STRIDE)
    chunks = max(1, -(-(steps - OVERLAP // STRIDE) // hop))
    begins = np.minimum(np.arange(chunks) * hop, max(steps - span, 0))
    each = max(1, group // CHUNK)
    for k in range(0, chunks, each):
        at = begins[k : k + each]
        part = data[at[0] * STRIDE : (at[-1] + span) * STRIDE + WIDTH]
        flat = np.zeros((at[-1] - at[0] + span) * STRIDE + WIDTH, np.uint8)
        flat[: len(part)] = part[: len(flat)]
        begin = at - at[0]
        feature = np.maximum(_pooled(net, flat, np.column_stack([begin, np.minimum(begin + span, steps - at[0])]), tables), 0)
        total += feature.sum(axis=0)
        most, least = np.maximum(most, feature.max(axis=0)), np.minimum(least, feature.min(axis=0))
        count += len(at)
    return float(_logit(net, total[None] / count, most[None], least[None])[0])


def _logit(net: Network, mean: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    a, b, c = net.weights.reshape(3, FILTERS)
    return mean @ a + most @ b + least @ c + net.bias


def train(rows: list[tuple[str, int]], totals: dict, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 9) -> Network:
    """Adam over all parameters. With one label or none in the rows, a network that gives that label's side of 0.5."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0)
    seen = {int(y) for _, y in rows}
    if len(seen) < 2:
        net.weights[:] = 0
        net.bias = 2.0 if 1 in seen else -2.0 if 0 in seen else 0.0
        return net
    texts = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, _ in rows]
    y = np.array([int(v) for _, v in rows], np.float32)
    bias = np.zeros(1, np.float32)
    params = [net.filters, net.shift, net.weights, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for p in range(0, len(order), batch):
            ids = order[p : p + batch]
            bounds = np.append(0, np.cumsum([len(texts[i]) for i in ids]))
            flat, spans, first = _laid_out(np.concatenate([texts[i] for i in ids]) if bounds[-1] else np.zeros(0, np.uint8), bounds)
            most_of, where = _best(net.filters, flat, spans)
            pooled = most_of + net.shift
            feature = np.maximum(pooled, 0)
            n = np.diff(first)
            mean = np.add.reduceat(feature, first[:-1], axis=0) / n[:, None]
            most = np.maximum.reduceat(feature, first[:-1], axis=0)
            least = np.minimum.reduceat(feature, first[:-1], axis=0)
            net.bias = float(bias[0])
            error = (1 / (1 + np.exp(-_logit(net, mean, most, least))) - y[ids]).astype(np.float32) / len(ids)
            back = np.repeat(error[:, None] * net.weights[:FILTERS] / n[:, None], n, axis=0)
            for k, end in ((1, most), (2, least)):
                back += np.where(feature == np.repeat(end, n, axis=0), np.repeat(error[:, None] * net.weights[k * FILTERS : (k + 1) * FILTERS], n, axis=0), 0)
            back[pooled <= 0] = 0
            learn = np.flatnonzero(np.abs(back).max(axis=1))
            where = where[learn] * STRIDE
            own, share = np.arange(FILTERS), back[learn].ravel()  # a filter learns from where it responded best
            grad = np.stack([np.bincount((flat[where + j].astype(np.int64) * FILTERS + own).ravel(), share, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]).astype(np.float32)
            grads = [grad, back.sum(axis=0), np.concatenate([(x * error[:, None]).sum(axis=0) for x in (mean, most, least)]), error.sum(keepdims=True)]
            t += 1
            step = rate * (1 - (t - 1) / steps)
            for value, g, (m1, m2) in zip(params, grads, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                value -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    net.bias = float(bias[0])
    good, bad = int(y.sum()), int(len(y) - y.sum())
    net.bias += float(np.log(totals.get(1, good) / totals.get(0, bad)) - np.log(good / bad))
    return net


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 3, held: int = 1, max_rows: int = 2000, max_bytes: int = 1 << 18) -> Network:
    """Learns from about ``max_rows`` labelled rows at most, half of each label, whose crc32 remainder is not ``held``.

    A doc_id whose labels contradict each other teaches nothing; repeated equal labels count once. Of several texts of one doc_id the
    least is learned from. Texts of more than ``max_bytes`` bytes are not picked, so rows and bytes on the driver are bounded.
    """
    y = labels.where(samples.learns(key, modulus, held)).select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    one = y.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    picked, totals = samples.balanced(one, "key", "key", "label", max_rows, salt="quality")
    if not picked:
        return train([], totals)
    few = pa.table({"key": pa.array([k for k, _ in picked], pa.int64()), "label": pa.array([y for _, y in picked], pa.int32())})
    few = docs.sparkSession.createDataFrame(few)  # max_rows at most, so it may be broadcast; a list would start Python workers, which stay beside those that score
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(few), "key")
    rows = texts.groupBy("key", "label").agg(F.min("text").alias("text")).collect()
    return train([(r.text or "", r.label) for r in sorted(rows, key=lambda r: r.key)], totals)


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", modulus: int = 3, held: int = 1) -> DataFrame:
    """Scores every row's whole text.

    Returns doc_id (null stays null), held_out, score (0 to 1) and predicted (1 from a score of 0.5). Null is scored as the
    empty text; repeated rows get equal scores; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = _doubled(net)
        for batch in tb.sliced(batches, "text"):
            data, bounds = tb.text_buffer(batch.column("text"))
            p = 1 / (1 + np.exp(-np.clip(scores(net, data, bounds, tables=tables), -500, 500)))
            yield from tb.table_of(OUT, {"doc_id": batch.column("key"), "held_out": batch.column("held"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}).to_batches()

    return docs.select(F.col(key).cast("bigint").alias("key"), samples.held_out(key, modulus, held).alias("held"), F.col(text).alias("text")).mapInArrow(scan, OUT)
