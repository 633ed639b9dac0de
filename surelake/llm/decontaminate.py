"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all benchmark items, over hashed words, is streamed along each
training text and keeps the longest match that ends at each word. A match of
``window`` words, or of a whole shorter item, marks its words. The automaton
only runs where it could matter: a vectorised look at short word n-grams leaves
out stretches in which no window of any item can lie.

Items reach the executors as broadcast slices of at most ``slice_words`` words, and
a pass over the texts broadcasts at most ``pass_words`` words of slices. A worker
reads one slice at a time, keeps the automata used last by what they were made of,
and takes a group of batches through one before the next, so its memory does not
grow with the benchmark. A benchmark of one pass takes the texts through once,
without a shuffle; of a larger one, each pass writes what it hit to the shared
folder, and the passes' hits are joined to the texts in the end. Words are compared
by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb
from surelake.llm.shared import stored

OUT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, kept_text string"
_HITS = "row bigint, spans array<bigint>, items array<string>"
_KEPT_AUTOMATA = 3
_built: OrderedDict[tuple[str, int], Automaton] = OrderedDict()
builds = 0  # automata that this process made


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, 0 the root."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lasts = [self._add(seq) for _, seq in items]
        n = len(self.link)
        inside: list[set[int]] = [set() for _ in range(n)]
        ends: list[list[int]] = [[] for _ in range(n)]
        for k, (_, seq) in enumerate(items):
            v = 0
            for c in seq:
                v = u = self.next[v][c]
                while u > 0 and k not in inside[u]:
                    inside[u].add(k)
                    u = self.link[u]
            if 0 < len(seq) < window:
                ends[lasts[k]].append(k)
        self.names = [name for name, _ in items]
        #: Items that contain the state's suffix of ``window`` words.
        self.of_window = [None] * n
        #: Whole short items that end wherever the state does: (words, items), the state's own last.
        self.short: list[tuple[tuple[int, frozenset], ...]] = [()] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.of_window[v] = self.of_window[up] if self.length[up] >= window else frozenset(inside[v])
            self.short[v] = self.short[up] + (((self.length[v], frozenset(ends[v])),) if ends[v] else ())
        self.least = min([window, *(len(s) for _, s in items if s)])
        self.q = min(3, self.least)
        grams = [tb.runs_of(np.array(s, tb.U), self.q, 21) for _, s in items if s]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, tb.U)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.grams >> tb.U(44)).astype(np.int64)] = True

    def _add(self, seq: list[int]) -> int:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in seq:
            if c in nxt[last]:
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = self._state(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
            else:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new
        return last

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (from, to) of words within which every window of any item must lie."""
        if not len(self.grams) or len(hashes) < self.q:
            return np.zeros((0, 2), np.int64)
        grams = tb.runs_of(hashes, self.q, 21)
        at = np.flatnonzero(self.sieve[(grams >> tb.U(44)).astype(np.int64)])
        found = grams[at]
        place = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        at = at[self.grams[place] == found]
        doc = np.searchsorted(first, at, "right")
        ok = at + self.q <= first[np.minimum(doc, len(first) - 1)]  # not across documents
        at, doc = at[ok], doc[ok]
        if not len(at):
            return np.zeros((0, 2), np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        rows = np.column_stack([at[begin], at[end] + self.q])
        return rows[rows[:, 1] - rows[:, 0] >= self.least]

    def stream(self, hashes: list[int], offset: int, hit: np.ndarray) -> set[int]:
        """Longest matches along these words; marks hit words from ``offset`` on and returns the items met."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        met: set[int] = set()
        for i, c in enumerate(hashes):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            else:
                size = 0
                continue
            end = offset + i + 1
            if size >= window:
                hit[end - window : end] = True
                met |= self.of_window[v]
            for k, items in self.short[v]:
                if k <= size:
                    hit[end - k : end] = True
                    met |= items
        return met


def _slices(benchmark: DataFrame, item: str, text: str, slice_words: int) -> Iterator[list[tuple[str | None, list[int]]]]:
    """Hashed items, in lists of bounded size."""
    part, size = [], 0
    for name, body in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        data = np.frombuffer((body or "").encode(), np.uint8)
        seq = tb.words(data, np.array([0, len(data)]), tb.ALNUM[tb.LOWER], tb.LOWER).hash.tolist()
        if not seq:
            continue
        if part and size + len(seq) > slice_words:
            yield part
            part, size = [], 0
        part.append((name, seq))
        size += len(seq)
    if part:
        yield part


class Slice:
    """Some items as a broadcast, and a digest of them."""

    def __init__(self, context, items: list[tuple[str | None, list[int]]]):
        self.digest = hashlib.sha256(repr(items).encode()).hexdigest()
        self.shared = context.broadcast(items)

    def items(self) -> list[tuple[str | None, list[int]]]:
        """A worker reads them from its executor's file and, unlike by ``value``, does not hold on to them."""
        path = getattr(self.shared, "_path", None)
        return self.shared.load_from_path(path) if path else self.shared.value

    def automaton(self, window: int) -> Automaton:
        """One of the automata that the process used last, or a new one in place of the oldest."""
        global builds
        key = (self.digest, window)
        if key not in _built:
            while len(_built) >= _KEPT_AUTOMATA:
                _built.popitem(last=False)
            _built[key] = Automaton(self.items(), window)
            builds += 1
        _built.move_to_end(key)
        return _built[key]


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about ``most`` bytes together."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _searched(batches: Iterator[pa.RecordBatch], slices: list[Slice], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, tb.Words, np.ndarray, dict[int, set[str]]]]:
    """Each batch with its bytes, bounds, words, which of them are hit, and the items that each document met."""
    for group in _grouped(tb.sliced(batches, "text"), 1 if len(slices) <= _KEPT_AUTOMATA else 32 << 20):
        hits: list[np.ndarray | None] = [None] * len(group)
        met: list[dict[int, set[str]]] = [{} for _ in group]
        alone = _words(group[0]) if len(group) == 1 else None
        for s in slices:
            a = s.automaton(window)
            for k, batch in enumerate(group):
                w = (alone or _words(batch))[2]
                if hits[k] is None:
                    hits[k] = np.zeros(len(w.hash), bool)
                for lo, hi in a.stretches(w.hash, w.first).tolist():
                    if items := a.stream(w.hash[lo:hi].tolist(), lo, hits[k]):
                        doc = int(np.searchsorted(w.first, lo, "right")) - 1
                        met[k].setdefault(doc, set()).update(a.names[i] for i in items if a.names[i] is not None)
        for batch, hit, names in zip(group, hits, met, strict=True):
            data, bounds, w = alone or _words(batch)
            yield batch, data, bounds, w, np.zeros(len(w.hash), bool) if hit is None else hit, names


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tb.Words]:
    data, bounds = tb.text_buffer(batch.column("text"))
    return data, bounds, tb.words(data, bounds, tb.ALNUM[tb.LOWER], tb.LOWER)


def _report(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, w: tb.Words, hit: np.ndarray, met: dict[int, set[str]], coverage: tuple[int, int], with_text: bool, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    part, whole = coverage
    n = np.diff(w.first)
    sums = np.append(0, np.cumsum(hit))
    hits = sums[w.first[1:]] - sums[w.first[:-1]]
    names = [",".join(sorted(met.get(d, ()))) for d in range(len(n))]
    texts = batch.column("text").to_pylist() if with_text else [None] * len(n)
    if with_text:
        for d in np.flatnonzero(hits).tolist():
            texts[d] = _cut(data[bounds[d] : bounds[d + 1]], w, hit, int(w.first[d]), int(w.first[d + 1]), int(bounds[d]))
    rows = {
        "doc_id": batch.column("key"), "n_words": n, "n_hit": hits, "n_items": [len(met.get(d, ())) for d in range(len(n))],
        "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in names],
        "contaminated": (hits > 0) & (whole * hits >= part * n), "kept_text": texts,
    }
    yield from tb.with_columns(tb.table_of(OUT, rows), pa.Table.from_batches([batch]), carry).to_batches()


def _hits(docs: DataFrame, slices: list[Slice], window: int) -> DataFrame:
    """(row, spans, items) of the rows that a pass hits: the words [from, to) of each span on end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, w, hit, met in _searched(batches, slices, window):
            rows, spans, items = [], [], []
            row = batch.column("row").to_pylist()
            for d in range(batch.num_rows):
                step = np.diff(hit[w.first[d] : w.first[d + 1]].astype(np.int8), prepend=0, append=0)
                if step.any():
                    rows.append(row[d])
                    spans.append(np.column_stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)]).ravel())
                    items.append(sorted(met.get(d, ())))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row", "spans", "items"])

    return docs.select("row", "text").mapInArrow(scan, _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, coverage: tuple[int, int] = (1, 20), with_text: bool = True, carry: tuple[str, ...] = (), slice_words: int = 200_000, pass_words: int = 8_000_000) -> DataFrame:
    """Marks and removes benchmark passages.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased. A document word is
    hit inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter item. Returns a row for
    each row of ``docs``: doc_id, n_words, n_hit, n_items (distinct items with an occurring window), items_sha256 (of
    their ids as sorted strings, comma-joined), contaminated (hit words reach the ``coverage`` fraction) and, unless
    ``with_text`` is false, kept_text: the text without the hit spans; then the columns ``carry`` as they are. Null and blank texts have no words; null and blank
    items match nothing; an item without id marks words but is not counted; repeated items and rows count alike; an
    empty table gives no rows, an empty benchmark no hits. Texts of any length are read whole, the benchmark item by
    item; an item longer than a slice is a slice of its own. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    schema = ", ".join([OUT, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    picked = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    numbered = picked.select(F.xxhash64("key", "text").alias("row"), "text")
    passes: list[DataFrame] = []
    slices, size = [], 0
    for items in _slices(benchmark, item, item_text, slice_words):
        words = sum(len(s) for _, s in items)
        if slices and size + words > pass_words:
            passes.append(stored(_hits(numbered, slices, window)))
            for s in slices:
                s.shared.destroy()
            slices, size = [], 0
        slices.append(Slice(context, items))
        size += words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _searched(batches, slices, window):
            yield from _report(*found, coverage, with_text, carry)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.sliced(batches, "text"):
            data, bounds, w = _words(batch)
            hit, met = np.zeros(len(w.hash), bool), {}
            for d, (spans, items) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                for lo, hi in np.array(spans or [], np.int64).reshape(-1, 2) + w.first[d]:
                    hit[lo:hi] = True
                if items:
                    met[d] = set(items)
            yield from _report(batch, data, bounds, w, hit, met, coverage, with_text, carry)

    if not passes:
        out = picked.mapInArrow(scan, schema)
    else:
        passes.append(stored(_hits(numbered, slices, window)))
        every = passes[0]
        for p in passes[1:]:
            every = every.unionByName(p)
        flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731 (one row a pass and copy of the row)
        found = every.dropDuplicates(["row", "spans", "items"]).groupBy("row").agg(flat("spans").alias("spans"), F.array_distinct(flat("items")).alias("items"))
        out = picked.withColumn("row", F.xxhash64("key", "text")).join(found, "row", "left").mapInArrow(finish, schema)
    return out if with_text else out.drop("kept_text")


def _cut(data: np.ndarray, w: tb.Words, hit: np.ndarray, a: int, b: int, at: int) -> str:
    """The text without the spans of consecutive hit words."""
    step = np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)
    pieces, p = [], 0
    for lo, hi in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        pieces.append(data[p : w.start[a + lo] - at].tobytes())
        p = int(w.end[a + hi - 1]) - at
    pieces.append(data[p:].tobytes())
    return b"".join(pieces).decode("utf-8", "replace")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM v)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
c AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
m AS (SELECT r, i, k, item FROM c JOIN q USING (k, t)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY r),
x AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)
"""
