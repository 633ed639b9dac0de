"""Substring dedup by recompression.

Words are hashed, then renamed in rounds as in Jez's recompression: a round
names maximal runs of one symbol, then parts the symbols by a hash bit into left
and right ones and names each left-right pair. A name is a hash of what it
stands for, so it is the same in every document of the corpus without a lookup.
Equal substrings thus get equal symbols inside. For each symbol the rounds also
keep the words that decided it: within a window that covers them, the symbol
appears wherever the window does.

1. Blocks send the distinct symbols of at least ``min_symbol`` words; each bucket
   of names answers which occur twice or more in the corpus.
2. A symbol that occurs once rules out every window that covers what decided it.
   The windows left, those whose inner symbols are all shared, are verified: 80 bits of
   two independent hashes of their words must occur again. The shared symbols show where repeats can be,
   the fingerprints of whole windows prove them; words are not compared letter by letter.
3. Words covered by verified windows are removed.

Each round's names are thus global by content, without a Spark job that hands them out: a lookup table
of names would have to be shuffled to every block in every round. Text is shuffled once, by
block; the rest moves as packed keys and bitmaps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb

OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
_FAR = 1 << 40


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after so many rounds: name, first word, number of words, and the words [low, high) that decided each.

    first: per document its first word, and one more entry. What a document's edge decided reaches beyond every window.
    """
    n = len(hashes)
    name, at, size = hashes.copy(), np.arange(n), np.ones(n, np.int64)
    low, high = at.copy(), at + 1
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    head = opens[:-1].copy()
    for r in range(rounds):
        if r % 2 == 0:
            name, at, size, low, high, head = _runs(name, at, size, low, high, head, r)
        name, at, size, low, high, head = _pairs(name, at, size, low, high, head, r)
    return name, at, size, low, high


def _beside(low, high, head):
    """What decided the left and the right neighbour; far away at a document's edge."""
    n = len(low)
    tail = np.ones(n, bool)
    tail[:-1] = head[1:]
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    left[1:], left[0] = low[:-1], -_FAR
    left[head] = -_FAR
    right[:-1], right[-1] = high[1:], _FAR
    right[tail] = _FAR
    return left, right, tail


def _runs(name, at, size, low, high, head, r):
    """Names each maximal run. That a symbol's neighbours differ was decided by them, so both count."""
    n = len(name)
    if n == 0:
        return name, at, size, low, high, head
    left, right, _ = _beside(low, high, head)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | head[1:]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n) - 1
    k = end - begin + 1
    run = name[begin]
    many = k > 1
    run[many] = tb.mix(run[many] + k[many].astype(tb.U) * tb._C2, 2 * r + 101)
    total = np.append(0, np.cumsum(size))
    return run, at[begin], total[end + 1] - total[begin], np.minimum(left[begin], low[begin]), np.maximum(right[end], high[end]), head[begin]


def _pairs(name, at, size, low, high, head, r):
    n = len(name)
    if n == 0:
        return name, at, size, low, high, head
    left, right, tail = _beside(low, high, head)
    is_left = (tb.mix(name, 2 * r + 1001) & tb.U(1)).astype(bool)
    joins = np.zeros(n, bool)  # with the next
    joins[:-1] = is_left[:-1] & ~is_left[1:] & ~head[1:]
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    alone = ~joins & ~joined
    lo, hi = low.copy(), high.copy()
    a = alone & is_left  # what follows decided it
    hi[a] = np.maximum(high[a], right[a])
    lo[a] = np.minimum(low[a], np.append(low[1:], -_FAR)[a])
    b = alone & ~is_left
    lo[b] = np.minimum(low[b], left[b])
    hi[b] = np.maximum(high[b], np.append(_FAR, high[:-1])[b])
    j = np.flatnonzero(joins)
    named = name.copy()
    named[j] = tb.mix(tb.mix(name[j], 2 * r + 7) * tb._C1 + name[j + 1], 2 * r + 2001)
    lo[j] = np.minimum(low[j], low[j + 1])
    hi[j] = np.maximum(high[j], high[j + 1])
    grown = size.copy()
    grown[j] += size[j + 1]
    keep = ~joined
    return named[keep], at[keep], grown[keep], lo[keep], hi[keep], head[keep]


def _block(table: pa.Table):
    table = tb.ordered(table)
    data, bounds = tb.text_buffer(table["text"])
    return table, data, bounds, tb.words(data, bounds)


def _symbols(w: tb.Words, rounds: int, min_symbol: int, window: int):
    """Symbols worth asking about: long enough, and decided by fewer words than a window has; with where they begin."""
    name, at, size, low, high = recompress(w.hash, w.first, rounds)
    use = (size >= min_symbol) & (high - low <= window)
    return name[use], at[use], low[use], high[use]


def _copies(table: pa.Table, w: tb.Words) -> np.ndarray:
    """Of each word, how often its row is there."""
    return np.repeat(table["copies"].to_numpy(), np.diff(w.first))


def _fits(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Per word: does a window that starts there end in the same document?"""
    ok = np.zeros(n, bool)
    step = np.zeros(n + 1, np.int32)
    last = first[1:] - window + 1
    has = last > first[:-1]
    np.add.at(step, first[:-1][has], 1)
    np.add.at(step, last[has], -1)
    ok[:] = np.cumsum(step[:-1]) > 0
    return ok


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    step[starts + window] -= 1
    return np.cumsum(step[:-1]) > 0


def _twice(keys: tb.Keys) -> tb.Keys:
    """Values of 2 at most: all that is asked is whether there are two."""
    return keys._replace(value=np.minimum(keys.value, 2))


def _fingerprints(w: tb.Words, starts: np.ndarray, window: int, copies: np.ndarray) -> tuple[tb.Keys, np.ndarray]:
    """80 bits of each window: two hashes of its words; each counts as often as its row is there."""
    a = tb.runs_of(w.hash, window, 11)[starts]
    b = tb.runs_of(w.hash, window, 12, 0xD1342543DE82EF95)[starts] >> tb.U(48)
    keys, at, _ = tb.united(a, b, copies[starts])
    return _twice(keys), at


def occurs_again(keys: tb.Keys) -> np.ndarray:
    """What a bucket answers: which of its keys are there twice or more."""
    return keys.value > 1


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, rounds: int = 4, min_symbol: int = 4, with_text: bool = True, carry: tuple[str, ...] = (), block_bytes: int = 4 << 20, bucket_keys: int = 1 << 20, fan: int = 4096) -> DataFrame:
    """Removes every word that lies in a ``window``-word passage that also starts elsewhere in the corpus.

    Returns a row for each row of ``docs``: doc_id (null stays null), n_words, n_removed, kept_sha256 and, unless
    ``with_text`` is false, kept_text; then the columns ``carry`` as they are. The hash is of the kept words joined by one
    space, and kept_text is the same, but a text that loses nothing stays as it is, null too. A null or blank text has no
    words. Repeated rows are copies of each other and lose all words if they have ``window`` or more. A text of any length
    is handled whole. An empty table gives none. Other columns are not read.
    """
    x, blocks, total = tb.in_blocks(docs, key, text, block_bytes, **{f"carry_{c}": F.col(c) for c in carry})
    out_schema = ", ".join([OUT, "copies bigint", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    way = tb.Exchange(blocks, max(1, total // 6 // bucket_keys), occurs_again, fan=fan)

    def ask_symbols(table: pa.Table) -> pa.Table:
        table, _, _, w = _block(table)
        name, at, _, _ = _symbols(w, rounds, min_symbol, window)
        return way.ask(tb.first_bid(table), _twice(tb.united(name, None, _copies(table, w)[at])[0]))

    def ask_windows(_, table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tb.note(0, b"").slice(0, 0)
        table, _, _, w = _block(table)
        n = len(w.hash)
        name, _, low, high = _symbols(w, rounds, min_symbol, window)
        once = ~way.replies(rows)[tb.united(name, None)[1]]
        step = np.zeros(n + 2, np.int32)  # over the starts of windows that cover what decided such a symbol
        np.add.at(step, np.maximum(high[once] - window, 0), 1)
        np.add.at(step, low[once] + 1, -1)
        maybe = _fits(w.first, n, window) & (np.cumsum(step)[:n] <= 0)
        bid = tb.first_bid(table)
        return pa.concat_tables([way.ask(bid, _fingerprints(w, np.flatnonzero(maybe), window, _copies(table, w))[0]), tb.note(bid, tb.pack_flags(maybe))])

    def remove(_, table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tb.with_columns(tb.table_of(f"{OUT}, copies bigint", {c.split()[0]: [] for c in f"{OUT}, copies bigint".split(", ")}), table, carry)
        table, data, bounds, w = _block(table)
        starts = np.flatnonzero(tb.unpack_flags(tb.noted(rows)))
        at = _fingerprints(w, starts, window, _copies(table, w))[1]
        gone = _covered(starts[way.replies(rows)[at]], len(w.hash), window)
        sums = np.append(0, np.cumsum(gone))
        first = w.first
        removed = sums[first[1:]] - sums[first[:-1]]
        digests, texts = [], []
        for i in range(table.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            if removed[i] == b - a:
                kept = b""
            else:
                kept = data[bounds[i] : bounds[i + 1]].tobytes().split()
                if removed[i]:
                    kept = [kept[j] for j in np.flatnonzero(~gone[a:b]).tolist()]
                kept = b" ".join(kept)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(None if not with_text else kept.decode("utf-8", "replace") if removed[i] else table["text"][i].as_py())
        rows = {"doc_id": table["key"], "n_words": np.diff(first), "n_removed": removed, "kept_sha256": digests, "kept_text": texts, "copies": table["copies"]}
        return tb.with_columns(tb.table_of(f"{OUT}, copies bigint", rows), table, carry)

    symbols = way.run(x.groupBy("bid").applyInArrow(ask_symbols, tb.REQUEST)).withColumnRenamed("child", "bid")
    repeats = way.run(x.groupBy("bid").cogroup(symbols.groupBy("bid")).applyInArrow(ask_windows, tb.REQUEST)).withColumnRenamed("child", "bid")
    out = x.groupBy("bid").cogroup(repeats.groupBy("bid")).applyInArrow(remove, out_schema)
    out = tb.multiplied(out)
    return out if with_text else out.drop("kept_text")


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM s),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i FROM h WHERE n > 1) CROSS JOIN (SELECT unnest(generate_series(0, 34)) AS k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
