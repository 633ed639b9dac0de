"""Language-model scoring with a trigram trie of Elias-Fano levels.

Blocks of documents first ask for the corpus counts of their tokens, by buckets of
the token's hash. Knowing them, they ask for their paths (u, v, w), three tokens in a row, by
buckets of u; a frequent u is split by v into as many contexts as its count calls for, so no bucket
grows with one word. Equal paths of many blocks are added up on the way (``textblocks.Exchange``). A
bucket lays the training paths down as a trie in memory maps: contexts u, monotone pointers to
their successors v, and from these to the successors w of (u, v), each relative to its parent, with quantised smoothed
probabilities. Then every path that was asked is looked up in it, trained or not.

Probabilities are Dirichlet-smoothed at each order: the trie has count(u, v, w) / (count(u, v) +
mu), to which mu / (count(u, v) + mu) times the next shorter probability is added, and so on down to the add-one unigram.
Counts are gathered from the whole training corpus; nothing goes to the driver. The totals
of all tokens and kinds travel as paths of their own: each token is counted by one of its askers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surelake.llm import samples
from surelake.llm import textblocks as tb
from surelake.llm.elias_fano import BOOK, Trie

OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_COPIED = f"{OUT}, copies bigint"
END, BEGIN = tb.U(0x5851F42D4C957F2D), tb.U(0x14057B7EF767814F)
#: The w of a path that ends at v: the text does, or the next token is not known.
NONE = 0xFFFFFFFF
_FEW = 1 << 16
_TOTALS = 16  # paths (0, 0, i << 8): eight bytes of the training tokens, eight of their kinds


def pack_tokens(k: tb.Keys) -> bytes:
    """Tokens are told apart by 48 bits."""
    return tb.sections(tb.pack_sorted(k.a, 2), tb.small_counts(k.value))


def unpack_tokens(body: bytes) -> tb.Keys:
    a, value = tb.from_sections(body)
    a = tb.unpack_sorted(a, 2)
    return tb.Keys(a, np.zeros(len(a), tb.U), tb.from_small(value), np.zeros(len(a), np.int64))


def narrowed(v: np.ndarray, w: np.ndarray, of_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """24 bits are enough to tell the successors of a context apart that has few; 32 are kept of others. Every block knows the context's count."""
    few = of_u < _FEW
    return np.where(few, v & tb.U(0xFFFFFF00), v), np.where(few & (w != tb.U(NONE)), np.minimum(w, tb.U(0xFFFFFE00)) & tb.U(0xFFFFFF00), w)


def _in_bytes(x: np.ndarray, few: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of 24 bits, then those of 32."""
    return np.ascontiguousarray(x[few].astype("<u4")).view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), x[~few].astype("<u4").tobytes()


def _from_bytes(three: bytes, four: bytes, few: np.ndarray) -> np.ndarray:
    wide = np.zeros((int(few.sum()), 4), np.uint8)
    wide[:, 1:] = np.frombuffer(three, np.uint8).reshape(-1, 3)
    out = np.empty(len(few), tb.U)
    out[few], out[~few] = wide.view("<u4").ravel(), np.frombuffer(four, "<u4")
    return out


def pack_paths(k: tb.Keys) -> bytes:
    """Each context once, with its count and how many pairs it has; each pair's v, with how many paths; each path's w and count."""
    u, v, w = split_up(k)
    new_u = np.ones(len(u), bool)
    new_u[1:] = u[1:] != u[:-1]
    new_v = new_u.copy()
    new_v[1:] |= v[1:] != v[:-1]
    pairs = np.flatnonzero(new_v)
    runs = lambda starts, n: tb.small_counts(np.diff(np.append(starts, n)))
    contexts, few = tb.pack_sorted(u[new_u] << tb.U(24), 3), k.extra < _FEW
    w = np.where(few & (w == tb.U(NONE)), tb.U(0xFFFFFF00), w)
    return tb.sections(contexts, tb.small_counts(k.extra[new_u]), runs(np.searchsorted(pairs, np.flatnonzero(new_u)), len(pairs)), *_in_bytes(v[new_v], few[new_v]), runs(pairs, len(u)), *_in_bytes(w, few), tb.small_counts(k.value))


def unpack_paths(body: bytes) -> tb.Keys:
    contexts, of_u, pairs, v3, v4, paths, w3, w4, value = tb.from_sections(body)
    pairs, paths = tb.from_small(pairs), tb.from_small(paths)
    u = np.repeat(np.repeat(tb.unpack_sorted(contexts, 3) >> tb.U(24), pairs), paths)
    of_pair = np.repeat(tb.from_small(of_u), pairs)
    extra = np.repeat(of_pair, paths)
    w = _from_bytes(w3, w4, extra < _FEW)
    w[(extra < _FEW) & (w == tb.U(0xFFFFFF00))] = NONE
    return joined(u, np.repeat(_from_bytes(v3, v4, of_pair < _FEW), paths), w, tb.from_small(value), extra)


def joined(u: np.ndarray, v: np.ndarray, w: np.ndarray, value: np.ndarray, extra: np.ndarray) -> tb.Keys:
    """Paths of 40, 32 and 32 bits as keys that ascend as they do."""
    return tb.Keys(u << tb.U(24) | v >> tb.U(8), (v & tb.U(255)) << tb.U(32) | w, value, extra)


def split_up(k: tb.Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return k.a >> tb.U(24), (k.a & tb.U(0xFFFFFF)) << tb.U(8) | k.b >> tb.U(32), k.b & tb.U(0xFFFFFFFF)


def pack_codes(codes: np.ndarray) -> bytes:
    """Two codes a path, of 12 bits each, their upper bits apart, deflated."""
    planes = np.ascontiguousarray(codes.T.astype("<u2")).view(np.uint8).reshape(2, -1, 2)
    return zlib.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), 1)


def unpack_codes(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(2, 2, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u2").reshape(2, -1).T


class _Tokens:
    """A block's tokens in order: each document's words, then one end."""

    def __init__(self, table: pa.Table):
        self.table = table = tb.ordered(table)
        data, bounds = tb.text_buffer(table["text"])
        w = tb.words(data, bounds, tb.SPACED, tb.LOWER)
        n, docs = len(w.hash), table.num_rows
        self.first = w.first + np.arange(docs + 1)
        self.token = np.empty(n + docs, tb.U)
        ends = self.first[1:] - 1
        word = np.ones(n + docs, bool)
        word[ends] = False
        self.token[ends] = END
        self.token[word] = w.hash
        self.weight = np.repeat(np.where(table["learns"].to_numpy(zero_copy_only=False).astype(bool), table["copies"].to_numpy(), 0), np.diff(self.first))  # how often it is learned
        self.kinds, self.at, _ = tb.united(tb.mix(self.token, 77) & ~tb.U(0xFFFF), None, self.weight)

    def before(self, values: np.ndarray, at_begin) -> np.ndarray:
        """Of each token, the value of the one before it."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first[:-1]] = at_begin
        return out

    def after(self, values: np.ndarray, at_end) -> np.ndarray:
        out = np.empty_like(values)
        out[:-1] = values[1:]
        out[self.first[1:] - 1] = at_end
        return out


class _Paths:
    """A block's paths: of each token, the one before it, itself and the one after it, where the first two are known."""

    def __init__(self, t: _Tokens, count: np.ndarray, split: int):
        self.count = c = count[t.at]
        begins = int(count[t.at[t.first[1] - 1]])  # as many texts begin as end
        self.of_u = t.before(c, begins)
        self.mask = np.flatnonzero((c > 0) & (self.of_u > 0))
        v = (tb.mix(t.token, 5) >> tb.U(32))
        w = np.where(t.after(c, 0) > 0, np.minimum(t.after(v, 0), tb.U(NONE - 1)), tb.U(NONE))
        u, of_u, v, w = t.before(t.token, BEGIN)[self.mask], self.of_u[self.mask], v[self.mask], w[self.mask]
        parts = (of_u // split + 1).astype(tb.U)
        u = tb.mix(u + (v % parts) * tb._C1, 8) >> tb.U(24)
        v, w = narrowed(v, w, of_u)
        every = joined(u, v, w, t.weight[self.mask], of_u)
        self.keys, self.at, _ = tb.united(*every)


def _totals(t: _Tokens, mine: np.ndarray, count: np.ndarray) -> tb.Keys:
    """The block's share of all training tokens and kinds, as the first paths of all."""
    value = np.zeros(_TOTALS, np.int64)
    value[0], value[8] = count[mine].sum(), np.count_nonzero(count[mine])
    zero = np.zeros(_TOTALS, tb.U)
    return joined(zero, zero, np.arange(_TOTALS, dtype=tb.U) << tb.U(8), value, np.zeros(_TOTALS, np.int64))


def look_up(keys: tb.Keys, mu: tuple[float, float]) -> np.ndarray:
    """What a bucket answers: builds its trie of the training paths and looks up every path that was asked; totals are given by bytes."""
    first = int(np.searchsorted(keys.a, 1)) if len(keys.a) else 0  # totals, in the first bucket
    rest = keys.part(first, len(keys.a))
    u, v, w = split_up(rest)
    seen = rest.value > 0
    trie = Trie(u[seen], v[seen], w[seen], rest.value[seen], rest.extra[seen], mu, NONE)
    out = np.zeros((len(keys.a), 2), np.uint16)
    if first:
        out[:first, 0] = np.frombuffer(keys.value[[0, 8]].astype("<i8").tobytes(), np.uint8)
    out[first:] = trie.find(u, v, w)
    return out


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, mu: tuple[float, float] = (10000.0, 5.0), block_bytes: int = 4 << 20, bucket_keys: int = 1 << 19, fan: int = 4096) -> DataFrame:
    """Scores every row's whole text with a trigram model of the rows whose crc32 remainder is not ``held``.

    Tokens are blank-separated words after A-Z are lower-cased, then one end. Returns doc_id (null stays null; such rows are
    scored but not learned from), held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (the
    add-one unigram log10 probability) and score (the model's). A null text is empty: one end. A text of any length is
    scored whole. Repeated rows count as often as they are there; an empty table gives none; other columns are not read.
    """
    x, blocks, total = tb.in_blocks(docs, key, text, block_bytes, learns=samples.learns(key, modulus, held), held=samples.held_out(key, modulus, held))
    tokens = tb.Exchange(blocks, max(1, total // 40 // bucket_keys), lambda k: k.value << 1, pack_tokens, unpack_tokens, pack_reply=tb.small_counts, unpack_reply=tb.from_small, owned=True, fan=fan)
    paths = tb.Exchange(blocks, max(1, total // 6 // bucket_keys), lambda k: look_up(k, mu), pack_paths, unpack_paths, pack_codes, unpack_codes, fan=fan)

    def ask_tokens(table: pa.Table) -> pa.Table:
        return tokens.ask(tb.first_bid(table), _Tokens(table).kinds)

    def ask_paths(_, table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tb.note(0, b"").slice(0, 0)
        t, got = _Tokens(table), tokens.replies(rows)
        count = got >> 1
        totals = _totals(t, (got & 1).astype(bool), count)
        keys = _Paths(t, count, bucket_keys).keys
        bid = tb.first_bid(table)
        return pa.concat_tables([paths.ask(bid, tb.Keys(*(np.concatenate(x) for x in zip(totals, keys, strict=True)))), tb.note(bid, tb.small_counts(count))])

    def add_scores(_, table: pa.Table, rows: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tb.table_of(_COPIED, {c.split()[0]: [] for c in _COPIED.split(", ")})
        t, codes = _Tokens(table), paths.replies(rows)
        n, kinds = (int(x) for x in np.frombuffer(codes[:_TOTALS, 0].astype(np.uint8).tobytes(), "<i8"))
        p = _Paths(t, tb.from_small(tb.noted(rows)), bucket_keys)
        found = np.zeros((len(t.token), 2))
        found[p.mask] = 10.0 ** BOOK[codes[_TOTALS:][p.at]]
        unigram = (p.count + 1) / (n + kinds + 1)
        bigram = found[:, 0] + mu[0] / (p.of_u + mu[0]) * unigram
        pair = found[:, 0] * (p.of_u + mu[0])  # of the pair (before, token); whole numbers as far as the code tells
        pair = t.before(np.where(pair < 12, np.rint(pair), pair), 0.0)
        trigram = t.before(found[:, 1], 0.0) + mu[1] / (pair + mu[1]) * bigram
        begin = t.first[:-1]
        columns = {
            "doc_id": t.table["key"], "held_out": t.table["held"], "n_tokens": np.diff(t.first), "n_known": np.add.reduceat((p.count > 0).astype(np.int64), begin),
            "train_tokens": np.full(len(begin), n), "base_score": np.add.reduceat(np.log10(unigram), begin), "score": np.add.reduceat(np.log10(np.minimum(trigram, 1.0)), begin), "copies": t.table["copies"],
        }
        return tb.table_of(_COPIED, columns)

    counted = tokens.run(x.groupBy("bid").applyInArrow(ask_tokens, tb.REQUEST)).withColumnRenamed("child", "bid")
    found = paths.run(x.groupBy("bid").cogroup(counted.groupBy("bid")).applyInArrow(ask_paths, tb.REQUEST)).withColumnRenamed("child", "bid")
    return tb.multiplied(x.groupBy("bid").cogroup(found.groupBy("bid")).applyInArrow(add_scores, _COPIED))
