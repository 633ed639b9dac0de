"""Vectorised word blocks and the packed exchange that several operators share.

A *block* is a set of documents, a few MB of text, that one Python call handles
with numpy. Its number ``bid`` comes from a hash of the row, so a block can be
rebuilt after an executor is lost. Blocks ask questions about hashed keys: each
sends its distinct keys as bytes, one row for each range of the key space that it has keys of;
whoever holds a bucket of the space answers in the order of the keys. JVM
rows are few and large, and a key that is frequent anywhere is sent once per block.

A block sends ``fan`` rows at most. Where the space has more buckets than that, the rows go up
a tree (``Exchange``): a node takes a range's rows from ``fan`` blocks, adds up equal keys, and
sends on what is left by narrower ranges; the answers come back the same way. So the number of
rows grows with the text, not with blocks times buckets, and a frequent key
reaches its bucket from the roots of a few trees rather than from every block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surelake.llm.shared import apart, repeated

U = np.uint64
_C1, _C2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U)
_PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}

BLANKS = b" \t\n\x0b\x0c\r"
REQUEST = "node bigint, child bigint, keys binary"
REPLY = "child bigint, bucket bigint, body binary"


def not_in(blanks: bytes) -> np.ndarray:
    """Per byte value: does it belong to a word?"""
    table = np.ones(256, bool)
    table[list(blanks)] = False
    return table


#: Words `[^\\x20\\x09-\\x0D]+`.
SPACED = not_in(BLANKS)
#: Words of ASCII digits, lower-case letters and everything beyond ASCII, after A-Z are lower-cased.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ U(salt)
    x ^= x >> U(30)
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
        if len(have) > 1 << 22:
            del _powers[base]
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry: the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words(NamedTuple):
    hash: np.ndarray  # uint64, of the word's bytes
    start: np.ndarray  # first byte
    end: np.ndarray  # after the last byte
    first: np.ndarray  # per document, its first word; one more entry: the number of words


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = SPACED, fold: np.ndarray | None = None) -> Words:
    """All words of the documents data[bounds[d]:bounds[d + 1]]: maximal runs of bytes with inside[byte]; fold maps bytes before hashing."""
    table = _BYTES if fold is None else _BYTES[fold]
    n, p = len(data), 0
    hashes, starts, ends = [], [], []
    begins = bounds[:-1]
    while p < n:
        q = min(p + _PIECE, n)
        while q < n:  # move on to where no word is cut
            stop = np.flatnonzero(~inside[data[q : q + 4096]])
            if len(stop):
                q += int(stop[0])
                break
            q = min(q + 4096, n)
        piece = data[p:q]
        m = inside[piece]
        before, after = np.empty_like(m), np.empty_like(m)
        before[0], after[-1] = False, False
        before[1:], after[:-1] = m[:-1], m[1:]
        cut = begins[np.searchsorted(begins, p) : np.searchsorted(begins, q)] - p
        before[cut] = False
        after[cut[cut > 0] - 1] = False
        s, e = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(table[piece] * powers(_BASE, len(piece)), out=total[1:])
        h = (total[e] - total[s]) * powers(_INVERSE, len(piece))[s]
        hashes.append(mix(h + (e - s).astype(U) * _C2))
        starts.append(s + p)
        ends.append(e + p)
        p = q
    if not hashes:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), empty, empty, np.zeros(len(bounds), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, bounds))


def runs_of(hashes: np.ndarray, k: int, salt: int = 1, base: int = _BASE) -> np.ndarray:
    """A hash for each k consecutive entries: of length len(hashes) - k + 1."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(mix(hashes, salt) * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n)[: n - k + 1])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper 32 bits; ascends with the hash."""
    return (((hashes >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


class Keys(NamedTuple):
    """Distinct keys (a, b) in ascending order; a alone decides the bucket."""

    a: np.ndarray  # uint64
    b: np.ndarray  # uint64
    value: np.ndarray  # int64, to be added up over equal keys
    extra: np.ndarray  # int64, the same wherever a key occurs

    def part(self, lo: int, hi: int) -> Keys:
        return Keys(*(x[lo:hi] for x in self))


def united(a: np.ndarray, b: np.ndarray | None, value: np.ndarray | None = None, extra: np.ndarray | None = None) -> tuple[Keys, np.ndarray, np.ndarray]:
    """The distinct keys; per input its place among them; and whether it is the first of its key. Without values each counts 1."""
    n = len(a)
    order = np.argsort(a)
    x = a[order]
    if b is not None:  # only equal ones need b
        tie = np.zeros(n + 1, bool)
        tie[1:n] = x[1:] == x[:-1]
        tied = np.flatnonzero(tie[:n] | tie[1:])
        some = order[tied]
        order[tied] = some[np.lexsort((b[some], x[tied]))]
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    if b is not None:
        y = b[order]
        new[1:] |= y[1:] != y[:-1]
    place = np.flatnonzero(new)
    at, first = np.empty(n, np.int64), np.zeros(n, bool)
    at[order] = np.cumsum(new) - 1
    first[order[place]] = True
    count = np.diff(np.append(place, n)) if value is None else np.add.reduceat(value[order], place) if n else np.zeros(0, np.int64)
    one = order[place]
    return Keys(x[place], y[place] if b is not None else np.zeros(len(place), U), count.astype(np.int64), extra[one] if extra is not None else np.zeros(len(place), np.int64)), at, first


def small_counts(counts: np.ndarray) -> bytes:
    """Counts, deflated: a byte each, 255 for those that follow in full."""
    large = counts[counts >= 255].astype(np.int64)
    return np.array([len(counts)], np.int32).tobytes() + zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes(), 1)


def from_small(body: bytes) -> np.ndarray:
    n, data = int(np.frombuffer(body, np.int32, 1)[0]), zlib.decompress(body[4:])
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = np.flatnonzero(counts == 255)
    counts[large] = np.frombuffer(data, np.int64, len(large), n)
    return counts


def sections(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int32).tobytes() + b"".join(parts)


def from_sections(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, np.int32, 1)[0])
    ends = 4 * (n + 1) + np.append(0, np.cumsum(np.frombuffer(body, np.int32, n, 4)))
    return [body[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def pack_sorted(x: np.ndarray, skip: int = 0) -> bytes:
    """Ascending numbers without their lowest ``skip`` bytes: the upper 16 bits as deflated differences, the rest as it is."""
    top = (x >> U(48)).astype(np.uint16)
    low = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, skip:6]
    return sections(zlib.compress(np.diff(top, prepend=top[:0] if not len(top) else np.uint16(0)).tobytes(), 1), low.tobytes())


def unpack_sorted(body: bytes, skip: int = 0) -> np.ndarray:
    top, low = from_sections(body)
    top = np.cumsum(np.frombuffer(zlib.decompress(top), np.uint16), dtype=np.uint16)
    out = np.zeros((len(top), 8), np.uint8)
    out[:, skip:6] = np.frombuffer(low, np.uint8).reshape(len(top), 6 - skip)
    return out.view("<u8").ravel().astype(U) | top.astype(U) << U(48)


def pack_plain(k: Keys) -> bytes:
    """a and the low 16 bits of b, which are left out if they are all 0."""
    return sections(pack_sorted(k.a), k.b.astype(np.uint16).tobytes() if k.b.any() else b"", small_counts(k.value))


def unpack_plain(body: bytes) -> Keys:
    a, b, value = from_sections(body)
    a = unpack_sorted(a)
    return Keys(a, np.frombuffer(b, np.uint16).astype(U) if b else np.zeros(len(a), U), from_small(value), np.zeros(len(a), np.int64))


def pack_flags(flags: np.ndarray) -> bytes:
    return np.array([len(flags)], np.int32).tobytes() + np.packbits(flags.astype(bool)).tobytes()


def unpack_flags(body: bytes) -> np.ndarray:
    n = int(np.frombuffer(body, np.int32, 1)[0])
    return np.unpackbits(np.frombuffer(body, np.uint8, -1, 4), count=n).astype(bool)


def note(bid: int, body: bytes) -> pa.Table:
    """A request that comes back to the block as it is, as the reply of bucket -1."""
    return _table(REQUEST, [-1 - bid], [bid], [body])


def noted(rows: pa.Table) -> bytes:
    """The note among a block's replies."""
    return next((body for b, body in zip(rows["bucket"].to_pylist(), rows["body"].to_pylist(), strict=True) if b < 0), b"")


def _table(schema: str, *columns: list) -> pa.Table:
    return table_of(schema, dict(zip((x.split()[0] for x in schema.split(", ")), columns, strict=True)))


class Exchange:
    """How blocks ask buckets about their keys, and get the answers.

    ``answer`` maps a bucket's distinct keys, with values added up over all blocks, to an array with an entry for each.
    With ``owned`` the lowest bit of an entry is left for the exchange: it is set for one asker of each key alone.
    """

    def __init__(self, blocks: int, buckets: int, answer: Callable[[Keys], np.ndarray], pack=pack_plain, unpack=unpack_plain, pack_reply=pack_flags, unpack_reply=unpack_flags, owned: bool = False, fan: int = 4096):
        self.blocks, self.buckets, self.fan, self.answer, self.owned = blocks, buckets, fan, answer, owned
        self.pack, self.unpack, self.pack_reply, self.unpack_reply = pack, unpack, pack_reply, unpack_reply
        self.levels = 1
        while fan**self.levels < buckets:
            self.levels += 1

    def _supers(self, level: int) -> int:
        """Groups of blocks at a level; at the buckets all meet."""
        return 1 if level >= self.levels else -(-self.blocks // self.fan**level)

    def _send(self, level: int, child: int, group: int, keys: Keys) -> pa.Table:
        """A row for each range of the level that has keys; group: of blocks, at that level."""
        ranges = bucket_of(keys.a, self.buckets) // self.fan ** (self.levels - level)
        cut = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(ranges) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(ranges))[: len(cut)]
        node = (ranges[cut] * self._supers(level) + (group if level < self.levels else 0)).tolist()
        return _table(REQUEST, node, [child] * len(cut), [self.pack(keys.part(lo, hi)) for lo, hi in zip(cut.tolist(), ends.tolist(), strict=True)])

    def ask(self, bid: int, keys: Keys) -> pa.Table:
        """A block's requests."""
        return self._send(1, bid, bid // self.fan, keys)

    def _joined(self, rows: pa.Table) -> tuple[pa.Table, list[Keys], Keys, np.ndarray, np.ndarray]:
        rows = rows.sort_by("child")
        parts = [self.unpack(x) for x in rows["keys"].to_pylist()]
        keys, at, first = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return rows, parts, keys, at, first

    def _reply(self, rows: pa.Table, parts: list[Keys], at: np.ndarray, first: np.ndarray, out: np.ndarray, bucket: int) -> pa.Table:
        got = out[at]
        if self.owned:
            got = np.where(first, got, got & ~1)
        ends = np.cumsum([len(p.a) for p in parts]).tolist()
        return _table(REPLY, rows["child"].to_pylist(), [bucket] * len(parts), [self.pack_reply(got[e - len(p.a) : e]) for e, p in zip(ends, parts, strict=True)])

    def _merge(self, rows: pa.Table, level: int) -> pa.Table:
        node = rows["node"][0].as_py()
        if node < 0:
            return _table(REQUEST, [node], [node], rows["keys"].to_pylist())
        return self._send(level + 1, node, node % self._supers(level) // self.fan, self._joined(rows)[2])

    def _answered(self, rows: pa.Table) -> pa.Table:
        node = rows["node"][0].as_py()
        if node < 0:
            return _table(REPLY, rows["child"].to_pylist(), [-1] * rows.num_rows, rows["keys"].to_pylist())
        rows, parts, keys, at, first = self._joined(rows)
        out = self.answer(keys)
        return self._reply(rows, parts, at, first, out | 1 if self.owned else out, node)

    def _hand_down(self, rows: pa.Table, found: pa.Table, level: int) -> pa.Table:
        node = rows["node"][0].as_py()
        if node < 0:
            return _table(REPLY, rows["child"].to_pylist(), [-1] * rows.num_rows, found["body"].to_pylist())
        rows, parts, _, at, first = self._joined(rows)
        return self._reply(rows, parts, at, first, self.replies(found), node // self._supers(level))

    def replies(self, rows: pa.Table) -> np.ndarray:
        """An asker's answers, in the order of its keys."""
        bodies = [body for b, body in sorted(zip(rows["bucket"].to_pylist(), rows["body"].to_pylist(), strict=True), key=lambda x: x[0]) if b >= 0]
        return np.concatenate([self.unpack_reply(x) for x in bodies]) if bodies else self.unpack_reply(self.pack_reply(self.answer(Keys(*(np.zeros(0, t) for t in (U, U, np.int64, np.int64))))))

    def run(self, asked: DataFrame, level: int = 1) -> DataFrame:
        """The replies to all requests."""
        if level == self.levels:
            return asked.groupBy("node").applyInArrow(lambda rows: self._answered(rows), REPLY)
        above = self.run(asked.groupBy("node").applyInArrow(lambda rows: self._merge(rows, level), REQUEST), level + 1).withColumnRenamed("child", "node")
        return asked.groupBy("node").cogroup(above.groupBy("node")).applyInArrow(lambda rows, found: self._hand_down(rows, found, level) if rows.num_rows else _table(REPLY, [], [], []), REPLY)


def table_of(schema: str, columns: dict) -> pa.Table:
    """Columns as the Arrow types of a DDL of int, bigint, double, string, boolean, binary."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def sliced(batches: Iterable[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes in a text column, or of one longer text, so that arrays per word stay small."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        p, n, ends = 0, len(size), np.cumsum(size, dtype=np.int64)
        while p < n:
            q = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + most, "right")))
            yield batch.slice(p, q - p)
            p = q


def with_columns(rows: pa.Table, source: pa.Table, carry: tuple[str, ...]) -> pa.Table:
    """rows, with the columns that came along as ``carry_`` columns of source."""
    for c in carry:
        rows = rows.append_column(c, source[f"carry_{c}"])
    return rows


def in_blocks(docs: DataFrame, key: str, text: str, block_bytes: int, **more: Column) -> tuple[DataFrame, int, int]:
    """(bid, row, key, text, copies, and more columns), with row a hash of key and text; the number of blocks; and of bytes of text.

    Equal rows are one, with the number of its copies: else a row that a third of the table repeats would fill one block. What repeats
    is found by counts of hashes; only those rows' texts are shuffled for it, once from each task. ``multiplied`` gives the copies back.
    Texts are deflated one by one for the way to their blocks; ``ordered`` inflates them.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    row = F.xxhash64(F.col(key), F.col(text))
    rows = docs.select(row.alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"), *(c.alias(name) for name, c in more.items()))
    keys, n = repeated(docs.select(row.alias("row")), "row")
    if n:
        once, twice = apart(rows, "row", keys, n)
        rows = once.withColumn("copies", F.lit(1).cast("bigint")).unionByName(twice.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    picked = rows.select(F.pmod(F.xxhash64("row", *more), F.lit(blocks)).cast("bigint").alias("bid"), "row", "key", "text", "copies", *more)

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else packer.compress(x) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()))

    return picked.mapInArrow(deflate, picked.schema), blocks, total


def ordered(table: pa.Table) -> pa.Table:
    """The block's rows, inflated, in an order that does not depend on how they arrived; only equal rows may change places."""
    row, key = table["row"].to_numpy(), table["key"].fill_null(-1).to_numpy()
    table = table.take(pa.array(np.lexsort((key, row))))
    unpacker = zstandard.ZstdDecompressor()
    texts = [None if x is None else unpacker.decompress(x) for x in table["text"].to_pylist()]
    return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


def multiplied(rows: DataFrame, copies: str = "copies", step: int = 1 << 16) -> DataFrame:
    """Each row as often as its copies, which column goes."""
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {step}"))))
    return parts.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(step).cast("bigint"), F.col(copies) - F.col("__part") * step)))).drop("__part", "__n", copies)


def first_bid(table: pa.Table) -> int:
    return table["bid"][0].as_py()
