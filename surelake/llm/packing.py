"""Best-fit packing of documents into sequences of fixed length, planned on a histogram of lengths.

A document is its token ids and an end id; only those longer than a sequence are cut, into full pieces and a rest. Each task
that tokenises numbers its pieces within each length as it writes them, so a piece's rank among all pieces of its
length is that number plus the pieces of that length in the tasks before, which is a sum over counts. The driver gets the
histogram, at most one count for each length, and plans by best fit, longest first, over counts: a *run* is
a number of sequences with equal contents, and a step puts as many pieces of one length as fit into each of a run's
sequences. So the plan's size depends on the length of a sequence alone. Pieces take
their slots by a join on length and rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb
from surelake.llm.shared import stored

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
_KINDS = {"piece": pa.int32(), "task": pa.int32(), "ids": pa.list_(pa.int32())}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MOST_CACHED = 1 << 20  # chunks of text that a worker keeps ids of
_LONG = 1 << 22  # characters or bytes of a text that are split at once


class Step(NamedTuple):
    """``pieces`` pieces of one length, from rank ``rank`` on, go into sequences from ``first`` on, ``each`` in every one (the last may get fewer), from ``offset`` on."""

    length: int
    rank: int
    pieces: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """Best fit, longest first, over a histogram of lengths up to ``capacity``; also how many sequences it takes.

    A length goes where the least room is left that holds it, and into new sequences if there is none. A length
    splits at most two runs and opens at most two, and a run is filled past half of its room by each step into it, so there are at most
    about 4 * capacity runs and log2(capacity) + 1 steps into each.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    steps, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens fits into no sequence of {capacity}")

        def fill(first: int, many: int, space: int, length=length) -> None:
            """Puts pieces into some sequences with that much space; what they leave, and sequences that got none, stay open."""
            nonlocal left, rank
            each = space // length
            full, rest = min(many, left // each), 0
            taken = full * each
            if full < many and left > taken:
                rest = left - taken  # fewer than ``each``, into one more
                taken = left
            steps.append(Step(length, rank, taken, first, each, capacity - space))
            if full:
                room[space - each * length].append((first, full))
            if rest:
                room[space - rest * length].append((first + full, 1))
            if (used := full + (rest > 0)) < many:
                room[space].append((first + used, many - used))
            left, rank = left - taken, rank + taken

        for space in range(length, capacity + 1):
            if not left:
                break
            open_now, room[space] = room[space], []
            for first, many in open_now:
                if left:
                    fill(first, many, space)
                else:
                    room[space].append((first, many))
        if left:
            many = -(-left // (capacity // length))
            opened += many
            fill(opened - many, many, capacity)
    return steps, opened


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ends(path: str) -> np.ndarray:
    """By id, whether a token ends a word; all false where the vocabulary does not tell."""
    found = json.loads(_tokenizer(path).to_str())["model"]
    suffix, vocabulary = found.get("end_of_word_suffix"), found.get("vocab", {})
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    if suffix and isinstance(vocabulary, dict):
        out[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return out


def _encoded(path: str, chunks: list[str], at_once: int = 64) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks in another order, how many ids each has, and all their ids.

    A call for each would cost more than the work, so chunks of letters alone, which are one word, go together by lines and
    are told apart by where words end.
    """
    order, sizes, flat = [], [], []
    plain = [c for c in chunks if _LETTERS.fullmatch(c)]
    alone = [c for c in chunks if not _LETTERS.fullmatch(c)]
    groups = [plain[p : p + at_once] for p in range(0, len(plain), at_once)]
    ends = _ends(path)
    for group, e in zip(groups, _tokenizer(path).encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) == len(group) and len(ids) == cuts[-1]:
            order += group
            sizes.append(np.diff(cuts, prepend=0))
            flat.append(ids)
        else:  # words end otherwise with this tokenizer
            alone += group
    found = [e.ids for e in _tokenizer(path).encode_batch_fast(alone, add_special_tokens=False)]
    sizes.append(np.array([len(x) for x in found], np.int64))
    flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
    return order + alone, np.concatenate(sizes), np.concatenate(flat)


class _Known:
    """What a worker has tokenised: chunks, each with its place in one array of ids."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.flat, self.used, self.kept = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0

    def places(self, chunks: list[str]) -> np.ndarray:
        if len(self.place) > _MOST_CACHED:
            self.clear()
        new = list(dict.fromkeys(c for c in chunks if c not in self.place))
        if new:
            new, sizes, ids = _encoded(self.path, new)
            ends = self.used + np.cumsum(sizes)
            n = self.kept
            while len(self.begin) < n + len(new) + 1:
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            while len(self.flat) < ends[-1]:
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : ends[-1]] = ids
            self.begin[n + 1 : n + len(new) + 1] = ends
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            self.used, self.kept = int(ends[-1]), n + len(new)
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))


_known: dict[str, _Known] = {}


def by_chunks(path: str, lower: bool = True) -> Callable[[pa.StringArray], list[np.ndarray]]:
    """A tokenizer's ids of each text, for one that drops white space and looks at nothing across it or across a letter and a point or comma, as word_bpe_49k.json.

    Texts are split there, and a worker keeps the ids of the chunks that it has met. The result is that of the
    whole text; a text of any length is held as its chunks and ids only, never as a tokenizer's own encoding. ``lower``: it lower-cases.
    """

    def short(texts: pa.StringArray) -> list[np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, "([A-Za-z])([,.;:!?])", "\\1 \\2"))
        coded = parts.flatten().dictionary_encode()
        known = _known.setdefault(path, _Known(path))
        # The tokenizer lower-cases; of words of ASCII letters that can be done before it, so that one look-up serves both.
        words = [c.lower() if c.isascii() and c.isalpha() else c for c in coded.dictionary.to_pylist()] if lower else coded.dictionary.to_pylist()
        at = known.places(words)[coded.indices.to_numpy()]
        many = known.begin[at + 1] - known.begin[at]
        total = np.concatenate([[0], np.cumsum(many)])
        out = known.flat[np.arange(total[-1]) + np.repeat(known.begin[at] - total[:-1], many)]
        ends = total[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(texts: pa.StringArray) -> list[np.ndarray]:
        if (pc.max(pc.binary_length(texts)).as_py() or 0) <= _LONG:
            return short(texts)
        found = []
        for text in texts.to_pylist():
            cuts = [0]
            while cuts[-1] < len(text):
                q = text.find(" ", cuts[-1] + _LONG)
                cuts.append(len(text) if q < 0 else q)
            found.append(np.concatenate([*(short(pa.array([text[a:b]]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.zeros(0, np.uint32)]))
        return found

    return encode


def whole(path: str) -> Callable[[pa.StringArray], list[np.ndarray]]:
    """Any tokenizer's ids of each text, by the tokenizer itself."""
    return lambda texts: [np.array(_tokenizer(path).encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]


def pieces(docs: DataFrame, encode: Callable[[pa.StringArray], list[np.ndarray]], key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, the task that made it and its number among those of its length there.

    The numbers hold only within one evaluation: write the table before it is read twice.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in tb.sliced(batches, 1):
            found: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            texts = pc.fill_null(batch.column(1), "")
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    found["doc_id"].append(doc)
                    found["piece"].append(n)
                    found["start"].append(start)
                    found["length"].append(len(part))
                    found["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    found["task"].append(task)
                    found["nth"].append(int(seen[len(part)]))
                    seen[len(part)] += 1
                    if with_ids:
                        found["ids"].append(part.astype(np.int32))
            yield pa.RecordBatch.from_pydict({c: pa.array(x, _KINDS.get(c, pa.int64())) for c, x in found.items()})

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, encode: Callable[[pa.StringArray], list[np.ndarray]], key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Places every row of ``docs`` in as few sequences of at most ``capacity`` tokens as best fit, longest first, needs.

    Returns per piece doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32 (of the ids as
    little-endian 32-bit words), sequence_id (from 0) and offset (its place there, without gaps from 0), and ids with
    ``with_ids``. Only a document longer than a sequence is cut. A null or empty text is its end id alone; rows without doc_id
    and repeated rows are packed one by one; which of several pieces of equal length gets which slot depends on the order in which
    tasks wrote them. An empty table gives none; other columns are not read. A worker holds a batch of about 4 MB of text, or one longer text.
    """
    if end < 0 or capacity < 1:
        raise ValueError("a sequence holds at least one token, and ids are not negative")
    cut = stored(pieces(docs, encode, key, text, capacity, end, with_ids))
    sizes = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stored(sizes.select("length", "task", "n", F.coalesce(before, F.lit(0)).cast("bigint").alias("before")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    steps, _ = plan(counts, capacity)
    planned = docs.sparkSession.createDataFrame(steps, "length bigint, rank bigint, pieces bigint, first bigint, each bigint, room bigint")
    ranked = cut.join(sizes.drop("n"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).alias("p")
    nth = F.col("p.rank") - F.col("s.rank")
    placed = ranked.join(F.broadcast(planned.alias("s")), (F.col("p.length") == F.col("s.length")) & nth.between(0, F.col("pieces") - 1))  # the plan's size is bounded by the capacity
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first") + F.expr("(p.rank - s.rank) div each")).alias("sequence_id"), (F.col("room") + nth % F.col("each") * F.col("p.length")).alias("offset"), *(["ids"] if with_ids else []))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, ids in order, and docs, a list of (doc_id, piece, offset)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.piece.alias("piece"), p.offset.alias("offset"))).alias("docs"))
