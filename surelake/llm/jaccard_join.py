"""N-gram Jaccard join by a MinHash LSH forest.

1. Each text's set of word n-grams gets a signature of ``depth`` MinHash values for every
   tree. A tree is the texts sorted by signature, a prefix trie laid flat: the texts below a
   prefix are neighbours, and the prefix that two neighbours share tells at which depth
   their paths part. So a tree is written with one row a text: the first text
   below the same branch, and the depth of the branch. Texts with equal words are one node.
2. Matched prefixes are shortened from the full depth on. At each length, the branches of that depth or
   more tie the nodes into candidate components; those that changed since the last
   length are verified, all pairs, on the exact sets.
3. A pair of similarity s meets in one of the trees at length k with probability
   P = 1 - (1 - s**k)**trees. So the pairs found so far estimate how many there are, the sum of 1 / P over
   them. Shortening ends once they are the target recall of that sum; else it goes on at the longest
   prefix that would give it, at the latest that at which a pair at the threshold itself would meet with that probability.
4. Small components are packed into groups, large ones are cut into parts by
   nodes and bytes, and every pair of parts is one group, so that no task holds more than two parts. There,
   counts of shared n-grams are products of 0/1 matrices. Groups return each node's
   number of links, a spanning tree of them and a histogram of their similarities, never the pairs.
5. The classes of a component that one group verified are whole; trees of the others are grown into classes.

A node is named by a 64-bit hash of its words; the words themselves are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb
from surelake.llm.components import components
from surelake.llm.shared import apart, forget, repeated, stored

_SIGNED = "row bigint, doc_id bigint, n_words bigint, octets bigint, node bigint, paths binary"
_NEIGHBOURS = "u bigint, v bigint, depth int, path binary"
_VERIFIED = "comp bigint, node bigint, other bigint, links bigint, bin int, pairs bigint, large boolean"
_BINS = 20


def meets(similarity: float | np.ndarray, length: int, trees: int):
    """The probability that a pair shares a prefix of that length in one of the trees."""
    return 1 - (1 - similarity**length) ** trees


def shortest(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix with which a pair at the threshold meets with the target recall: none shorter is ever asked for."""
    return next((k for k in range(depth, 1, -1) if meets(threshold, k, trees) >= recall), 1)


def estimated_recall(pairs: dict[int, int], threshold: float, length: int, trees: int) -> float:
    """Of all pairs, the part that was found, from the found pairs by bin of similarity, each taken at its lower edge. None found: 0."""
    found = sum(pairs.values())
    every = sum(n / meets(threshold + b * (1 - threshold) / _BINS, length, trees) for b, n in pairs.items())
    return found / every if found else 0.0


def next_length(pairs: dict[int, int], threshold: float, recall: float, length: int, least: int, trees: int) -> int:
    """The length to go on with: ``length`` if the recall is reached there, else the longest shorter one that would reach it for pairs like these."""
    return next((k for k in range(length, least, -1) if estimated_recall(pairs, threshold, k, trees) >= recall), least)


def shingles(w: tb.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-grams, repeats included, and where each document's begin. A shorter text is one n-gram."""
    size = np.diff(w.first)
    many = np.maximum(size - n + 1, (size > 0).astype(np.int64))
    first = np.append(0, np.cumsum(many))
    at = np.repeat(w.first[:-1] - first[:-1], many) + np.arange(first[-1])
    grams = tb.runs_of(w.hash, n, 31)
    short = np.flatnonzero((size > 0) & (size < n))
    out = np.zeros(len(at), tb.U)
    long = np.repeat(size >= n, many)
    out[long] = grams[at[long]]
    for d in short.tolist():
        words = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = tb.runs_of(words, len(words), 31 + len(words))[0]
    return out, first


def signatures(grams: np.ndarray, first: np.ndarray, functions: int, piece: int = 1 << 15) -> np.ndarray:
    """MinHash of each document, uint32 [documents, functions]; all ones where there is no n-gram."""
    docs = len(first) - 1
    out = np.full((docs, functions), 0xFFFFFFFF, np.uint32)
    factors = np.random.default_rng(41).integers(0, 1 << 63, functions, dtype=np.uint64) * tb.U(2) + tb.U(1)
    some = np.flatnonzero(np.diff(first) > 0)
    p = 0
    while p < len(some):  # documents of about a piece of n-grams; a longer one piece by piece
        q = max(p + 1, int(np.searchsorted(first[some], first[some[p]] + piece)))
        lo, hi = int(first[some[p]]), int(first[some[q - 1] + 1])
        for a in range(lo, hi, piece) if q == p + 1 else (lo,):
            part = grams[a : min(a + piece, hi)] if q == p + 1 else grams[lo:hi]
            starts = np.zeros(1, np.int64) if q == p + 1 else first[some[p:q]] - lo
            for f in range(functions):
                least = np.minimum.reduceat(((part * factors[f]) >> tb.U(32)).astype(np.uint32), starts)
                out[some[p:q], f] = np.minimum(out[some[p:q], f], least)
        p = q
    return out


def whole_hash(w: tb.Words) -> np.ndarray:
    """A hash of each document's word sequence."""
    size = np.diff(w.first)
    out = np.zeros(len(size), tb.U)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], size)
    some = np.flatnonzero(size > 0)
    if len(some):
        out[some] = np.add.reduceat(tb.mix(w.hash, 51) * tb.powers(tb._BASE, int(size.max()))[place], w.first[some])
    return tb.mix(out + size.astype(tb.U) * tb._C1)


def _sign(trees: int, depth: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.sliced(batches, "text"):
            data, bounds = tb.text_buffer(batch.column("text"))
            w = tb.words(data, bounds, tb.SPACED, tb.LOWER)
            size = np.diff(w.first)
            # 16 bits of each value, the high ones first, so that paths sort as bytes
            paths = (tb.mix(signatures(*shingles(w, n), trees * depth).astype(tb.U), 61) >> tb.U(48)).astype(">u2")
            node = np.where(size > 0, whole_hash(w).view(np.int64), batch.column("row").to_numpy())
            rows = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": size, "octets": np.diff(bounds), "node": node, "paths": [x.tobytes() if s else None for x, s in zip(paths, size, strict=True)]}
            yield from tb.table_of(_SIGNED, rows).to_batches()

    return run


def _unpack(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                paths = b"".join(part.column("paths").to_pylist())
                width = len(paths) // max(part.num_rows * trees, 1)
                node = np.repeat(part.column("node").to_numpy(), trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(node), [None, pa.py_buffer(paths)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(tree), path, pa.array(node)], ["tree", "path", "node"])

    return run


def shared_depth(paths: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How many values each path [nodes, depth] shares with the one before; 0 across trees."""
    same = paths[1:] == paths[:-1]
    same &= (trees[1:] == trees[:-1])[:, None]
    return np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)


def branches(depth: np.ndarray, node: np.ndarray, begun: dict[int, int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, first node of the run of rows that share as much, depth) of each row that shares ``least`` values or more with the one before.

    ``begun`` has, for each depth, the first node of the run that the rows before end with, and is brought up to date.
    """
    u, v, d = [], [], []
    place = np.arange(len(depth))
    for k in range(least, int(depth.max(initial=0)) + 1):
        at = np.maximum.accumulate(np.where(depth < k, place, -1))
        rows = np.flatnonzero(depth == k)
        first = np.where(at[rows] >= 0, node[at[rows]], begun.get(k, 0))
        keep = first != node[rows]
        u.append(node[rows][keep])
        v.append(first[keep])
        d.append(np.full(int(keep.sum()), k))
    for k in begun:
        parted = np.flatnonzero(depth < k)
        if len(parted):
            begun[k] = int(node[parted[-1]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v, d))


def _neighbours(least: int, ends: bool):
    """(u, v, depth) of the branches in sorted rows. With ``ends``, also the first and the last row: (node, null, tree, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            paths = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u2").reshape(len(node), -1)
            first = [(int(node[0]), int(tree[0]), paths[0].tobytes())] if ends and last is None else []
            if last is None:
                begun = {k: int(node[0]) for k in range(least, paths.shape[1] + 1)}
                depth = np.append(0, shared_depth(paths, tree))
            else:
                depth = shared_depth(np.concatenate([last[2], paths]), np.append(last[0], tree))
            last = tree[-1:], node[-1:], paths[-1:]
            yield _ties(*branches(depth, node, begun, least), first)
        if ends and last is not None:
            none = np.zeros(0, np.int64)
            yield _ties(none, none, none, [(int(last[1][0]), int(last[0][0]), last[2][0].tobytes())])

    return run


def _ties(u: np.ndarray, v: np.ndarray, depth: np.ndarray, ends: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    rows = {"u": [*u.tolist(), *(e[0] for e in ends)], "v": [*v.tolist(), *(None for _ in ends)], "depth": [*depth.tolist(), *(e[1] for e in ends)], "path": [*(None for _ in u), *(e[2] for e in ends)]}
    return pa.RecordBatch.from_arrays([pa.array(rows["u"], pa.int64()), pa.array(rows["v"], pa.int64()), pa.array(rows["depth"], pa.int32()), pa.array(rows["path"], pa.binary())], list(rows))


def forest(signed: DataFrame, trees: int, least: int) -> DataFrame:
    """(u, v, depth): of every tree, each node with the first one below the branch of ``least`` values or more that it parts from, and the branch's depth.

    The rows are sorted by range, so a prefix that a third of all texts share takes as many tasks as its texts need; the ends
    of the sorted partitions are neighbours too, and are tied in one more look at two rows a partition.
    """
    nodes = signed.where("n_words > 0").select("node", "paths").distinct()
    rows = nodes.mapInArrow(_unpack(trees), "tree int, path binary, node bigint")
    order = ["tree", "path", "node"]
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(least, True), _NEIGHBOURS))
    ends = found.where("v IS NULL").select(F.col("depth").alias("tree"), "path", F.col("u").alias("node")).coalesce(1).sortWithinPartitions(*order)
    across = ends.mapInArrow(_neighbours(least, False), _NEIGHBOURS)
    return found.where("v IS NOT NULL").unionByName(across).select("u", "v", "depth")


def similarities(a: np.ndarray, b: np.ndarray | None, grams: list[np.ndarray], threshold: tuple[int, int], dims: int = 1024, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets a, or of a (rows) and b (columns), reach the threshold: a boolean matrix, exact; and how many linked pairs each bin of similarity has.

    Whole matrices are of 32-bit numbers at most; what needs wider ones is done some rows at a time.
    """
    every = a if b is None else np.concatenate([a, b])
    m, n = len(a), len(every)
    size = np.array([len(grams[i]) for i in every], np.int64)
    keys, column = np.unique(np.concatenate([grams[i] for i in every]), return_inverse=True)
    often = np.bincount(column, minlength=len(keys)) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(n), size)
    use = often[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, m), slice(0, m)) if b is None else (slice(0, m), slice(m, n))
    shared = np.zeros((m, m if b is None else n - m), np.int32)
    for lo in range(0, int(often.sum()), dims):
        s, e = np.searchsorted(column, [lo, lo + dims])
        part = np.zeros((n, min(dims, int(column[e - 1]) - lo + 1) if e > s else 0), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        for k in range(0, m, rows):  # whole numbers up to dims, which float32 has
            shared[k : k + rows] += (part[left][k : k + rows] @ part[right].T).astype(np.int32)
    up, down = threshold
    low = up / down
    link, bins = np.zeros(shared.shape, bool), np.zeros(_BINS, np.int64)
    for k in range(0, m, rows):
        both = shared[k : k + rows].astype(np.int64)
        either = size[left][k : k + rows, None] + size[right][None, :] - both
        hit = down * both >= up * either
        if b is None:
            hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = False
        link[k : k + rows] = hit
        once = np.triu(hit, k + 1) if b is None else hit
        found = both[once] / np.maximum(either[once], 1)
        bins += np.bincount(np.minimum(((found - low) / max(1 - low, 1e-9) * _BINS).astype(np.int64), _BINS - 1), minlength=_BINS)
    return link, bins


def _least(link: np.ndarray, label: np.ndarray, none: int, rows: int = 256) -> np.ndarray:
    """Of each row, the smallest label of the columns that it is linked to."""
    return np.concatenate([np.where(link[k : k + rows], label[None, :], none).min(axis=1, initial=none) for k in range(0, len(link), rows)]) if len(link) else np.zeros(0, np.int64)


def _classes(link: np.ndarray, square: bool) -> np.ndarray:
    """The smallest member of each member's component. Members are the rows, and then the columns unless they are the same."""
    m = len(link)
    n = m if square else m + link.shape[1]
    label = np.arange(n)
    while True:
        near = _least(link, label, n) if square else np.concatenate([_least(link, label[m:], n), _least(link.T, label[:m], n)])
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _counts(link: np.ndarray, weight: np.ndarray, rows: int = 256) -> np.ndarray:
    """Of each row, the weights of the columns that it is linked to, added up."""
    return np.concatenate([link[k : k + rows] @ weight for k in range(0, len(link), rows)]) if len(link) else np.zeros(0, np.int64)


def verify(rows: pa.Table, n: int, threshold: tuple[int, int]) -> pa.Table:
    """Links of a group of components, or of the pair of parts (i, j) of one."""
    out: dict[str, list] = {c.split()[0]: [] for c in _VERIFIED.split(", ")}
    rows = rows.take(pa.array(np.lexsort((rows["node"].to_numpy(), rows["comp"].to_numpy()))))
    node, comp, part, docs = (rows[c].to_numpy() for c in ("node", "comp", "part", "docs"))
    data, bounds = tb.text_buffer(rows["text"])
    w = tb.words(data, bounds, tb.SPACED, tb.LOWER)
    every, first = shingles(w, n)
    once = np.ones(len(node), bool)
    once[1:] = node[1:] != node[:-1]  # repeated rows bring a node's text again
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    starts = np.flatnonzero(np.append(True, comp[1:] != comp[:-1]))
    for lo, hi in zip(starts, np.append(starts[1:], len(comp)), strict=True):
        at = lo + np.flatnonzero(once[lo:hi])
        grams = {k: np.unique(every[first[k] : first[k + 1]]) for k in at.tolist()}
        if i == j:
            link, bins = similarities(at, None, grams, threshold)
            links = _counts(link, docs[at])
        else:
            here, there = at[part[at] == i], at[part[at] == j]
            if not len(here) or not len(there):
                continue
            link, bins = similarities(here, there, grams, threshold)
            links = np.concatenate([_counts(link, docs[there]), _counts(link.T, docs[here])])
            at = np.concatenate([here, there])
        label = _classes(link, i == j)
        tied = np.flatnonzero(label != np.arange(len(at)))
        some = np.flatnonzero(bins)
        a, z = at[tied], np.zeros(len(tied), np.int64)
        out["node"] += [node[a], node[at], np.zeros(len(some), np.int64)]
        out["other"] += [node[at[label[tied]]], node[at], np.zeros(len(some), np.int64)]
        out["links"] += [z, links.astype(np.int64), np.zeros(len(some), np.int64)]
        out["bin"] += [np.full(len(tied) + len(at), -1), some]
        out["pairs"] += [np.zeros(len(tied) + len(at), np.int64), bins[some]]
        out["comp"].append(np.full(len(tied) + len(at) + len(some), comp[lo]))
        out["large"].append(np.full(len(tied) + len(at) + len(some), rows["large"][0].as_py()))
    return tb.table_of(_VERIFIED, {c: np.concatenate(v) if v else [] for c, v in out.items()})


def one_text(picked: DataFrame, signed: DataFrame) -> DataFrame:
    """(row, text) of each row once, however often it is there; of those that repeat, each task sends one."""
    keys, n = repeated(signed.select("row"), "row")
    rows = picked.select("row", "text")
    if not n:
        return rows
    once, twice = apart(rows, "row", keys, n)
    return once.unionByName(twice.groupBy("row", "text").agg(F.count("*").alias("n")).drop("n"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9995, trees: int = 16, depth: int = 10, part_nodes: int = 2048, part_bytes: int = 16 << 20, group_bytes: int = 4 << 20) -> DataFrame:
    """Texts whose sets of n-word shingles have a Jaccard similarity of ``threshold`` or more are linked.

    Words are blank-separated, with A-Z lower-cased; a text of fewer than n words is one shingle. Returns a row for each row
    of ``docs``: doc_id (null stays null), class_id (the smallest doc_id that a chain of links leads to), copy_id (the
    smallest doc_id of the rows with the same words), n_links (other rows that it is linked to, copies included),
    n_words, row (a hash of doc_id and text) and root (a number of the class). Null and blank texts have no links and are their own class; classes
    without any doc_id have a null class_id. A text of any length is read whole. An empty table gives none; other columns
    are not read. ``recall`` is the part of all linked pairs at which prefixes are no more shortened; components that take
    more than 60 rounds to settle, which needs chains beyond 2**30, stop the query.
    """
    low = threshold[0] / threshold[1]
    least = shortest(low, recall, trees, depth)
    row = F.xxhash64(F.col(key), F.col(text))
    picked = docs.select(row.alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    signed = stored(picked.mapInArrow(_sign(trees, depth, n), _SIGNED))
    single = one_text(picked, signed)
    nodes = signed.groupBy("node").agg(F.count("*").alias("docs"), F.min("doc_id").alias("copy_id"), F.min("row").alias("row"), F.max("octets").alias("octets"))
    ties = stored(forest(signed, trees, least))

    groups = max(1, total // group_bytes)
    pair = lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j"))
    grown = verified = known = last_sizes = None
    length, before = depth, depth + 1
    while True:
        new, last = ties.where((F.col("depth") >= length) & (F.col("depth") < before)).select("u", "v"), grown
        grown = components(new if grown is None else new.unionByName(grown))
        forget(last)
        members = grown.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(grown.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        placed = members.join(nodes, "node")
        sizes = stored(placed.groupBy("comp").agg(F.count("*").alias("size"), F.sum("octets").alias("octets")))
        fresh = sizes if known is None else sizes.join(known, ["comp", "size"], "left_anti")  # a component only grows, so of one size it is the same
        parts = F.greatest(F.ceil(F.col("size") / part_nodes), F.ceil(F.col("all_octets") / part_bytes)).cast("int")
        cut = placed.join(fresh.select("comp", "size", F.col("octets").alias("all_octets")), "comp").select("node", "comp", "docs", "row", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        texts = single.join(cut, "row")
        spread = texts.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)))
        own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.col("comp"))
        dealt = spread.select(own.alias("own"), (F.col("parts") > 1).alias("large"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "comp", "part", "node", "docs", "text")
        found = stored(dealt.groupBy("own", "large", "i", "j").applyInArrow(lambda rows: verify(rows, n, threshold), _VERIFIED))
        if verified is not None:  # components that grew or went into others are verified anew
            before_that, verified = verified, stored(verified.join(fresh.select("comp"), "comp", "left_anti").join(sizes.select("comp"), "comp", "left_semi").unionByName(found))
            forget(before_that, found, last_sizes)
        else:
            verified = found
        last_sizes, known = sizes, sizes.select("comp", "size")
        pairs = {r.bin: r.n for r in verified.where("bin >= 0").groupBy("bin").agg(F.sum("pairs").alias("n")).collect()}
        before, length = length, next_length(pairs, low, recall, length, least, trees)
        if length == before:
            break

    forget(ties, last_sizes, grown)
    verified = verified.where("bin < 0")
    tied = verified.where("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v"), "large")
    roots = tied.where("NOT large").drop("large").unionByName(components(tied.where("large").drop("large")))  # one group's classes are whole
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(roots, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("v", "node")).join(links, "node", "left")
    named = named.select("node", "root", "docs", "copy_id", F.coalesce("links", F.lit(0)).alias("links"))
    smallest = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    facts = named.join(smallest, "root").select("node", "root", "class_id", "copy_id", (F.col("links") + F.col("docs") - 1).alias("n_links"))
    return signed.drop("paths", "octets").join(facts, "node").select("doc_id", "class_id", "copy_id", F.when(F.col("n_words") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), "n_words", "row", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, the row with its smallest doc_id stays, once.

    In a class without any doc_id, and of rows with equal doc_id and text, one stays. All null or blank texts stay, but
    rows that repeat one doc_id with such a text stay once.
    """
    found = near_duplicates(docs, key, text, **options)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("__stays"))
    marked = docs.withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    keys, n = repeated(found.select("row"), "row")
    if n:
        once, twice = apart(marked, "__row", keys.withColumnRenamed("row", "__row"), n)
        marked = once.unionByName(twice.dropDuplicates(["__row"]))
    return marked.join(stays.select("__stays"), F.col("__row") == F.col("__stays")).select(docs.columns)


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
t AS (SELECT *, array_to_string(w, ' ') AS words FROM d),
c AS (SELECT words, any_value(w) AS w, count(*) AS docs, min(doc_id) AS copy_id FROM t WHERE len(w) > 0 GROUP BY words),
n AS (SELECT row_number() OVER (ORDER BY copy_id, words) AS k, * FROM c),
g AS (SELECT DISTINCT k, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT k, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM n)),
z AS (SELECT k, count(*) AS size FROM g GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 5 * shared >= 4 * (x.size + y.size - shared)),
reach AS (SELECT k AS a, k AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS k, min(n.copy_id) AS class_id FROM reach JOIN n ON n.k = reach.b GROUP BY reach.a),
l AS (SELECT e.a AS k, CAST(sum(n.docs) AS BIGINT) AS links FROM e JOIN n ON n.k = e.b GROUP BY e.a)
SELECT t.doc_id, coalesce(m.class_id, t.doc_id) AS class_id, coalesce(n.copy_id, t.doc_id) AS copy_id, CASE WHEN len(t.w) = 0 THEN 0 ELSE coalesce(l.links, 0) + n.docs - 1 END AS n_links, CAST(len(t.w) AS BIGINT) AS n_words
FROM t LEFT JOIN n ON n.words = t.words AND len(t.w) > 0 LEFT JOIN m ON m.k = n.k LEFT JOIN l ON l.k = n.k
"""
