"""Spelling variants: words at edit distance one, by a trie self-join with active-node sets.

Two words at distance one agree before the place where they differ and after it. That place lies in the first
half of the shorter word, and then the second halves agree, or in the second half, and then the first halves do. So each
word goes to the partitions of its halves, one set for pairs with words of its length and longer ones, one for shorter ones:
a partition is a prefix (or suffix) of the vocabulary's trie and what lies below it. One that holds too many words is
halved again where its words may still differ, and so on; when that is a single place, a partition has no more words
than letters and pairs of letters. No partition is skipped or cut off.

In a partition, the parts of words that may differ form a trie. Down the trie goes, for each node, the set of nodes whose
strings are at distance one from its own, made from its parent's set alone. A word's end that has other words' ends in
its set has found its neighbours. A pair is reported only where its leftmost difference lies in the partition's range, so once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surelake.llm.shared import forget, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]"
_FOUND = "word string, n_near bigint, form_n bigint, form string"
_MOST_BROADCAST = 1 << 20  # keys of 8 bytes


def _upper_lower() -> tuple[str, str]:
    upper = "".join(map(chr, range(65, 91)))
    return upper, upper.lower()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, with at least that many code points and occurrences.

    A run whose crc32 with its document's key is divisible by ``every`` loses the code point at that number modulo its length. A null key
    counts as an empty one; null texts have no runs. Runs are counted on each task before they are shuffled.
    """
    lower = F.translate(F.col(text).cast("string"), *_upper_lower())
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.split(lower, f"{RUN.replace('[', '[^')}+")).alias("run")).where(F.length("run") >= min_length)
    h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_places(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of every two distinct words at edit distance one, in both orders, by active-node sets down their trie."""
    below: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, w in enumerate(words):
        node = 0
        for c in w:
            child = below[node].get(c)
            if child is None:
                child = below[node][c] = len(below)
                below.append({})
                ends.append(-1)
            node = child
        ends[node] = i
    todo = [(0, set(below[0].values()))]
    while todo:
        node, active = todo.pop()
        if ends[node] >= 0:
            for a in active:
                if ends[a] >= 0:
                    yield ends[node], ends[a]
        children = below[node]
        for c, q in children.items():
            found = {node, *children.values(), *below[q].values()}  # a letter less, another letter, a letter more
            for a in active:  # the difference is behind already
                b = below[a].get(c)
                if b is not None:
                    found.add(b)
            found.discard(q)
            todo.append((q, found))


def _partition(rows: list[tuple], m: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
    """For each word of (word, n) with neighbours here: how many, and the one of largest n (on a tie the first in code-point order)."""
    tail = max(0, m - hi - 1)
    parts: dict[tuple[str, str], list[tuple[str, str, int]]] = {}
    for word, n in rows:
        end = len(word) - tail
        parts.setdefault((word[:lo], word[end:]), []).append((word[lo:end], word, n))
    for found in parts.values():  # one, but for a collision of keys
        if len(found) == 1:
            continue
        best: dict[int, list] = {}
        middles = [x[0] for x in found]
        for i, j in near_places(middles):
            a, b = middles[i], middles[j]
            _, u, nu = found[i]
            _, v, nv = found[j]
            if len(u) > m and len(v) > m:
                continue  # of the next length
            same, most = 0, min(len(a), len(b))
            while same < most and a[same] == b[same]:
                same += 1
            if lo + same > hi:
                continue  # of the right half
            mine = best.get(i)
            if mine is None:
                best[i] = [1, nv, v]
            else:
                mine[0] += 1
                if nv > mine[1] or nv == mine[1] and v < mine[2]:
                    mine[1:] = nv, v
        for i, (count, n, v) in best.items():
            yield found[i][1], count, n, v


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions lie one after the other; each is held as a whole, and no two."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "m", "lo", "hi", "word", "n")), strict=True)

    out: list[tuple] = []
    for (_, m, lo, hi), group in groupby(rows(), key=lambda r: r[:4]):
        words = [r[4:] for r in group]
        if len(words) > 1:
            out += _partition(words, m, lo, hi)
        if len(out) > 20000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["word", "n_near", "form_n", "form"])


def _keyed(rows: DataFrame) -> DataFrame:
    """The partition's key: the range of places, and what all its words share before and after it."""
    tail = F.greatest(F.lit(0), F.col("m") - F.col("hi") - 1)
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail)))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.expr("(lo + hi + 1) div 2").cast("int")
    sides = F.array(F.struct(F.col("lo").alias("lo"), (middle - 1).alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.lo", "s.hi"))


def partitions(words: DataFrame, min_length: int, most: int) -> list[DataFrame]:
    """(word, n, m, lo, hi, key): m is the shorter length of a pair, lo to hi the places where it may differ first."""
    shorter = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= min_length)
    todo = _halved(words.select("word", "n", F.explode(shorter).alias("m")).select("*", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    done: list[DataFrame] = []
    while True:
        large = stored(todo.where("lo < hi").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key"))
        count = large.count()
        if not count:
            forget(large)
            return [*done, todo]
        keys = F.broadcast(large) if count <= _MOST_BROADCAST else large
        done.append(todo.join(keys, "key", "left_anti").select(*todo.columns))
        todo = stored(_halved(todo.join(keys, "key", "left_semi").select("word", "n", "m", "lo", "hi")))


def neighbours(words: DataFrame, min_length: int = 6, most: int = 20_000) -> DataFrame:
    """(word, n_near, form_n, form) of each word of (word, n) with others at edit distance one: how many, and the one of largest n (on a tie the first in code-point order)."""
    rows = None
    for part in partitions(words, min_length, most):
        rows = part if rows is None else rows.unionByName(part)
    found = rows.repartition("key").sortWithinPartitions("key", "m", "lo", "hi").select("key", "m", "lo", "hi", "word", "n").mapInArrow(_joined, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): what one comes to by following (word, form) to the last, by doubling. Each step's n grows fivefold or so, hence few rounds."""
    step, last = stored(forms.select("word", F.col("form").alias("root"))), None
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        forget(last)
        last, step = step, moved.select("word", "root")
        step._stored = moved._stored
        if not moved.where("on").limit(1).count():
            return step


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199, times: int = 5, most: int = 20_000) -> DataFrame:
    """Every word of ``vocabulary`` with its n, n_near (words at edit distance one), form, form_n and root.

    The form is the near word of largest n (on a tie the first in code-point order) if that is at least ``times`` the word's n, else null,
    and so is form_n; the root is the last word on the way from form to form, the word itself if it has none. ``times`` is above 1, so no way is a circle.
    Null, blank and letterless texts have no words; repeated rows count each time; an empty table gives none; other columns are not read.
    A partition's words, at most about ``most`` or 8,200, are held at once; a word of any length is.
    """
    if times <= 1 or min_length < 1:
        raise ValueError("times is above 1 and words have a letter at least")
    words = stored(vocabulary(docs, key, text, min_length, min_count, every))
    near = words.join(neighbours(words, min_length, most), "word", "left")
    is_form = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    forget(words)
    return near.join(_roots(near.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The crc32 of a text of code points up to 255, from a table made by its rule.
_TABLE = "list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))"
_BYTES = "flatten(list_transform(string_split(k, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 | (unicode(s) >> 6) AS BIGINT), CAST(128 | (unicode(s) & 63) AS BIGINT)] END))"
ORACLE_SQL = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{_upper_lower()[0]}', '{_upper_lower()[1]}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
seen AS (SELECT d, w, d || ':' || w AS k, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY d, w),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM seen, (SELECT {_TABLE} AS crc) t),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, min_by(near, (-m, near)) AS form, max(m) AS form_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way w USING (word) JOIN forms l ON l.word = w.at AND l.form IS NULL"""
