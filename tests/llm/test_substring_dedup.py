import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from surelake.llm import textblocks as tb
from surelake.llm.substring_dedup import recompress, substring_dedup
from tests.llm.cases import DOCS, awkward, frame, prose


def brute(rows, window):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", r[2] or "") if w] for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((r[1], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if any(gone) else r[2]))
    return out


@pytest.mark.parametrize("window,rounds,block,fan", [(35, 4, 1 << 22, 4096), (35, 3, 3000, 4096), (8, 2, 2000, 4096), (8, 2, 2000, 8), (35, 3, 5000, 3)])
def test_equals_brute_force(spark, window, rounds, block, fan):
    rows = awkward() + [("s", 100 + i, prose(i, 80, 40), "en", 1, 1, "k") for i in range(40)]
    found = substring_dedup(frame(spark, rows), window=window, rounds=rounds, block_bytes=block, bucket_keys=500, fan=fan)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows, window)))


@pytest.fixture
def scattered(spark):
    """Partitions that are not put together again, so that what must meet has to be dealt alike."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_blocks_and_replies_meet(spark, scattered):
    rows = awkward() + [("s", 100 + i, prose(i, 80, 40), "en", 1, 1, "k") for i in range(40)]
    found = substring_dedup(frame(spark, rows), window=8, rounds=2, block_bytes=2000, bucket_keys=500, fan=5)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows, 8)))


def test_carries_columns(spark):
    found = substring_dedup(frame(spark), with_text=False, carry=("lang", "bid", "key"))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "lang", "bid", "key"]
    assert sorted(map(repr, found.select("doc_id", "lang", "bid", "key").collect())) == sorted(map(repr, frame(spark).select("doc_id", "lang", "bid", "key").collect()))


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [], DOCS)).collect() == []


def test_symbols_of_a_window_do_not_depend_on_its_surroundings():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
    core = words[rng.integers(0, 50, 40)]
    seen = []
    for k in range(30):
        around = words[rng.integers(0, 50, 30 + k)]
        text = np.concatenate([around, core, around[::-1]])
        name, at, size, low, high = recompress(text, np.array([0, len(text)]), 4)
        inside = (low >= len(around)) & (high <= len(around) + len(core))
        seen.append({(int(a) - len(around), int(s), int(n)) for a, s, n in zip(at[inside], size[inside], name[inside], strict=True)})
    every = set.intersection(*seen)
    assert every and all(s == seen[0] for s in seen)


def test_words_across_pieces():
    text = ("word " * 100 + "x" * 400_000 + " é" * 300_000).encode()
    data = np.frombuffer(text, np.uint8)
    w = tb.words(data, np.array([0, 7, len(text)]))
    assert [text[a:b] for a, b in zip(w.start, w.end, strict=True)][:2] == [b"word", b"wo"]
    assert len(w.hash) == len(text[:7].split()) + len(text[7:].split())
    assert len(np.unique(w.hash)) == 5  # word, wo, rd, x.., é


def _exchange(texts: int, fan: int) -> tuple[tb.Exchange, dict[int, tb.Keys]]:
    """Blocks of 200 keys each, a tenth of them the same in all, in buckets of 50."""
    rng = np.random.default_rng(texts)
    hot = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    asked = {bid: tb.united(np.concatenate([hot, tb.mix(np.arange(180, dtype=np.uint64) + np.uint64(1000 * bid % 700))]), None)[0] for bid in range(texts)}
    return tb.Exchange(texts, texts * 4, lambda k: k.value, pack_reply=tb.small_counts, unpack_reply=tb.from_small, fan=fan), asked


@pytest.mark.parametrize("fan", [4, 7, 4096])
def test_the_exchange_counts_over_all_blocks(spark, fan):
    way, asked = _exchange(30, fan)
    total = Counter(k for keys in asked.values() for k in keys.a.tolist())
    rows = pa.concat_tables([*(way.ask(bid, k) for bid, k in asked.items()), *(tb.note(bid, b"%d" % bid) for bid in asked)])
    found = way.run(spark.createDataFrame(rows.to_pandas(), tb.REQUEST)).toArrow()
    for bid, keys in asked.items():
        own = found.filter(pc.equal(found["child"], bid))
        assert way.replies(own).tolist() == [total[k] for k in keys.a.tolist()] and tb.noted(own) == b"%d" % bid


def test_one_asker_owns_each_key(spark):
    way, asked = _exchange(20, 4)
    way = tb.Exchange(way.blocks, way.buckets, lambda k: k.value << 1, pack_reply=tb.small_counts, unpack_reply=tb.from_small, fan=4, owned=True)
    found = way.run(spark.createDataFrame(pa.concat_tables([way.ask(bid, k) for bid, k in asked.items()]).to_pandas(), tb.REQUEST)).toArrow()
    owners = Counter(k for bid, keys in asked.items() for k, r in zip(keys.a.tolist(), way.replies(found.filter(pc.equal(found["child"], bid))).tolist(), strict=True) if r & 1)
    assert set(owners) == {k for keys in asked.values() for k in keys.a.tolist()} and set(owners.values()) == {1}


def _rows_of(way: tb.Exchange, asked: dict[int, tb.Keys]) -> list[int]:
    """Rows that are sent at each level."""
    out, rows = [], pa.concat_tables([way.ask(bid, k) for bid, k in asked.items()])
    for level in range(1, way.levels + 1):
        out.append(rows.num_rows)
        if level < way.levels:
            rows = pa.concat_tables([way._merge(rows.filter(pc.equal(rows["node"], n)), level) for n in sorted(set(rows["node"].to_pylist()))])
    return out


def test_the_rows_of_an_exchange_grow_with_the_text():
    """Both the blocks and the buckets grow; their product is never sent."""
    for fan in (8, 16):
        (small, few), (large, many) = ((n, _exchange(n, fan)) for n in (64, 256))
        a, b = sum(_rows_of(*few)), sum(_rows_of(*many))
        assert b / a < 1.6 * large / small and max(_rows_of(*many)) <= fan * large
        assert b < large * many[0].buckets / 4
    direct = _exchange(256, 4096)
    assert sum(_rows_of(*direct)) > 1.5 * sum(_rows_of(*_exchange(256, 8)))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_packing(n):
    rng = np.random.default_rng(n)
    keys, at, first = tb.united(rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 16, n, dtype=np.uint64), rng.integers(0, 400, n))
    for a, b in zip(keys, tb.unpack_plain(tb.pack_plain(keys)), strict=True):
        assert (a == b).all()
    counts = np.array([0, 3, 254, 255, 10**12] * n, np.int64)
    assert (tb.from_small(tb.small_counts(counts)) == counts).all()
    assert (tb.unpack_sorted(tb.pack_sorted(keys.a >> np.uint64(24) << np.uint64(24), 3), 3) == keys.a >> np.uint64(24) << np.uint64(24)).all()


@pytest.mark.parametrize("keyed", [False, True])
def test_a_row_that_is_there_100_000_times_is_one_in_its_block(spark, keyed):
    """The largest block has as many rows as without the copies, and every copy comes out."""
    from surelake.llm import textblocks as tb

    text, others = prose(31, 50), [(i, prose(100 + i, 40)) for i in range(300)]
    rest = spark.createDataFrame(others, "doc_id bigint, text string")
    copies = spark.range(100_000).select(F.lit(7777 if keyed else None).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).repartition(6)
    size = lambda docs, blocks: tb.in_blocks(docs, "doc_id", "text", blocks)[0].groupBy("bid").count().agg({"count": "max"}).first()[0]
    assert size(copies.unionByName(rest), 1 << 22) <= size(rest, 1 << 14) + 1
    found = substring_dedup(copies.unionByName(rest), block_bytes=1 << 22, with_text=False)
    counts = {(r.doc_id is None or r.doc_id == 7777, r.n_words, r.n_removed): r["count"] for r in found.groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert counts[True, 50, 50] == 100_000 and found.where("n_removed = 0").count() == 300


def test_copies_with_other_columns_keep_them(spark):
    text = prose(31, 50)
    rows = [(None, text, "a")] * 3 + [(None, text, "b"), (1, text, None), (2, prose(9, 60), "c")]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), carry=("lang",))
    assert sorted((r.lang or "", r.n_removed) for r in found.collect()) == [("", 50), ("a", 50), ("a", 50), ("a", 50), ("b", 50), ("c", 0)]
