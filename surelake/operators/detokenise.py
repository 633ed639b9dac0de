"""Text from token ids by a join with a vocabulary table, and the places of tokens in it by running sums.

A vocabulary is (id, piece, special) with pieces of bytes. Positions of all rows are joined with it, a row's pieces are put
together in order, and the code points that begin before a token give its offset; a token that begins within a character starts where
that does. All of it is relational: nothing depends on a tokenizer but the table.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "id bigint, piece binary, special boolean"
_MOST_BROADCAST = 1 << 20  # rows of a vocabulary


def byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write for bytes: printable ones stand for themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary of a byte-level tokenizer's JSON file; added tokens are their own text."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    signs = byte_signs()
    added = {t["id"]: t for t in found.get("added_tokens", [])}
    rows = [(i, bytes(signs[c] for c in piece), False) for piece, i in found["model"]["vocab"].items() if i not in added]
    rows += [(i, t["content"].encode(), bool(t.get("special"))) for i, t in added.items()]
    return spark.createDataFrame(rows, VOCABULARY)


def _leads(digits: Column) -> Column:
    """How many code points begin among bytes, given as pairs of digits: all but continuation bytes."""
    return F.length(F.regexp_replace(F.regexp_replace(digits, "([0-9A-F])[0-9A-F]", "$1"), "[89AB]", ""))


def decoded(rows: DataFrame, vocabulary: DataFrame, keys: list[str], tokens: str = "token_ids") -> DataFrame:
    """keys, text and offsets, an array of (start, end) in code points for each token, null for special ones, which the text leaves out.

    The keys name a row; keys that are there twice and tokens that are not in the vocabulary stop the query. Null tokens give a null
    text and no tokens an empty one. Bytes that are not UTF-8 become U+FFFD. A vocabulary of up to 2**20 rows is broadcast, a larger one is joined by
    shuffles. The tokens of one row are put together in one task.
    """
    digits = F.hex("piece")
    special = F.coalesce("special", F.lit(False))
    words = vocabulary.select("id", special.alias("special"), F.when(special, "").otherwise(digits).alias("digits"))
    words = words.withColumns({"leads": _leads(F.col("digits")), "inside": F.coalesce(F.substring("digits", 1, 1).isin("8", "9", "A", "B"), F.lit(False)).cast("int")})
    if words.limit(_MOST_BROADCAST + 1).count() <= _MOST_BROADCAST:
        words = F.broadcast(words)
    named = F.struct(*keys).alias("__k")
    placed = rows.where(F.size(tokens) > 0).select(named, F.posexplode(tokens).alias("__at", "id")).join(words, "id", "left")
    stop = F.raise_error(F.concat(F.lit("no piece for token "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("string")
    before = F.coalesce(F.sum("leads").over(Window.partitionBy("__k").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before - F.col("inside")).cast("int")
    span = F.when(~F.col("special"), F.struct(F.greatest(start, F.lit(0)).alias("start"), (before + F.col("leads")).cast("int").alias("end")))
    spans = placed.select("__k", "__at", F.coalesce("digits", stop).alias("digits"), span.alias("span"))
    whole = spans.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("__at", "digits", "span"))).alias("p"))
    twice = F.raise_error(F.lit("two rows have the same keys")).cast("array<struct<__at:int,digits:string,span:struct<start:int,end:int>>>")
    whole = whole.withColumn("p", F.when(F.get("p", F.size("p") - 1)["__at"] == F.size("p") - 1, F.col("p")).otherwise(twice))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.col("p.digits"), "")).cast("string"))
    out = whole.select("__k.*", text.alias("text"), F.col("p.span").alias("offsets"))
    none = rows.where(f"{tokens} IS NULL OR size({tokens}) = 0").select(*keys, F.when(F.col(tokens).isNotNull(), "").alias("text"), F.expr(f"IF({tokens} IS NULL, NULL, CAST(array() AS array<struct<start:int,end:int>>))").alias("offsets"))
    return out.unionByName(none)


def wrong_texts(rows: DataFrame, vocabulary: DataFrame, keys: list[str], tokens: str = "token_ids", text: str = "text") -> DataFrame:
    """The keys of rows whose text is not what their tokens say, with both."""
    found = decoded(rows, vocabulary, keys, tokens).withColumnRenamed("text", "decoded").drop("offsets")
    return rows.select(*keys, text).join(found, keys).where(~F.col(text).eqNullSafe(F.col("decoded"))).select(*keys, F.col(text).alias("text"), "decoded")


def stage_texts(stages: DataFrame) -> DataFrame:
    """(example_id, component, token_ids, text) of every generation in saved stages."""
    greedy = F.struct(F.lit("greedy").alias("component"), F.col("greedy.token_ids").alias("token_ids"), F.col("greedy.text").alias("text"))
    samples = F.transform(F.map_entries("samples"), lambda e: F.struct(e["key"].alias("component"), e["value"]["generation"]["token_ids"].alias("token_ids"), e["value"]["generation"]["text"].alias("text")))
    parts = F.concat(F.when(F.col("greedy").isNotNull(), F.array(greedy)).otherwise(F.array().cast("array<struct<component:string,token_ids:array<int>,text:string>>")), F.coalesce(samples, F.array().cast("array<struct<component:string,token_ids:array<int>,text:string>>")))
    return stages.select("example_id", F.explode(parts).alias("p")).select("example_id", "p.*")


def text_violations(stages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(example_id, violations): the components of saved stages whose text is not what their tokens say."""
    return wrong_texts(stage_texts(stages), vocabulary, ["example_id", "component"]).groupBy("example_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("text of "), F.col("component")))).alias("violations"))


def reencoded(path: str):
    """A column function: the ids that a tokenizer's file gives a text, for ``confidence.alignment``; null for a null text."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        found = iter(Tokenizer.from_file(path).encode_batch_fast(texts.dropna().tolist(), add_special_tokens=False))
        return pd.Series([None if t is None else next(found).ids for t in texts])

    return encode


def aligned(rows: DataFrame, vocabulary: DataFrame, keys: list[str], special: list[int], path: str, tokens: str = "token_ids") -> DataFrame:
    """keys, text, spans and status of generated tokens: offsets count only if encoding the text again gives the visible tokens."""
    from surelake.operators.confidence import alignment

    found = decoded(rows, vocabulary, keys, tokens).withColumn("encoded", reencoded(path)(F.col("text"))).join(rows.select(*keys, F.col(tokens).alias("__t")), keys)
    shown = F.filter("offsets", lambda o: o.isNotNull())
    return found.select(*keys, "text", alignment(F.col("__t"), special, F.col("encoded"), shown, F.length("text")).alias("a")).select(*keys, "text", "a.spans", "a.status")
