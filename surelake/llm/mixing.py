"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed over cells of (source, language, topic). A token budget gives each source, each
language and each topic a target. Raking scales the cells' weights, the tokens to draw from each, to
the targets of the sources, then the languages, then the topics, and so on in rounds. No
cell can give more than it has: one that is full stays so and the free ones of its value make up
for it. A weight over its cell's tokens is the sampling probability, so that tokens times
probabilities meet the targets; ``gaps`` tells by how much they do not. A document stays if
a uniform number made from its key lies below its cell's probability, so the sample does not depend
on order or partitions. Only cells are aggregated and joined; the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surelake.llm.shared import forget, stored

DIMS = ("source", "lang", "topic")
#: Share of a value's tokens, to this power, is its target share before all are scaled to 1.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
_MOST_BROADCAST = 100_000  # cells, of three short strings and a number


def topic_of(text: str) -> Column:
    """A coarse topic from marks in the text."""
    has = lambda x: F.contains(F.col(text), F.lit(x))
    return F.when(has("icense") | has("opyright"), "legal").when(has("http") | has("@"), "web").when(has(" | ") | has("{"), "layout").otherwise("prose")


def uniform(key: str, text: str, salt: str = "mix") -> Column:
    """A number in [0, 1) from the key, or from the text where the key is null."""
    hashed = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(1 << 52)


def described(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: Column | None) -> DataFrame:
    """docs with its cell, tokens and uniform number under names of their own."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.withColumns(
        {"__source": value(source), "__lang": value(lang), "__topic": F.coalesce(topic if topic is not None else topic_of(text), F.lit(NONE)), "__tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"), "__u": uniform(key, text)}
    )


def _with_sums(cells: DataFrame, dim: str, sums: dict[str, Column], few: bool) -> DataFrame:
    """cells with sums over all cells of the same value; few cells lie in one partition, so that windows need no exchange."""
    if few:
        return cells.withColumns({name: F.sum(c).over(Window.partitionBy(dim)) for name, c in sums.items()})
    return cells.join(cells.groupBy(dim).agg(*(F.sum(c).alias(name) for name, c in sums.items())), dim)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float, few: bool) -> DataFrame:
    """Cells with weights ``w`` brought to the targets (dimension, target) of every dimension in turn, none beyond its tokens.

    A value without target gets weight 0; a cell's weight stays 0 once it is. Rounds end early once no value is further
    from its target than ``tolerance`` of it.
    """
    for dim in DIMS:
        cells = cells.join(targets[dim].select(dim, F.col("target").alias(f"target_{dim}")), dim, "left").withColumn(f"target_{dim}", F.coalesce(f"target_{dim}", F.lit(0.0)))
    last = cells = stored(cells.coalesce(1) if few else cells)
    full = F.col("w") >= F.col("tokens") * (1 - 1e-12)
    for done in range(1, rounds + 1):
        if few:
            cells = cells.coalesce(1)
        worst = F.lit(0.0)
        for dim in DIMS:
            target = F.col(f"target_{dim}")
            cells = _with_sums(cells, dim, {"have": F.col("w"), "whole": F.when(full, F.col("w")).otherwise(0.0), "free": F.when(full, 0.0).otherwise(F.col("w"))}, few)
            raised = F.when(full, F.col("w")).otherwise(F.least(F.col("tokens").cast("double"), F.col("w") * F.coalesce(F.try_divide(target - F.col("whole"), F.col("free")), F.lit(1.0))))
            cells = cells.withColumn("w", F.when(target > F.col("have"), raised).otherwise(F.coalesce(F.col("w") * F.try_divide(target, F.col("have")), F.lit(0.0)))).drop("have", "whole", "free")
        if done % 4 == 0 or not few:
            cells = stored(cells)
            forget(last)
            last = marked = cells
            for dim in DIMS:
                marked = _with_sums(marked.coalesce(1) if few else marked, dim, {f"have_{dim}": F.col("w")}, few)
                worst = F.greatest(worst, F.coalesce(F.abs(F.try_divide(F.col(f"have_{dim}"), F.col(f"target_{dim}")) - 1), F.lit(0.0)))
            if (marked.agg(F.max(worst)).first()[0] or 0.0) <= tolerance:
                break
    return cells


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Cells with probability ``p``: tokens * p add up to the budget (or all tokens) in proportion to w, and no p is over 1."""
    ratio = F.col("w") / F.col("tokens")
    open_cells = cells.where("tokens > 0 AND w > 0")
    level, before = 0.0, -1
    while True:  # the cells kept whole only become more, so this ends; each pass reads one row
        whole = F.lit(level) * ratio >= 1
        row = open_cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("w"))), F.count(F.when(whole, 1))).first()
        if row[0] is None or row[2] == before:
            break
        before = row[2]
        if not row[1]:
            break
        level = max(level, (budget - row[0]) / row[1])
    return cells.withColumn("p", F.when((F.col("tokens") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.lit(level) * ratio)).otherwise(0.0))


def cell_probabilities(marked: DataFrame, keep: float, rounds: int = 12, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(source, lang, topic, tokens, w, p) and the targets of every cell of ``described`` rows.

    A dimension's targets are shares of the budget in proportion to what is given, or to powers of the values' tokens; a
    value that lacks tokens for its share gives all, and the others share the rest.
    """
    cells = stored(marked.groupBy(*(F.col(f"__{d}").alias(d) for d in DIMS)).agg(F.sum("__tokens").alias("tokens")))
    count, tokens = cells.agg(F.count("*"), F.sum("tokens")).first()
    budget, few = keep * (tokens or 0), count <= _MOST_BROADCAST
    spark = marked.sparkSession
    share = {}
    for d in DIMS:
        sizes = cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        given = (targets or {}).get(d)
        if given:
            sizes = sizes.join(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, w double"), d)
        else:
            sizes = sizes.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(TEMPER[d])))
        sizes = stored(sizes)
        share[d] = calibrated(sizes, budget).select(d, (F.col("p") * F.col("tokens")).alias("target"))
    raked = rake(cells.withColumn("w", F.col("tokens") * F.lit(keep)), share, rounds, tolerance, few)
    p = F.when(F.col("w") >= F.col("tokens") * (1 - 1e-9), 1.0).otherwise(F.col("w") / F.col("tokens"))
    return raked.withColumn("p", F.when(F.col("tokens") > 0, p).otherwise(0.0))


def gaps(cells: DataFrame) -> DataFrame:
    """(dim, value, tokens, target, drawn, gap) of ``cell_probabilities``: what tokens times probabilities make, and how far from the target, as a part of it."""
    every = None
    for d in DIMS:
        one = cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"target_{d}").alias("target"), F.sum(F.col("tokens") * F.col("p")).alias("drawn"))
        every = one if every is None else every.unionByName(one)
    return every.withColumn("gap", F.coalesce(F.try_divide(F.col("drawn"), F.col("target")) - 1, F.lit(0.0)))


def sampled(docs: DataFrame, keep: float = 0.5, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, rounds: int = 12, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The documents that the mix keeps, with the columns of ``docs`` and __source, __lang, __topic, __tokens, __p.

    keep: the token budget as a share of all tokens; targets: shares by dimension and value, tempered shares of the tokens
    where none are given; values that are given none are not drawn. A value or cell that has too little gives all of it.
    Null source, language or topic is a value of its own, ``(none)``. A text that is null or blank
    has no tokens and is kept like its cell, or not at all in a cell without tokens. Repeated rows are kept or dropped
    together; an empty table gives none.
    """
    marked = described(docs, key, text, source, lang, topic)
    cells = cell_probabilities(marked, keep, rounds, targets).select(*(F.col(d).alias(f"__{d}") for d in DIMS), F.col("p").alias("__p"))
    on = [f"__{d}" for d in DIMS]
    if cells.count() <= _MOST_BROADCAST:
        joined = marked.join(F.broadcast(cells), on)
    else:  # a hot cell is spread over as many tasks as there are salts
        salts = 64
        marked = marked.withColumn("__salt", F.floor(F.col("__u") * salts * 1024) % salts)
        joined = marked.join(cells.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("bigint")), [*on, "__salt"]).drop("__salt")
    return joined.where("__u < __p").drop("__u")


def mixing_report(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    kept = sampled(docs, keep)
    return kept.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__p", 9).alias("p"))


def oracle_sql(table: str = "documents", keep: float = 0.5, rounds: int = 12) -> str:
    """The same sample in DuckDB's SQL."""
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '{NONE}') AS source, coalesce(CAST(lang AS VARCHAR), '{NONE}') AS lang,
          CASE WHEN contains(text, 'icense') OR contains(text, 'opyright') THEN 'legal' WHEN contains(text, 'http') OR contains(text, '@') THEN 'web'
               WHEN contains(text, ' | ') OR contains(text, '{{') THEN 'layout' ELSE 'prose' END AS topic,
          CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS tokens,
          CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM {table})""",
        f"w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) * {keep}::DOUBLE AS w FROM d GROUP BY ALL)",
        f"b AS MATERIALIZED (SELECT {keep}::DOUBLE * sum(tokens) AS budget FROM w0)",
    ]
    for dim in DIMS:  # the level at which values that lack tokens give all of them
        ctes += [
            f"z_{dim} AS MATERIALIZED (SELECT {dim}, sum(tokens)::DOUBLE AS n, pow(sum(tokens)::DOUBLE, {TEMPER[dim]}) AS f FROM w0 GROUP BY {dim} HAVING sum(tokens) > 0)",
            f"r_{dim} AS (SELECT f / n AS ratio, coalesce(sum(n) OVER (ORDER BY f / n DESC, {dim} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(f) OVER (ORDER BY f / n, {dim} DESC ROWS UNBOUNDED PRECEDING) AS rest FROM z_{dim})",
            f"l_{dim} AS (SELECT max((budget - before) / rest) FILTER ((budget - before) / rest * ratio < 1) AS level FROM r_{dim}, b)",
            f"t_{dim} AS MATERIALIZED (SELECT {dim}, least(1.0, coalesce(level, 1e300) * f / n) * n AS target FROM z_{dim}, l_{dim})",
        ]
    k = 0
    for _ in range(rounds):
        for dim in DIMS:
            ctes.append(
                f"""w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN target > have THEN CASE WHEN w >= tokens * (1 - 1e-12) THEN w ELSE least(tokens::DOUBLE, w * coalesce((target - whole) / nullif(free, 0), 1)) END
                ELSE coalesce(w * (target / nullif(have, 0)), 0) END AS w
                FROM (SELECT c.*, coalesce(target, 0) AS target, sum(w) OVER p AS have, sum(CASE WHEN w >= tokens * (1 - 1e-12) THEN w ELSE 0 END) OVER p AS whole, sum(CASE WHEN w >= tokens * (1 - 1e-12) THEN 0 ELSE w END) OVER p AS free
                  FROM w{k} c LEFT JOIN t_{dim} t ON c.{dim} = t.{dim} WINDOW p AS (PARTITION BY c.{dim})))"""
            )
            k += 1
    ctes.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN CASE WHEN w >= tokens * (1 - 1e-9) THEN 1.0::DOUBLE ELSE w / tokens END ELSE 0.0::DOUBLE END AS p FROM w{k})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.tokens AS n_tokens, round(p.p, 9) AS p FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic WHERE d.u < p.p"
