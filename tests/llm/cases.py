"""Small tables with the awkward rows that every operator must take."""

import numpy as np

DOCS = "source string, doc_id bigint, text string, lang string, n_chars bigint, bid int, key string"


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


def awkward() -> list[tuple]:
    """Null and empty texts, a null key, repeated rows, copies, one very long text, odd characters."""
    long = prose(1, 20000, 5000)
    part = prose(2, 60)
    texts = [None, "", "  \n\t ", "one", "ÀB ça-va? ÀB", long, part, part, prose(3, 100) + " " + part + " " + prose(4, 50), "a " * 90, "\x00\x85 x   y", prose(5, 34), prose(5, 34), prose(6, 35), prose(6, 35)]
    rows = [("s0", i, t, "en", 1, 7, "k") for i, t in enumerate(texts)]
    rows += [(None, None, part, None, None, None, None), (None, None, None, None, None, None, None), rows[8], rows[3], ("s1", 40, prose(9, 300), "xx", 2, 1, "q")]
    return rows


def frame(spark, rows=None, schema: str = DOCS):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame(awkward() if rows is None else rows, schema)
