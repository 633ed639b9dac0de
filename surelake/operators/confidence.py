"""Confidence from parallel arrays of token scores, in higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_tokens(entropies: Column, logprobs: Column, mask: Column, vocab_size: int) -> Column:
    """The entropies; stops the query if the arrays differ in length or hold what no token can have."""
    if isinstance(vocab_size, bool) or not isinstance(vocab_size, int) or vocab_size < 2:
        raise ValueError("vocab_size must be an integer greater than one")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sizes = (F.size(entropies) == F.size(logprobs)) & (F.size(entropies) == F.size(mask))
    values = F.forall(entropies, lambda x: finite(x) & (x >= 0)) & F.forall(logprobs, lambda x: finite(x) & (x <= 1e-7)) & F.forall(mask, lambda x: x.isNotNull())
    message = F.when(~F.coalesce(sizes, F.lit(False)), F.lit("token vectors need the same count")).when(~values, F.lit("token scores are out of range"))
    return F.when(message.isNull(), entropies).otherwise(F.raise_error(message).cast("array<double>"))


def token_confidence(entropies: Column, logprobs: Column, spans: Column, mask: Column, start: Column, end: Column, vocab_size: int) -> Column:
    """Struct of content_token_count, mean_entropy_nats, entropy_confidence, sequence_logprob_sum, sequence_geometric_probability,
    answer_token_count, answer_token_geometric_probability and answer_alignment_status.

    spans: array of structs (start, end), null as a whole or in part; start and end: the answer's span, null if there is none.
    """
    given = F.struct(checked_tokens(entropies, logprobs, mask, vocab_size).alias("e"), logprobs.alias("p"), mask.alias("m"), spans.alias("s"), start.alias("start"), end.alias("end"))
    return bound(given, lambda z: bound(_token_sums(z), lambda r: _summary(r, z, vocab_size)))


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _usable(z: Column) -> Column:
    return F.coalesce(z["s"].isNotNull() & (F.size(z["s"]) == F.size(z["e"])), F.lit(False))


def _token_sums(z: Column) -> Column:
    """In one pass over the tokens: how many there are of content and of the answer, and sums of their scores."""
    rows = F.transform(F.arrays_zip(z["e"], z["p"], z["m"]), lambda t, i: F.struct(t["e"].alias("e"), t["p"].alias("p"), t["m"].alias("m"), F.get(z["s"], i).alias("s")))

    def add(acc: Column, t: Column) -> Column:
        hit = F.coalesce((t["s"]["start"] < z["end"]) & (t["s"]["end"] > z["start"]) & (t["s"]["end"] > t["s"]["start"]), F.lit(False)) & _usable(z)
        grown = F.struct((acc["n"] + 1).alias("n"), (acc["e"] + t["e"]).alias("e"), (acc["p"] + t["p"]).alias("p"), (acc["k"] + hit.cast("int")).alias("k"), (acc["a"] + F.when(hit, t["p"]).otherwise(0.0)).alias("a"))
        return F.when(t["m"], grown).otherwise(acc)

    return F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("e"), F.lit(0.0).alias("p"), F.lit(0).alias("k"), F.lit(0.0).alias("a")), add)


def _summary(r: Column, z: Column, vocab_size: int) -> Column:
    some = r["n"] > 0
    mean = F.try_divide(r["e"], r["n"])
    status = F.when(z["start"].isNull(), "no_answer_span").when(~_usable(z), "token_alignment_unavailable").when(r["k"] > 0, "aligned").otherwise("no_answer_tokens")
    return F.struct(
        r["n"].alias("content_token_count"), mean.alias("mean_entropy_nats"), F.when(some, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - mean / math.log(vocab_size)))).alias("entropy_confidence"),
        F.when(some, r["p"]).alias("sequence_logprob_sum"), F.exp(F.try_divide(r["p"], r["n"])).alias("sequence_geometric_probability"), r["k"].alias("answer_token_count"),
        F.exp(F.try_divide(r["a"], r["k"])).alias("answer_token_geometric_probability"), status.alias("answer_alignment_status"),
    )


def termination(tokens: Column, eos: list[int], max_new_tokens: int) -> Column:
    """Struct of eos_generated, was_truncated and termination_reason."""
    return termination_of(F.try_element_at(tokens, F.lit(-1)), F.size(tokens), eos, max_new_tokens)


def termination_of(last: Column, count: Column, eos: list[int], max_new_tokens: int) -> Column:
    """The same from the last token, null if there is none, and the number of tokens."""
    if isinstance(max_new_tokens, bool) or max_new_tokens < 1:
        raise ValueError("max_new_tokens must be a positive integer")
    ended = F.coalesce(last.isin(*eos) if eos else F.lit(False), F.lit(False))
    cut = ~ended & (count >= max_new_tokens)
    reason = F.when(ended, "eos").when(cut, "max_new_tokens").otherwise("other_stop")
    return F.struct(ended.alias("eos_generated"), cut.alias("was_truncated"), reason.alias("termination_reason"))


def alignment(tokens: Column, special: list[int], encoded: Column, offsets: Column, length: Column) -> Column:
    """Struct of spans and status: offsets count only if encoding the decoded text again gives the visible tokens.

    encoded and offsets: what the tokenizer made of the text, null if it can't give offsets; length: of the text.
    """
    visible = F.filter(tokens, lambda t: ~t.isin(*special)) if special else tokens
    bad = F.exists(offsets, lambda o: (o["start"] < 0) | (o["end"] < o["start"]) | (o["end"] > length))
    same = (encoded == visible) & (F.size(offsets) == F.size(visible))
    status = F.when(encoded.isNull() | offsets.isNull(), "offsets_unavailable").when(~F.coalesce(same, F.lit(False)), "token_roundtrip_mismatch").when(bad, "invalid_offsets").otherwise("aligned")
    is_special = (lambda t: t.isin(*special)) if special else (lambda t: F.lit(False))
    # Visible positions carry the offsets in order, special ones nothing; sorted by position they are one span a token.
    places = lambda shown: F.filter(F.transform(tokens, lambda t, i: F.when(is_special(t) != F.lit(shown), i)), lambda i: i.isNotNull())
    span = lambda i, o: F.struct(i.alias("i"), o.alias("o"))
    seen = F.zip_with(places(True), offsets, span)
    hidden = F.transform(places(False), lambda i: span(i, F.when(F.lit(False), F.get(offsets, F.lit(0)))))
    spans = F.transform(F.array_sort(F.concat(seen, hidden), lambda a, b: a["i"] - b["i"]), lambda x: x["o"])
    return F.struct(F.when(status == "aligned", spans).alias("spans"), status.alias("status"))


def logit_scores(logits: Column, chosen: Column) -> Column:
    """Struct of entropy (nats) and logprob of the chosen entry of one token's logits. Largest logit and mass are computed once a token, not once an entry."""
    given = F.struct(logits.alias("v"), F.array_max(logits).alias("top"), chosen.alias("chosen"))

    def scores(z: Column) -> Column:
        down = lambda a, x: a - F.exp(x - z["z"]["top"] - z["mass"]) * (x - z["z"]["top"] - z["mass"])
        return F.struct(F.aggregate(z["z"]["v"], F.lit(0.0), down).alias("entropy"), (F.get(z["z"]["v"], z["z"]["chosen"]) - z["z"]["top"] - z["mass"]).alias("logprob"))

    mass = lambda z: F.log(F.aggregate(z["v"], F.lit(0.0), lambda a, x: a + F.exp(x - z["top"])))
    return bound(given, lambda z: bound(F.struct(z.alias("z"), mass(z).alias("mass")), scores))
