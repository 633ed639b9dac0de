"""Types of UDFs, made without a session so that modules import anywhere, and UDFs that work once on equal arguments."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
STRING, BOOLEAN, DOUBLE = _KINDS["string"], _KINDS["boolean"], _KINDS["double"]


def struct(fields: str) -> T.StructType:
    """From ``name kind, name kind`` of plain kinds."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _marks(column: pa.Array) -> list:
    """A mark for each text, or list of texts, of a batch; equal ones have the same."""
    if not pa.types.is_list(column.type):
        return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy().tolist()
    codes = pc.dictionary_encode(column.flatten(), null_encoding="encode").indices.to_numpy().astype(np.int32).tobytes()
    ends = 4 * np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy())
    return [codes[a:b] if there else None for (a, b), there in zip(pairwise([0, *ends.tolist()]), column.is_valid().to_pylist(), strict=True)]


def by_distinct(fields: str, work: Callable[..., tuple], *columns: pa.Array) -> pa.Array:
    """Structs of ``work(*arguments)`` for each row of a batch of texts or lists of texts; equal arguments are worked on once a batch."""
    places: dict[tuple, int] = {}
    at = [places.setdefault(k, len(places)) for k in zip(*map(_marks, columns), strict=True)]
    first = pa.array(np.unique(at, return_index=True)[1], pa.int64())
    rows = [work(*a) for a in zip(*(c.take(first).to_pylist() for c in columns), strict=True)]
    named = [f.split() for f in fields.split(", ")]
    made = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(named)], names=[n for n, _ in named])
    return made.take(pa.array(at, pa.int64()))
