"""Body parameters. JSON nests without a bound, so its flattening is an Arrow UDF; forms stay in the engine."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from weftlog.functions.text import strip
from weftlog.functions.url import query_pairs

PAIRS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))


@dataclass(frozen=True)
class Dialect:
    """How arrays are named, how many elements count, and what becomes of nulls and empty arrays."""

    indexed: bool = False
    first_elements: int | None = None
    null: str | None = ""
    empty_array: str | None = None


EVENT = Dialect()
PROFILE = Dialect(empty_array="[]")
BOUNDARY = Dialect(indexed=True, first_elements=20, null=None)
DETECTION = Dialect(indexed=True, null="None")


def flatten(value: Any, dialect: Dialect, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of each leaf; numbers and booleans are spelt as Python spells them."""
    stack = [(prefix, value)]
    while stack:
        name, now = stack.pop()
        if isinstance(now, dict):
            stack.extend((f"{name}.{k}" if name else str(k), v) for k, v in reversed(now.items()))
        elif isinstance(now, list):
            if not now and dialect.empty_array is not None and name:
                yield name, dialect.empty_array
            some = now[: dialect.first_elements]
            stack.extend((f"{name}[{i}]" if dialect.indexed or not name else f"{name}[]", v) for i, v in reversed(list(enumerate(some))))
        elif name and (now is not None or dialect.null is not None):
            yield name, dialect.null if now is None else str(now)


def lists(texts: pa.Array, read: Callable[[str], list[tuple] | None], kind: list[tuple[str, pa.DataType]]) -> pa.Array:
    """What ``read`` finds in each text, as a list of structs; texts that repeat in a batch are read once."""
    coded = texts.dictionary_encode()
    found = [read(t) for t in coded.dictionary.to_pylist()]
    rows = list(chain.from_iterable(x or () for x in found))
    columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kind)]
    ends = np.cumsum([0, *(len(x or ()) for x in found)])
    each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in kind]), mask=pa.array([x is None for x in found], pa.bool_()))
    return each.take(coded.indices)


def json_pairs(body: Column, dialect: Dialect = EVENT) -> Column:
    """Leaves of a JSON object or array; null for text that is neither."""

    def read(text: str) -> list[tuple[str, str]] | None:
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return list(flatten(found, dialect)) if isinstance(found, dict | list) else None

    @F.arrow_udf(PAIRS)
    def run(texts: pa.Array) -> pa.Array:
        return lists(texts, read, [("name", pa.string()), ("value", pa.string())])

    return run(F.when(body.startswith("{") | body.startswith("["), body))


def body_pairs(body: Column, dialect: Dialect = EVENT) -> Column:
    """Parameters of a JSON or form body; bad JSON and other text give none."""
    text = strip(F.coalesce(body, F.lit("")))
    none = F.array().cast(PAIRS)
    is_json = text.startswith("{") | text.startswith("[")
    form = F.when(text.contains("="), query_pairs(text)).otherwise(none)
    return F.when(is_json, F.coalesce(json_pairs(text, dialect), none)).otherwise(form)
