"""Tolerant decoding of nested and numeric CSV cells."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = {"allowSingleQuotes": "true"}
_UNWRAPS = 3


def _peel(text: Column) -> Column:
    """Drop matching outer quotes, layer by layer."""
    layers = F.length(F.regexp_extract(text, r"""^["'\s]*""", 0)) + 1

    def step(rest: Column, _: Column) -> Column:
        quoted = rest.rlike(r"""(?s)^(?:".*"|'.*')$""") & (F.length(rest) >= 2)
        return F.when(quoted, F.trim(F.substr(rest, F.lit(2), F.length(rest) - 2))).otherwise(rest)

    return F.aggregate(F.sequence(F.lit(1), layers), F.trim(text), step)


def _unwrap(text: Column) -> Column:
    """The content of a JSON string, up to three times; other JSON text stays as it is."""

    def step(rest: Column, _: Column) -> Column:
        listed = F.concat(F.lit("["), rest, F.lit("]"))
        values = F.from_json(listed, "array<string>", _JSON)
        return F.when(F.size(values) == 1, F.get(values, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_UNWRAPS)), text, step)


def _shaped(text: Column, kind: T.DataType) -> Column:
    """The JSON value that is the whole text; null if anything follows it."""
    opening = "{" if isinstance(kind, T.MapType) else "["
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(kind), {**_JSON, "mode": "PERMISSIVE"})
    return F.when(F.ltrim(text).startswith(opening) & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def _literal_to_json(rounds: int, kind: T.DataType):
    """A pandas UDF that turns the first Python literal of a type among some texts into JSON; else null.

    The function is local, so it travels to the workers by value: they need not
    have this package installed. No text can fail the job.
    """
    wanted = dict if isinstance(kind, T.MapType) else list

    def convert(text):
        try:
            for _ in range(rounds):
                value = ast.literal_eval(text.strip())
                if not isinstance(value, str):
                    return json.dumps(value) if isinstance(value, wanted) else None
                text = value
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            pass
        return None

    def first(texts):
        return None if texts is None else next((v for v in (convert(t) for t in texts if t is not None) if v is not None), None)

    def fallback(candidates: pd.Series) -> pd.Series:
        return candidates.map(first)

    return F.pandas_udf(fallback, "string")


def decode_cell(cell: Column, kind: T.DataType, python_literals: bool = True) -> Column:
    """A list or map written as JSON, over-quoted JSON, or a Python literal.

    Built-in JSON parsing does the work. Only cells it leaves null are handed to
    the Python fallback, in all their forms, and only where it is asked for. A
    cell of another type, or with text after its value, is null.
    """
    raw = F.trim(cell)
    texts = F.array(
        raw,
        _peel(raw),
        _peel(F.replace(raw, F.lit('""'), F.lit('"'))),
        _peel(F.replace(raw, F.lit('\\"'), F.lit('"'))),
        _peel(F.rtrim(raw, F.lit('"'))),
    )
    # most forms of a text without outer quotes are the text itself
    texts = F.array_distinct(texts)

    def read(text: Column) -> Column:
        # only a text that starts with a quote is a JSON string
        quoted = F.when(text.rlike(r"""^\s*["']"""), _unwrap(text))
        return F.coalesce(_shaped(text, kind), _shaped(quoted, kind))

    # well-formed cells are read at once; the rest tries its forms in order, until one is read
    tried = F.aggregate(texts, F.lit(None).cast(kind), lambda found, t: F.coalesce(found, read(t)))
    found = F.coalesce(_shaped(raw, kind), tried)
    if not python_literals:
        return found
    fallback = _literal_to_json(_UNWRAPS + 1, kind)(F.when(found.isNull() & cell.isNotNull(), texts))
    return F.coalesce(found, _shaped(fallback, kind))


def whole_number(cell: Column) -> Column:
    """A nullable integer: ``7`` and ``7.0`` are 7, other text is null."""
    as_double = cell.try_cast("double")
    return F.coalesce(
        cell.try_cast("bigint"), F.when(as_double == F.floor(as_double), as_double.cast("string").try_cast("decimal(38,4)").try_cast("bigint"))
    )
