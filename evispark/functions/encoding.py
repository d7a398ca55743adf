"""JSON text in one canonical form, and vectors as base64 of half-precision numbers."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short escapes of JSON.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_text(text: Column | str) -> Column:
    """A JSON string in ASCII only: whatever lies outside blank to tilde as ``\\uXXXX`` (two of them beyond 16 bits), null as ``null``."""
    c = F.col(text) if isinstance(text, str) else text
    u = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def sign(x: Column) -> Column:
        code = F.ascii(x)
        wide = F.concat(u(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), u(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
        out = F.when(code.between(32, 126), x).when(code < 0x10000, u(code)).otherwise(wide)
        for raw, escaped in ESCAPES.items():
            out = F.when(x == F.lit(raw), F.lit(escaped)).otherwise(out)
        return out

    plain = c.rlike(r'^[ !#-\[\]-~]*\z')  # nothing to escape
    return F.coalesce(F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), sign), "")), F.lit('"')), F.lit("null"))


def json_number(value: Column) -> Column:
    """A number as JSON, null as ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """A JSON object of values that are JSON text already, with sorted keys and a blank behind each comma and colon."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_array(items: Column) -> Column:
    """A JSON array of an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def half_precision(value: str | None, size: int | None = None) -> bytes | None:
    """The bytes of ``value``, or None unless, line breaks aside, it is base64 of (``size``) finite numbers in half precision, not all zero."""
    if value is None:
        return None
    value = re.sub(r"[\r\n]", "", value)
    if size is not None and len(value) != 4 * -(-2 * size // 3):
        return None
    try:
        raw = base64.b64decode(value, validate=True)
    except ValueError:
        return None
    if not raw or len(raw) % 2 or (size is not None and len(raw) != 2 * size):
        return None
    x = np.frombuffer(raw, dtype="<f2")
    return raw if np.isfinite(x).all() and x.any() else None


def _decoded(values: pd.Series) -> pd.Series:
    found = (half_precision(v) for v in values)
    return pd.Series([None if r is None else np.frombuffer(r, dtype="<f2").astype(float).tolist() for r in found])


def _encoded(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else base64.b64encode(np.asarray(v, dtype="<f2").tobytes()).decode() for v in vectors])


def decode_vector(value: Column | str) -> Column:
    """The numbers of a recorded vector; null unless they are readable (:func:`half_precision`)."""
    return F.pandas_udf(_decoded, "array<double>")(value)


def encode_vector(vector: Column | str) -> Column:
    """base64 of the little-endian half-precision numbers, null for null."""
    return F.pandas_udf(_encoded, "string")(vector)
