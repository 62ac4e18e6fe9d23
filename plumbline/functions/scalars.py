"""Scalar functions on values and byte strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REGEX_SPECIAL = frozenset("\\^]-[&")


def value_to_string(c: Column, kind: T.DataType) -> Column:
    """Text of a value: NULL for null, true or false, six decimals for floating-point numbers."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.format_string("%.6f", c.cast("double"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def field(value: Column, name: str, stop_chars: str = ",;}") -> Column:
    """The text after a field's name and colon, up to a stop character; null where the field isn't found.

    The name is looked for in double quotes, then before a colon, then bare; blanks around the result
    and one pair of double quotes go. Not a JSON parser: use `get_json_object` for that.
    """
    quoted, colon, bare = (F.instr(value, F.lit(p)) for p in (f'"{name}"', f"{name}:", name))
    start = F.when(quoted > 0, quoted).when(colon > 0, colon).otherwise(bare)
    at = F.position(F.lit(":"), value, F.when(start > 0, start).otherwise(1))
    stops = "".join(f"\\{c}" if c in _REGEX_SPECIAL else c for c in stop_chars)
    tail = F.substring(value, at + 1, F.length(value))
    found = F.regexp_replace(F.regexp_extract(tail, f"^\\s*([^{stops}]*)", 1), r"\s+$", "")
    bare_text = F.when((F.length(found) >= 2) & found.startswith('"') & found.endswith('"'), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)
    return F.when((start > 0) & (at > 0), bare_text)


def remove_prefix(c: Column, n: int) -> Column:
    return F.substring(c, n + 1, 1 << 30)


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def now_micros() -> Column:
    return F.unix_micros(F.current_timestamp())
