"""Comparison rules.

`loose`: if both sides are numeric they compare as doubles, otherwise as strings. Typed columns compare natively where the
literal fits their type, so the filter reaches the Parquet scan. `bytes`: everything compares as strings.
"""

from __future__ import annotations

import datetime
import decimal
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A numeric text: optional spaces, sign, digits with a point, exponent. try_cast alone also takes '1d' and 'NaN'.
NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
_NUMERIC = re.compile(NUMERIC)
NULL_TEXT = "NULL"


def is_number(value: Any) -> bool:
    if isinstance(value, bool):
        return False
    return isinstance(value, (int, float, decimal.Decimal)) or (isinstance(value, str) and _NUMERIC.match(value) is not None)


def as_text(value: Any) -> str:
    if isinstance(value, bool):
        return "1" if value else ""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def is_numeric(column: Column) -> Column:
    """Of a string column: whether its text is a number."""
    return F.coalesce(column.rlike(NUMERIC), F.lit(False))


def to_double(column: Column, kind: T.DataType) -> Column:
    """The number in a column, null where there is none."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(is_numeric(column), column.try_cast("double"))
    return column.try_cast("double")


_OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def compare(column: Column, kind: T.DataType, op: str, value: Any, rule: str = "loose") -> Column:
    """column op value; null where the column is null."""
    test = _OPS[op]
    if rule == "bytes":
        return test(column.cast("string"), F.lit(as_text(value)))
    if isinstance(kind, T.NumericType):
        if is_number(value):
            return test(column, F.lit(float(value) if isinstance(value, str) and not value.strip().lstrip("+-").isdigit() else int(value) if isinstance(value, str) else value))
        return test(column.cast("string"), F.lit(as_text(value)))
    if isinstance(kind, T.BooleanType):
        return test(column, F.lit(value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on", "y")))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        literal = F.lit(value) if isinstance(value, (datetime.date, datetime.datetime)) else F.lit(str(value)).try_cast(kind)
        return test(column, literal)
    if isinstance(kind, T.StringType) and is_number(value):
        return F.when(column.rlike(NUMERIC), test(column.try_cast("double"), F.lit(float(value)))).otherwise(test(column, F.lit(as_text(value))))
    return test(column.cast("string"), F.lit(as_text(value)))


def like(column: Column, pattern: str, rule: str = "loose") -> Column:
    """`%` and `_` are wildcards, case does not matter; under `bytes`, a case-insensitive search for the text as it is."""
    text = column.cast("string")
    if rule == "bytes":
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    return text.ilike(pattern.replace("\\", "\\\\"))


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null, empty, or the word NULL."""
    if isinstance(kind, T.StringType):
        return column.isNull() | column.isin("", NULL_TEXT)
    return column.isNull()
