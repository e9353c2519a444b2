"""Functions of one cell, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.compare import is_numeric
from . import rules as R

def trim(c: Column) -> Column:
    return F.trim(c, F.lit(R.TRIMMED))


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def is_empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def numeric(c: Column) -> Column:
    return is_numeric(c.cast("string"))


def as_int(c: Column, default: int = 0) -> Column:
    text = c.cast("string")
    return F.when(is_numeric(text), text.try_cast("double").try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def as_float(c: Column, default: float = 0.0) -> Column:
    text = c.cast("string")
    return F.when(is_numeric(text), text.try_cast("double")).otherwise(F.lit(float(default)))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(trim(c.cast("string"))).isin(*R.TRUE_WORDS), F.lit(False))


def as_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def errors(c: Column, rules: list[str]) -> Column:
    """Messages of the rules that a cell breaks: required, numeric, email, min:n and max:n (bytes)."""
    text = as_string(c)
    broken = {
        "required": lambda _: text == "",
        "numeric": lambda _: (text != "") & ~is_numeric(text),
        "email": lambda _: (text != "") & ~text.rlike(R.EMAIL),
        "min": lambda n: F.octet_length(text) < n,
        "max": lambda n: F.octet_length(text) > n,
    }
    found = [F.when(broken[name](n), F.lit(R.MESSAGES[name])) for name, n in filter(None, map(R.parse, rules))]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validate(c: Column, rules: list[str]) -> Column:
    """struct(valid, errors)."""
    e = errors(c, rules)
    return F.struct((F.size(e) == 0).alias("valid"), e.alias("errors"))
