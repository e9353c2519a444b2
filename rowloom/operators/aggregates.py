"""Aggregates over cells that may be text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compare import to_double

FUNCTIONS = ("count", "sum", "avg", "average", "min", "max", "distinct")


def aggregate(func: str, column: str, kind: T.DataType, text_as_zero: bool = False) -> Column:
    """One aggregate. Text that is no number is left out, or counts as 0 if text_as_zero. Sums, averages and extremes of
    text columns are of their numbers; typed columns keep their type."""
    func = func.lower()
    if func == "count":
        return F.count(F.lit(1)) if column == "*" else F.count(f"`{column}`")
    if func == "distinct":
        return F.count_distinct(f"`{column}`")
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType) or (func in ("sum", "avg", "average") and not isinstance(kind, T.NumericType)):
        value = to_double(value, kind)
        value = F.coalesce(value, F.lit(0.0)) if text_as_zero else value
    made = {"sum": F.sum, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max}.get(func)
    if made is None:
        raise ValueError(f"unknown aggregate: {func}")
    return made(value)
