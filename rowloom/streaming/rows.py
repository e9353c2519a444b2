"""Rows to the driver one partition at a time: memory holds a partition, never the result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row


def each(df: DataFrame) -> Iterator[Row]:
    yield from df.toLocalIterator()


def batches(rows: Iterator[Any], size: int = 100) -> Iterator[list]:
    if size < 1:
        raise ValueError("a batch has at least one row")
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def offsets(df: DataFrame, id_col: str) -> Iterator[str]:
    """Row ids as lines of text."""
    for row in df.select(id_col).toLocalIterator():
        yield f"{row[0]}\n"
