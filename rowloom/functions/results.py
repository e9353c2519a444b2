"""Wrappers of fetched rows: a row by name or position, its columns, and a cell with casts and validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from ..operators.compare import is_number
from . import rules as R


class Cell:
    def __init__(self, row: ResultRow, index: int, name: str, value: Any):
        self.row, self.index, self.name, self.value = row, index, name, value

    def is_empty(self) -> bool:
        return self.value is None or self.value == ""

    def is_numeric(self) -> bool:
        return is_number(self.value)

    def as_string(self) -> str:
        return "" if self.value is None else str(self.value)

    def as_int(self, default: int = 0) -> int:
        return int(float(self.value)) if self.is_numeric() else default

    def as_float(self, default: float = 0.0) -> float:
        return float(self.value) if self.is_numeric() else default

    def as_bool(self) -> bool:
        return self.as_string().strip(R.TRIMMED).lower() in R.TRUE_WORDS

    def validate(self, rules: list[str]) -> dict[str, Any]:
        text = self.as_string()
        size = len(text.encode())
        broken: dict[str, Callable[[int | None], bool]] = {
            "required": lambda _: not text,
            "numeric": lambda _: bool(text) and not self.is_numeric(),
            "email": lambda _: bool(text) and not re.match(R.EMAIL, text),
            "min": lambda n: size < n,
            "max": lambda n: size > n,
        }
        found = [R.MESSAGES[name] for name, n in filter(None, map(R.parse, rules)) if broken[name](n)]
        return {"valid": not found, "errors": found}

    def __str__(self) -> str:
        return self.as_string()


class ResultColumn:
    def __init__(self, cell: Cell):
        self.cell, self.value, self.name, self.index = cell, cell.value, cell.name, cell.index

    def trim(self) -> str:
        return self.cell.as_string().strip(R.TRIMMED)

    def upper(self) -> str:
        return self.cell.as_string().upper()

    def lower(self) -> str:
        return self.cell.as_string().lower()

    def __str__(self) -> str:
        return self.cell.as_string()


class ResultRow:
    """Missing columns are None; iteration gives (name, value) pairs; as text it is JSON. line is set by queries with_lines()."""

    def __init__(self, values: dict[str, Any], line: Any = None):
        self._values, self.line = values, line

    def get(self, key: str | int) -> Any:
        if isinstance(key, int):
            values = list(self._values.values())
            return values[key] if -len(values) <= key < len(values) else None
        return self._values.get(key)

    __getitem__ = get

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._values.get(name)

    def keys(self) -> list[str]:
        return list(self._values)

    def __contains__(self, name: str) -> bool:
        return self._values.get(name) is not None

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self._values.items())

    def __len__(self) -> int:
        return len(self._values)

    def cell(self, name: str) -> Cell:
        """A missing column's cell is empty, at position -1."""
        return Cell(self, list(self._values).index(name) if name in self._values else -1, name, self._values.get(name))

    def column(self, name: str) -> ResultColumn:
        return ResultColumn(self.cell(name))

    def as_dict(self) -> dict[str, Any]:
        return dict(self._values)

    def to_json(self) -> str:
        return json.dumps(self._values, default=str, ensure_ascii=False)

    __str__ = to_json
