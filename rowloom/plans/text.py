"""SQL text of a query, for people and logs. Over a view of typed columns with the table's name Spark can run it."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import types as T

from ..operators import conditions as C
from ..operators.compare import NULL_TEXT, is_number

if TYPE_CHECKING:
    from .query import Query


def quote(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if is_number(value):
        return str(value).strip()
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def condition_text(c: Any, schema: T.StructType) -> str:
    if isinstance(c, C.Group):
        return f" {c.op.upper()} ".join(f"({condition_text(x, schema)})" for x in c.children)
    if isinstance(c, C.Not):
        return f"NOT ({condition_text(c.child, schema)})"
    column, op = name(c.column), c.op.upper()
    if c.op in C.UNARY:
        text = isinstance(schema[c.column].dataType, T.StringType)
        missing = f"{column} IS NULL" + (f" OR {column} IN ('', '{NULL_TEXT}')" if text else "")
        return missing if c.op == "is null" else f"NOT ({missing})"
    if c.op in ("is", "is not"):
        return f"{column} <=> {quote(c.value)}" if c.op == "is" else f"NOT ({column} <=> {quote(c.value)})"
    if c.op in ("like", "not like"):
        return f"{column} {op.replace('LIKE', 'ILIKE')} {_string(c.value)}"
    if c.op in ("in", "not in"):
        if not c.value:
            return "FALSE" if c.op == "in" else f"{column} IS NOT NULL"
        return f"{column} {op} ({', '.join(map(quote, c.value))})"
    if c.op in ("between", "not between"):
        return f"{column} {op} {quote(c.value[0])} AND {quote(c.value[1])}"
    return f"{column} {op} {quote(c.value)}"


def _string(pattern: Any) -> str:
    return "'" + str(pattern).replace("\\", "\\\\\\\\").replace("'", "''") + "'"


def sql_text(q: Query) -> str:
    out = f"SELECT {', '.join(map(name, q.columns)) or '*'} FROM {name(q.table.name)}"
    tests = [condition_text(q.condition, q.table.schema)] if q.condition is not None else []
    tests += [q.sql_condition] if q.sql_condition else []
    if tests:
        out += " WHERE " + (tests[0] if len(tests) == 1 else " AND ".join(f"({t})" for t in tests))
    if q.groups:
        out += f" GROUP BY {', '.join(map(name, q.groups))}"
    if q.order:
        out += " ORDER BY " + ", ".join(f"{name(c)} {'DESC' if down else 'ASC'}" for c, down in q.order)
    if q.most is not None:
        out += f" LIMIT {q.most}"
    if q.skip:
        out += f" OFFSET {q.skip}"
    return out
