"""Conditions: parsed from dicts, lists or JSON into a small tree, lowered to one Column.

Forms: {column: value, ...} (all equal; a list means IN, None IS NULL); ["and"|"or", c1, c2, ...]; ["not", c];
[operator, column, value(s)]; [[c1, c2], [v1, v2]]; and {"operator": .., "column": .., "value": .., "children": [..]}.
Predicates are true or false, never unknown: a missing column value is false except under IS NULL and IS NOT value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import compare as C

COMPARISONS = ("=", "!=", "<>", ">", "<", ">=", "<=")
UNARY = ("is null", "is not null")
OPERATORS = (*COMPARISONS, *UNARY, "like", "not like", "is", "is not", "in", "not in", "between", "not between")


@dataclass(frozen=True)
class Leaf:
    op: str
    column: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    op: str  # and, or
    children: tuple


@dataclass(frozen=True)
class Not:
    child: Any


Condition = Leaf | Group | Not


def parse(raw: Any) -> Condition | None:
    """The tree of a condition in any of its forms; None for an empty one."""
    if raw is None or isinstance(raw, (Leaf, Group, Not)):
        return raw
    if isinstance(raw, (str, bytes)):
        raise ValueError("a condition can't be plain text; use where_sql() for SQL and parse_json() for JSON")
    if not raw:
        return None
    if isinstance(raw, dict):
        return _of_node(raw) if "operator" in raw else _all([_equal(c, v) for c, v in raw.items()])
    raw = list(raw)
    if isinstance(raw[0], (list, tuple)):
        if len(raw) != 2 or not isinstance(raw[1], (list, tuple)) or len(raw[0]) != len(raw[1]):
            raise ValueError("a composite condition needs as many values as columns")
        return _all([Leaf("=", c, v) for c, v in zip(*raw)])
    op = str(raw[0]).strip().lower()
    if op in ("and", "or"):
        children = tuple(c for c in map(parse, raw[1:]) if c is not None)
        return None if not children else children[0] if len(children) == 1 else Group(op, children)
    if op == "not":
        child = parse(raw[1] if len(raw) == 2 else raw[1:])
        return None if child is None else Not(child)
    return _leaf(op, *raw[1:])


def _leaf(op: str, column: str, *values: Any) -> Condition:
    if op.startswith("not ") and op[4:] in COMPARISONS:
        return Not(_leaf(op[4:], column, *values))
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}")
    op = "!=" if op == "<>" else op
    if op in UNARY:
        return Leaf(op, column)
    if op in ("between", "not between"):
        pair = values[0] if len(values) == 1 else values
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            raise ValueError(f"{op} needs two values")
        return Leaf(op, column, tuple(pair))
    if len(values) != 1:
        raise ValueError(f"{op} needs one value")
    if op in ("in", "not in"):
        return Leaf(op, column, tuple(values[0]) if isinstance(values[0], (list, tuple, set)) else (values[0],))
    if op in ("is", "is not") and values[0] is None:
        return Leaf(f"{op} null", column)
    return Leaf(op, column, values[0])


def _equal(column: str, value: Any) -> Leaf:
    if value is None:
        return Leaf("is null", column)
    return Leaf("in", column, tuple(value)) if isinstance(value, (list, tuple, set)) else Leaf("=", column, value)


def _all(leaves: list) -> Condition | None:
    return None if not leaves else leaves[0] if len(leaves) == 1 else Group("and", tuple(leaves))


def _of_node(node: dict) -> Condition | None:
    op = str(node["operator"]).strip().lower()
    if op in ("and", "or", "not"):
        return parse([op, *node.get("children", [])])
    return _leaf(op, node["column"], *([] if op in UNARY else [node.get("value")]))


def parse_json(text: str | bytes) -> Condition | None:
    return parse(json.loads(text)) if text and text.strip() else None


def is_empty(value: Any) -> bool:
    return value is None or (isinstance(value, str) and not value.strip()) or (isinstance(value, (list, tuple, dict)) and not value)


def prune(raw: Any) -> Any:
    """A condition without the operands whose value is empty: what a form leaves unfilled is no filter."""
    if isinstance(raw, dict) and "operator" not in raw:
        return {c: v for c, v in raw.items() if not is_empty(v)}
    if not isinstance(raw, (list, tuple)) or not raw:
        return raw
    if not isinstance(raw[0], (list, tuple)) and str(raw[0]).strip().lower() in ("and", "or", "not"):
        kept = [c for c in map(prune, raw[1:]) if not is_empty(c)]
        return [raw[0], *kept] if kept else []
    if isinstance(raw[0], (list, tuple)):
        pairs = [(c, v) for c, v in zip(*raw) if not is_empty(v)]
        return [list(x) for x in zip(*pairs)] if pairs else []
    if len(raw) > 2 and is_empty(raw[2]):
        return []
    return raw


def both(op: str, a: Condition | None, b: Condition | None) -> Condition | None:
    if a is None or b is None:
        return a if b is None else b
    return Group(op, (a, b))


def leaves(condition: Condition | None) -> Iterator[Leaf]:
    if isinstance(condition, Leaf):
        yield condition
    elif isinstance(condition, Not):
        yield from leaves(condition.child)
    elif condition is not None:
        for child in condition.children:
            yield from leaves(child)


def columns_used(condition: Condition | None) -> list[str]:
    return list(dict.fromkeys(leaf.column for leaf in leaves(condition)))


def equalities(condition: Condition | None) -> dict[str, Any]:
    """Columns that must equal a value for the condition to hold."""
    if isinstance(condition, Leaf):
        return {condition.column: condition.value} if condition.op == "=" else {}
    if isinstance(condition, Group) and condition.op == "and":
        return {c: v for child in condition.children for c, v in equalities(child).items()}
    return {}


def to_column(condition: Condition, schema: T.StructType, rule: str = "loose", negated: bool = False) -> Column:
    """The condition as a Column. Only under NOT unknown is turned into false, since WHERE does so anyway and
    a bare comparison reaches the scan."""
    if isinstance(condition, Group):
        parts = [to_column(c, schema, rule, negated) for c in condition.children]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if condition.op == "and" else out | part
        return out
    if isinstance(condition, Not):
        return ~to_column(condition.child, schema, rule, True)
    out = _predicate(condition, schema, rule)
    return F.coalesce(out, F.lit(False)) if negated else out


def _predicate(leaf: Leaf, schema: T.StructType, rule: str) -> Column:
    column, kind, value = F.col(f"`{leaf.column}`"), schema[leaf.column].dataType, leaf.value
    if leaf.op in COMPARISONS:
        return C.compare(column, kind, leaf.op, value, rule)
    if leaf.op == "is null":
        return C.is_missing(column, kind)
    if leaf.op == "is not null":
        return ~C.is_missing(column, kind)
    if leaf.op == "is":
        return C.compare(column, kind, "=", value, rule)
    if leaf.op == "is not":
        return F.coalesce(C.compare(column, kind, "!=", value, rule), F.lit(True))
    if leaf.op in ("like", "not like"):
        found = C.like(column, str(value), rule)
        return found if leaf.op == "like" else ~found
    if leaf.op in ("in", "not in"):
        found = _one_of(column, kind, value, rule)
        return found if leaf.op == "in" else ~found
    low, high = value
    within = C.compare(column, kind, ">=", low, rule) & C.compare(column, kind, "<=", high, rule)
    return within if leaf.op == "between" else ~within


def _one_of(column: Column, kind: T.DataType, values: tuple, rule: str) -> Column:
    if not values:
        return F.when(column.isNotNull(), F.lit(False))
    plain = [v for v in values if v is not None]
    typed = isinstance(kind, T.NumericType) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in plain)
    if rule == "loose" and (typed or (isinstance(kind, T.StringType) and not any(map(C.is_number, plain)))):
        return column.isin(*[v if typed else C.as_text(v) for v in plain])
    out = F.when(column.isNotNull(), F.lit(False))
    for v in plain:
        out = out | C.compare(column, kind, "=", v, rule)
    return out
