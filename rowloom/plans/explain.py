"""What a query would read and why, without running it."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from ..operators import conditions as C
from ..sources import files

if TYPE_CHECKING:
    from .query import Query

# Shares of the table's bytes up to which a plan's cost has a name.
SHARES = ((0.1, "Low"), (0.5, "Medium"))


def plan_of(q: Query) -> dict[str, Any]:
    """type, strategy, index, the columns it is searched by, reason, bytes to read (by the footers' statistics for an index), bytes of
    the whole, and a word for their ratio."""
    q.validate()
    table = q.table
    size = files.size(table.spark, table.path)
    if name := q.access_path():
        left, size = table.indexes.bytes_left(name, C.equalities(q.condition))
        columns = table.indexes.meta()["indexes"][name]["columns"]
        found = {"type": "IndexScan", "strategy": "sorted copy", "index": name, "columns": columns, "reason": f"{', '.join(columns)} must equal a value."}
    else:
        left, reason = size, "No index has all its columns compared for equality."
        if table.indexes.meta()["indexes"]:
            reason = "Appended or updated rows are not in the indexes." if table.changed else reason
            reason = reason if table.validate_integrity() else "The indexes are of an older state of the table."
        found = {"type": "FullScan", "strategy": "files in order" if not q.groups else "first row of each group", "index": None, "columns": [], "reason": reason}
    cost = next((word for share, word in SHARES if left <= share * size), "High")
    return found | {"bytes": left, "of": size, "cost": cost}


def explain(q: Query, format: str = "array") -> Any:
    """array, json, table, tree, or spark for Spark's own plan."""
    if format == "spark":
        df = q.frame()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = plan_of(q)
    if format == "array":
        return plan
    if format == "json":
        return json.dumps(plan, indent=2)
    if format == "table":
        width = max(len(str(v)) for v in plan.values())
        line = f"+{'-' * 10}+{'-' * (width + 2)}+"
        return "\n".join([line, *(f"| {k:<8} | {str(v):<{width}} |" for k, v in plan.items()), line])
    if format == "tree":
        return "\n".join([f"{plan['type']} on {q.table.name}", *(f"  {k}: {v}" for k, v in plan.items() if k != "type" and v is not None)])
    raise ValueError(f"unknown format: {format}")
