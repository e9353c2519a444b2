"""Requests as dicts, and a command line: index, query, write, daemon, version."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from . import __version__
from .sources.table import Table


def _query(table: Table, request: Mapping[str, Any]):
    where = request.get("where")
    q = table.find()
    q = q.where_json(where) if isinstance(where, str) else q.where(where) if where else q
    if request.get("limit") is not None:  # 0 is a limit too
        q = q.limit(int(request["limit"]))
    return q.offset(int(request.get("offset") or 0))


def handle_request(table: Table, request: Mapping[str, Any]) -> dict[str, Any]:
    """Actions: ping, count, select, query, explain, groupby, status. Errors come back as text."""
    try:
        return {"success": True} | _handle(table, request)
    except Exception as e:  # the answer to any failure is a message
        return {"success": False, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}


def _handle(table: Table, request: Mapping[str, Any]) -> dict[str, Any]:
    action = request.get("action")
    if action == "ping":
        return {"pong": True}
    if action == "status":
        return {"status": "running", "table": table.path, "rows": table.find().count(), "columns": len(table.headers)}
    q = _query(table, request)
    if action == "count":
        return {"count": q.count()}
    if action == "select":
        return {"rows": q.as_array().all()}
    if action == "explain" or (action == "query" and request.get("explain")):
        return {"data": q.explain()}
    if action == "groupby" or (action == "query" and request.get("groupBy")):
        group = request.get("groupBy") or request["column"]
        func = request.get("aggFunc") or "count"
        return {"groups" if action == "groupby" else "data": q.aggregate(group, {request.get("aggCol") or ("*" if func == "count" else group): func})}
    if action == "query":
        return {"rows": q.as_array().all()}
    raise ValueError(f"unknown action: {action}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rowloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("index", "query", "write", "daemon"):
        c = sub.add_parser(name)
        if name != "daemon":
            c.add_argument("--table", required=True)
        c.add_argument("--kind", default="csv")
        c.add_argument("--separator", default=",")
        c.add_argument("--state-dir")
        if name == "index":
            c.add_argument("--columns", required=True, help='JSON, as ["a", ["b", "c"]]')
            c.add_argument("--bloom", action="store_true")
            c.add_argument("--verbose", action="store_true")
        elif name == "daemon":
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=7790)
        elif name == "query":
            c.add_argument("--request", required=True, help="JSON request")
        else:
            c.add_argument("--rows", required=True, help="JSON list of objects")
    a = p.parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "daemon":
        from .daemon import Daemon

        with Daemon(spark, a.host, a.port, a.kind) as daemon:
            daemon.serve_forever()
        return 0
    table = Table(spark, a.table, a.kind, a.separator, a.state_dir)
    if a.command == "index":
        out: Any = {"indexes": table.create_index(json.loads(a.columns), a.bloom, a.verbose)}
    elif a.command == "write":
        out = {"rows": table.batch_insert(json.loads(a.rows))}
    else:
        out = handle_request(table, json.loads(a.request))
    json.dump(out, sys.stdout, default=str)
    print()
    return 0


