"""The registered queries: each operator through the builder, with the same result as SQL where SQL can say it."""

from __future__ import annotations

import contextlib
import io
import json
import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, daemon, service
from .functions import cells
from .plans.query import Query
from .sources import delimited
from .sources.delimited import ROW_ID
from .sources.files import delete, work_folder, write_bytes
from .sources.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, state_dir: str | None = None) -> Table:
    return Table(spark, f"{sf_dir}/{name}.parquet", "parquet", state_dir=state_dir or f"{sf_dir}/.rowloom/{name}", name=name)


def _own(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A table whose changes go to a folder of this call."""
    return _table(spark, sf_dir, name, work_folder(spark, f"state-{name}"))


def _register(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _rows(name: str, table: str, build: Callable[[Query], Query], sql: str) -> None:
    _register(name, sql)(lambda spark, sf_dir: build(_table(spark, sf_dir, table).find()).frame())


def _made(name: str, table: str, build: Callable[[Query], DataFrame], sql: str) -> None:
    _register(name, sql)(lambda spark, sf_dir: build(_table(spark, sf_dir, table).find()))


# --- scans, projections, predicates ---------------------------------------------------------------------------------

_rows("scan_all", "nation", lambda q: q, "SELECT * FROM nation")
_rows("select_cols", "customer", lambda q: q.select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
_rows("where_eq", "orders", lambda q: q.select("o_orderkey", "o_totalprice").where("o_orderstatus", "F"),
      "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
_rows("where_hash", "orders", lambda q: q.select("o_orderkey").where({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}),
      "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_rows("where_composite", "lineitem", lambda q: q.select("l_orderkey", "l_linenumber").where([["l_returnflag", "l_linestatus"], ["R", "F"]]),
      "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
_rows("where_neq", "customer", lambda q: q.select("c_custkey", "c_mktsegment").where(["<>", "c_mktsegment", "FURNITURE"]),
      "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'")
_rows("where_range", "lineitem", lambda q: q.select("l_orderkey", "l_linenumber", "l_quantity").where([">", "l_quantity", 45]).and_where(["<=", "l_discount", 0.05]),
      "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05")
_rows("where_or", "orders", lambda q: q.select("o_orderkey").where({"o_orderstatus": "P"}).or_where([">=", "o_totalprice", 400000]),
      "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice >= 400000")
_rows("nested_and_or", "lineitem",
      lambda q: q.select("l_orderkey", "l_linenumber").where(["or", {"l_returnflag": "A"}, ["and", [">", "l_quantity", 48], {"l_linestatus": "O"}]]),
      "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR (l_quantity > 48 AND l_linestatus = 'O')")
_rows("where_not", "part", lambda q: q.select("p_partkey").where(["not", ["or", [">", "p_size", 25], {"p_type": "ECONOMY"}]]),
      "SELECT p_partkey FROM part WHERE NOT (p_size > 25 OR p_type = 'ECONOMY')")
_rows("where_json", "orders",
      lambda q: q.select("o_orderkey").where_json('{"operator":"AND","children":[{"operator":"=","column":"o_orderstatus","value":"O"},{"operator":">","column":"o_totalprice","value":200000}]}'),
      "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
_rows("where_sql", "part", lambda q: q.select("p_partkey").where_sql("p_size % 7 = 0"), "SELECT p_partkey FROM part WHERE p_size % 7 = 0")
_rows("like_pct", "part", lambda q: q.select("p_partkey", "p_name").where(["like", "p_name", "%WIDGET"]),
      "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET'")
_rows("like_underscore", "part", lambda q: q.select("p_partkey", "p_brand").where(["like", "p_brand", "brand#1_"]),
      "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'brand#1_'")
_rows("like_contains", "part", lambda q: q.compare_as("bytes").select("p_partkey", "p_name").where(["like", "p_name", "small"]),
      "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small')")
_rows("in_list", "supplier", lambda q: q.select("s_suppkey", "s_nationkey").where(["in", "s_nationkey", [1, 3, 5, 7]]),
      "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)")
_rows("not_in_list", "customer", lambda q: q.select("c_custkey").where(["not in", "c_mktsegment", ["FURNITURE", "BUILDING"]]),
      "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('FURNITURE', 'BUILDING')")
_rows("between_num", "lineitem", lambda q: q.select("l_orderkey", "l_linenumber").where(["between", "l_discount", 0.05, 0.07]),
      "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
_rows("not_between", "part", lambda q: q.select("p_partkey", "p_size").where(["not between", "p_size", 10, 40]),
      "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 40")
_rows("is_null_rule", "documents", lambda q: q.select("doc_id").where(["is", "lang", None]),
      "SELECT doc_id FROM documents WHERE lang IS NULL OR lang = '' OR lang = 'NULL'")
_made("is_not_null_rule", "documents", lambda q: q.where(["is not", "lang", None]).count_frame(),
      "SELECT COUNT(*) AS cnt FROM documents WHERE NOT (lang IS NULL OR lang = '' OR lang = 'NULL')")
_made("is_not_value", "customer", lambda q: q.where(["is not", "c_mktsegment", "BUILDING"]).count_frame(),
      "SELECT COUNT(*) AS cnt FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
_rows("filter_where", "orders", lambda q: q.select("o_orderkey").filter_where({"o_orderstatus": "", "o_orderpriority": "2-HIGH", "o_custkey": None}),
      "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
_rows("loose_numeric", "orders", lambda q: q.select("o_orderkey").where([">", "o_orderkey", "990"]),
      "SELECT o_orderkey FROM orders WHERE TRY_CAST(CAST(o_orderkey AS VARCHAR(20)) AS DOUBLE) > 990")
_rows("bytes_compare", "orders", lambda q: q.compare_as("bytes").select("o_orderkey").where([">", "o_orderkey", "990"]),
      "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '990'")

# --- aggregates -----------------------------------------------------------------------------------------------------

_made("count_all", "lineitem", lambda q: q.count_frame(), "SELECT COUNT(*) AS cnt FROM lineitem")
_made("count_where", "lineitem", lambda q: q.where(["and", {"l_returnflag": "R"}, [">", "l_quantity", 30]]).count_frame(),
      "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
_made("agg_scalar", "orders",
      lambda q: q.where("o_orderstatus", "F").aggregate_frame({"s": ("sum", "o_totalprice"), "a": ("avg", "o_totalprice"), "mn": ("min", "o_totalprice"), "mx": ("max", "o_totalprice")})
      .select(F.round("s", 2).alias("s"), F.round("a", 6).alias("a"), "mn", "mx"),
      "SELECT ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 6) AS a, MIN(o_totalprice) AS mn, MAX(o_totalprice) AS mx FROM orders WHERE o_orderstatus = 'F'")
_made("group_count", "customer", lambda q: q.group_by("c_mktsegment").aggregate_frame({"cnt": ("count", "*")}),
      "SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment")
_made("group_sum", "lineitem", lambda q: q.group_by("l_returnflag").aggregate_frame({"s": ("sum", "l_extendedprice")}).withColumn("s", F.round("s", 2)),
      "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag")
_made("group_avg", "lineitem", lambda q: q.group_by("l_linestatus").aggregate_frame({"a": ("avg", "l_quantity")}).withColumn("a", F.round("a", 6)),
      "SELECT l_linestatus, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_linestatus")
_made("group_min_max", "events", lambda q: q.group_by("event_type").aggregate_frame({"mn": ("min", "value"), "mx": ("max", "value")}),
      "SELECT event_type, MIN(value) AS mn, MAX(value) AS mx FROM events GROUP BY event_type")
_made("group_multi_col", "lineitem",
      lambda q: q.where(["<", "l_quantity", 40]).group_by("l_returnflag", "l_linestatus").aggregate_frame({"cnt": ("count", "*"), "q": ("sum", "l_quantity")}).withColumn("q", F.round("q", 2)),
      "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, ROUND(SUM(l_quantity), 2) AS q FROM lineitem WHERE l_quantity < 40 GROUP BY l_returnflag, l_linestatus")
_made("distinct_values", "orders", lambda q: q.select("o_orderstatus", "o_orderpriority").distinct_frame(),
      "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_made("count_groups", "orders", lambda q: q.group_by("o_orderpriority").count_frame(), "SELECT COUNT(DISTINCT o_orderpriority) AS cnt FROM orders")
_made("count_distinct", "lineitem", lambda q: q.group_by("l_returnflag").aggregate_frame({"parts": ("distinct", "l_partkey")}),
      "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
_rows("group_first_row", "lineitem",
      lambda q: q.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber").group_by("l_returnflag", "l_linestatus")
      .order_by("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"),
      "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_linestatus "
      "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1")
_rows("group_first_row_desc", "orders",
      lambda q: q.select("o_orderpriority", "o_orderkey", "o_totalprice").group_by("o_orderpriority").order_by("o_totalprice desc, o_orderkey"),
      "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority "
      "ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1")
_made("exists_true", "orders", lambda q: q.where("o_orderstatus", "P")._filtered().limit(1).agg((F.count("*") > 0).alias("found")),
      "SELECT COUNT(*) > 0 AS found FROM orders WHERE o_orderstatus = 'P'")
_made("numeric_or_zero_sum", "events",
      lambda q: q.group_by("event_type").aggregate_frame({"s": ("sum", "props")}, text_as_zero=True),
      "SELECT event_type, SUM(COALESCE(TRY_CAST(props AS DOUBLE), 0.0)) AS s FROM events GROUP BY event_type")

# --- order, limits, keys --------------------------------------------------------------------------------------------

_rows("top_k", "orders", lambda q: q.select("o_orderkey", "o_totalprice").order_by("o_totalprice desc, o_orderkey").limit(10),
      "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_rows("order_offset", "customer", lambda q: q.select("c_custkey", "c_acctbal").order_by("c_mktsegment").add_order_by({"c_acctbal": "desc"}, "c_custkey").limit(20).offset(15),
      "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 20 OFFSET 15")
_rows("one_row", "part", lambda q: q.select("p_partkey", "p_name").where([">", "p_size", 40]).order_by("p_partkey").limit(1),
      "SELECT p_partkey, p_name FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 1")
_rows("first_column", "region", lambda q: q.select("r_name"), "SELECT r_name FROM region")
_made("index_by_last_wins", "orders", lambda q: q.select("o_orderstatus", "o_orderkey").order_by("o_orderkey").keyed("o_orderstatus"),
      "SELECT o_orderstatus, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderstatus")
_made("index_by_desc", "orders", lambda q: q.select("o_orderstatus", "o_orderkey").order_by("o_orderkey desc").keyed("o_orderstatus"),
      "SELECT o_orderstatus, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderstatus")
_made("group_by_two_sums", "lineitem",
      lambda q: q.group_by("l_returnflag").add_group_by("l_linestatus").aggregate_frame({"s": ("sum", "l_quantity"), "mx": ("max", "l_discount"), "n": ("count", "l_orderkey")}),
      "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS s, MAX(l_discount) AS mx, COUNT(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")

# --- indexes, virtual columns, updates, appends ---------------------------------------------------------------------


@_register("index_lookup", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 42")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _own(spark, sf_dir, "lineitem")
    table.create_index(["l_orderkey"])
    return table.find().select("l_orderkey", "l_linenumber", "l_partkey").where({"l_orderkey": 42}).frame()


@_register("index_composite", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 49")
def index_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _own(spark, sf_dir, "lineitem")
    table.create_index([["l_returnflag", "l_linestatus"]])
    return table.find().select("l_orderkey", "l_linenumber", "l_partkey").where(["and", {"l_returnflag": "R", "l_linestatus": "F"}, [">", "l_quantity", 49]]).frame()


@_register("virtual_column", "SELECT r_regionkey, r_name, 'UNKNOWN' AS zone FROM region")
def virtual_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _own(spark, sf_dir, "region")
    table.add_column("zone", "UNKNOWN")
    return table.find().frame()


@_register("update_overlay", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'INACTIVE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _own(spark, sf_dir, "customer")
    table.update({"c_mktsegment": "INACTIVE"}, {"c_nationkey": 3})
    return table.find().select("c_custkey", "c_mktsegment").frame()


@_register("insert_append", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _own(spark, sf_dir, "region")
    table.insert({"r_regionkey": 99, "r_name": "ATLANTIS"})
    return table.find().select("r_regionkey", "r_name").frame()


# --- functions of cells ---------------------------------------------------------------------------------------------

_made("column_fns", "supplier", lambda q: q._filtered().select("s_suppkey", cells.trim(cells.upper(F.col("s_name"))).alias("up"), cells.lower(F.col("s_name")).alias("lo")),
      "SELECT s_suppkey, TRIM(UPPER(s_name)) AS up, LOWER(s_name) AS lo FROM supplier")
_made("cell_casts", "events", lambda q: q._filtered().select("event_id", cells.numeric(F.col("props")).alias("is_num"), cells.as_float(F.col("props")).alias("f")),
      "SELECT event_id, TRY_CAST(props AS DOUBLE) IS NOT NULL AS is_num, COALESCE(TRY_CAST(props AS DOUBLE), 0.0) AS f FROM events")
_made("cell_bool", "labels", lambda q: q._filtered().select("doc_id", cells.as_bool(F.col("toxic")).alias("b")),
      "SELECT doc_id, LOWER(TRIM(CAST(toxic AS VARCHAR(20)))) IN ('1','true','yes','on','y') AS b FROM labels")
_made("cell_validate", "customer",
      lambda q: q._filtered().select("c_custkey", F.size(cells.errors(F.col("c_name"), ["required", "numeric", "email", "min:5", "max:8"])).alias("n_errors")),
      "SELECT c_custkey, CAST((coalesce(c_name, '') = '') AS INT) + CAST((coalesce(c_name, '') <> '' AND TRY_CAST(c_name AS DOUBLE) IS NULL) AS INT) "
      "+ CAST((coalesce(c_name, '') <> '' AND NOT contains(c_name, '@')) AS INT) + CAST((strlen(coalesce(c_name, '')) < 5) AS INT) + CAST((strlen(coalesce(c_name, '')) > 8) AS INT) AS n_errors FROM customer")

_rows("limit_rows", "region", lambda q: q.where(["<", "r_regionkey", 3]).limit(9), "SELECT * FROM region WHERE r_regionkey < 3")

# --- delimited text -------------------------------------------------------------------------------------------------
# Tables are written as text into a folder of the call, in the order of their keys, and read back: every column is text then.

_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer"


def _csv(spark: SparkSession, sf_dir: str, name: str = "customer", columns: Iterable[str] = _CUSTOMER) -> Table:
    columns, folder = list(columns), work_folder(spark, f"csv-{name}")
    delimited.write(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).orderBy(columns[0]), f"{folder}/{name}.csv")
    return Table(spark, f"{folder}/{name}.csv", name=name)


def _text(query: str, build: Callable[[Table], DataFrame], sql: str, /, **source) -> None:
    """A query over a table that is written as text first."""
    _register(query, sql)(lambda spark, sf_dir: build(_csv(spark, sf_dir, **source)))


def _made_rows(table: Table, rows: list[tuple], schema: str) -> DataFrame:
    return table.spark.createDataFrame(rows, schema)


def _then(change: Callable[[Table], object], build: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
    def run(table: Table) -> DataFrame:
        change(table)
        return build(table)

    return run


def _quietly(args: list[str]) -> None:
    with contextlib.redirect_stdout(io.StringIO()):
        service.main(args)


_REGION = {"name": "region", "columns": ("r_regionkey", "r_name")}
_FEW = ("c_custkey", "c_mktsegment")
_KEY = "CAST(c_custkey AS VARCHAR) AS c_custkey"

_text("csv_scan", lambda t: t.find().select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").frame(), _CUSTOMER_SQL)
_text("csv_headers", lambda t: _made_rows(t, list(t.header_map.items()), "name string, place int"),
      "SELECT * FROM (VALUES ('c_custkey', 0), ('c_name', 1), ('c_nationkey', 2), ('c_acctbal', 3), ('c_mktsegment', 4)) AS v(name, place)")
_text("csv_count", lambda t: t.find().count_frame(), "SELECT COUNT(*) AS cnt FROM customer")
_text("csv_count_where", lambda t: t.find().where(["and", {"c_mktsegment": "BUILDING"}, [">", "c_acctbal", 1000]]).count_frame(),
      "SELECT COUNT(*) AS cnt FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
_text("csv_where_number", lambda t: t.find().select("c_custkey", "c_acctbal").where(["between", "c_acctbal", 0, "2500.5"]).frame().withColumn("c_acctbal", F.col("c_acctbal").cast("double")),
      f"SELECT {_KEY}, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 2500.5")
_text("csv_in_list", lambda t: t.find().select("c_custkey").where(["in", "c_nationkey", ["1", 3, "7.0"]]).frame(),
      f"SELECT {_KEY} FROM customer WHERE c_nationkey IN (1, 3, 7)")
_text("csv_order_numbers", lambda t: t.find().select("c_custkey", "c_mktsegment").order_by("c_mktsegment desc").limit(7).frame(),
      f"SELECT {_KEY}, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, customer.c_custkey LIMIT 7")
_text("csv_offsets", lambda t: t.find().where({"c_nationkey": 3})._filtered(row_id=True).select(F.col(ROW_ID).alias("line")),
      "SELECT line FROM (SELECT c_nationkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS line FROM customer) WHERE c_nationkey = 3")
_text("csv_lines", lambda t: _made_rows(t, [(r.line, r["c_custkey"]) for r in t.find().with_lines().where({"c_nationkey": 5}).all()], "line long, c_custkey string"),
      "SELECT line, c_custkey FROM (SELECT c_nationkey, CAST(c_custkey AS VARCHAR) AS c_custkey, ROW_NUMBER() OVER (ORDER BY customer.c_custkey) AS line FROM customer) WHERE c_nationkey = 5")
_text("csv_group_count", lambda t: t.find().group_by("c_mktsegment").aggregate_frame({"cnt": ("count", "*")}),
      "SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment")
_text("csv_group_sum", lambda t: t.find().group_by("c_nationkey").aggregate_frame({"s": ("sum", "c_acctbal"), "mx": ("max", "c_acctbal")}).withColumn("s", F.round("s", 2)),
      "SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, ROUND(SUM(c_acctbal), 2) AS s, MAX(c_acctbal) AS mx FROM customer GROUP BY c_nationkey")
_text("csv_group_first_row", lambda t: t.find().select(*_FEW).group_by("c_mktsegment").frame(),
      f"SELECT {_KEY}, c_mktsegment FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) AS customer WHERE rn = 1")
_text("csv_limit", lambda t: t.find().select(*_FEW).limit(5).offset(3).frame(), f"SELECT {_KEY}, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5 OFFSET 3")
_text("csv_one", lambda t: _made_rows(t, [tuple(t.find().select(*_FEW).one().as_dict().values())], "c_custkey string, c_mktsegment string"),
      f"SELECT {_KEY}, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 1")
_text("csv_scalar", lambda t: _made_rows(t, [(t.find().select("c_name").where({"c_custkey": 12}).scalar(),)], "c_name string"), "SELECT c_name FROM customer WHERE c_custkey = 12")
_text("csv_column", lambda t: _made_rows(t, [(v,) for v in t.find().select("c_name").where(["<", "c_custkey", 30]).column()], "c_name string"), "SELECT c_name FROM customer WHERE c_custkey < 30")
_text("csv_all", lambda t: _made_rows(t, [(r.c_custkey, r["c_mktsegment"]) for r in t.find().where({"c_nationkey": 4}).all()], "c_custkey string, c_mktsegment string"),
      f"SELECT {_KEY}, c_mktsegment FROM customer WHERE c_nationkey = 4")
_text("csv_as_array", lambda t: _made_rows(t, [tuple(r.values()) for r in t.find().select(*_FEW).as_array().where({"c_nationkey": 6}).all()], "c_custkey string, c_mktsegment string"),
      f"SELECT {_KEY}, c_mktsegment FROM customer WHERE c_nationkey = 6")
_text("csv_each", lambda t: _made_rows(t, [(r[0],) for r in t.find().offset(10).limit(20).each()], "c_custkey string"), f"SELECT {_KEY} FROM customer ORDER BY customer.c_custkey LIMIT 20 OFFSET 10")
_text("csv_batch", lambda t: _made_rows(t, [(i, len(b), b[0][0]) for i, b in enumerate(t.find().limit(50).batch(20))], "batch int, n int, first string"),
      "SELECT CAST((rn - 1) // 20 AS INT) AS batch, CAST(COUNT(*) AS INT) AS n, CAST(MIN(c_custkey) AS VARCHAR) AS first FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 50 GROUP BY (rn - 1) // 20")
_text("csv_index_by", lambda t: _made_rows(t, [(k, r["c_custkey"]) for k, r in t.find().index_by(lambda r: int(r["c_nationkey"]) % 4).all().items()], "k int, c_custkey string"),
      "SELECT CAST(c_nationkey % 4 AS INT) AS k, CAST(MAX(c_custkey) AS VARCHAR) AS c_custkey FROM customer GROUP BY c_nationkey % 4")
_text("csv_json", lambda t: _made_rows(t, [(r.to_json(),) for r in t.find().all()], "j string"),
      """SELECT '{"r_regionkey": "' || r_regionkey || '", "r_name": "' || r_name || '"}' AS j FROM region""", **_REGION)
_text("csv_virtual_column", _then(lambda t: t.add_column("zone", "EU"), lambda t: t.find().where({"zone": "EU"}).frame()),
      "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, 'EU' AS zone FROM region", **_REGION)
_text("csv_batch_insert", _then(lambda t: t.batch_insert([{"r_regionkey": "7", "r_name": 'a "b", c'}, {"r_name": "d"}]), lambda t: t.find().frame()),
      """SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL VALUES ('7', 'a "b", c'), ('', 'd')""", **_REGION)
_text("csv_cli_write", _then(lambda t: _quietly(["write", "--table", t.path, "--rows", json.dumps([{"r_regionkey": "8"}])]), lambda t: t.find().select("r_regionkey").frame()),
      "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey FROM region UNION ALL SELECT '8'", **_REGION)
_text("csv_update", _then(lambda t: (t.update({"c_mktsegment": "X"}, {"c_nationkey": 3}), t.update({"c_mktsegment": "Y"}, ["and", {"c_mktsegment": "X"}, [">", "c_acctbal", 0]])),
      lambda t: t.find().select(*_FEW).frame()),
      f"SELECT {_KEY}, CASE WHEN c_nationkey <> 3 THEN c_mktsegment WHEN c_acctbal > 0 THEN 'Y' ELSE 'X' END AS c_mktsegment FROM customer")
_text("csv_materialize", _then(lambda t: (t.update({"r_name": "Q"}, {"r_regionkey": "2"}), t.add_column("zone", "EU", materialize=True)), lambda t: t.find().frame()),
      "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, CASE WHEN r_regionkey = 2 THEN 'Q' ELSE r_name END AS r_name, 'EU' AS zone FROM region", **_REGION)
_text("csv_index_lookup", _then(lambda t: t.create_index(["o_orderkey"]), lambda t: t.find().where({"o_orderkey": 42}).frame()),
      "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 42",
      name="orders", columns=("o_orderkey", "o_custkey", "o_orderpriority"))
_text("csv_index_composite", _then(lambda t: t.create_index(["c_custkey", ["c_nationkey", "c_mktsegment"]]), lambda t: t.find().select("c_custkey").where({"c_mktsegment": "BUILDING", "c_nationkey": "3"}).frame()),
      f"SELECT {_KEY} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
_text("csv_index_bloom", _then(lambda t: t.create_index(["c_name"], bloom=True), lambda t: t.find().where({"c_name": "nobody"}).count_frame()), "SELECT COUNT(*) AS cnt FROM customer WHERE c_name = 'nobody'")
_text("csv_index_group", _then(lambda t: t.create_index(["c_mktsegment"]), lambda t: t.find().group_by("c_mktsegment").aggregate_frame({"cnt": ("count", "*"), "mn": ("min", "c_acctbal")})),
      "SELECT c_mktsegment, COUNT(*) AS cnt, MIN(c_acctbal) AS mn FROM customer GROUP BY c_mktsegment")
_text("csv_index_count", _then(lambda t: t.create_index(["c_nationkey"]), lambda t: t.find().count_frame()), "SELECT COUNT(*) AS cnt FROM customer")
_text("csv_index_meta", _then(lambda t: t.create_index(["c_mktsegment", ["c_nationkey", "c_mktsegment"]]),
      lambda t: _made_rows(t, [(n, t.meta()["totalRows"], e["distinctCount"]) for n, e in t.meta()["indexes"].items()], "name string, n_rows long, n_keys long")),
      "SELECT 'c_mktsegment' AS name, COUNT(*) AS n_rows, COUNT(DISTINCT c_mktsegment) AS n_keys FROM customer "
      "UNION ALL SELECT 'c_mktsegment_c_nationkey', COUNT(*), COUNT(DISTINCT (c_mktsegment, c_nationkey)) FROM customer")
_text("csv_index_lifecycle", lambda t: _made_rows(t, [(t.create_index(["c_name"])[0], t.has_index("c_name"), t.index_path("c_name").startswith(t.index_dir), t.drop_index("c_name"), t.has_index("c_name"))],
      "made string, has boolean, inside boolean, dropped boolean, still boolean"),
      "SELECT 'c_name' AS made, TRUE AS has, TRUE AS inside, TRUE AS dropped, FALSE AS still")
_text("csv_index_pruned", _then(lambda t: t.create_index(["c_custkey"]), lambda t: _made_rows(t, [(q.explain()["type"], q.explain()["bytes"]) for q in [t.find().where({"c_custkey": -5})]], "type string, bytes long")),
      "SELECT 'IndexScan' AS type, CAST(0 AS BIGINT) AS bytes")


def _rewritten(t: Table) -> DataFrame:
    t.create_index(["r_name"])
    before = t.validate_integrity()
    df = t.spark.createDataFrame(t.find().frame().collect())
    delete(t.spark, t.path)
    delimited.write(df.withColumn("r_name", F.reverse("r_name")), t.path)
    return _made_rows(t, [(before, t.validate_integrity())], "before boolean, after boolean")


_text("csv_stale_index", _rewritten, "SELECT TRUE AS before, FALSE AS after", **_REGION)


def _message(call: Callable[[], object]) -> str:
    try:
        call()
    except ValueError as e:
        return str(e)
    return ""


_text("csv_column_check", lambda t: _made_rows(t, [(_message(t.find().where({"nope": 1}).count), _message(lambda: t.add_column("R_NAME")))], "unknown string, taken string"),
      "SELECT 'Column not found: nope' AS unknown, 'Column already exists: R_NAME' AS taken", **_REGION)
_text("csv_and_where", lambda t: t.and_where({"c_nationkey": 3}).and_where(["<", "c_custkey", 500]).select("c_custkey").frame(), f"SELECT {_KEY} FROM customer WHERE c_nationkey = 3 AND customer.c_custkey < 500")
_text("csv_getters", lambda t: _made_rows(t, [(t.separator, t.name, t.path.endswith(".csv"), t.skipped_rows(), len(t.virtual_columns))], "sep string, name string, csv boolean, skipped long, virtual long"),
      "SELECT ',' AS sep, 'region' AS name, TRUE AS csv, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS virtual", **_REGION)


@_register("csv_fields", """SELECT * FROM (VALUES ('1', 'x, "y"', '3'), ('4', '5', ''), (' ', ' z ', ''), ('last', 'NULL', 'q')) AS v(a, b, c)""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialect in small: a mark at the begin, both line ends, quotes in quotes, a short, a long and an empty row, no last line end."""
    folder = work_folder(spark, "csv-fields")
    text = '\ufeffa,b,c\r\n1,"x, ""y""",3\r\n\r\n4,5\n6,7,8,9\n , z ,\nlast,NULL,"q"'
    write_bytes(spark, f"{folder}/fields.csv", text.encode())
    return Table(spark, f"{folder}/fields.csv").find().frame()


# --- requests, texts and plans --------------------------------------------------------------------------------------

_text("service_groupby", lambda t: _made_rows(t, list(service.handle_request(t, {"action": "groupby", "groupBy": "c_mktsegment"})["groups"].items()), "k string, n long"),
      "SELECT c_mktsegment AS k, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
_text("service_select", lambda t: _made_rows(t, [(r["c_custkey"],) for r in service.handle_request(t, {"action": "select", "where": {"c_nationkey": 8}})["rows"]], "c_custkey string"),
      f"SELECT {_KEY} FROM customer WHERE c_nationkey = 8")
_text("service_actions", lambda t: _made_rows(t, [(
          service.handle_request(t, {"action": "ping"})["pong"], service.handle_request(t, {"action": "status"})["rows"], service.handle_request(t, {"action": "explain"})["data"]["type"],
          len(service.handle_request(t, {"action": "select", "limit": 0})["rows"]), service.handle_request(t, {"action": "x"})["success"])],
          "pong boolean, n_rows long, plan string, none long, known boolean"),
      "SELECT TRUE AS pong, CAST(COUNT(*) AS BIGINT) AS n_rows, 'FullScan' AS plan, CAST(0 AS BIGINT) AS none, FALSE AS known FROM region", **_REGION)


def _over_a_socket(t: Table) -> DataFrame:
    with daemon.Daemon(t.spark) as server:
        client = daemon.Client(*server.start())
        rows = [(client.ask(action="ping")["pong"], client.ask(action="count", csv=t.path, where={"r_regionkey": 1})["count"], client.ask(action="count", csv=t.path)["count"])]
        client.close()
        server.shutdown()
    return _made_rows(t, rows, "pong boolean, one long, n_all long")


_text("daemon_requests", _over_a_socket, "SELECT TRUE AS pong, CAST(1 AS BIGINT) AS one, COUNT(*) AS n_all FROM region", **_REGION)


@_register("sql_text", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority ILIKE '%urgent') AND o_custkey % 3 = 0")
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a query, run by Spark over a view."""
    table = _table(spark, sf_dir, "orders")
    q = table.find().select("o_orderkey").where(["and", ["is not", "o_orderstatus", "F"], ["like", "o_orderpriority", "%urgent"]]).where_sql("o_custkey % 3 = 0")
    table.frame().createOrReplaceTempView("orders")
    return spark.sql(q.sql())


def _logged(t: Table) -> DataFrame:
    seen: list[str] = []
    handler, logger = logging.Handler(), logging.getLogger("rowloom")
    handler.emit = lambda record: seen.append(record.getMessage())
    level = logger.level
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    try:
        t.find().debug().where({"r_name": "ASIA"}).count()
    finally:
        logger.removeHandler(handler)
        logger.setLevel(level)
    return _made_rows(t, [(s,) for s in seen], "line string")


_text("debug_log", _logged, "SELECT 'SELECT * FROM `region` WHERE `r_name` = ''ASIA'' | table' AS line", **_REGION)
_text("stats_rows", lambda t: _made_rows(t, [(s["rows"], s["run"] >= 0, "optimization" in s["phases"]) for s in [t.find().stats()]], "n long, timed boolean, planned boolean"),
      "SELECT COUNT(*) AS n, TRUE AS timed, TRUE AS planned FROM region", **_REGION)
_text("version", lambda t: _made_rows(t, [(__version__,)], "version string"), f"SELECT '{__version__}' AS version", **_REGION)
_text("row_access", lambda t: _made_rows(t, [(r[1], r.column("r_name").lower(), r.column("r_name").index, r.cell("r_regionkey").as_int(), r.cell("missing").as_string(), str(r)) for r in t.find().all()],
      "name string, low string, place int, number int, missing string, shown string"),
      """SELECT r_name AS name, LOWER(r_name) AS low, 1 AS place, r_regionkey AS number, '' AS missing,
         '{"r_regionkey": "' || r_regionkey || '", "r_name": "' || r_name || '"}' AS shown FROM region""", **_REGION)
_text("cell_texts", lambda t: t.find()._filtered().select("c_custkey", cells.is_empty(F.col("c_name")).alias("empty"), cells.as_int(F.col("c_acctbal"), -1).alias("i"), cells.as_int(F.col("c_name"), -1).alias("none"), cells.as_string(F.lit(None)).alias("s")),
      f"SELECT {_KEY}, c_name = '' AS empty, CAST(TRUNC(c_acctbal) AS BIGINT) AS i, CAST(-1 AS BIGINT) AS none, '' AS s FROM customer")
