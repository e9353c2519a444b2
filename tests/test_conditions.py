"""Random conditions against a plain evaluator, and the numeric rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowloom.functions import cells
from rowloom.operators import conditions as C
from rowloom.operators.compare import NUMERIC, as_text
from pyspark.sql import functions as F

VALUES = ["9", "10", "1.0", " 1 ", "1d", "abc", "", None, "NULL", "Abc", "-3", "1e2", "NaN", "a%b"]
LITERALS = ["9", 10, 1, 1.0, "abc", "", "1d", -3.5, "100", "zz"]


def number(v):
    return float(v) if not isinstance(v, str) or re.match(NUMERIC, v) else None


def compare(v, op, w):
    if v is None:
        return False
    a, b = number(v), number(w)
    x, y = (a, b) if a is not None and b is not None else (v.encode(), as_text(w).encode())
    return {"=": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def like(v, p):
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p)
    return v is not None and re.fullmatch(body, v, re.I | re.S) is not None


def holds(c, row):
    op = c[0]
    if op in ("and", "or"):
        return (all if op == "and" else any)(holds(x, row) for x in c[1:])
    if op == "not":
        return not holds(c[1], row)
    v = row[c[1]]
    if op == "is":
        return v in (None, "", "NULL") if c[2] is None else compare(v, "=", c[2])
    if op == "is not":
        return v not in (None, "", "NULL") if c[2] is None else not compare(v, "=", c[2])
    if op == "like":
        return like(v, c[2])
    if op in ("in", "not in"):
        return v is not None and any(compare(v, "=", w) for w in c[2]) == (op == "in")
    if op in ("between", "not between"):
        return v is not None and (compare(v, ">=", c[2]) and compare(v, "<=", c[3])) == (op == "between")
    return compare(v, op, c[2])


column, literal = st.sampled_from(["a", "b"]), st.sampled_from(LITERALS)
leaf = st.one_of(
    st.tuples(st.sampled_from(["=", "!=", ">", "<", ">=", "<="]), column, literal),
    st.tuples(st.sampled_from(["is", "is not"]), column, st.one_of(st.none(), literal)),
    st.tuples(st.just("like"), column, st.sampled_from(["a%", "%B%", "_", "1_", "a%b", "%", ""])),
    st.tuples(st.sampled_from(["in", "not in"]), column, st.lists(literal, max_size=3)),
    st.tuples(st.sampled_from(["between", "not between"]), column, literal, literal),
)
tree = st.recursive(
    leaf,
    lambda x: st.one_of(st.tuples(st.just("not"), x), st.lists(x, min_size=1, max_size=3).map(lambda v: ("and", *v)), st.lists(x, min_size=1, max_size=3).map(lambda v: ("or", *v))),
    max_leaves=5,
)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(c=tree)
def test_random_conditions(spark, c):
    rows = [{"i": i * 20 + j, "a": v, "b": w} for i, v in enumerate(VALUES) for j, w in enumerate(VALUES[::3])]
    df = getattr(test_random_conditions, "df", None)
    if df is None:
        df = test_random_conditions.df = spark.createDataFrame([(r["i"], r["a"], r["b"]) for r in rows], "i long, a string, b string").cache()
    got = {r.i for r in df.filter(C.to_column(C.parse(list(c)), df.schema)).collect()}
    assert got == {r["i"] for r in rows if holds(c, r)}


def test_pruning():
    assert C.prune({"a": "", "b": 0, "c": None}) == {"b": 0}
    assert C.prune(["or", {"a": " "}, ["=", "b", []], ["=", "c", 1]]) == ["or", ["=", "c", 1]]
    assert C.prune(["and", {"a": ""}]) == [] and C.prune([["a", "b"], ["", 2]]) == [["b"], [2]]
    assert C.equalities(C.parse(["and", {"a": 1, "b": 2}, [">", "c", 1]])) == {"a": 1, "b": 2}
    assert C.equalities(C.parse(["or", {"a": 1}, {"b": 2}])) == {}


def test_cells(spark):
    df = spark.createDataFrame([(v,) for v in VALUES + [" Yes\t", "me@example.com"]], "v string")
    c = F.col("v")
    got = {r.v: r for r in df.select("v", cells.as_int(c, -1).alias("i"), cells.as_float(c).alias("f"), cells.as_bool(c).alias("b"), cells.trim(c).alias("t"), cells.is_empty(c).alias("e"), cells.validate(c, ["required", "numeric", "email", "max:3"]).alias("x")).collect()}
    assert got["1.0"].i == 1 and got["1e2"].i == 100 and got["1d"].i == got["NaN"].i == -1 and got[" 1 "].f == 1.0
    assert got[" Yes\t"].b and got[" Yes\t"].t == "Yes" and not got["abc"].b and got[""].e and got[None].e
    assert got[""].x.errors == ["Field is required"] and got["me@example.com"].x.errors == ["Value must be numeric", "Too long"] and not got["me@example.com"].x.valid
