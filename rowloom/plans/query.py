"""The query builder: immutable, and lowered to one lazy DataFrame."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import chain, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.results import ResultRow
from ..operators import conditions as C
from ..operators.aggregates import aggregate as make_aggregate
from ..sources.delimited import ROW_ID
from ..sources.table import ORDER, Table
from ..streaming import rows as streams

log = logging.getLogger("rowloom")


@dataclass(frozen=True)
class Query:
    table: Table
    columns: tuple[str, ...] = ()
    condition: Any = None
    sql_condition: str | None = None
    order: tuple[tuple[str, bool], ...] = ()  # (column, descending)
    groups: tuple[str, ...] = ()
    most: int | None = None
    skip: int = 0
    key: str | Callable | None = None
    plain: bool = False
    rule: str = "loose"
    debugging: bool = False
    lines: bool = False

    # --- building ------------------------------------------------------------------------------------------------

    def select(self, *columns: str | Iterable[str]) -> Query:
        return replace(self, columns=tuple(_flat(columns)))

    def where(self, condition: Any, value: Any = None) -> Query:
        """Replaces the filter. where("column", value) is short for equality."""
        return replace(self, condition=C.parse(_pair(condition, value)))

    def and_where(self, condition: Any, value: Any = None) -> Query:
        return replace(self, condition=C.both("and", self.condition, C.parse(_pair(condition, value))))

    def or_where(self, condition: Any, value: Any = None) -> Query:
        return replace(self, condition=C.both("or", self.condition, C.parse(_pair(condition, value))))

    def filter_where(self, condition: Any) -> Query:
        return self.where(C.prune(condition))

    def and_filter_where(self, condition: Any) -> Query:
        return self.and_where(C.prune(condition))

    def or_filter_where(self, condition: Any) -> Query:
        return self.or_where(C.prune(condition))

    def where_json(self, text: str) -> Query:
        return replace(self, condition=C.parse_json(text))

    def where_sql(self, text: str) -> Query:
        """A filter in SQL, besides the other one."""
        return replace(self, sql_condition=text)

    def order_by(self, *columns: Any) -> Query:
        return replace(self, order=tuple(_orders(columns)))

    def add_order_by(self, *columns: Any) -> Query:
        return replace(self, order=(*self.order, *_orders(columns)))

    def group_by(self, *columns: str | Iterable[str]) -> Query:
        return replace(self, groups=tuple(_flat(columns)))

    def add_group_by(self, *columns: str | Iterable[str]) -> Query:
        return replace(self, groups=(*self.groups, *_flat(columns)))

    def limit(self, n: int | None) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=max(0, n))

    def index_by(self, key: str | Callable) -> Query:
        return replace(self, key=key)

    def as_array(self, on: bool = True) -> Query:
        return replace(self, plain=on)

    def compare_as(self, rule: str) -> Query:
        """loose (numbers as numbers) or bytes (everything as text)."""
        if rule not in ("loose", "bytes"):
            raise ValueError(f"unknown rule: {rule}")
        return replace(self, rule=rule)

    def debug(self, on: bool = True) -> Query:
        """Log the query's text and access path, as information of the logger `rowloom`, whenever it is lowered."""
        return replace(self, debugging=on)

    def with_lines(self, on: bool = True) -> Query:
        """Result rows know their line: the number of the row in delimited text, from 1, or the identity of a Parquet row."""
        return replace(self, lines=on)

    # --- lowering ------------------------------------------------------------------------------------------------

    def used_columns(self) -> list[str]:
        key = [self.key] if isinstance(self.key, str) else []
        return list(dict.fromkeys([*self.columns, *C.columns_used(self.condition), *(c for c, _ in self.order), *self.groups, *key]))

    def validate(self) -> None:
        self.table.check(self.used_columns())

    def access_path(self) -> str | None:
        """The index to read instead of the table, if one fits and is up to date."""
        equal, indexes = C.equalities(self.condition), self.table.indexes
        if not equal or self.table.changed or not indexes.meta()["indexes"] or not indexes.fresh():
            return None
        return indexes.choose(equal)

    def _filtered(self, row_id: bool = False, order: bool = False, any_order: bool = False, only: list[str] | None = None) -> DataFrame:
        self.validate()
        table, path = self.table, self.access_path()
        if self.debugging:
            log.info("%s | %s", self.sql(), f"index {path}" if path else "table")
        if path:
            df = table._with_virtual(table.indexes.read(path, C.equalities(self.condition)), table._state())
            df = df.withColumn(ORDER, F.col(ROW_ID)) if order else df
            df = df if row_id else df.drop(ROW_ID)
        else:
            df = table.frame(row_id, order, any_order, only)
        if self.condition is not None:
            df = df.filter(C.to_column(self.condition, table.schema, self.rule))
        return df.filter(F.expr(self.sql_condition)) if self.sql_condition else df

    def _sorting(self) -> list[Column]:
        return [F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in self.order]

    def frame(self) -> DataFrame:
        """The result as a lazy DataFrame. With an order, a limit takes equal rows in the order of the files; with groups, the
        first row of each group in the given order and then that of the files comes out. Without either, a limit takes the first rows
        of the files, of which each task keeps no more than the limit."""
        return self._lowered()

    def _lowered(self, ordered: bool | None = None, only: list[str] | None = None) -> DataFrame:
        """The frame; with ordered its rows are sorted by the given order and that of the files also without a limit, and with False
        rows come as Spark reads them."""
        cut = (self.most is not None or self.skip > 0) if ordered is None else ordered
        placed = cut or bool(self.groups)
        df = self._filtered(row_id=self.lines, order=placed, only=only)
        names = list(self.columns) or [c for c in df.columns if c not in (ROW_ID, ORDER)]
        names += [ROW_ID] if self.lines else []
        if self.groups:
            df = self._first_of_groups(df, names)
        if self.order or cut:
            df = df.orderBy(*self._sorting(), *([F.col(ORDER)] if placed else []))
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*[f"`{c}`" for c in names])

    def _first_of_groups(self, df: DataFrame, names: list[str]) -> DataFrame:
        """By an aggregation, so that each task sends one row per group; only an order that goes down needs a window, which keeps
        one row per group and task as well before it shuffles."""
        keep = list(dict.fromkeys([*names, *(c for c, _ in self.order), ORDER]))
        groups = [F.col(f"`{g}`") for g in self.groups]
        if any(down for _, down in self.order):
            place = F.row_number().over(Window.partitionBy(*groups).orderBy(*self._sorting(), ORDER))
            return df.withColumn("_place", place).filter("_place = 1").select(*[f"`{c}`" for c in keep])
        place = F.struct(*[F.col(f"`{c}`") for c, _ in self.order], ORDER)
        first = df.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.min_by(F.struct(*[f"`{c}`" for c in keep]), place).alias("_row"))
        return first.select("_row.*")

    # --- results -------------------------------------------------------------------------------------------------

    def _wrap(self, row) -> Any:
        values = row.asDict()
        line = values.pop(ROW_ID) if self.lines else None
        return values if self.plain else ResultRow(values, line)

    def _by_files(self) -> list[str]:
        """The table's files in order, if the result's rows are theirs one after another."""
        if self.order or self.groups or self.lines or self.table.changed or self.access_path():
            return []
        return self.table.files()

    def _piece(self, names: list[str], at: int, n: int) -> DataFrame:
        """Rows of n of the files in their order; a file alone is read in its order, so that a limit ends the reading."""
        return self._lowered(ordered=n > 1, only=names[at : at + n] if len(names) > 1 else None)

    def _collected(self) -> list:
        """The rows in the given order and that of the files. A limit without an order reads files until it has its rows, four times
        as many at each step."""
        if self.most == 0:
            return []
        names = self._by_files()
        if self.most is None:
            return replace(self, skip=0)._lowered(ordered=len(names) != 1).collect()[self.skip :]
        if not names:
            return self._lowered().collect()
        rows, need, at, n = [], self.skip + self.most, 0, 1
        while len(rows) < need and at < len(names):
            rows += replace(self, most=need - len(rows), skip=0)._piece(names, at, min(n, len(names) - at)).collect()
            at, n = at + n, n * 4
        return rows[self.skip :]

    def all(self) -> Any:
        rows = [self._wrap(r) for r in self._collected()]
        if self.key is None:
            return rows
        pick = self.key if callable(self.key) else lambda r: r[self.key]
        return {pick(r): r for r in rows}

    def keyed(self, column: str) -> DataFrame:
        """One row per value of a column: the last in the order of the query, or of the rows' identity."""
        df = self._filtered(order=not self.order)
        names = list(self.columns) or [c for c in df.columns if c != ORDER]
        if any(down for _, down in self.order):
            turned = [F.col(f"`{c}`").asc() if down else F.col(f"`{c}`").desc() for c, down in self.order]
            last = F.row_number().over(Window.partitionBy(f"`{column}`").orderBy(*turned))
            return df.withColumn("_place", last).filter("_place = 1").select(*[f"`{c}`" for c in names])
        place = F.struct(*[F.col(f"`{c}`") for c, _ in self.order] or [F.col(ORDER)])
        return df.groupBy(F.col(f"`{column}`").alias("_key")).agg(F.max_by(F.struct(*[f"`{c}`" for c in names]), place).alias("_row")).select("_row.*")

    def one(self) -> Any:
        found = replace(self, most=1)._collected() if self.most != 0 else []
        return self._wrap(found[0]) if found else None

    def scalar(self) -> Any:
        found = replace(self, most=1)._collected() if self.most != 0 else []
        return found[0][0] if found else None

    def column(self) -> list:
        first = self.columns[0] if self.columns else self.table.headers[0]
        return [r[0] for r in replace(self, columns=(first,))._collected()]

    def each(self) -> Iterator[Any]:
        """Row by row, in the given order and that of the files. A limit without an order ends the reading."""
        names, whole = self._by_files(), replace(self, most=None, skip=0)
        if names:
            rows = chain.from_iterable(streams.each(whole._piece(names, i, 1)) for i in range(len(names)))
        elif self.most is None:
            rows = streams.each(whole._lowered(ordered=True))
        else:
            return map(self._wrap, streams.each(self._lowered()))
        return map(self._wrap, islice(rows, self.skip, None if self.most is None else self.skip + self.most))

    def batch(self, size: int = 100) -> Iterator[list]:
        return streams.batches(self.each(), size)

    def offsets(self) -> Iterator[str]:
        return streams.offsets(self._filtered(row_id=True).orderBy(ROW_ID), ROW_ID)

    def exists(self) -> bool:
        return not self._filtered().limit(1).isEmpty()

    # --- aggregates ----------------------------------------------------------------------------------------------

    def count_frame(self, name: str = "cnt") -> DataFrame:
        """Rows that fit, or groups if there are any; limit and offset don't matter."""
        df = self._filtered(any_order=True)
        if self.groups:
            return df.agg(F.count_distinct(F.struct(*[f"`{g}`" for g in self.groups])).alias(name))
        return df.agg(F.count("*").alias(name))

    def count(self) -> int:
        return self.count_frame().first()[0]

    def aggregate_frame(self, specs: Mapping[str, Any], text_as_zero: bool = False) -> DataFrame:
        """Groups (all rows are one without) with aggregates {name: (function, column)}, computed in one pass."""
        schema = self.table.schema
        df = self._filtered(any_order=True)
        self.table.check([c for _, c in specs.values() if c != "*"])
        made = [make_aggregate(f, c, schema[c].dataType if c != "*" else None, text_as_zero).alias(n) for n, (f, c) in specs.items()]
        return df.groupBy(*[f"`{g}`" for g in self.groups]).agg(*made)

    def _scalar_of(self, func: str, column: str) -> Any:
        return replace(self, groups=()).aggregate_frame({"v": (func, column)}).first()[0]

    def sum(self, column: str) -> Any:
        return self._scalar_of("sum", column)

    def average(self, column: str) -> Any:
        return self._scalar_of("avg", column)

    def min(self, column: str) -> Any:
        return self._scalar_of("min", column)

    def max(self, column: str) -> Any:
        return self._scalar_of("max", column)

    def aggregate(self, group: str | list[str], specs: Mapping[str, str]) -> dict:
        """{group: value}, or {group: {name: value}} with several {column: function}."""
        names = [group] if isinstance(group, str) else list(group)
        df = replace(self, groups=tuple(names)).aggregate_frame({f"{f}_{c}": (f, c) for c, f in specs.items()})
        out = {}
        for r in df.collect():
            key = r[0] if len(names) == 1 else tuple(r[: len(names)])
            values = r.asDict()
            out[key] = r[len(names)] if len(specs) == 1 else {n: values[n] for n in df.columns[len(names) :]}
        return out

    def group_counts(self) -> dict:
        rows = self.aggregate_frame({"cnt": ("count", "*")}).collect()
        return {(r[0] if len(self.groups) == 1 else tuple(r[:-1])): r[-1] for r in rows}

    def distinct_frame(self) -> DataFrame:
        """Distinct values of the selected columns."""
        return self._filtered(any_order=True).select(*[f"`{c}`" for c in self.columns]).distinct()

    # --- plans ---------------------------------------------------------------------------------------------------

    def explain(self, format: str = "array") -> Any:
        from .explain import explain

        return explain(self, format)

    def sql(self) -> str:
        from .text import sql_text

        return sql_text(self)

    def stats(self) -> dict[str, Any]:
        """Rows, and the seconds that each phase took, of a run of the query: those of Spark's planning, and the run itself."""
        began = time.perf_counter()
        df = self.frame()
        made = time.perf_counter()
        n = df.count()
        done = time.perf_counter()
        df._jdf.queryExecution().executedPlan()
        phases, each = df._jdf.queryExecution().tracker().phases(), {}
        names = phases.keysIterator()
        while names.hasNext():
            name = names.next()
            each[name] = phases.apply(name).durationMs() / 1000
        return {"rows": n, "seconds": done - began, "build": made - began, "run": done - made, "phases": each}


def _pair(condition: Any, value: Any) -> Any:
    return {condition: value} if isinstance(condition, str) and value is not None else condition


def _flat(columns: Iterable[Any]) -> list[str]:
    return [c for x in columns for c in ([p.strip() for p in x.split(",") if p.strip()] if isinstance(x, str) else x)]


def _orders(columns: Iterable[Any]) -> Iterator[tuple[str, bool]]:
    for x in columns:
        if isinstance(x, str):
            for part in filter(None, (p.strip() for p in x.split(","))):
                m = re.fullmatch(r"(.*?)\s+(asc|desc)", part, re.I)
                yield (m[1], m[2].lower() == "desc") if m else (part, False)
        elif isinstance(x, Mapping):
            yield from ((c, str(d).lower() in ("desc", "-1", "3")) for c, d in x.items())
        else:
            yield x[0], bool(x[1])
