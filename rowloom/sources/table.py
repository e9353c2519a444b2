"""A table: its rows, virtual columns, appended rows, cell updates and indexes.

State lies in a folder beside the table: meta.json (virtual columns, versions), lock, rows/ (numbered copy of delimited text),
appends/ (Parquet), updates/ (Parquet: row, column, value, sequence) and index/. Updates are merged at read time,
before any predicate. An index is a sorted copy and never changes a result. Changes are made under a lock and count from the moment
meta.json is replaced: of a change that died before, nothing is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import conditions
from . import delimited, files
from .delimited import ROW_ID
from .index import Indexes

ORDER = "_row_order"  # a column by which rows are in the order of the files; unlike their identity it holds for one query
BATCH = 1 << 40  # row numbers of a batch of appended rows start at this times the batch's number


class Table:
    def __init__(self, spark: SparkSession, path: str, kind: str = "csv", separator: str = ",", state_dir: str | None = None, multi_line: bool = False, name: str | None = None):
        if not files.exists(spark, path):
            raise FileNotFoundError(path)
        if kind not in ("csv", "parquet"):
            raise ValueError(f"unknown kind of table: {kind}")
        self.spark, self.path, self.kind, self.separator, self.multi_line = spark, path, kind, separator, multi_line
        self.state_dir = (state_dir or f"{path.rstrip('/')}.rowloom").rstrip("/")
        self.name = name or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.indexes = Indexes(self)

    # --- state ---------------------------------------------------------------------------------------------------

    def _state(self) -> dict[str, Any]:
        return files.read_json(self.spark, f"{self.state_dir}/meta.json", {"virtual_columns": {}, "updates": 0, "appends": 0})

    def _save(self, state: dict[str, Any]) -> None:
        files.write_json(self.spark, f"{self.state_dir}/meta.json", state)

    @property
    def virtual_columns(self) -> dict[str, str]:
        return dict(sorted(self._state()["virtual_columns"].items()))

    @property
    def changed(self) -> bool:
        """Whether there are appended or updated rows, which sorted copies don't hold."""
        state = self._state()
        return bool(state["updates"] or state["appends"])

    def _locked(self):
        return files.lock(self.spark, f"{self.state_dir}/lock")

    def fingerprint(self) -> str:
        return files.fingerprint(self.spark, self.path)

    # --- rows ----------------------------------------------------------------------------------------------------

    @cached_property
    def _plain(self) -> DataFrame:
        if self.kind == "parquet":
            return self.spark.read.parquet(self.path)
        return delimited.read(self.spark, self.path, self.separator, self.multi_line)

    def _numbered(self) -> DataFrame:
        """Rows of the file with their identity: for Parquet, file and row number, which its reader knows; for
        text the row number, kept in a copy that is made once per state of the file."""
        if self.kind == "parquet":
            at = F.concat("_metadata.file_path", F.lit("#"), F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0"))
            return self._plain.select("*", at.alias(ROW_ID))
        folder = self._rows_folder
        if not files.exists(self.spark, f"{folder}/_SUCCESS"):
            placed = delimited.read(self.spark, self.path, self.separator, self.multi_line, place=ORDER)
            with delimited.steady_splits(self.spark):
                delimited.with_row_numbers(placed, place=ORDER).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    @property
    def _rows_folder(self) -> str:
        return f"{self.state_dir}/rows/{self.fingerprint()}"

    def _columnar(self) -> DataFrame | None:
        """The rows of delimited text from a Parquet copy, if there is one of its present state: in any order, and pruned by column."""
        if self.kind == "parquet":
            return None
        if (indexes := self.indexes.meta()["indexes"]) and self.indexes.fresh():
            return self.indexes.read(min(indexes, key=lambda n: indexes[n]["fileSize"])).drop(ROW_ID)
        folder = self._rows_folder if files.exists(self.spark, f"{self.state_dir}/rows") else ""
        return self.spark.read.parquet(folder).drop(ROW_ID) if folder and files.exists(self.spark, f"{folder}/_SUCCESS") else None

    @property
    def schema(self) -> T.StructType:
        fields = list(self._plain.schema.fields)
        return T.StructType([*fields, *(T.StructField(v, T.StringType()) for v in self.virtual_columns)])

    @property
    def headers(self) -> list[str]:
        return self.schema.names

    @property
    def header_map(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.headers)}

    def files(self) -> list[str]:
        """The files of the rows by name, which is their order. Spark reads those of several files by size, the largest first."""
        return files.data_files(self.spark, self.path)

    def frame(self, row_id: bool = False, order: bool = False, any_order: bool = False, only: list[str] | None = None) -> DataFrame:
        """Current rows: file, appended rows, updates, virtual columns. With row_id each row's identity comes along, with order
        a column ORDER, for which nothing is counted or copied. any_order allows to read a copy in another order. With only, the rows of
        these files come out, for a table that is not changed and without row_id."""
        state = self._state()
        if not row_id and not state["updates"] and not state["appends"]:
            if not order and not only:
                return self._with_virtual((self._columnar() if any_order else None) or self._plain, state)
            if self.kind == "parquet":
                plain = self.spark.read.schema(self._plain.schema).option("basePath", self.path).parquet(*only) if only else self._plain
                placed = plain.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(ORDER))
            else:
                placed = delimited.read(self.spark, self.path, self.separator, self.multi_line, place=ORDER, only=only)
            return self._with_virtual(placed if order else placed.drop(ORDER), state)
        df = self._numbered()
        if state["appends"]:
            stored = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
            df = df.unionByName(self.spark.read.schema(stored).parquet(f"{self.state_dir}/appends").filter(F.col("batch") <= state["appends"]).drop("batch"))
        df = self._with_virtual(df, state)
        if state["updates"]:
            df = self._merged(df, state["updates"])
        df = df.withColumn(ORDER, F.col(ROW_ID)) if order else df
        return df if row_id else df.drop(ROW_ID)

    def _with_virtual(self, df: DataFrame, state: dict) -> DataFrame:
        new = {n: F.lit(d) for n, d in sorted(state["virtual_columns"].items()) if n not in df.columns}
        return df.withColumns(new) if new else df

    def _merged(self, df: DataFrame, updates: int) -> DataFrame:
        """Last written values over df. The changes of a row meet in one aggregation; Spark broadcasts them if they are small."""
        log = self.spark.read.parquet(f"{self.state_dir}/updates").filter(F.col("batch") <= updates)
        names = [c for c in df.columns if c != ROW_ID]
        last = log.groupBy(F.col("row").alias("_row")).agg(
            *[F.max(F.when(F.col("column") == n, F.struct("seq", "value"))).alias(f"_new_{i}") for i, n in enumerate(names)]
        )
        both = df.join(last, F.col(ROW_ID).cast("string") == F.col("_row"), "left")
        return both.select(
            *[F.when(F.col(f"_new_{i}").isNotNull(), F.col(f"_new_{i}.value").cast(df.schema[n].dataType)).otherwise(F.col(f"`{n}`")).alias(n) for i, n in enumerate(names)],
            ROW_ID,
        )

    # --- queries -------------------------------------------------------------------------------------------------

    def find(self):
        from ..plans.query import Query

        return Query(self)

    def where(self, condition: Any, value: Any = None):
        return self.find().where(condition, value)

    def and_where(self, condition: Any, value: Any = None):
        return self.find().and_where(condition, value)

    def skipped_rows(self) -> int:
        """Rows of delimited text that have too many fields and are left out."""
        return delimited.long_rows(self.spark, self.path, self.separator, self.multi_line) if self.kind == "csv" else 0

    # --- changes -------------------------------------------------------------------------------------------------

    def insert(self, row: Mapping[str, Any]) -> int:
        return self.batch_insert([row])

    def batch_insert(self, rows: Iterable[Mapping[str, Any]] | DataFrame) -> int:
        """Append rows. Columns that a row lacks are empty text (null in typed columns); virtual columns can't be given."""
        physical = self._plain.schema
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            if unknown := {c for r in rows for c in r} - set(physical.names):
                raise ValueError(f"Column not found: {', '.join(sorted(unknown))}")
            if not rows:
                return 0
            text = {f.name for f in physical if isinstance(f.dataType, T.StringType)}
            rows = self.spark.createDataFrame([tuple(_cell(r.get(n), n in text) for n in physical.names) for r in rows], physical)
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in physical])
        draft = f"{self.state_dir}/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)  # first, since a frame may give other partitions when it is run again, and numbers follow partitions
        written = self.spark.read.schema(rows.schema).parquet(draft)
        placed = written.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias(ORDER))
        with self._locked():
            state = self._state()
            batch = state["appends"] + 1
            numbered = delimited.with_row_numbers(placed, start=batch * BATCH, place=ORDER)
            if self.kind == "parquet":
                numbered = numbered.withColumn(ROW_ID, F.format_string("~%020d", ROW_ID))
            with delimited.steady_splits(self.spark):
                numbered.write.mode("overwrite").parquet(f"{self.state_dir}/appends/batch={batch}")
            self._save(state | {"appends": batch})
        n = written.count()
        files.delete(self.spark, draft)
        return n

    def update(self, values: Mapping[str, Any], condition: Any = None) -> int:
        """Set cells of the rows that fit; returns how many fit. Cells are written beside the table, the last write counts."""
        query = self.find().where(condition) if condition else self.find()
        if unknown := set(values) - set(self.headers):
            raise ValueError(f"Column not found: {', '.join(sorted(unknown))}")
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(None if v is None else str(v)).alias("value")) for c, v in values.items()])
        with self._locked():
            state = self._state()
            batch = state["updates"] + 1
            changes = query._filtered(row_id=True).select(F.col(ROW_ID).cast("string").alias("row"), F.inline(cells)).withColumn("seq", F.lit(batch))
            folder = f"{self.state_dir}/updates/batch={batch}"
            changes.write.mode("overwrite").parquet(folder)
            written = self.spark.read.parquet(folder).count() // max(1, len(values))
            self._save(state | {"updates": batch})
        return written

    def add_column(self, name: str, default: str = "", materialize: bool = False) -> None:
        """A column with one value: by metadata alone, or with materialize by rewriting the table's rows."""
        if name.lower() in {h.lower() for h in self.headers}:
            raise ValueError(f"Column already exists: {name}")
        with self._locked():
            state = self._state()
            self._save(state | {"virtual_columns": state["virtual_columns"] | {name: default}})
        if materialize:
            self.materialize()

    def materialize(self) -> None:
        """Write the current rows, virtual columns included, as the table itself: a folder of files that by name are in the order of the
        rows. It replaces the old one by renaming."""
        new, old = f"{self.path.rstrip('/')}.new", f"{self.path.rstrip('/')}.old"
        df = self.frame()
        if self.kind == "csv":
            delimited.write(self.frame(row_id=True).orderBy(ROW_ID).drop(ROW_ID), new, self.separator)
        else:
            df.write.parquet(new)
        files.move(self.spark, self.path, old)
        files.move(self.spark, new, self.path)
        files.delete(self.spark, old)
        for part in ("rows", "appends", "updates", "index"):
            files.delete(self.spark, f"{self.state_dir}/{part}")
        self._save({"virtual_columns": {}, "updates": 0, "appends": 0})
        self.spark.catalog.refreshByPath(self.path)
        self.__dict__.pop("_plain", None)

    # --- indexes -------------------------------------------------------------------------------------------------

    def create_index(self, columns: Iterable[str | Iterable[str]], bloom: bool = False, verbose: bool = False) -> list[str]:
        return self.indexes.create([[c] if isinstance(c, str) else list(c) for c in columns], bloom, verbose)

    def index_path(self, columns: str | Iterable[str]) -> str:
        return self.indexes.path(columns)

    @property
    def index_dir(self) -> str:
        return self.indexes.folder

    def has_index(self, columns: str | Iterable[str]) -> bool:
        return self.indexes.has(columns)

    def drop_index(self, columns: str | Iterable[str]) -> bool:
        return self.indexes.drop(columns)

    def clear_indexes(self) -> None:
        self.indexes.clear()

    def meta(self) -> dict[str, Any]:
        return self.indexes.describe()

    def validate_integrity(self) -> bool:
        return self.indexes.fresh()

    def check(self, columns: Iterable[str]) -> None:
        known = set(self.headers)
        for c in columns:
            if c not in known:
                raise ValueError(f"Column not found: {c}")

    def column_of(self, condition: Any, rule: str = "loose"):
        return conditions.to_column(condition, self.schema, rule)


def _cell(value: Any, text: bool) -> Any:
    if text:
        return "" if value is None else str(value)
    return value
