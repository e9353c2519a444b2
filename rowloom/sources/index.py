"""Indexes as sorted Parquet copies: range-partitioned and sorted by their key, so that equality reads few row groups.

A text key that is a number compares as one, so each text column of a key gets a column beside it with its number; copies are sorted by
that first, and a comparison with a number is a plain equality that reaches the scan.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compare
from . import files
from .delimited import ROW_ID

if TYPE_CHECKING:
    from .table import Table

FILE_BYTES = 64 << 20  # of the table for each file of a copy
LEAST_BYTES = 1 << 20  # smaller tables get as many files as there are cores to sort them, each of so much of the table at least
TASK_BYTES = 128 << 20  # of rows as a task holds them to sort them, for each file of a copy
SPLIT_BYTES = 32 << 20  # of the table at most for each task that deals rows out, and twice TASK_BYTES of rows: beyond 200 files Spark holds what it deals
FOOTERS = 64  # files whose statistics an estimate reads


def index_name(columns: str | Iterable[str]) -> str:
    """Names of composite indexes don't depend on the order of their columns."""
    names = [columns] if isinstance(columns, str) else list(columns)
    return "_".join(sorted(n.lower() for n in names))


def number_of(column: str) -> str:
    return f"_number_{column}"


class Indexes:
    def __init__(self, table: Table):
        self.table = table

    @property
    def folder(self) -> str:
        return f"{self.table.state_dir}/index"

    def meta(self) -> dict[str, Any]:
        return files.read_json(self.table.spark, f"{self.folder}/meta.json", {"totalRows": None, "fingerprint": None, "indexes": {}})

    def _save(self, meta: dict[str, Any]) -> None:
        files.write_json(self.table.spark, f"{self.folder}/meta.json", meta)

    def create(self, keys: list[list[str]], bloom: bool = False, verbose: bool = False) -> list[str]:
        """Write the sorted copies of several keys from one scan. Rows take part in the ranges by their identity too, so a value
        that many rows have is dealt over several files. With bloom the keys get Parquet bloom filters, which need plain encoding;
        they help with values that are absent within a row group's range."""
        table, spark = self.table, self.table.spark
        keys = [sorted(k) for k in keys]
        for k in keys:
            table.check(k)
        if not keys:
            return []
        names, state = [index_name(k) for k in keys], table.fingerprint()
        rows = table._numbered()
        texts = sorted({c for k in keys for c in k if isinstance(rows.schema[c].dataType, T.StringType)})
        rows = rows.withColumns({number_of(c): compare.to_double(F.col(f"`{c}`"), T.StringType()) + F.lit(0.0) for c in texts})
        sort = [[x for c in k for x in ([number_of(c)] if c in texts else []) + [c]] for k in keys]
        size = files.size(spark, table.path) * len(keys)
        held = rows.count() * len(keys) * _row_bytes(table, len(rows.columns)) + size * (4 if table.kind == "parquet" else 1)
        n_files = max(1, -(-size // FILE_BYTES), -(-held // TASK_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
        if len(keys) == 1:
            order: list[Column] = [F.col(f"`{c}`") for c in sort[0]]
        else:  # a row for each copy; the columns of other copies' keys count as null
            rows = rows.withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(len(keys))])))
            order = [F.col("_copy"), *(F.when(F.col("_copy") == i, F.col(f"`{c}`")) for i, own in enumerate(sort) for c in own)]
        dealt = rows.repartitionByRange(n_files, *order, ROW_ID) if n_files > 1 else rows.coalesce(1)
        writer = dealt.sortWithinPartitions(*order, ROW_ID).write.mode("overwrite").option("parquet.block.size", 32 << 20)
        for c in dict.fromkeys(c for own in sort for c in own) if bloom else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
        with _progress(spark, verbose), _splits(spark, min(SPLIT_BYTES // len(keys), max(1 << 20, 2 * TASK_BYTES * size // len(keys) // max(1, held)))):
            if len(keys) == 1:
                writer.parquet(f"{self.folder}/{names[0]}")
            else:
                draft = f"{self.folder}/_draft"
                writer.partitionBy("_copy").parquet(draft)
                for i, name in enumerate(names):
                    files.delete(spark, f"{self.folder}/{name}")
                    if files.exists(spark, f"{draft}/_copy={i}"):
                        files.move(spark, f"{draft}/_copy={i}", f"{self.folder}/{name}")
                    else:  # no rows
                        rows.drop("_copy").limit(0).write.parquet(f"{self.folder}/{name}")
                files.delete(spark, draft)
        meta = self.meta()
        if meta["fingerprint"] != state:
            meta = {"indexes": {}}
        meta |= {"fingerprint": state}
        meta.setdefault("totalRows", None)
        for name, k in zip(names, keys):
            meta["indexes"][name] = {"columns": k, "numbers": [c for c in k if c in texts], "distinctCount": None, "fileSize": files.size(spark, f"{self.folder}/{name}"), "bloom": bloom}
        self._save(meta)
        return names

    def describe(self) -> dict[str, Any]:
        """The entries with rows and distinct keys, exactly; counted once, when first asked for."""
        meta, new = self.meta(), False
        for name, entry in meta["indexes"].items():
            if entry["distinctCount"] is None:
                rows = self.table.spark.read.parquet(f"{self.folder}/{name}")
                entry["distinctCount"] = rows.select(*[f"`{c}`" for c in entry["columns"]]).distinct().count()
                meta["totalRows"], new = rows.count(), True
        if new:
            self._save(meta)
        return meta

    def has(self, columns: str | Iterable[str]) -> bool:
        return index_name(columns) in self.meta()["indexes"]

    def path(self, columns: str | Iterable[str]) -> str:
        return f"{self.folder}/{index_name(columns)}"

    def drop(self, columns: str | Iterable[str]) -> bool:
        meta, name = self.meta(), index_name(columns)
        if name not in meta["indexes"]:
            return False
        files.delete(self.table.spark, f"{self.folder}/{name}")
        del meta["indexes"][name]
        self._save(meta)
        return True

    def clear(self) -> None:
        files.delete(self.table.spark, self.folder)

    def fresh(self) -> bool:
        """Whether the indexes are of the table as it is now."""
        found = self.meta()["fingerprint"]
        return found is None or found == self.table.fingerprint()

    def choose(self, equal: Mapping[str, Any]) -> str | None:
        """The index all of whose columns are compared for equality: of several the one that leaves fewest bytes to read, by the
        statistics in its footers."""
        fit = [n for n, entry in sorted(self.meta()["indexes"].items()) if set(entry["columns"]) <= set(equal)]
        return min(fit, key=lambda n: self.bytes_left(n, equal)[0]) if len(fit) > 1 else fit[0] if fit else None

    def _tests(self, name: str, equal: Mapping[str, Any]) -> dict[str, Any]:
        """Columns of the copy that must have a value."""
        entry = self.meta()["indexes"][name]
        out: dict[str, Any] = {}
        for c in entry["columns"]:
            if c in entry["numbers"] and compare.is_number(equal[c]):
                out[number_of(c)] = float(equal[c]) + 0.0
            else:
                out[c] = equal[c]
        return out

    def read(self, name: str, equal: Mapping[str, Any] | None = None) -> DataFrame:
        """A copy, or its rows whose numbers equal those of the given values; the condition itself is still to be applied."""
        df = self.table.spark.read.parquet(f"{self.folder}/{name}")
        for c, v in self._tests(name, equal).items() if equal else ():
            if c not in equal:
                df = df.filter(F.col(f"`{c}`") == F.lit(v))
        return df.drop(*[c for c in df.columns if c.startswith(number_of(""))])

    def bytes_left(self, name: str, equal: Mapping[str, Any]) -> tuple[int, int]:
        """Bytes of the row groups that can hold the values, and of all: from the footers of FOOTERS files at most, scaled up."""
        spark, tests = self.table.spark, self._tests(name, equal)
        found = [s for s in files.listing(spark, f"{self.folder}/{name}") if s.getPath().getName().endswith(".parquet")]
        step = -(-len(found) // FOOTERS) or 1
        left = total = 0
        for status in found[::step]:
            for group in _row_groups(spark, status.getPath()):
                size = group.getCompressedSize()
                total += size
                left += size if all(_may_hold(group, c, v) for c, v in tests.items()) else 0
        return left * step, total * step


def _row_bytes(table: Table, columns: int) -> int:
    """Memory of a row that is sorted, without its texts: however well the table is compressed, rows are not. The identity of a Parquet row has its path."""
    return 64 + 16 * columns + (len(table.path) + 24 if table.kind == "parquet" else 0)


@contextmanager
def _splits(spark: SparkSession, most: int) -> Iterator[None]:
    """Tables are read in splits of so many bytes at most."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _row_groups(spark: SparkSession, path: Any) -> list:
    parquet = spark._jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    try:
        return list(reader.getFooter().getBlocks())
    finally:
        reader.close()


def _may_hold(group: Any, column: str, value: Any) -> bool:
    for chunk in group.getColumns():
        if chunk.getPath().toDotString() == column:
            stats = chunk.getStatistics()
            if stats is None or not stats.hasNonNullValue():
                return stats is None or stats.getNumNulls() < group.getRowCount()
            low, high = stats.genericGetMin(), stats.genericGetMax()
            if hasattr(low, "toStringUsingUTF8"):
                low, high, value = (x.encode() for x in (low.toStringUsingUTF8(), high.toStringUsingUTF8(), compare.as_text(value)))
            try:
                return low <= value <= high
            except TypeError:  # a value of another kind says nothing
                return True
    return True


@contextmanager
def _progress(spark: SparkSession, verbose: bool) -> Iterator[None]:
    """Prints how many tasks of the running stages are done, every two seconds."""
    done = threading.Event()

    def show() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not done.wait(2):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    print(f"stage {stage}: {info.numCompletedTasks} of {info.numTasks} tasks", flush=True)

    if verbose:
        threading.Thread(target=show, daemon=True).start()
    try:
        yield
    finally:
        done.set()
