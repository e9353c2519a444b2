"""Delimited text: a header row, every column a string, missing fields empty."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"
ROW_ID = "_row_id"


def header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """Column names. A UTF-8 mark is dropped, case and spaces stay, of equal names the last stays under its name."""
    names = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).option("quote", '"').option("escape", '"').csv(path).columns
    return names


def _raw(spark: SparkSession, path: str | list[str], names: list[str], separator: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(BAD, T.StringType())])
    return (
        spark.read.schema(schema).option("header", True).option("sep", separator).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True)
        .option("columnPruning", False).csv(path)  # with pruning Spark overlooks rows of a wrong length
    )


def _too_long(names: list[str], separator: str) -> Column:
    """A broken row whose last column is filled has too many fields."""
    return F.col(BAD).isNotNull() & F.col(f"`{names[-1]}`").isNotNull() & _has_more(F.col(BAD), separator, len(names))


def read(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False, long_rows: str = "drop", place: str | None = None, only: list[str] | None = None) -> DataFrame:
    """All rows as strings. Short rows are filled with empty text; rows with too many fields are dropped, or cut if
    long_rows is "cut". multi_line allows line breaks in quotes, but then a file can't be split. place names a column to add by which
    rows are in the order of the files; it holds for one query, since it follows the splits. With only, just these files of the path are read."""
    names = header(spark, path, separator)
    raw = _raw(spark, only or path, names, separator, multi_line)
    more = []
    if place:
        raw = raw.withColumn(place, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")))
        more = [F.col(place)]
    if long_rows == "drop":
        raw = raw.filter(~_too_long(names, separator))
    return raw.select(*[F.coalesce(f"`{n}`", F.lit("")).alias(n) for n in names], *more)


def long_rows(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False) -> int:
    """How many rows have too many fields, and are dropped."""
    names = header(spark, path, separator)
    return _raw(spark, path, names, separator, multi_line).filter(_too_long(names, separator)).count()


def _has_more(line: Column, separator: str, n: int) -> Column:
    """Whether a line has more than n fields; separators in quotes don't count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) >= n * len(separator)


def with_row_numbers(df: DataFrame, name: str = ROW_ID, start: int = 1, place: str | None = None) -> DataFrame:
    """Rows numbered in the order of the files, from one count per split. Spark deals the splits of several files to partitions by their
    size, so place names a struct that has file_path and file_block_start, which is left out; without it partitions count as splits.
    The rows are read twice: run it within steady_splits. Where the second reading deals its rows otherwise, it fails."""
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    split = F.struct(f"{place}.file_path", f"{place}.file_block_start") if place else F.shiftright("_at", 33)
    counts = tagged.groupBy(split.alias("_split")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("_split", "_n", "_first", (F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")).alias("_before"))  # a row per split
    numbered = tagged.withColumn("_split", split).join(F.broadcast(before), "_split", "left")
    at = F.col("_at") - F.col("_first")
    number = F.when((at >= 0) & (at < F.col("_n")), F.col("_before") + at + start).otherwise(F.raise_error(F.lit("splits changed while rows were numbered")).cast("long"))
    return numbered.select(*[f"`{c}`" for c in df.columns if c != place], number.alias(name))


@contextmanager
def steady_splits(spark: SparkSession) -> Iterator[None]:
    """Tables are dealt to as many partitions as the cores of now ask for, also when executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if not before:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if not before:
            spark.conf.unset(name)


def write(df: DataFrame, path: str, separator: str = ",") -> None:
    """A folder of delimited files, each with a header, appended to if it exists."""
    df.write.mode("append").option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
