"""What the operators of this subpackage share: the shared folder, sizes and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.files import work_folder

# The 26 letters that contracts lower-case, and nothing else.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of scratch()
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def scratch(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the folder that all executors share (in a folder for each value of `by`) and read it back:
    lineage ends here and survives lost executors."""
    path = work_folder(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def release(table: DataFrame) -> None:
    """Delete the folder of a table that scratch() gave; anything else is left alone. No frame that is still to run may read it."""
    if path := _folders.pop(table, None):
        files.delete(table.sparkSession, path)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that scratch() writes within are released at the end, but for those put into the list, which an enclosing passing()
    releases in its turn."""
    made: list[DataFrame] = []
    keep: list[DataFrame] = []
    outer = _made.get()
    token = _made.set(made)
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        _made.reset(token)
        for own in made:
            if not any(own is k for k in keep):
                release(own)
            elif outer is not None:
                outer.append(own)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Let at most `rows` rows, or `size` bytes of several rows, go to Python at once from now on: whole texts are long, and 10,000 of
    them fill a worker. The setting is the session's, since plans read it when they run."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
