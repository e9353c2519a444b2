"""Small files, locks and listings through Hadoop's file systems, so that state may lie wherever Spark can write."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

SAMPLE = 64 << 10  # bytes of each place of a file that go into a fingerprint


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, source: str, to: str) -> None:
    fs, p = _at(spark, source)
    target = _at(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"can't move {source} to {to}")


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return default
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Replaces the file in one step where the file system can: readers see the old text or the new, never a part."""
    fs, p = _at(spark, path)
    draft = _at(spark, f"{path}.{uuid.uuid4().hex}")[1]
    write_bytes(spark, draft.toString(), json.dumps(value, indent=1).encode())
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(p), over)


@contextmanager
def lock(spark: SparkSession, path: str, seconds: float = 60) -> Iterator[None]:
    """Holds a lock file, which one writer at a time can make."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    until = time.monotonic() + seconds
    while not fs.createNewFile(p):
        if time.monotonic() > until:
            raise TimeoutError(f"another writer holds {path}; if it has died, delete the file")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(p, False)


def listing(spark: SparkSession, path: str) -> list:
    """The status of each file below a path, by name."""
    fs, p = _at(spark, path)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next())
    return sorted(out, key=lambda s: s.getPath().toString())


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files below a path that Spark reads, by name: nothing that it takes for hidden."""
    root = _at(spark, path)[0].makeQualified(_at(spark, path)[1]).toString().rstrip("/")
    found = [s.getPath().toString() for s in listing(spark, path)]
    return [p for p in found if not any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in p[len(root) :].split("/"))]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and modification times below a path, and of the content at the begin, middle and end of its first,
    middle and last file: a file may be rewritten at equal size within a tick of the clock."""
    fs, found = _at(spark, path)[0], listing(spark, path)
    out = [f"{s.getPath().getName()}|{s.getLen()}|{s.getModificationTime()}" for s in found]
    digest, bounded = spark._jvm.org.apache.commons.codec.digest.DigestUtils, spark._jvm.org.apache.commons.io.input.BoundedInputStream
    for i in sorted({0, len(found) // 2, len(found) - 1}) if found else ():
        n = found[i].getLen()
        for at in sorted({0, max(0, n // 2 - SAMPLE // 2), max(0, n - SAMPLE)}):
            stream = fs.open(found[i].getPath())
            try:
                stream.seek(at)
                out.append(digest.sha1Hex(bounded(stream, SAMPLE)))
            finally:
                stream.close()
    return hashlib.sha1("\n".join(out).encode()).hexdigest()


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or in local mode without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rowloom-")
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
