"""Rows of several files, of which Spark reads the largest first, in the order of the files."""

import os
import threading
import time
from pathlib import Path

import duckdb
import pytest

from rowloom import catalogue
from rowloom.sources import delimited
from rowloom.sources.table import ORDER, Table

SIZES = (3, 40, 9, 200, 1, 80)
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    at = 0
    for i, n in enumerate(SIZES):
        (tmp_path / "t.csv" / f"part-{i:05d}.csv").write_text("id,k\n" + "".join(f"{j},{j % 4}\n" for j in range(at, at + n)) + "too,long,row\n")
        at += n
    return Table(spark, str(tmp_path / "t.csv"), state_dir=str(tmp_path / "state"))


def test_lines(table):
    got = [(r.line, r["id"]) for r in table.find().with_lines().where({"k": 1}).all()]
    assert sorted(got) == [(i + 1, str(i)) for i in range(1, sum(SIZES), 4)]


def test_offsets(table):
    assert list(table.find().where({"k": 3}).offsets()) == [f"{i + 1}\n" for i in range(3, sum(SIZES), 4)]


@pytest.fixture
def cores_go(spark, monkeypatch):
    """Of the cores that Spark's splits follow one is left, from the first stage on that runs after rows were to be numbered."""
    name, numbered, threads = "spark.sql.leafNodeDefaultParallelism", delimited.with_row_numbers, []

    def wait():
        while not spark.sparkContext.statusTracker().getActiveStageIds():
            time.sleep(0.001)
        spark.conf.set(name, "1")

    def watched(*args, **more):
        out = numbered(*args, **more)
        threads.append(threading.Thread(target=wait))
        threads[-1].start()
        return out

    monkeypatch.setattr(delimited, "with_row_numbers", watched)
    yield
    for t in threads:
        t.join()
    spark.conf.unset(name)


def test_offsets_while_executors_go(spark, table, cores_go):
    assert list(table.find().where({"k": 3}).offsets()) == [f"{i + 1}\n" for i in range(3, sum(SIZES), 4)]
    assert spark.conf.get("spark.sql.leafNodeDefaultParallelism") == "1" and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_numbers_of_other_splits_are_refused(spark, table, cores_go):
    placed = delimited.read(spark, table.path, place=ORDER)
    with pytest.raises(Exception, match="splits changed"):
        delimited.with_row_numbers(placed, place=ORDER).collect()


def test_appended_rows_are_numbered_as_given(spark, table):
    more = spark.createDataFrame(spark.sparkContext.parallelize([(str(i), "0") for i in range(333, 340)], 1), "id string, k string")
    more = more.union(spark.range(340, 900, numPartitions=1).selectExpr("cast(id as string)", "'0'"))
    assert table.batch_insert(more) == 567 and table.insert({"id": "900", "k": "0"}) == 1
    lines = {r["id"]: r.line for r in table.find().with_lines().all()}
    assert sorted(lines, key=lines.get) == [str(i) for i in range(901)]


def test_limit(table):
    frame = table.find().select("id").offset(3).limit(50).frame()
    assert [r.id for r in frame.collect()] == [str(i) for i in range(3, 53)]
    assert {r.id for r in frame.repartition(3).collect()} == {str(i) for i in range(3, 53)}


def test_one(table):
    assert table.find().one()["id"] == "0" and table.find().where({"k": 3}).scalar() == "3"
    assert table.find().offset(4).one()["id"] == "4" and table.find().limit(0).one() is None
    assert table.find().where([">", "id", 330]).scalar() == "331"


def test_each(table):
    assert [r["id"] for r in table.find().each()] == [str(i) for i in range(sum(SIZES))]
    assert [r["id"] for r in table.find().offset(2).limit(60).each()] == [str(i) for i in range(2, 62)]


def test_batch(table):
    assert [[r["id"] for r in b] for b in table.find().limit(5).batch(2)] == [["0", "1"], ["2", "3"], ["4"]]
    table.update({"k": "x"}, {"id": "1"})
    assert [[r["id"] for r in b] for b in table.find().limit(5).batch(2)] == [["0", "1"], ["2", "3"], ["4"]]


def test_all_and_index_by(table):
    assert [r["id"] for r in table.find().all()] == table.find().column() == [str(i) for i in range(sum(SIZES))]
    assert {k: r["id"] for k, r in table.find().index_by("k").all().items()} == {"0": "332", "1": "329", "2": "330", "3": "331"}
    assert table.find().offset(330).column() == ["330", "331", "332"] and table.find().limit(45).column() == [str(i) for i in range(45)]


def test_parquet(spark, tmp_path):
    spark.range(700, numPartitions=1).write.parquet(str(tmp_path / "big"))
    spark.range(3, numPartitions=1).write.parquet(str(tmp_path / "small"))
    (tmp_path / "t").mkdir()
    for i, n in enumerate(("small", "big", "small")):
        (tmp_path / "t" / f"{i}.parquet").write_bytes(next((tmp_path / n).glob("part-*.parquet")).read_bytes())
    q = Table(spark, str(tmp_path / "t"), "parquet", state_dir=str(tmp_path / "state")).find()
    want = [0, 1, 2, *range(700), 0, 1, 2]
    assert q.column() == want and [r["id"] for r in q.limit(7).each()] == want[:7] and q.limit(5).column() == want[:5]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["csv_batch", "csv_each", "csv_index_by"])
def test_same_as_sql_over_files(spark, monkeypatch, name):
    """The text is written as four files, of which the first is not the largest, and the last not the smallest."""
    made, tables = catalogue._csv, []
    monkeypatch.setattr(catalogue, "_csv", lambda *args, **more: tables.append(made(*args, **more)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in catalogue.QUERIES[name](spark, DATA).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = duckdb.connect().execute(f"create view customer as select * from '{DATA}/customer.parquet'").execute(catalogue.ORACLE_SQL[name]).fetchall()
    sizes = [p.stat().st_size for p in sorted(Path(tables[0].path.removeprefix("file://")).glob("part-*"))]
    assert len(sizes) == 4 and sizes[0] < max(sizes) and sizes[-1] > min(sizes)
    assert sorted(got) == sorted(want)
