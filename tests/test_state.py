"""Virtual columns, updates, appends, indexes, staleness."""

import os

import pytest

from rowloom.sources import delimited
from rowloom.sources.table import Table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(params=["csv", "parquet"])
def table(request, spark, tmp_path):
    df = spark.range(40, numPartitions=3).selectExpr("cast(id as string) as id", "concat('n', id % 7) as name", "cast(id * 3 % 11 as string) as n")
    path = str(tmp_path / f"t.{request.param}")
    if request.param == "csv":
        (tmp_path / "t.csv").write_text("id,name,n\n" + "".join(f"{r.id},{r.name},{r.n}\n" for r in df.collect()))
    else:
        df.write.parquet(path)
    return Table(spark, path, request.param, state_dir=str(tmp_path / "state"))


def rows(q):
    return sorted(tuple(r.values()) for r in q.as_array().all())


def test_virtual_column(table):
    table.add_column("zone", "EU")
    assert table.headers[-1] == "zone" and table.find().where({"zone": "EU"}).count() == 40
    for taken in ("zone", "NAME"):
        with pytest.raises(ValueError, match="exists"):
            table.add_column(taken)
    assert table.update({"zone": "US"}, {"name": "n1"}) == 6
    assert table.find().where({"zone": "US"}).count() == 6


def test_update_is_seen_by_predicates_and_last_write_wins(table):
    assert table.update({"name": "x", "n": "5"}, ["in", "id", ["3", "4"]]) == 2
    assert table.update({"name": "y"}, {"name": "x", "id": "4"}) == 1
    assert rows(table.find().select("id", "n").where({"name": "x"})) == [("3", "5")]
    assert rows(table.find().select("id", "n").where({"name": "y"})) == [("4", "5")]
    assert table.find().count() == 40


def test_insert(table):
    table.add_column("zone", "EU")
    assert table.batch_insert([{"id": "100", "n": "1"}, {"name": "z"}]) == 2 and table.insert({"id": "101"}) == 1
    assert rows(table.find().where(["in", "id", ["100", "101"]])) == [("100", "", "1", "EU"), ("101", "", "", "EU")]
    assert table.update({"n": "9"}, {"id": "101"}) == 1 and table.find().where({"id": "101", "n": "9"}).count() == 1
    with pytest.raises(ValueError, match="Column not found"):
        table.insert({"zone": "x"})


def test_index_never_changes_a_result(table):
    queries = [{"id": "7"}, {"name": "n3"}, ["and", {"name": "n3"}, [">", "n", 4]], {"name": "n2", "n": "6"}, ["or", {"id": "1"}, {"id": "2"}], {"id": "none"}]
    plain = [rows(table.find().where(c)) for c in queries]
    assert table.create_index(["id", ["n", "name"]]) == ["id", "n_name"]
    assert table.has_index(["name", "n"]) and not table.has_index("n")
    assert [rows(table.find().where(c)) for c in queries] == plain
    assert table.find().where({"id": "7"}).explain()["index"] == "id" and table.find().where({"n": "6", "name": "n2"}).explain()["index"] == "n_name"
    assert table.find().where({"name": "n3"}).explain()["type"] == "FullScan"
    assert "EqualTo(id,none)" in table.find().compare_as("bytes").where({"id": "none"}).explain("spark")
    table.update({"name": "q"}, {"id": "7"})
    assert table.find().where({"id": "7"}).explain()["type"] == "FullScan" and rows(table.find().where({"id": "7"}))[0][1] == "q"
    assert table.drop_index("id") and not table.has_index("id") and not table.drop_index("id")
    table.clear_indexes()
    assert table.meta()["indexes"] == {}


def test_limits_without_an_order_copy_nothing(table):
    q = table.find()
    assert [r["id"] for r in q.as_array().limit(3).offset(2).all()] == [r["id"] for r in q.as_array().all()][2:5]
    assert q.one() is not None and q.scalar() is not None and q.limit(0).scalar() is None and q.limit(0).one() is None
    assert len(list(q.limit(2).each())) == 2 and [len(b) for b in q.limit(5).batch(2)] == [2, 2, 1]
    assert len(q.order_by("name").limit(2).all()) == 2 and len(q.group_by("name").all()) == 7
    assert not os.path.isdir(f"{table.state_dir}/rows")


def test_numbers_in_text_keys_reach_the_scan(table):
    plain = {v: rows(table.find().where({"n": v})) for v in (5, "5", "5.0", " 5", "x", -1)}
    assert plain[5] == plain["5.0"] and plain[5] and not plain["x"]
    table.create_index(["n", "id"], bloom=True)
    for v, want in plain.items():
        assert rows(table.find().where({"n": v})) == want
        if v != "x":
            assert f"EqualTo(_number_n,{float(v)})" in table.find().where({"n": v}).explain("spark")
    assert rows(table.find().compare_as("bytes").where({"n": "5.0"})) == [] and rows(table.find().compare_as("bytes").where({"n": "5"})) == plain[5]
    plan = table.find().where({"id": 7}).explain()
    assert plan["index"] == "id" and plan["bytes"] > 0 and table.find().where({"id": 99}).explain()["bytes"] == 0
    assert table.meta()["totalRows"] == 40 and table.meta()["indexes"]["n"]["distinctCount"] == 11
    assert "_number_" not in str(table.find().where({"id": 7}).frame().columns) and table.find().count() == 40


def test_a_value_of_many_rows_is_dealt_over_files(spark, tmp_path, monkeypatch):
    from rowloom.sources import index

    monkeypatch.setattr(index, "FILE_BYTES", 10_000)
    spark.range(20_000).selectExpr("id", "'one' as flag").write.parquet(str(tmp_path / "t"))
    t = Table(spark, str(tmp_path / "t"), "parquet", state_dir=str(tmp_path / "state"))
    t.create_index(["flag", ["flag", "id"]])
    sizes = [r["count"] for r in spark.read.parquet(t.index_path("flag")).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 10_000 and sum(sizes) == 20_000
    assert t.find().where({"flag": "one", "id": 77}).explain()["index"] == "flag_id" and t.find().where({"flag": "one"}).count() == 20_000


def test_what_died_before_it_counted_is_not_seen(spark, table):
    from rowloom.sources import files

    table.insert({"id": "100"})
    for part in ("appends", "updates"):
        spark.createDataFrame([("x",)], "id string").write.parquet(f"{table.state_dir}/{part}/batch=9")
    assert table.find().count() == 41 and table.update({"name": "z"}, {"id": "100"}) == 1 and table.find().where({"name": "z"}).count() == 1
    with files.lock(spark, f"{table.state_dir}/lock"), pytest.raises(TimeoutError):
        with files.lock(spark, f"{table.state_dir}/lock", 0.3):
            pass
    assert table.insert({"id": "101"}) == 1


def test_a_file_rewritten_at_equal_size_and_time_is_stale(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n")
    t = Table(spark, str(path), state_dir=str(tmp_path / "s"))
    t.create_index(["a"])
    at = os.stat(path)
    path.write_text("a,b\n2,x\n")
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert not t.validate_integrity() and t.find().where({"a": 2}).count() == 1


def test_stale_index_is_not_read(table):
    table.create_index(["id"])
    assert table.validate_integrity()
    if table.kind == "csv":
        with open(table.path, "a") as f:
            f.write("7,late,0\n")
        fresh = Table(table.spark, table.path, "csv", state_dir=table.state_dir)
        assert not fresh.validate_integrity() and fresh.find().where({"id": "7"}).explain()["type"] == "FullScan"
        assert fresh.find().where({"id": "7"}).count() == 2


def test_materialize(table):
    table.add_column("zone", "EU", materialize=True)
    again = Table(table.spark, table.path, table.kind, state_dir=table.state_dir)
    assert again.virtual_columns == {} and again.headers == ["id", "name", "n", "zone"] and again.find().where({"zone": "EU"}).count() == 40


def test_dialect(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes(b'\xef\xbb\xbfa,b,c\r\n1,"x, ""y""",3\r\n\r\n4,5\r\n6,7,8,9\r\n , z ,\r\nlast,NULL,"q"')
    got = [tuple(r) for r in delimited.read(spark, str(path)).collect()]
    assert got == [("1", 'x, "y"', "3"), ("4", "5", ""), (" ", " z ", ""), ("last", "NULL", "q")]
    assert len(delimited.read(spark, str(path), long_rows="cut").collect()) == 5
    t = Table(spark, str(path), state_dir=str(tmp_path / "s"))
    assert t.find().where(["is", "b", None]).count() == 1 and t.find().where(["is not", "c", None]).count() == 2
    semi = tmp_path / "s.csv"
    semi.write_text('a;b\n1;"two\nlines"\n')
    assert [tuple(r) for r in delimited.read(spark, str(semi), ";", multi_line=True).collect()] == [("1", "two\nlines")]
    delimited.write(delimited.read(spark, str(path)), str(tmp_path / "out"))
    assert sorted(map(tuple, delimited.read(spark, str(tmp_path / "out")).collect())) == sorted(got)


def test_row_numbers(spark):
    df = delimited.with_row_numbers(spark.range(1000, numPartitions=7))
    assert [r.id + 1 for r in df.orderBy("_row_id").collect()] == [r._row_id for r in df.orderBy("_row_id").collect()]


def test_command_line(tmp_path, spark, capsys):
    from rowloom.service import main

    (tmp_path / "c.csv").write_text("a,b\n1,2\n3,4\n")
    base = ["--table", str(tmp_path / "c.csv"), "--state-dir", str(tmp_path / "s")]
    assert main(["index", *base, "--columns", '["a"]']) == 0
    assert main(["write", *base, "--rows", '[{"a": "5"}]']) == 0
    assert main(["query", *base, "--request", '{"action": "count"}']) == 0
    assert main(["version"]) == 0
    assert '"count": 3' in capsys.readouterr().out and os.path.isdir(tmp_path / "s")
