"""The ten-row fixture with values computed by hand, through delimited text."""

import pytest

from rowloom.functions.results import ResultRow
from rowloom.service import handle_request
from rowloom.sources.table import Table

TEXT = """ID,NAME,STATUS,SCORE,CATEGORY
1,Alice Smith,active,95,A
2,Bob Jones,inactive,72,B
3,Carol White,active,88,A
4,David Brown,pending,65,C
5,Eve Davis,active,92,B
6,Frank Miller,inactive,78,D
7,Grace Wilson,active,85,A
8,Henry Taylor,pending,70,C
9,Ivy Anderson,active,91,B
10,Jack Thomas,inactive,60,D
"""


@pytest.fixture
def table(spark, tmp_path):
    (tmp_path / "sample.csv").write_text(TEXT)
    return Table(spark, str(tmp_path / "sample.csv"), state_dir=str(tmp_path / "state"))


def ids(q):
    return [int(r["ID"]) for r in q.as_array().all()]


def test_scan(table):
    assert table.headers == ["ID", "NAME", "STATUS", "SCORE", "CATEGORY"] and table.header_map["SCORE"] == 3
    assert table.find().count() == 10 and len(table.find().all()) == 10
    with pytest.raises(FileNotFoundError):
        Table(table.spark, table.path + ".missing")


def test_filters(table):
    f = table.find
    assert f().where({"STATUS": "active"}).count() == 5
    assert f().where("STATUS", "active").or_where({"STATUS": "pending"}).count() == 7
    assert ids(f().where(["in", "CATEGORY", ["A", "B"]])) and f().where(["in", "CATEGORY", ["A", "B"]]).count() == 6
    assert sorted(ids(f().where(["between", "SCORE", 80, 95]))) == [1, 3, 5, 7, 9]
    assert f().where([">", "SCORE", 80]).and_where({"STATUS": "active"}).count() == 5
    assert sorted(ids(f().where(["like", "NAME", "%SON"]))) == [7, 9]
    assert sorted(ids(f().where(["not", ["or", {"STATUS": "active"}, [">=", "SCORE", 70]]]))) == [4, 10]
    assert sorted(ids(f().where(["not in", "CATEGORY", ["A", "B", "C"]]))) == [6, 10]
    assert sorted(ids(f().where([">", "SCORE", "9"]))) == list(range(1, 11))  # as numbers
    assert sorted(ids(f().compare_as("bytes").where([">", "SCORE", "9"]))) == [1, 5, 9]  # as text
    assert f().filter_where(["and", {"STATUS": ""}, ["=", "CATEGORY", "D"], ["like", "NAME", "  "]]).count() == 2
    assert not f().where({"STATUS": "nonexistent"}).exists() and f().where({"STATUS": "active"}).exists()
    assert f().where([]).count() == 10 and f().where_json("{}").count() == 10 and f().where_json('{"STATUS": "active"}').count() == 5


def test_wrong_input(table):
    for bad in ({"NOPE": 1}, ["=", "nope", 1]):
        with pytest.raises(ValueError, match="Column not found"):
            table.find().where(bad).count()
    for bad in ("STATUS = 'x'", ["~", "STATUS", 1], [["ID", "NAME"], [1]], ["between", "ID", 1]):
        with pytest.raises(ValueError):
            table.find().where(bad)


def test_aggregates(table):
    q = table.find()
    assert (q.sum("SCORE"), q.average("SCORE"), q.min("SCORE"), q.max("SCORE")) == (796, 79.6, 60, 95)
    assert q.aggregate("STATUS", {"SCORE": "sum"}) == {"active": 451, "inactive": 210, "pending": 135}
    assert q.aggregate("CATEGORY", {"SCORE": "sum"}) == {"A": 268, "B": 255, "C": 135, "D": 138}
    assert q.group_by("CATEGORY").group_counts() == {"A": 3, "B": 3, "C": 2, "D": 2}
    assert q.group_by("STATUS", "CATEGORY").count() == 5
    assert q.aggregate(["STATUS"], {"SCORE": "max", "ID": "count"})["active"] == {"max_SCORE": 95, "count_ID": 5}
    assert sorted(ids(q.group_by("CATEGORY"))) == [1, 2, 4, 6]
    assert sorted(ids(q.group_by("CATEGORY").order_by("SCORE desc"))) == [1, 5, 6, 8]
    assert ids(q.select("ID").group_by("STATUS").order_by("SCORE desc, ID").limit(2)) == [1, 6]


def test_order_and_results(table):
    q = table.find()
    assert ids(q.order_by("SCORE desc").limit(3)) == [1, 5, 9]
    assert ids(q.order_by({"SCORE": "desc"}).offset(2).limit(3)) == [9, 3, 7]
    assert ids(q.limit(3).offset(4)) == [5, 6, 7] and ids(q.limit(0)) == []
    assert q.one()["NAME"] == "Alice Smith" and q.select("NAME").scalar() == "Alice Smith"
    assert q.select("NAME").limit(2).column() == ["Alice Smith", "Bob Jones"]
    assert q.index_by("CATEGORY").as_array().all()["D"]["CATEGORY"] == "D"
    assert set(q.index_by(lambda r: int(r["ID"]) % 2).as_array().all()) == {0, 1}
    assert sorted(r["ID"] for r in q.select("ID", "CATEGORY").keyed("CATEGORY").collect()) == ["10", "7", "8", "9"]
    assert sorted(r["ID"] for r in q.order_by("SCORE desc").select("ID", "CATEGORY").keyed("CATEGORY").collect()) == ["10", "2", "4", "7"]
    assert sum(1 for _ in q.each()) == 10 and [len(b) for b in q.batch(4)] == [4, 4, 2]
    assert list(q.where({"ID": 3}).offsets()) == ["3\n"]


def test_rows_and_cells(table):
    row = table.find().one()
    assert isinstance(row, ResultRow) and row.NAME == row["NAME"] == row[1] == "Alice Smith" and row["missing"] is None and row[99] is None
    assert row.cell("SCORE").as_int() == 95 and row.cell("NAME").as_int(7) == 7 and row.cell("SCORE").as_float() == 95.0
    assert row.column("STATUS").upper() == "ACTIVE" and row.column("SCORE").index == 3
    assert row.cell("NAME").validate(["required", "numeric", "min:50"]) == {"valid": False, "errors": ["Value must be numeric", "Too short"]}
    assert '"NAME": "Alice Smith"' in row.to_json() and len(dict(row)) == 5 and str(row) == row.to_json()
    assert row.cell("nope").is_empty() and row.column("nope").index == -1 and row.line is None
    assert [r.line for r in table.find().with_lines().where({"STATUS": "pending"}).all()] == [4, 8] and table.find().with_lines().one().line == 1


def test_text_and_plans(table):
    q = table.find().select("ID", "NAME").where(["and", {"STATUS": "it's"}, ["between", "SCORE", 1, "9"]]).order_by("SCORE desc").limit(5).offset(2)
    assert q.sql() == "SELECT `ID`, `NAME` FROM `sample` WHERE (`STATUS` = 'it''s') AND (`SCORE` BETWEEN 1 AND 9) ORDER BY `SCORE` DESC LIMIT 5 OFFSET 2"
    assert table.find().where(["is not", "NAME", "x"]).where_sql("ID > 3").sql() == "SELECT * FROM `sample` WHERE (NOT (`NAME` <=> 'x')) AND (ID > 3)"
    assert q.explain()["type"] == "FullScan" and "FullScan" in q.explain("tree") and "cost" in q.explain("table") and '"cost"' in q.explain("json")
    assert "Physical Plan" in q.explain("spark") and q.stats()["rows"] == 0


def test_service(table):
    ask = lambda **r: handle_request(table, r)
    assert ask(action="ping") == {"success": True, "pong": True}
    assert ask(action="count", where={"STATUS": "active"})["count"] == 5
    assert ask(action="select", where='{"operator":">","column":"SCORE","value":90}', limit=2)["rows"][0]["ID"] == "1"
    assert ask(action="groupby", groupBy="STATUS")["groups"] == {"active": 5, "inactive": 3, "pending": 2}
    assert ask(action="query", groupBy="STATUS", aggFunc="avg", aggCol="SCORE")["data"]["pending"] == 67.5
    assert ask(action="status")["rows"] == 10 and ask(action="explain")["data"]["type"] == "FullScan"
    assert ask(action="select", limit=0)["rows"] == [] and ask(action="select", limit=1, offset=1)["rows"][0]["ID"] == "2"
    assert not ask(action="nope")["success"] and "Column not found" in ask(action="count", where={"x": 1})["error"]
