"""Modes of parsing, previews and identities of counts."""

import pytest
from pyspark.sql import functions as F

from tests.test_meeting_tables import AGENDA, DATE, ELECTION
from tests.test_rights import PAID, TARGETS, table
from tidemark.operators import modes


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("/a/b/2024.01.html", "유상증자 결정", table(PAID) + table(TARGETS)), ("7.html", None, None), ("8", "주주총회결과", AGENDA + ELECTION + DATE), ("9.html", "x", "<table><tr><td rowspan=0>a</td></tr></table>"), (".html", "y", table([["", " "], ["k", "k", "v"]]))]
    return spark.createDataFrame(rows, "path string, title string, html string")


def test_base_records(docs):
    got = {r.acpt_no: r for r in modes.base_records(docs, "asset_transaction").collect()}
    assert set(got) == {"2024.01", "7", "8", "9", ".html"} and got["7"].title == "" and got["7"].tables == []
    assert len(got["2024.01"].tables) == 2 and got["2024.01"].tables[0].rows[0] == ["1. 신주의 종류와 수", "보통주식 (주)", "1,000"]
    assert got["9"].error and got["9"].tables == [] and [(t["index"], t.rows) for t in got[".html"].tables] == [(0, [["k", "v"]])]


def test_modes(docs):
    assert modes.parse(docs, "security_transaction").columns == ["acpt_no", "mode", "title", "tables", "error"]
    rights = {r.acpt_no: r.fields for r in modes.parse(docs, "rights_issuance").collect()}
    assert rights["2024.01"].kind == "paid" and rights["2024.01"].method == "제3자배정증자" and rights["7"].error == "no title"
    meeting = {r.acpt_no: r.fields for r in modes.parse(docs, "shareholder_meeting").collect()}["8"]
    assert meeting.phase == "result" and str(meeting.meeting_date) == "2024-03-05" and [a.status for a in meeting.agendas] == ["passed", "rejected", "withdrawn"] and [e.name for e in meeting.elections] == ["홍 길동", "김철수"]
    assert all(r.fields is None for r in modes.parse(docs, "bond_issuance").collect())
    with pytest.raises(ValueError, match="supported modes: asset_transaction"):
        modes.parse(docs, "other")


def test_preview(spark, docs):
    got = modes.preview(docs, "rights_issuance", F.col("fields.kind") == "paid", 2).collect()
    assert [r.acpt_no for r in got] == ["2024.01"] and got[0].source.omitted_rows == 0 and len(got[0].source.shown) == 2
    tables = [(i, [[str(j)] for j in range(n)]) for i, n in enumerate([100, 15, 10, 3])]
    x = spark.createDataFrame([(tables,), ([],), ([(i, [["a"]]) for i in range(15)],)], "t array<struct<index:int,rows:array<array<string>>>>").select(modes.compact_tables(F.col("t")).alias("c")).collect()
    assert [(t["index"], len(t.rows), t.omitted_rows) for t in x[0].c.shown] == [(0, 100, 0), (1, 15, 0), (2, 5, 5)] and x[0].c.omitted_rows == 8
    assert x[1].c.shown == [] and len(x[2].c.shown) == 12 and x[2].c.omitted_rows == 3


def test_identities_and_projection(spark):
    rows = spark.createDataFrame([("1", 1), ("2", 2)], "acpt_no string, `__filter_x` int")
    ask = lambda df=rows, source_rows=10, offset=2, inspected=8, returned=2, unique=2, complete=True: [r.rule for r in modes.count_identities(df, source_rows, offset, inspected, returned, unique, complete).collect()]
    assert ask() == [] and ask(inspected=5, complete=False) == []
    assert ask(inspected=5) == ["complete but not all inspected"] and ask(returned=3) == ["returned is not the number of rows"]
    assert ask(offset=11, inspected=0, complete=False) == ["the offset is beyond the source", "more returned than inspected"]
    twice = rows.unionByName(rows.limit(1)).unionByName(rows.limit(1).withColumn("acpt_no", F.lit(" ")))
    assert ask(twice, returned=4, unique=4) == ["a row has no number", "a number comes twice"]
    assert modes.public(rows).columns == ["acpt_no"]
    groups = spark.createDataFrame([("CB",), ("주주총회",), (None,)], "g string")
    count = lambda o: groups.filter(modes.in_group(F.col("g"), o)).count()
    assert [count(o) for o in ("전체", "", "bond_issuance", "CB", "other")] == [3, 3, 1, 1, 0]
