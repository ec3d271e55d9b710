"""Fields of rights issues from HTML tables of all three kinds."""

import pytest

from tidemark.operators import rights
from tidemark.sources import html_tables


def table(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td{a}>{t}</td>" for t, a in ((c if isinstance(c, tuple) else (c, "")) for c in r)) + "</tr>" for r in rows) + "</table>"


two = ' rowspan="2"'
PAID = [
    [("1. 신주의 종류와 수", two), "보통주식 (주)", "1,000"],
    ["기타주식 (주)", "-"],
    [("2. 증자전 발행주식총수 (주)", two), "보통주식 (주)", "50,000"],
    ["종류주식 (주)", "10"],
    [("3. 자금조달의 목적", ' rowspan="3"'), "시설자금 (원)", "300,000"],
    ["운영자금 (원)", "-"],
    ["채무상환자금 (원)", "200,000"],
    [("4. 신주 발행가액", two), "확정발행가", "보통주식 (원)", "500"],
    ["예정발행가", "보통주식 (원)", "-"],
    ["5. 증자방식", "제3자배정증자"],
    ["6. 납입일", "2024년 3월 5일"],
    ["신주배정기준일", "2024-02-01"],
    ["1주당 신주배정주식수 (주)", "0.5"],
    ["신주권교부예정일", "2024-04-01"],
]
TARGETS = [["제3자배정 대상자", "관계", "배정주식수 (주)"], ["홍길동", "-", "600"], ["Acme", "주주", "300 100"], ["계", "", "1,000"]]
BONUS = [["무상증자"], [("신주의 종류와 수", two), "보통주식 (주)", "77"], ["기타주식 (주)", "0"], ["신주배정기준일", "2024-05-05"], ["1주당 신주배정주식수", "보통주식 (주)", "0.1"], ["신주의 상장 예정일", "2024-06-06"]]


@pytest.fixture(scope="module")
def found(spark):
    docs = [
        (1, "유상증자 결정", table([["정정", "x"]]) + table(PAID) + table(TARGETS)),
        (2, "유무상증자 결정", table([["유상증자"], *PAID, *BONUS])),
        (3, "무상증자 결정", table(BONUS[1:])),
        (4, "유무상증자 결정", table(PAID)),
        (5, "합병", table(PAID)),
        (6, None, None),
        (7, "유상증자", table(PAID) + table([TARGETS[0], ["-", "-", "-"]])),
        (8, "종속회사 유상증자", table(PAID)),
        (9, "유상증자", table([["신주의 종류와 수", "값"]])),
    ]
    df = spark.createDataFrame(docs, "id long, title string, html string")
    grid = html_tables.explode_tables(df, "id", "html").filter("error IS NULL AND cells IS NOT NULL").drop("error")
    return {r.id: r for r in rights.with_warnings(rights.rights_fields(grid, df, "id")).collect()}


def items(v):
    return None if v is None else [tuple(x) for x in v]


def test_paid(found):
    r = found[1]
    assert (items(r.counts), items(r.before), items(r.prices)) == ([("보통주식", 1000), ("기타주식", 0)], [("보통주식", 50000), ("기타주식", 10)], [("보통주식", 500), ("기타주식", None)])
    assert items(r.purposes) == [("시설자금", 300000), ("채무상환자금", 200000)] and r.method == "제3자배정증자" and r.payment_date == "2024년 3월 5일"
    assert items(r.targets) == [("홍길동", 600), ("Acme", 400)] and r.record_date == "2024-02-01" and r.per_share == ["0.5", None]
    assert r.listing_date is None and r.status["listing_date"] == "source_not_found" and r.status["counts"] == "parsed" and r.bonus_counts is None
    assert [(w.level, w.warning) for w in r.warnings] == [("strong", "listing_date: no source")]


def test_mixed(found):
    r = found[2]
    assert items(r.counts)[0] == ("보통주식", 1000) and items(r.bonus_counts) == [("보통주식", 77), ("기타주식", 0)]
    assert r.bonus_record_date == "2024-05-05" and r.bonus_per_share == ["0.1", None] and r.bonus_listing_date == "2024-06-06" and r.bonus_before[0].amount is None
    assert r.targets is None and r.status["targets"] == "source_not_found" and r.listing_date is None


def test_bonus(found):
    r = found[3]
    assert items(r.counts) == [("보통주식", 77), ("기타주식", 0)] and r.prices is None and r.purposes is None and r.targets is None and r.record_date is None
    assert {f for f, s in r.status.items() if s == "not_applicable"} == {"prices", "purposes", "targets", "method", "payment_date"}
    assert r.bonus_record_date == "2024-05-05"


def test_errors_and_gaps(found):
    assert [found[i].error for i in (4, 5, 6)] == ["no row parts paid from bonus", "title names no issue", "no title"]
    assert items(found[7].targets) == [("-", 0)] and found[7].status["targets"] == "explicit_zero"
    assert found[8].targets == [] and found[8].status["targets"] is None
    assert found[9].status["counts"] == "source_not_found" and items(found[9].counts) == [("보통주식", None), ("기타주식", None)]
