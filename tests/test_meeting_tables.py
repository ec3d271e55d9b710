"""Meetings out of tables, and names by the words before them."""

import datetime
import random
import re

import pytest

from tidemark.operators import meeting_tables as M
from tidemark.sources import html_tables


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(c if c.startswith("<t") else f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


AGENDA = table(["번호", "결의 구분", "회의 목적사항", "가결여부", "비고"], ["1", "보통", "재무제표", "원안대로 가결", ""], ["2", "특별", "정관", "부결", "-"], ["3", "", "해당없음", "가결", ""], ["", "", "x", "", ""], ["찬성률", "", "y", "", ""], ["4", "", "합병", "가결", "안건 철회"])
GROUPED = table(['<th rowspan="2">번호</th>', '<th colspan="2">회의목적사항</th>', '<th rowspan="2">비고</th>'], ["<th>안건</th>", "<th>후보자</th>"], ["1", "이사 선임", "홍길동", "메모"])
ELECTION = "<span>사외이사선임 세부내역</span>" + table(["성명", "출생년월", "임기", "신규선임여부", "주요경력(현직포함)"], ["홍 길동 (비상근)", "1970-01", "3", "신규", "x  y"], ["-", "", "", "", ""], ["미정", "", "", "", ""], ["김철수", "1980-02", "", "", ""])
PURPOSE = "<p><span>사업목적 변경 세부내역</span></p>" + table(["구분", '<td colspan="2">내용</td>', "이유"], ["구분", "변경전", "변경후", "이유"], ["사업목적 변경", "a", "b", "r"], ["사업목적 추가", "c", "c", "s"])
CORRECTION = table(["정정항목", "정정전", "정정후"], ["1. 기타 투자판단에 참고할 사항", "old", "new\n text"], ["일자", "주주총회일자", "x"], ["기타 투자판단에 참고할 사항", "o", "-" + table(["a"])])
DATE = table(["2. 주주총회일자", "2024년 3월 5일 오전 9시"], ["일시", "2023-01-02"])


@pytest.fixture(scope="module")
def rows(spark):
    docs = [
        (1, CORRECTION + AGENDA + GROUPED + ELECTION + PURPOSE + DATE),
        (2, GROUPED + "<span>감사선임 세부내역</span><span>이사선임 세부내역</span>" + table(["성명"], ["a"]) + "<span>이사선임 세부내역</span>" + table(["성명"], ["late"])),
        (3, table(["<td><span>이사선임 세부내역</span></td>"]) + "<span>이사선임 세부내역</span>" + table(["성명"], ["b"]) + table(["일시", "2024.13.1"])),
        (4, None),
        (5, "<table><tr><td rowspan=0>x</td></tr></table>"),
        (6, table(["정정항목", "정정전", "정정후"], ["a", "b", table(["번호", "회의목적사항"], ["1", "inner"])])),
        (7, table(["일시"])),
    ]
    return html_tables.explode_titled(spark.createDataFrame(docs, "id int, html string"), "id", "html", M.SECTIONS).cache()


def test_structured_agendas(rows):
    got = {(r.id, r.number): tuple(r)[1:] for r in M.structured_agendas(rows, "id").collect()}
    assert got == {
        (1, "1"): ("agenda:0", "1", "재무제표", "보통", None, "원안대로 가결", "passed", None, "result"),
        (1, "2"): ("agenda:1", "2", "정관", "특별", None, "부결", "rejected", "-", "result"),
        (1, "4"): ("agenda:2", "4", "합병", None, None, "가결", "withdrawn", "안건 철회", "result"),
        (2, "1"): ("agenda:0", "1", "이사 선임", None, "홍길동", None, None, "메모", "notice"),
    }


def test_elections(rows):
    got = {(r.id, r.name): (r.office, r.employment_mode, r.birth_month, r.career) for r in M.elections(rows, "id").collect()}
    assert got == {(1, "홍 길동"): ("outside_director", "비상근", "1970-01", "x y"), (1, "김철수"): ("outside_director", None, "1980-02", ""), (2, "a"): ("director", None, "", "")}


def test_purpose_changes(rows):
    got = [tuple(r)[2:] for r in M.purpose_changes(rows, "id").orderBy("row").collect()]
    assert got == [("사업목적 변경", "a", "b", None, "r"), ("사업목적 추가", None, None, "c", "s")]


def test_dates_and_notes(spark, rows):
    phases = spark.createDataFrame([(1, "result"), (3, "notice"), (4, "result"), (7, "notice")], "id int, phase string")
    got = {r.id: r.meeting_date for r in M.meeting_date(rows, phases, "id").collect()}
    assert got == {1: datetime.date(2024, 3, 5), 3: None, 4: None, 7: None}
    other = spark.createDataFrame([(1, "notice")], phases.schema)
    assert M.meeting_date(rows, other, "id").first().meeting_date == datetime.date(2023, 1, 2)
    assert [r.text for r in M.correction_notes(rows, "id").filter("id = 1").orderBy("row").collect()][0] == "new text"
    assert rows.filter("error IS NOT NULL").count() == 1 and M.structured_agendas(rows.filter("id = 6"), "id").count() == 0


def test_anchored_spans(spark):
    rnd = random.Random(3)
    words = ["외부감사인", "외부 감사인", "전자투표", "한빛회계법인", "삼일회계법인", "한국예탁결제원", "미래증권", "을 ", "는 ", "𝄞 ", "\n", "양수인: "]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["", None]
    got = {}
    for r in M.anchored_spans(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", reach=40).collect():
        got.setdefault(r.id, set()).add(tuple(r)[1:])
    for i, t in enumerate(texts):
        t = t or ""
        marks = sorted((m.start(), k) for k, p in M.ANCHORS.items() for m in re.finditer(p, t))
        want = set()
        for kind, p in M.STAKEHOLDERS.items():
            for m in re.finditer(p, t):
                at = max((a for a in marks if a[0] < m.start()), default=None)
                near = at and m.start() - at[0] <= 40
                want.add((kind, m.start(), m.end(), m[0], at[1] if near else None, at[0] if near else None))
        assert got.get(i, set()) == want
