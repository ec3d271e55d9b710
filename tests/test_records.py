import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import build, graph, records
from tidemark.sources import html_tables, pages
from tidemark.sources import tables as S

ROW = """<tr><td>1</td><td>2024-01-02 10:00</td><td>{firm}</td><td><a onclick="openDisclsViewer('9','')">{title}</a></td><td>s</td></tr>"""
FIRM = """<img alt="M"><a id="companysum" title=" A  B " onclick="companysummary_open('5')">A</a>"""


def page(*rows):
    return '<table summary="번호, 회사명, 공시제목"><tbody>' + "".join(rows) + "</tbody></table>"


@pytest.mark.parametrize(
    ("html", "error"),
    [
        ("", "not one listing table"),
        (page("<tr><td>1</td></tr>"), "row 1 has fewer than 5 cells"),
        (page(ROW.format(firm="", title="t"), ROW.format(firm="", title=" ")), "row 2 has no title"),
        (page(ROW.format(firm='<img alt="">', title="t")), "image without a label"),
        (page(ROW.format(firm=FIRM + FIRM, title="t")), "2 company links"),
        (page(ROW.format(firm=FIRM.replace("'5'", "''"), title="t")), "without an id"),
    ],
)
def test_listing_errors(html, error):
    with pytest.raises(ValueError, match=error):
        pages.listing(html)


def test_listing_of_a_page(spark):
    docs = spark.createDataFrame([(1, page(ROW.format(firm=FIRM, title="[정정][정정] [첨부] t"), ROW.format(firm="", title="u"))), (2, None), (3, page())], "id int, html string")
    got = {(r.id, r.at): r for r in pages.read_pages(docs, "id", "html", pages.listing, pages.LISTING).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, None)}  # a listing without rows has none
    assert got[1, 1].company_name == "A B" and got[1, 1].title_flags == ["정정", "첨부"] and got[1, 1].is_correction_report and got[1, 1].badges == []
    assert got[1, 2].company_id is None and got[1, 2].market is None and not got[1, 2].is_correction_report
    assert "listing table" in got[2, None].error and got[1, 1].error is None


def test_strict_viewer():
    whole = '<input name=acptNo value=1><select id=mainDoc><option value="">본문선택</option><option value="2|Y" selected>x</select><select id=attachedDoc><option value="">첨부문서선택</select>'
    assert pages.viewer(whole, strict=True)[0][0] == "1"
    for broken in ("", whole.replace("selected", ""), whole.replace("name=acptNo", "name=no"), whole.replace("첨부문서선택", "?"), whole.split("<select id=attached")[0]):
        pages.viewer(broken)
        with pytest.raises(ValueError):
            pages.viewer(broken, strict=True)


def test_sections():
    html = '<html><head></head><body><p>x<h2 class="SECTION-1">A</h2><div>1</div><h3 class="b SECTION-2"></h3><p> title  two</p></body></html>'
    assert [(n, t) for n, t, _ in pages.sections(html)] == [(1, "A"), (2, "title two")]
    assert pages.sections(html)[0][2] == '<h2 class="SECTION-1">A</h2><div>1</div>'
    for broken in ("", "<head></head><body></body>", html.replace(" title  two", ""), html.replace("<head></head>", "")):
        with pytest.raises(ValueError):
            pages.sections(broken)


def test_deep_pages_do_not_recurse():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert pages.viewer(f"<h1 class=ttl>{deep}</h1>")[0][1] == "x"


def test_labels(spark):
    c = [("1. 사채의 종류", "사채의종류"), ("IV-2.자금", "자금"), ("Ⅳ. 자금", "자금"), ("가. 자금", "가.자금"), ("1) 자금", "1)자금"), ("2-1. a", "a")]
    rows = spark.createDataFrame(c, "a string, b string").select(T.normalize_label(F.col("a")).alias("a"), "b").collect()
    assert all(r.a == r.b for r in rows)


def test_bond_fields_of_odd_tables(spark):
    main = "<table><tr><td>1. 사채의 종류</td><td>회차</td><td>3</td></tr><tr><td>2. 사채의 권면총액 (원)</td><td>1,000</td></tr><tr><td>x</td><td>원화기준 (원)</td><td>2,000</td></tr><tr><td>3. 자금조달의 목적</td><td>시설자금</td></tr><tr><td>a</td><td>교환에 따라 발행할 주식</td><td>P 주</td></tr><tr><td>b</td><td>교환가격 (원/주)</td><td>1,234.5</td></tr></table>"
    docs = spark.createDataFrame([(1, main), (2, "<table><tr><td>회차</td></tr></table>"), (3, None), (4, main.replace("2,000", "?") + main.replace("회차", "-"))], "id int, html string")
    grid = html_tables.explode_tables(docs, "id", "html").filter("error IS NULL").drop("error")
    got = {r.id: r for r in records.bond_fields(grid, docs.select("id", F.lit("전환사채 및 교환사채").alias("title")), "id").collect()}
    assert set(got) == {1, 4}
    one = got[1]
    assert (one["round"], one.type, one.amount, one.target, one.exercise_price, one.purposes, one.investors) == ("3", None, 2000, "P 주", 1234.5, [], None)
    assert one.status["purposes"] == one.status["investors"] == one.status["type"] == "source_not_found" and one.status["amount"] == "parsed"
    assert got[4].amount is None and got[4]["round"] == "3"


def test_sums(spark):
    item = "array<struct<label: string, amount: bigint>>"
    row = spark.createDataFrame([(10, [("a", 4), ("b", 6)], [("a", 1200)], None)], f"amount bigint, purposes {item}, investors {item}, none {item}")
    assert row.select(records.bond_warnings().alias("w")).first().w == ["투자자: 발행권면총액 합계(1,200)가 발행금액(10)과 일치하지 않습니다."]
    assert row.select(records.bond_warnings(purposes="none", people="none").alias("w")).first().w == []
    assert row.select(records.rights_warnings("none", "none", "none", "none", "none").alias("w")).first().w == []
    t = spark.createDataFrame([([("a", 3), ("b", 4), ("합 계", 7)], [("a", 7), ("합계 (주)", 7)], [("합계", 7)])], f"a {item}, b {item}, c {item}")
    cut = lambda c, n: len(t.select(records.without_total(c, F.lit(n)).alias("x")).first().x)
    assert (cut("a", 7), cut("b", 7), cut("b", 8), cut("c", 7), cut("c", 0)) == (2, 1, 2, 1, 1)


def test_label_row(spark):
    rows = spark.createDataFrame([(1, 0, 0, ["x", "1. 납 입일", "d"]), (1, 0, 1, ["납입일", "e"]), (2, 0, 0, ["납입일"])], "id int, `table` int, row int, line array<string>")
    assert {(r.id, r.value) for r in records.label_row(rows, "id", "납입일").collect()} == {(1, "d"), (2, None)}


def test_download_order(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("b", 1, 2), ("b", 2, 3)], "k string, i int, p int")
    assert [r.p for r in records.recent(rows, ["k", "i"], "p").collect()] == [3, 2, 1, 0]


def graph_of(spark, rows, one_security=False):
    item = "array<struct<label: string, amount: double>>"
    r = spark.createDataFrame(rows, f"acpt_no string, position int, title string, kind string, paid_on date, items {item}, purposes {item}, people {item}, company_id string")
    meta = r.groupBy("acpt_no").agg(F.first("company_id").alias("company_id"), F.lit("Co").alias("company_name"), F.lit("").alias("submitter"), F.lit(None).cast("date").alias("disclosed_on"))
    names = spark.createDataFrame([("KNOWN", "company_000009")], "name string, company string")
    return build.issuance_graph(r.drop("company_id"), meta, names, "d", one_security)


def test_graph_build(spark):
    rows = [
        ("1", 0, "t", "first", None, [("a", 0.0), ("b", 5.0)], [("u", None)], [(" (주)known ", 2.0), ("-", 1.0), (" ", 1.0)], "7"),
        ("1", 1, "t", "second", None, [("b", 9.0)], [], [], "7"),
        ("2", 2, "t", "k", None, [], None, [("known", None)], "7"),
        ("3", 3, "t", "k", None, [("a", 1.0)], [], [], ""),
        ("", 4, "t", "k", None, [("a", 1.0)], [], [], "7"),
    ]
    nodes, edges = graph_of(spark, rows)
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"company_000007", "company_000009", "issuance_event_1", "issuance_event_2", "security_1_b"}
    assert n["issuance_event_1"].label == "second" and n["security_1_b"].amount == 5 and n["company_000009"].label == "(주)known"
    e = edges.collect()
    assert {(r.source, r.target, r.weight) for r in e if r.relation == "ACQUIRED"} == {("company_000009", "security_1_b", 2.0), ("company_000009", "issuance_event_2", 0.0)}
    assert len({r.id for r in e}) == len(e) == 7
    nodes, edges = graph_of(spark, rows, one_security=True)
    assert {r.id for r in nodes.filter("type = 'Security'").collect()} == {"security_1"}
    assert graph.dangling(nodes, edges).count() == 0


def test_directory(spark):
    meta = lambda *rows: spark.createDataFrame(rows, "company_id string, company_name string, submitter string, position int")
    got = build.directory([meta(("1", "주식회사 A", "", 0), ("2", "a", "", 1), (None, "b", "", 2)), meta(("3", " ", "c d", 0), ("4", "", None, 1))])
    assert {(r.name, r.company) for r in got.collect()} == {("A", "company_000002"), ("CD", "company_000003")}


def test_relations_need_known_refs(spark):
    refs = spark.createDataFrame([("1", "p", "person", "P"), ("1", "c", "company", "C"), ("1", "d", "person", "D"), ("1", "d", "person", "E"), ("1", "@p", "person", "P")], "acpt_no string, ref string, kind string, id string")
    rel = lambda r, s, t, evidence="e", phase="result", outcome="passed": ("1", r, s, t, evidence, phase, outcome, True, "", None, None)
    rows = [rel("elected_as", "p", "c"), rel("elected_as", "d", "c"), rel("elected_as", "@p", "c"), rel("elected_as", "p", "c", outcome="pending"), rel("elected_as", "p", "c", phase="notice"), rel("elected_as", "p", "c", evidence=None), rel("elected_as", "c", "p"), rel("unknown", "p", "c"), rel(None, "p", "c")]
    given = spark.createDataFrame(rows, "acpt_no string, relation string, source_ref string, target_ref string, evidence string, phase string, outcome string, is_current boolean, state string, event_date date, meeting_date date")
    assert [(r.source, r.target, r.is_active) for r in build.relation_edges(given, refs).collect()] == [("P", "C", True)]


def test_shortest_path(spark):
    edges = spark.createDataFrame([("1", "a", "c"), ("2", "a", "b"), ("3", "b", "d"), ("4", "c", "d"), ("5", "d", "e"), ("6", "x", "y"), ("7", "a", "a")], "id string, source string, target string")
    path = lambda a, b: [(r.path, r.hops) for r in graph.shortest_path(edges, a, b).collect()]
    assert path("a", "e") == [(["a", "b", "d", "e"], 3)]
    assert path("e", "a") == [(["e", "d", "b", "a"], 3)]
    assert path("a", "x") == [] and path("a", "a") == [(["a"], 0)]


def test_investors_like(spark):
    nodes = spark.createDataFrame([("company_1", "One", "Company"), ("person_1_A", "A 나", "Person"), ("security_1", "s", "Security"), ("issuance_event_1", "e", "IssuanceEvent"), ("shareholder_meeting_1", "m", "Meeting"), ("org_x", "XA나", "Organization")], "id string, label string, type string")
    edges = spark.createDataFrame([("1", "company_1", "issuance_event_1", "EXECUTED", None), ("2", "issuance_event_1", "security_1", "ISSUED", None), ("3", "person_1_A", "security_1", "ACQUIRED", None), ("4", "company_1", "shareholder_meeting_1", "HELD", None), ("5", "person_1_A", "shareholder_meeting_1", "PROPOSED", None), ("6", "person_1_A", "company_1", "SERVES_AT", None)], "id string, source string, target string, relation string, start_date date")
    got = sorted((r.id, r.relation or "", r.company) for r in graph.investors_like(nodes, edges, "a나").collect())
    assert got == [("org_x", "", None), ("person_1_A", "ACQUIRED", "One"), ("person_1_A", "PROPOSED", "One"), ("person_1_A", "SERVES_AT", "One")]
    assert graph.investors_like(nodes, edges, "(주)").count() == 0


def test_replace_tables(spark, tmp_path):
    a, b = (str(tmp_path / n) for n in "ab")
    spark.range(1).write.parquet(a)
    spark.range(2).write.parquet(f"{a}_new")
    spark.range(3).write.parquet(f"{b}_new")
    with pytest.raises(Exception):
        S.replace_tables(spark, {a: f"{a}_new", b: f"{b}_lacking"})
    assert spark.read.parquet(a).count() == 1 and spark.read.parquet(f"{a}_new").count() == 2
    S.replace_tables(spark, {a: f"{a}_new", b: f"{b}_new"})
    assert spark.read.parquet(a).count() == 2 and spark.read.parquet(b).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_small_sources(spark):
    assert S.item_name(["open", "adjOpen", "close"], "open") == "adjOpen" and S.item_name(["open"], "open") == "open" and S.item_name([], "low") is None
    wide = spark.createDataFrame([("d", 1, 2)], "date string, B int, A int")
    assert S.wide_codes(wide) == ["A", "B"] and S.preview(wide, 1, 2).columns == ["date", "B"]
