"""Queries of meetings (agendas out of lines, elections put to them, mentions merged) and of rights issues, with independently worded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import build, meeting_tables, meetings, rights
from .queries import query
from .queries_records import _orders, _text
from .session import spread, stored
from .sources import html_tables
from .sources import tables as S

#: Lines of every document with marks of agendas, sections and outcomes put to them by place.
_LINES = """l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'notice' ELSE 'result' END AS phase, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)),
  m AS (SELECT doc_id, phase, i, trim(CASE WHEN i % 9 = 4 THEN '1. 보고사항' WHEN i % 9 = 7 THEN '<부의안건>' WHEN i % 9 = 2 THEN '→ 원안대로 가결' WHEN i % 9 = 1 THEN '제' || (i // 3 + 1) || ' - 1호 의안: ' || s WHEN i % 9 = 5 THEN i || ') ' || s WHEN i % 9 = 8 THEN s || ' (부결)' WHEN i % 3 = 0 THEN '제' || (i // 3 + 1) || '호 의안: 감사 Kim 선임 ' || s ELSE s END) AS line FROM l)"""


def _marked(spark, d):
    docs = S.table(spark, d, "documents", ["doc_id", "text"]).filter("text IS NOT NULL")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " ")))
    i, s, n = F.col("i"), F.col("s"), F.floor(F.col("i") / 3) + 1
    line = (
        F.when(i % 9 == 4, "1. 보고사항")
        .when(i % 9 == 7, "<부의안건>")
        .when(i % 9 == 2, "→ 원안대로 가결")
        .when(i % 9 == 1, F.concat(F.lit("제"), n, F.lit(" - 1호 의안: "), s))
        .when(i % 9 == 5, F.concat(i, F.lit(") "), s))
        .when(i % 9 == 8, F.concat(s, F.lit(" (부결)")))
        .when(i % 3 == 0, F.concat(F.lit("제"), n, F.lit("호 의안: 감사 Kim 선임 "), s))
        .otherwise(s)
    )
    cells = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n").alias("cell"))
    return cells.select(F.col("doc_id").alias("acpt_no"), F.when(F.col("doc_id") % 3 == 0, "notice").otherwise("result").alias("phase"), "cell")


@query(rf"""WITH {_LINES}, g AS (SELECT *, CASE WHEN line = '1. 보고사항' THEN 0 WHEN line = '<부의안건>' THEN 1 END AS section FROM m WHERE line NOT IN ('', '-')),
  a AS (SELECT *, coalesce(last_value(section IGNORE NULLS) OVER w, 1) AS active FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, CASE WHEN section IS NOT NULL THEN NULL WHEN i % 9 = 1 THEN (i // 3 + 1) || '-1' WHEN i % 9 = 5 AND active = 1 AND len(line) > len(i || ')') THEN i::VARCHAR WHEN i % 3 = 0 THEN (i // 3 + 1)::VARCHAR END AS number FROM a),
  b AS (SELECT *, count(*) FILTER (WHERE section IS NOT NULL OR number IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM s),
  r AS (SELECT doc_id, phase, block, first(number ORDER BY i) AS number, string_agg(line, ' ' ORDER BY i) AS raw, string_agg(line, ' ' ORDER BY i) FILTER (WHERE i % 9 = 2) AS settled FROM b GROUP BY ALL),
  k AS (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY block) AS following FROM r)
  SELECT doc_id AS acpt_no, number, count(*)::BIGINT AS agendas, min(sha256(raw)) AS digest FROM k WHERE number IS NOT NULL AND NOT (following IS NOT NULL AND starts_with(following, number || '-') AND (phase = 'notice' OR settled IS NULL)) GROUP BY ALL""")
def legacy_agendas(spark, d):
    found = meetings.legacy_agendas(meetings.agenda_lines(_marked(spark, d)))
    return found.groupBy("acpt_no", "number").agg(F.count("*").alias("agendas"), F.min(F.sha2(F.col("title").cast("binary"), 256)).alias("digest"))


def _lines(spark, d):
    """(order, line): one row a line number of an order, of its smallest supplier and part. Apart by order, so that what goes by document needs no other shuffle."""
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]).repartition("l_orderkey")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))


_LINE_SQL = "x AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_LINE_SQL}, e AS (SELECT o, n, s, CASE WHEN p % 2 = 0 THEN 'out' ELSE 'aud' END AS office FROM x), a AS (SELECT o, n, CASE WHEN p % 3 = 0 THEN NULL ELSE s + (p % 3 = 2)::INT END AS s, CASE WHEN s % 2 = 0 THEN 'out' ELSE 'aud' END AS office FROM x),
  h AS (SELECT e.o, e.n, count(*) AS c, min(a.n) AS a FROM e JOIN a ON a.o = e.o AND a.s = e.s AND a.office = e.office GROUP BY ALL),
  u AS (SELECT o, office, min(n) AS a FROM a WHERE s IS NULL GROUP BY ALL HAVING count(*) = 1), v AS (SELECT o, office, min(n) AS n FROM e GROUP BY ALL HAVING count(*) = 1)
  SELECT o AS acpt_no, n AS election, a AS agenda, 'name' AS by FROM h WHERE c = 1 UNION ALL SELECT v.o, v.n, u.a, 'office' FROM v JOIN u USING (o, office) WHERE NOT EXISTS (FROM h WHERE h.o = v.o AND h.n = v.n)""")
def election_agendas(spark, d):
    x = _lines(spark, d)
    name = lambda c: F.concat(F.lit("Kim"), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
    e = x.select(F.col("o").alias("acpt_no"), F.lpad(F.col("n").cast("string"), 3, "0").alias("election_ref"), name(F.col("s")).alias("name"), F.when(F.col("p") % 2 == 0, "outside_director").otherwise("auditor").alias("office"))
    who = F.when(F.col("p") % 3 == 1, name(F.col("s"))).when(F.col("p") % 3 == 2, name(F.col("s") + 1))
    office = F.when(F.col("s") % 2 == 0, "사외이사").otherwise("감사")
    title = F.concat(office, F.lit(" "), F.coalesce(F.when(F.col("s") % 5 > 0, F.concat(who, F.lit(" "))), F.lit("")), F.lit("선임"))
    a = x.select(F.col("o").alias("acpt_no"), F.lpad(F.col("n").cast("string"), 3, "0").alias("agenda_ref"), title.alias("title"), F.when(who.isNotNull(), F.array(who)).alias("candidates"))
    got = meetings.match_elections(e, a)
    return got.select("acpt_no", F.col("election_ref").cast("int").alias("election"), F.col("agenda_ref").cast("int").alias("agenda"), "by")


def _mentions(spark, d):
    x = _lines(spark, d)
    person = F.col("p") % 2 == 0
    name = F.when(person, F.concat(F.lit("Kim "), (F.col("s") % 3).cast("string"), F.when(F.col("p") % 4 == 0, " (Kim Alias)").otherwise(""))).otherwise(F.concat(F.lit("- Org, "), (F.col("s") % 3).cast("string")))
    return x.select(F.col("o").alias("acpt_no"), F.col("n").alias("at"), F.when(person, "person").otherwise("organization").alias("kind"), name.alias("name"), F.when(F.col("s") % 7 == 0, "1970-01").alias("birth_month"), F.concat(F.lit("e"), (F.col("p") % 5).cast("string")).alias("evidence"), "s", "p")


_ENTITY_SQL = f"""{_LINE_SQL}, m AS (SELECT o, n, s, p, CASE WHEN p % 2 = 0 THEN 'person' ELSE 'organization' END AS kind, s % 3 AS k, CASE WHEN p % 2 = 0 AND s % 7 = 0 THEN '1970-01' ELSE '' END AS b FROM x),
  g AS (SELECT o, kind, k, b, min(n) AS first_n, count(DISTINCT p % 5) AS mentions, max(CASE WHEN p % 4 = 0 AND kind = 'person' THEN 1 ELSE 0 END) AS aliases FROM m GROUP BY ALL),
  r AS (SELECT *, kind || ':' || (row_number() OVER (PARTITION BY o, kind ORDER BY first_n) - 1) AS ref FROM g)"""


@query(f"""WITH {_ENTITY_SQL} SELECT o AS acpt_no, ref AS entity_ref, CASE WHEN kind = 'person' THEN 'Kim ' || k ELSE 'Org, ' || k END AS name, b AS birth_month, aliases, mentions FROM r""")
def meeting_entities(spark, d):
    ents, _ = meetings.merge_entities(_mentions(spark, d).drop("s", "p"))
    return ents.select("acpt_no", "entity_ref", "name", "birth_month", F.size("aliases").alias("aliases"), F.size("mentions").cast("long").alias("mentions"))


@query(f"""WITH {_ENTITY_SQL}, l AS (SELECT m.o, m.n, r.ref, CASE WHEN m.s % 4 = 0 THEN 'agenda:' || m.p % 2 ELSE '@meeting' END AS target, CASE WHEN m.s % 4 = 0 THEN 'subject_of' ELSE 'candidate_for' END AS type, CASE WHEN m.p % 3 = 0 THEN 'director' ELSE 'auditor' END AS office, CASE WHEN m.p % 5 = 0 THEN 'passed' END AS outcome FROM m JOIN r USING (o, kind, k, b)),
  k AS (SELECT *, CASE WHEN type = 'subject_of' THEN 'appointment' ELSE office END AS told FROM l)
  SELECT o AS acpt_no, ref AS source, target, type, told, string_agg(DISTINCT office, ',' ORDER BY office) AS offices, coalesce(last(outcome ORDER BY n) FILTER (WHERE outcome IS NOT NULL), '') AS outcome, coalesce(max(n) FILTER (WHERE outcome IS NOT NULL), min(n)) AS evidence,
    row_number() OVER (PARTITION BY o ORDER BY min(n)) - 1 AS relation_no FROM k GROUP BY o, ref, target, type, told""")
def meeting_relations(spark, d):
    m = _mentions(spark, d)
    _, refs = meetings.merge_entities(m.drop("s", "p"))
    subject = F.col("s") % 4 == 0
    office = F.when(F.col("p") % 3 == 0, "director").otherwise("auditor")
    attributes = F.create_map(F.lit("office_type"), office, F.lit("action"), F.when(subject, "appointment").otherwise(""), F.lit("outcome"), F.when(F.col("p") % 5 == 0, "passed"))
    found = m.select("acpt_no", "at", F.col("at").cast("string").alias("source"), F.when(subject, F.concat(F.lit("agenda:"), (F.col("p") % 2).cast("string"))).otherwise("@meeting").alias("target"), F.when(subject, "subject_of").otherwise("candidate_for").alias("type"), attributes.alias("attributes"), F.col("at").cast("string").alias("evidence"))
    got = meetings.merge_relations(found, refs)
    a = F.col("attributes")
    told = F.when(F.col("type") == "subject_of", a["action"]).otherwise(a["office_type"])
    offices = F.array_join(F.array_sort(F.split(F.coalesce(a["office_types"], a["office_type"]), ",")), ",")
    return got.select("acpt_no", F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "type", told.alias("told"), offices.alias("offices"), F.coalesce(a["outcome"], F.lit("")).alias("outcome"), F.col("evidence").cast("int").alias("evidence"), F.col("relation_no").cast("long").alias("relation_no"))


# rights issues ------------------------------------------------------------------------------------------


def _issues(spark, d):
    """Orders as pages of paid, bonus and mixed issues by turns."""
    o, k = spread(_orders(spark, d), "o_orderkey"), F.col("o_orderkey")
    money = lambda c: F.format_number(c, 0)
    paid = _text(
        """<tr><td rowspan="2">1. 신주의 종류와 수</td><td>보통주식 (주)</td><td>{count}</td></tr><tr><td>기타주식 (주)</td><td>-</td></tr><tr><td>증자전 발행주식총수 (주)</td><td>보통주식 (주)</td><td>{before}</td></tr>"""
        """<tr><td rowspan="2">자금조달의 목적</td><td>시설자금 (원)</td><td>{p1}</td></tr><tr><td>운영자금 (원)</td><td>{p2}</td></tr><tr><td>신주 발행가액</td><td>확정발행가</td><td>보통주식 (원)</td><td>{price}</td></tr><tr><td>증자방식</td><td>{method}</td></tr><tr><td>납입일</td><td>{day}</td></tr>""",
        count=money(k % 50 * 10), before=money(k), p1=money(k * 100), p2=F.when(k % 2 == 0, "-").otherwise(money(k * 50)), price=money(k % 7 * 100), method=F.when(k % 4 == 0, "제3자배정증자").otherwise("주주배정증자"), day=F.substring("stamp", 1, 10),
    )
    bonus = _text("""<tr><td rowspan="2">신주의 종류와 수</td><td>보통주식 (주)</td><td>{n}</td></tr><tr><td>기타주식 (주)</td><td>0</td></tr><tr><td>신주배정기준일</td><td>{day}</td></tr>""", n=money(k % 9), day=F.substring("stamp", 1, 10))
    people = F.when(k % 4 == 0, _text("""<table><tr><th>제3자배정 대상자</th><th>배정주식수 (주)</th></tr><tr><td>{name}</td><td>{count}</td></tr></table>""", name=F.col("c_name"), count=money(k % 50 * 10))).otherwise("")
    wrap = lambda body: F.concat(F.lit("<table>"), body, F.lit("</table>"))
    html = F.when(k % 3 == 0, F.concat(wrap(paid), people)).when(k % 3 == 1, wrap(bonus)).otherwise(F.concat(wrap(F.concat(F.lit("<tr><td>유상증자</td></tr>"), paid, F.lit("<tr><td>무상증자</td></tr>"), bonus)), people))
    title = F.element_at(F.array(F.lit("유상증자 결정"), F.lit("무상증자 결정"), F.lit("유무상증자 결정")), (k % 3 + 1).cast("int"))
    return o.select(k.alias("id"), title.alias("title"), html.alias("html"), "cust", "c_name", F.to_date("o_orderdate").alias("day"))


def _issue_fields(spark, d):
    docs = _issues(spark, d)
    return docs, rights.with_warnings(rights.rights_fields(html_tables.read_tables(docs, "id", "html", keep=("title",)), None, "id"))


_ISSUE_SQL = """i AS (SELECT o_orderkey AS id, o_orderkey % 3 AS m, o_orderkey AS k, c_name AS name, o_custkey AS cust, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {_ISSUE_SQL} SELECT id, ['paid', 'bonus', 'mixed'][m + 1] AS kind, CASE WHEN m = 1 THEN k % 9 ELSE k % 50 * 10 END AS common, CASE WHEN m <> 1 THEN k END AS before, CASE WHEN m <> 1 THEN k % 7 * 100 END AS price,
  CASE WHEN m = 1 THEN NULL WHEN k = 0 THEN '' ELSE '시설자금:' || k * 100 || CASE WHEN k % 2 = 1 THEN '|운영자금:' || k * 50 ELSE '' END END AS purposes, CASE WHEN m <> 1 THEN CASE WHEN k % 4 = 0 THEN '제3자배정증자' ELSE '주주배정증자' END END AS method,
  CASE WHEN m <> 1 THEN CASE WHEN k % 4 = 0 THEN name || ':' || k % 50 * 10 ELSE '' END END AS targets, CASE WHEN m > 0 THEN k % 9 END AS bonus_common, CASE WHEN m > 0 THEN day END AS bonus_day,
  CASE WHEN m = 1 THEN 'not_applicable' WHEN k % 7 = 0 THEN 'explicit_zero' ELSE 'parsed' END AS price_status,
  (CASE WHEN m <> 1 AND (k % 7 = 0 AND false OR k % 7 > 0 AND (k % 50 * 10) * (k % 7 * 100) <> k * 100 + k % 2 * k * 50) AND k > 0 THEN 1 ELSE 0 END)::BIGINT AS value_off FROM i""")
def rights_records(spark, d):
    _, got = _issue_fields(spark, d)
    show = lambda items: F.array_join(F.transform(items, lambda x: F.concat(x["label"], F.lit(":"), x["amount"].cast("string"))), "|")
    first = lambda items: F.get(items, F.lit(0))["amount"]
    off = F.size(F.filter("warnings", lambda w: w["warning"].startswith("발행목적: 신주"))).cast("long")
    return got.select("id", "kind", first("counts").alias("common"), first("before").alias("before"), first("prices").alias("price"), show("purposes").alias("purposes"), "method", show("targets").alias("targets"), first("bonus_counts").alias("bonus_common"), F.col("bonus_record_date").alias("bonus_day"), F.col("status")["prices"].alias("price_status"), off.alias("value_off"))


def _issue_graph(spark, d):
    docs, got = _issue_fields(spark, d)
    meta = docs.select(F.col("id").cast("string").alias("acpt_no"), F.col("cust").alias("company_id"), F.col("c_name").alias("company_name"), F.lit("").alias("submitter"), F.col("day").alias("disclosed_on"))
    names = build.directory([docs.select(F.col("cust").alias("company_id"), F.col("c_name").alias("company_name"), F.lit("").alias("submitter"), F.col("id").alias("position"))])
    records = stored(rights.to_records(got, "id"), "issues")  # the graph reads them once for each kind of node and edge, the pages are read once
    return build.issuance_graph(records, meta, names, "유상증자결정"), meta, names


@query(f"""WITH {_ISSUE_SQL}, e AS (SELECT id, 'EXECUTED' AS relation, NULL::DOUBLE AS w FROM i UNION ALL SELECT id, 'ISSUED', CASE WHEN m = 1 THEN k % 9 ELSE k % 50 * 10 END FROM i WHERE CASE WHEN m = 1 THEN k % 9 ELSE k % 50 * 10 END > 0
  UNION ALL SELECT id, 'FOR_PURPOSE', k * 100 FROM i WHERE m <> 1 AND k > 0 UNION ALL SELECT id, 'FOR_PURPOSE', k * 50 FROM i WHERE m <> 1 AND k % 2 = 1 UNION ALL SELECT id, 'ACQUIRED', k % 50 * 10 FROM i WHERE m <> 1 AND k % 4 = 0)
  SELECT id::VARCHAR AS acpt_no, relation, count(*)::BIGINT AS edges, sum(w) AS weight FROM e GROUP BY ALL""")
def rights_page_edges(spark, d):
    (_, edges), _, _ = _issue_graph(spark, d)
    return edges.groupBy("acpt_no", "relation").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query(f"""WITH {_ISSUE_SQL} SELECT 'Company' AS type, count(DISTINCT cust)::BIGINT AS nodes FROM i UNION ALL SELECT 'IssuanceEvent', count(*) FROM i UNION ALL SELECT 'ShareholderMeeting', count(*) FROM i
  UNION ALL SELECT 'Security', count(*) FILTER (CASE WHEN m = 1 THEN k % 9 ELSE k % 50 END > 0) + count(*) FILTER (k % 10 > 0) FROM i UNION ALL SELECT 'FundUsage', count(*) FILTER (k > 0) + count(*) FILTER (m <> 1 AND k % 2 = 1) FROM i""")
def families_graph(spark, d):
    """Rights, bonds and meetings of the same companies as one graph; bonds share event and purpose nodes with rights of one number."""
    rights_graph, meta, names = _issue_graph(spark, d)
    o, k = _orders(spark, d), F.col("o_orderkey")
    item = lambda label, amount: F.array(F.struct(F.lit(label).alias("label"), amount.cast("long").alias("amount")))
    bonds = o.select(F.col("id").alias("acpt_no"), k.alias("position"), F.lit("전환사채").alias("title"), F.lit("CB").alias("kind"), F.to_date("o_orderdate").alias("paid_on"), item("전환사채", k % 10).alias("items"), item("시설자금", k).alias("purposes"), item("-", k).alias("people"))
    bond_graph = build.issuance_graph(bonds, meta, names, "전환사채권발행결정", one_security=True)
    held = o.select(F.col("id").alias("acpt_no"), F.col("cust").alias("company_id"), F.col("c_name").alias("company_name"), F.to_date("o_orderdate").alias("meeting_date"), F.col("o_orderpriority").alias("title"), F.lit(False).alias("has_later_correction"), F.lit(True).alias("parsed"))
    nodes, _ = build.one_graph([rights_graph, bond_graph, build.meeting_graph(held)])
    return nodes.groupBy("type").agg(F.count("*").alias("nodes"))


# meetings out of tables ---------------------------------------------------------------------------------


def _meeting_rows(spark, d):
    """Orders as pages of meetings: corrections, agendas, an election, a change of purpose and the date."""
    o, k = spread(_orders(spark, d), "o_orderkey"), F.col("o_orderkey")
    html = _text(
        """<table><tr><th>정정항목</th><th>정정전</th><th>정정후</th></tr><tr><td>3. 기타 투자판단에 참고할 사항</td><td>-</td><td>after {id}</td></tr><tr><td>일시</td><td>-</td><td>1999-01-01</td></tr></table>"""
        """<table><tr><th>번호</th><th>결의구분</th><th>회의 목적사항</th><th>가결여부</th></tr><tr><td>1</td><td>보통</td><td>{name}</td><td>{said}</td></tr><tr><td>2</td><td>특별</td><td>{other}</td><td>{also}</td></tr></table>"""
        """<span>{section}</span><table><tr><th>성명</th><th>임기</th></tr><tr><td>{name} (상근)</td><td>{term}</td></tr><tr><td>미정</td><td>1</td></tr></table>"""
        """<span>사업목적 변경 세부내역</span><table><tr><th>구분</th><th colspan="2">내용</th><th>이유</th></tr><tr><td>{change}</td><td>{id}</td><td>b</td><td>{status}</td></tr></table><table><tr><td>1. 주주총회일자(시간)</td><td>{day} 09:00</td></tr></table>""",
        id=F.col("id"), name=F.col("c_name"), said=F.when(k % 3 == 0, "원안대로 승인").otherwise("부결"), other=F.when(k % 5 == 0, "미정").otherwise(F.col("o_orderpriority")), also=F.when(k % 2 == 0, "안건 철회").otherwise("가결"), term=(k % 4).cast("string"),
        section=F.element_at(F.array(*[F.lit(s) for s in meeting_tables.ELECTIONS]), (k % 4 + 1).cast("int")), change=F.when(k % 2 == 0, "사업목적 변경").otherwise("사업목적 추가"), status=F.col("o_orderstatus"), day=F.when(k % 7 == 0, "2024-02-31").otherwise(F.substring("stamp", 1, 10)),
    )
    return html_tables.read_tables(o.select(F.col("o_orderkey").alias("id"), html.alias("html")), "id", "html", meeting_tables.SECTIONS)


@query("""WITH a AS (SELECT o_orderkey AS id, '1' AS number, c_name AS title, CASE WHEN o_orderkey % 3 = 0 THEN '원안대로 승인' ELSE '부결' END AS said FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, '2', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '안건 철회' ELSE '가결' END FROM orders WHERE o_orderkey % 5 > 0)
  SELECT id, 'agenda:' || (row_number() OVER (PARTITION BY id ORDER BY number) - 1) AS agenda_ref, number, title, CASE said WHEN '원안대로 승인' THEN 'passed' WHEN '부결' THEN 'rejected' WHEN '가결' THEN 'passed' ELSE 'withdrawn' END AS status FROM a""")
def structured_agendas(spark, d):
    return meeting_tables.structured_agendas(_meeting_rows(spark, d), "id").select("id", "agenda_ref", "number", "title", "status")


@query("""SELECT o_orderkey AS id, ['director', 'outside_director', 'auditor', 'audit_committee_member'][(o_orderkey % 4 + 1)::INT] AS office, c_name AS name, '상근' AS employment_mode, (o_orderkey % 4)::VARCHAR AS term FROM orders JOIN customer ON o_custkey = c_custkey""")
def meeting_elections(spark, d):
    return meeting_tables.elections(_meeting_rows(spark, d), "id").select("id", "office", "name", "employment_mode", "term")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '>b' ELSE o_orderkey::VARCHAR END AS change, o_orderstatus AS reason, 'after ' || o_orderkey AS note FROM orders""")
def meeting_facts(spark, d):
    """The date, the change of purpose and the note of the correction of each meeting."""
    rows = _meeting_rows(spark, d).select("id", "tables", F.date_format(meeting_tables.date_of("tables", F.lit("result")), "yyyy-MM-dd").alias("day"))
    each = rows.select("id", "tables", "day", F.explode_outer(meeting_tables.changes_of("tables")).alias("c")).filter("c IS NOT NULL")
    each = each.select("id", "day", "c", F.explode_outer(meeting_tables.notes_of("tables")).alias("n")).filter("n IS NOT NULL")
    return each.select("id", "day", F.coalesce("c.content", F.concat("c.before", F.lit(">"), "c.after")).alias("change"), "c.reason", F.col("n.text").alias("note"))


_SPAN_SQL = """t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, k, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS s FROM t, (VALUES ('word', '[a-z]+ing'), ('number', '[0-9]+'), ('stop', '[.!?]'), ('comma', ',')) v(k, p)),
  e AS (SELECT doc_id, k, i, m[i] AS text, (length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i - 1], '')))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
  a AS (SELECT *, last_value(CASE WHEN k IN ('stop', 'comma') THEN start END IGNORE NULLS) OVER w AS before, last_value(CASE WHEN k IN ('stop', 'comma') THEN k END IGNORE NULLS) OVER w AS relation FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_SPAN_SQL} SELECT doc_id, k AS kind, CASE WHEN start - before <= 60 THEN relation END AS relation, count(*) AS n, sum(start)::BIGINT AS starts, sum(CASE WHEN start - before <= 60 THEN before END)::BIGINT AS anchors FROM a WHERE k IN ('word', 'number') GROUP BY ALL""")
def anchored_spans(spark, d):
    """Words and numbers of every document with the mark before them, summed by document, kind and mark."""
    docs = S.table(spark, d, "documents", ["doc_id", "text"])
    got = meeting_tables.anchored_spans(docs, "doc_id", "text", {"word": "[a-z]+ing", "number": "[0-9]+"}, {"stop": "[.!?]", "comma": ","}, 60)
    return got.groupBy("doc_id", "kind", "relation").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum(F.col("anchor_start").cast("long")).alias("anchors"))


@query("""WITH p AS (SELECT page_id AS id, regexp_extract_all(html, '<ul>.*?</ul>', 0, 's') AS lists FROM pages) SELECT id, len(lists)::INT AS tables, list_sum(list_transform(lists, lambda x: (length(x) - length(replace(x, '<li>', ''))) // 4))::BIGINT AS cells, 0 AS errors FROM p WHERE len(lists) > 0""")
def page_lists(spark, d):
    """The lists of every page, put as tables to the reader of HTML: how many, their cells, and how many pages it can't read."""
    p = S.table(spark, d, "pages", ["page_id", "html"])
    html = F.col("html")
    for old, new in {"<ul>": "<table>", "</ul>": "</table>", "<li>": "<tr><td>", "</li>": "</td></tr>"}.items():
        html = F.replace(html, F.lit(old), F.lit(new))
    rows = html_tables.explode_titled(p.select(F.col("page_id").alias("id"), html.alias("html")), "id", "html", meeting_tables.SECTIONS)
    return rows.groupBy("id").agg(F.count_distinct("table").cast("int").alias("tables"), F.sum(F.size("cells")).cast("long").alias("cells"), F.count("error").cast("int").alias("errors"))
