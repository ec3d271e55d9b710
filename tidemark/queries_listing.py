"""Queries of listings, records and text functions, each with an independently worded SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .functions import keys as K
from .functions import text as T
from .operators import asof, facets, listing
from .plans import predicates as P
from .queries import _DISCLOSURES, query
from .sources import tables as S

#: Titles that stand in for those of disclosures, picked by a row's number.
TITLES = (
    "유상증자 결정", "무상증자 및 유상증자 결정", "유무상 증자 결정", "[정정] 전환사채권 발행결정", "교환사채 및 전환사채", "신주인수권부사채 [기재정정][첨부]",
    "주주총회결과", "주주총회 소집결의", "1. 가. 자금의 사용목적", "(ii) 시설 자금", "시설자금 (원)", "운영자금 / 원", "12,345원", "-3.5 %", "없음", " - ",
)
RESULTS = (("원안대로 가결", ""), ("미가결", ""), ("가결되지 않음", ""), ("부결", "안건 철회"), ("원안 승인", ""), ("미결", ""), ("", "의안을 폐기"), ("불상정", ""), ("가결", "가결 후 보류"), ("보류", ""))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, number) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _titled(spark, d):
    return S.table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("id"), _pick(TITLES, F.col("o_orderkey")).alias("title"))


_TITLED = f"t AS (SELECT o_orderkey AS id, {_sql_list(TITLES)}[(o_orderkey % {len(TITLES)} + 1)::INT] AS title FROM orders)"


@query(rf"""WITH {_TITLED}, u AS (SELECT id, title, replace(title, ' ', '') AS s FROM t) SELECT id,
  CASE WHEN contains(s, '유무상증자') THEN 'mixed' WHEN contains(s, '무상증자') THEN 'bonus' WHEN contains(s, '유상증자') THEN 'paid' ELSE 'unknown' END AS issuance,
  CASE WHEN contains(title, '전환사채')::INT + contains(title, '교환사채')::INT + contains(title, '신주인수권부사채')::INT <> 1 THEN NULL
       WHEN contains(title, '전환사채') THEN 'CB' WHEN contains(title, '교환사채') THEN 'EB' ELSE 'BW' END AS bond,
  CASE WHEN contains(title, '주주총회결과') THEN 'RESULT' WHEN contains(title, '소집결의') OR contains(title, '소집공고') THEN 'NOTICE' END AS phase,
  array_to_string(list_distinct_in_order, '|') AS flags FROM (SELECT *, regexp_extract_all(title, '\[([^\]]+)\]', 1) AS list_distinct_in_order FROM u)""")
def title_kinds(spark, d):
    t = F.col("title")
    return _titled(spark, d).select("id", T.issuance_type(t).alias("issuance"), T.bond_type(t).alias("bond"), T.meeting_phase(t).alias("phase"), F.array_join(T.title_flags(t), "|").alias("flags"))


@query(rf"""WITH {_TITLED} SELECT id, replace(title, ' ', '') AS bare, regexp_replace(replace(title, ' ', ''), '^([0-9]+|[ivxlcdmIVXLCDM]+)(-([0-9]+|[ivxlcdmIVXLCDM]+))?\.', '') AS label,
  nullif(trim(regexp_replace(trim(regexp_replace(title, '\(\s*원\s*\)', '', 'g')), '\s*원$', ''), ' -_/·,'), '') AS purpose,
  TRY_CAST(replace(regexp_extract(title, '-?[0-9][0-9,]*(\.[0-9]+)?', 0), ',', '') AS DOUBLE) AS price FROM t""")
def label_cleaning(spark, d):
    t = F.col("title")
    return _titled(spark, d).select("id", T.remove_spaces(t).alias("bare"), T.normalize_label(t).alias("label"), T.purpose_label(t).alias("purpose"), T.parse_price(t).alias("price"))


@query(f"""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS line, {_sql_list(r for r, _ in RESULTS)}[(l_orderkey % {len(RESULTS)} + 1)::INT] AS r, {_sql_list(m for _, m in RESULTS)}[(l_orderkey % {len(RESULTS)} + 1)::INT] AS m FROM lineitem)
  SELECT id, line, CASE WHEN m IN ('안건 철회') THEN 'withdrawn' WHEN r = '불상정' OR m = '의안을 폐기' THEN 'not_tabled' WHEN r IN ('부결', '미가결', '가결되지 않음') THEN 'rejected'
  WHEN r IN ('원안대로 가결', '원안 승인', '가결') THEN 'passed' WHEN r = '미결' THEN 'unresolved' END AS status FROM t""")
def agenda_statuses(spark, d):
    rows = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    k = F.col("l_orderkey")
    return rows.select(k.alias("id"), F.col("l_linenumber").alias("line"), T.agenda_status(_pick([r for r, _ in RESULTS], k), _pick([m for _, m in RESULTS], k)).alias("status"))


@query(f"""WITH {_DISCLOSURES} SELECT id, year(strptime(disclosed_at, '%Y-%m-%d %H:%M'))::INT AS y, split_part(disclosed_at, ' ', 1) AS day, id % 7 <> 0 AS stamp_ok,
  sha256('{{"id":' || id || ',"market":"' || market || '"}}') AS hash FROM d""")
def row_stamps(spark, d):
    rows = S.order_disclosures(spark, d)
    stamp = F.when(F.col("id") % 7 == 0, F.concat(F.lit("2024-13-01 "), F.substring("disclosed_at", 12, 5))).otherwise(F.col("disclosed_at"))
    return rows.select("id", T.year_of(F.col("disclosed_at")).alias("y"), T.date_part(F.col("disclosed_at")).alias("day"), listing.stamp_ok(stamp).alias("stamp_ok"), T.canonical_hash(market=F.col("market"), id=F.col("id")).alias("hash"))


@query("""SELECT o_custkey AS id, sha256(string_agg(o_orderkey::VARCHAR, '' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1""")
def order_list_hash(spark, d):
    return S.table(spark, d, "orders", ["o_custkey", "o_orderkey"]).groupBy(F.col("o_custkey").alias("id")).agg(T.codes_hash(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("hash"))


_CALLS = """c AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'go(1)' ELSE 'openDisclsViewer( ''' || event_id || ''', "' || user_id || '" )' END AS call FROM events)"""


@query(f"""WITH {_CALLS} SELECT id, CASE WHEN id % 5 <> 0 THEN id::VARCHAR END AS acpt_no, CASE WHEN id % 5 <> 0 THEN (SELECT e.user_id::VARCHAR FROM events e WHERE e.event_id = c.id) END AS doc_no FROM c""")
def viewer_calls(spark, d):
    e = S.table(spark, d, "events", ["event_id", "user_id"])
    call = F.when(F.col("event_id") % 5 == 0, F.lit("go(1)")).otherwise(F.format_string("openDisclsViewer( '%d', \"%d\" )", "event_id", "user_id"))
    hit = e.select(F.col("event_id").alias("id"), T.viewer_call(call).alias("v"))
    return hit.select("id", F.col("v.acpt_no").alias("acpt_no"), F.col("v.doc_no").alias("doc_no"))


@query(f"""WITH {_DISCLOSURES}, s AS (SELECT id, year, title, row_number() OVER (ORDER BY year, id) AS r FROM d) SELECT id, year, title FROM s WHERE r > (SELECT count(*) // 2 FROM d)""")
def scan_offset(spark, d):
    rows = S.order_disclosures(spark, d).select("id", "year", "title")
    counts = rows.groupBy("year").agg(F.count("*").alias("n"))
    return listing.scan_from(rows, counts, rows.count() // 2)


@query(f"""WITH {_DISCLOSURES} SELECT id, acpt_no, disclosed_at FROM d WHERE market = 'BUILDING' AND disclosed_date BETWEEN '1994-01-01' AND '1997-12-31'
  AND (contains(lower(title), 'urgent') OR contains(lower(title), 'high')) AND NOT contains(lower(title), '2-') AND contains(lower(company_name), '#0000') AND lower(submitter) = 'o' AND id % 3 <> 0""")
def full_search(spark, d):
    rows = S.order_disclosures(spark, d)
    title = T.fold(F.col("title"))
    out = listing.search(rows, acpt_nos=rows.filter("id % 3 <> 0"), market="BUILDING", start="1994-01-01", end="1997-12-31", keywords=title.contains("urgent") | title.contains("high"), exclude=title.contains("2-"), company="#0000", submitter="O")
    return out.select("id", "acpt_no", "disclosed_at")


@query(f"""WITH {_DISCLOSURES} SELECT id FROM d WHERE market = 'MACHINERY' AND contains(lower(title), 'low')""")
def title_search_ignores_exclusions(spark, d):
    rows = S.order_disclosures(spark, d)
    return listing.search(rows, market="MACHINERY", title=P.compile_title("low", F.col("title")), keywords=F.lit(False), exclude=F.lit(True)).select("id")


@query("""WITH e AS (SELECT event_id, event_type AS code, CASE WHEN hour(ts) * 60 + minute(ts) >= 930 THEN ts::DATE + 1 ELSE ts::DATE END AS anchor FROM events)
  SELECT e.event_id, min(b.date) AS trade_day FROM e LEFT JOIN (SELECT DISTINCT event_type AS code, ts::DATE AS date FROM events) b ON b.code = e.code AND b.date >= e.anchor GROUP BY 1""")
def trade_day_join(spark, d):
    e = S.table(spark, d, "events", ["event_id", "ts", "event_type"]).select("event_id", F.col("event_type").alias("code"), asof.anchor_date(F.col("ts")).alias("anchor"))
    days = asof.forward_asof_small(e, S.event_bars(spark, d).select("code", "date"), keep=("date",)).select("event_id", F.col("date").alias("trade_day"))
    return e.select("event_id").join(days, "event_id", "left")


@query("SELECT o_orderkey AS id, l_linenumber AS line, l_shipdate AS shipped FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC) AS r FROM lineitem) l ON l_orderkey = o_orderkey AND r = 1")
def lookup_last_wins(spark, d):
    left = S.table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("id"))
    right = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"]).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"), F.struct("l_linenumber", "l_shipdate").alias("position"))
    return listing.last_lookup(left, right, "id", "position")


@query("""SELECT c_custkey::VARCHAR AS code, c_name AS name, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def unlisted_companies(spark, d):
    mapping = S.table(spark, d, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"))
    found = S.order_disclosures(spark, d).groupBy(F.col("company_id").alias("code"), F.col("company_name").alias("name")).agg(F.count("*").alias("n"))
    return listing.add_unlisted(found, mapping, "code", "name")


@query("""SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_price_data FROM customer""")
def price_data_flag(spark, d):
    traded = S.table(spark, d, "orders", ["o_custkey"]).distinct()
    return S.table(spark, d, "customer", ["c_custkey"]).join(traded, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("o_custkey").isNotNull().alias("has_price_data"))


@query("""WITH c AS (SELECT DISTINCT s_suppkey AS key, s_suppkey * 2 + r AS code, r AS rank FROM supplier, (VALUES (0), (1), (2)) v(r)), h AS (SELECT key, min(rank) AS rank FROM c WHERE code IN (SELECT o_custkey FROM orders) GROUP BY 1)
  SELECT c.key, o_orderkey AS id FROM h JOIN c ON c.key = h.key AND c.rank = h.rank JOIN orders ON o_custkey = c.code""")
def first_candidate_lookup(spark, d):
    c = S.table(spark, d, "supplier", ["s_suppkey"]).distinct().select(F.col("s_suppkey").alias("key"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank"))
    rows = S.table(spark, d, "orders", ["o_custkey", "o_orderkey"]).select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"))
    return listing.first_candidate(c.withColumn("code", F.col("key") * 2 + F.col("rank")), rows, "key", "code").select("key", "id")


@query("""WITH p AS (SELECT l_orderkey AS acpt_no, l_linenumber AS page, l_partkey AS id FROM lineitem), f AS (SELECT acpt_no, page, id, row_number() OVER (PARTITION BY acpt_no ORDER BY page, id) AS r FROM p)
  SELECT page, count(*)::BIGINT AS source, count(*) FILTER (WHERE r = 1)::BIGINT AS written, count(*) FILTER (WHERE r > 1)::BIGINT AS duplicates FROM f GROUP BY page""")
def page_dedup_counts(spark, d):
    return listing.page_counts(S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).select(F.col("l_orderkey").alias("acpt_no"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("id")))


@query("""WITH x AS (SELECT o_custkey AS id, o_orderkey * 10 + i AS o, [o_orderpriority, o_orderstatus][i] AS v FROM orders, (VALUES (1), (2)) t(i)), f AS (SELECT id, v, min(o) AS o FROM x GROUP BY ALL)
  SELECT id, string_agg(v, ', ' ORDER BY o) AS badges FROM f GROUP BY id""")
def badge_union(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"])
    return listing.ordered_union(o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o"), F.array("o_orderpriority", "o_orderstatus").alias("badges")), "id", "badges", "o")


@query("SELECT DISTINCT c_custkey::VARCHAR AS code, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def code_names(spark, d):
    return S.order_disclosures(spark, d).select(F.col("company_id").alias("code"), F.col("company_name").alias("name")).distinct().orderBy("code", "name")


@query(f"""WITH {_DISCLOSURES}, r AS (SELECT id, row_number() OVER (ORDER BY disclosed_at DESC, id DESC) AS r FROM d) SELECT id, (SELECT count(*) FROM d) > 40 AS has_more FROM r WHERE r BETWEEN 21 AND 40""")
def timeline_page(spark, d):
    rows = S.order_disclosures(spark, d).select("id", F.col("disclosed_at"), (-F.col("id")).alias("late"), (-F.unix_timestamp("disclosed_at", "yyyy-MM-dd HH:mm")).alias("at"))
    return listing.page_of(rows, ["at", "late"], 2, 20).select("id", "has_more")


@query("""WITH x AS (SELECT l_orderkey AS family, f AS field, l_linenumber AS n, max(v) AS v FROM (SELECT l_orderkey, l_linenumber, 'quantity' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem) GROUP BY ALL)
  SELECT family, field, string_agg(n || '=' || v, '|' ORDER BY n) AS versions FROM x GROUP BY ALL""")
def change_matrix(spark, d):
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"]).withColumnsRenamed({"l_quantity": "quantity", "l_tax": "tax"})  # noqa: E741
    found = listing.change_matrix(l.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "tax"], "field", "v").withColumnRenamed("l_orderkey", "family"), "family", "field", "l_linenumber", "v")
    return found.withColumn("versions", F.array_join(F.transform("versions", lambda x: F.concat(x["version"], F.lit("="), x["value"])), "|"))


@query("SELECT code, date, (row_number() OVER (PARTITION BY code ORDER BY date) - 1)::INT AS day_index FROM (SELECT DISTINCT event_type AS code, ts::DATE AS date FROM events)")
def trading_day_index(spark, d):
    return S.event_bars(spark, d).select("code", "date", (F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1).alias("day_index"))


@query("""WITH w AS (SELECT l_orderkey AS family, count(*) AS members FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND bool_and(l_partkey % 10 <> 0))
  SELECT l_orderkey AS family, l_partkey AS doc_no, l_linenumber AS line, members FROM lineitem JOIN w ON w.family = l_orderkey""")
def correction_families(spark, d):
    docs = S.table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"]).select(F.col("l_orderkey").alias("family"), F.col("l_partkey").alias("doc_no"), F.col("l_linenumber").alias("line"))
    return listing.family_members(docs, docs.filter("doc_no % 10 <> 0").select("doc_no"))


@query("SELECT o_orderkey AS id, o_custkey AS customer FROM orders")
def segment_merge(spark, d):
    o = S.table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return listing.merge_segments([(o.filter("id % 2 = 0"), 0, 1), (o.filter("id % 2 = 1"), 1, 2)])


@query("""SELECT DISTINCT o_custkey AS code, 'left' AS side FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT DISTINCT s_suppkey, 'right' FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders)""")
def axis_differences(spark, d):
    return listing.axis_difference(S.table(spark, d, "orders", ["o_custkey"]).withColumnRenamed("o_custkey", "code"), S.table(spark, d, "supplier", ["s_suppkey"]).withColumnRenamed("s_suppkey", "code"), "code")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'equal' END AS state FROM orders""")
def recomputation_check(spark, d):
    o = S.table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).withColumnRenamed("o_orderkey", "id")
    again = o.filter("id % 11 <> 0").withColumn("o_custkey", F.when(F.col("id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")))
    return listing.recomputed(o, again, "id")


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'unverified' WHEN doc_id % 5 = 1 THEN 'mismatch' ELSE 'verified' END AS state FROM documents""")
def file_integrity(spark, d):
    files = S.table(spark, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    sha = F.sha2(F.when(F.col("path") % 5 == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content")).cast("binary"), 256)
    manifest = files.select("path", F.octet_length("content").alias("size"), sha.alias("sha256"), F.when(F.col("path") % 5 == 0, "old").otherwise("new").alias("fingerprint"))
    return listing.integrity(files, manifest, "new")


@query(f"""WITH {_DISCLOSURES}, u AS (SELECT title, min(id) AS first, count(*) AS n FROM d GROUP BY title) SELECT title, first, n::BIGINT AS n FROM u""")
def unique_titles(spark, d):
    return facets.unique_titles(S.order_disclosures(spark, d), F.col("title"), "id")


@query("""SELECT s_suppkey AS id, CASE WHEN length(s_suppkey::VARCHAR) >= 6 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 6, '0') END AS code,
  'A' || CASE WHEN length(s_suppkey::VARCHAR) >= 6 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 6, '0') END AS stock FROM supplier""")
def code_keys(spark, d):
    c = F.col("s_suppkey").cast("string")
    return S.table(spark, d, "supplier", ["s_suppkey"]).select(F.col("s_suppkey").alias("id"), K.company_code(c).alias("code"), K.stock_column(c).alias("stock"))
