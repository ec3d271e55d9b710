"""Queries of lookups, exports, signatures, choices of sections, the viewer's filter, restartable stages and JSON sources, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import graph, lookups, modes
from .queries import query
from .queries_meetings import _issues
from .queries_records import _orders
from .session import shared_folder, spread, stored
from .sources import json_files, pages, stages
from .sources import tables as S

_DISCLOSED = """d AS (SELECT o_orderkey AS id, lpad(o_custkey::VARCHAR, 6, '0') AS company_id, c_name AS company_name, c_mktsegment AS market, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS disclosed_at, strftime(o_orderdate, '%Y-%m-%d') AS disclosed_date, o_orderpriority AS title, o_orderstatus AS title_display FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _disclosed(spark, d):
    o = _orders(spark, d)
    return o.select(F.col("id").alias("acpt_no"), F.lpad("cust", 6, "0").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("market"), F.col("stamp").alias("disclosed_at"), F.substring("stamp", 1, 10).alias("disclosed_date"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("title_display"))


@query(f"""WITH {_DISCLOSED} SELECT id::VARCHAR AS acpt_no, disclosed_at, title FROM d WHERE company_id = '000007' AND disclosed_date BETWEEN '1990-01-01' AND '2030-12-31' AND (title ILIKE '%u_%' OR title_display ILIKE '%u_%')""")
def company_disclosures(spark, d):
    return lookups.company_disclosures(_disclosed(spark, d), "7", "1990-01-01", "2030-12-31", "U_").select("acpt_no", "disclosed_at", "title")


@query("""WITH c AS (SELECT c_name AS company_name, c_mktsegment AS market, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment), k AS (SELECT * FROM c WHERE company_name ILIKE '%#00000%' AND market = 'BUILDING')
  SELECT 'company' AS kind, company_name AS name, n FROM k UNION ALL SELECT 'market', market, 0 FROM (SELECT DISTINCT market FROM c) UNION ALL SELECT 'market', '전체', 0""")
def company_index(spark, d):
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders", ["o_custkey"])
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("market"), F.coalesce("n", F.lit(0)).alias("disclosures"))
    got, markets = lookups.company_index(rows, "#00000", "BUILDING")
    return got.select(F.lit("company").alias("kind"), F.col("company_name").alias("name"), F.col("disclosures").alias("n")).unionByName(markets.select(F.lit("market").alias("kind"), F.col("market").alias("name"), F.lit(0).cast("long").alias("n")))


@query("""WITH r AS (SELECT 'S' || s_suppkey % 50 AS company_name, s_suppkey % 50 AS k, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE l_returnflag END AS market, l_linestatus || l_linenumber % 2 AS b, l_orderkey * 10 + l_linenumber AS pos, l_orderkey % 7 AS gone FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  x AS (SELECT company_name, k, market, b, min(pos) AS pos FROM r WHERE gone > 0 GROUP BY ALL), m AS (SELECT company_name, k, arg_min(market, (pos, market)) FILTER (WHERE market <> '') AS market, min(pos) AS position FROM x GROUP BY ALL), f AS (SELECT company_name, b, min(pos) AS pos FROM x GROUP BY ALL)
  SELECT m.company_name, 'A' || lpad(CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 6, '0') END, 6, '0') AS stock_code, coalesce(m.market, '') AS market, (SELECT string_agg(b, ', ' ORDER BY pos) FROM f WHERE f.company_name = m.company_name) AS flags, m.position FROM m""")
def unique_companies(spark, d):
    l, s = S.table(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]), S.table(spark, d, "supplier", ["s_suppkey"])  # noqa: E741
    k = F.col("s_suppkey") % 50
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = F.when(F.col("l_orderkey") % 7 > 0, F.concat(F.lit(" S"), k)).otherwise(" ")  # nothing for keys that are null or negative, as in the SQL
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(name.alias("company_name"), k.cast("string").alias("company_id"), F.when(F.col("l_orderkey") % 3 == 0, " ").otherwise(F.col("l_returnflag")).alias("market"), F.array(F.concat("l_linestatus", F.col("l_linenumber") % 2)).alias("badges"), at.alias("at"))
    # one row a value, so that rows which share a place are told apart the same way everywhere
    rows = rows.groupBy("company_name", "company_id", "market", "badges").agg(F.min("at").alias("at"))
    # rows without a place come last
    got = lookups.unique_companies(rows.withColumn("position", F.struct(F.col("at").isNull().alias("unplaced"), "at", "market", "badges")))
    return got.withColumns({"flags": F.nullif("flags", F.lit("")), "position": F.col("position.at")})


@query("""SELECT event_id AS disclosure_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_datetime, value FROM events WHERE event_type = 'click' AND user_id % 3 = 1""")
def stored_results(spark, d):
    e = S.table(spark, d, "events", ["event_id", "ts", "event_type", "user_id", "value"])
    rows = e.select(F.col("event_id").alias("disclosure_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_datetime"), F.col("event_type").alias("ticker"), (F.col("user_id") % 3).cast("string").alias("parameter_hash"), "value")
    return lookups.stored_results(rows, "click", "1").select("disclosure_id", "event_datetime", "value")


@query("""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey::VARCHAR AS acpt_no, CASE WHEN n IS NULL OR n % 4 = 0 THEN 'old' ELSE 'd' || n END AS disclosed_at, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN n IS NOT NULL THEN 'n' || n ELSE '' END AS doc_no,
  CASE WHEN n % 3 > 0 THEN 'M' || n END AS market, CASE WHEN n % 5 > 0 THEN n::INT END AS current_sequence, CASE WHEN n IS NOT NULL THEN 'C' END AS corp_name FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def records_with_metadata(spark, d):
    r = S.table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").cast("string").alias("acpt_no"), F.when(F.col("o_orderkey") % 2 == 0, "own").otherwise("").alias("doc_no"), F.lit("old").alias("disclosed_at"))
    n = F.col("n")
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))  # noqa: E741
    m = l.select(F.col("l_orderkey").cast("string").alias("acpt_no"), F.when(n % 3 > 0, F.concat(F.lit("M"), n)).alias("market"), F.lit("C").alias("company_name"), F.when(n % 4 > 0, F.concat(F.lit("d"), n)).otherwise(" ").alias("disclosed_at"), F.concat(F.lit("n"), n).alias("doc_no"), F.lit("f").alias("family_id"), F.when(n % 5 > 0, n).cast("int").alias("current_sequence"), F.lit(9).alias("family_member_count"))
    return lookups.with_metadata(r, m, "rights_issuance").select("acpt_no", "disclosed_at", "doc_no", "market", "current_sequence", "corp_name")


@query("""WITH x AS (SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity + l_linenumber)::DOUBLE AS total, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS flags FROM lineitem GROUP BY 1)
  SELECT id, (2 * n + 1)::INT AS numbers, total + id AS total, count(*) OVER (PARTITION BY n, flags, id % 2) AS twins FROM x""")
def numeric_signatures(spark, d):
    l = spread(S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]), "l_orderkey")  # noqa: E741
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))), lambda x: F.struct(x["l_linenumber"].alias("n"), F.struct(x["l_returnflag"].alias("flag"), F.concat(x["l_quantity"], F.lit(" won")).alias("q")).alias("of")))
    rows = l.groupBy("l_orderkey").agg(lines.alias("lines")).select(F.col("l_orderkey").alias("id"), F.to_json(F.struct(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") % 2 == 0).alias("even"), "lines")).alias("j"))
    got = lookups.numeric_signature(rows, "id", "j")
    total = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x)
    got = stored(got.select("id", F.sha2("shape", 256).alias("shape"), F.size("numbers").alias("numbers"), total.alias("total")), "signatures")
    twins = got.groupBy("shape").agg(F.count("*").alias("twins"))
    return got.join(twins, "shape").select("id", "numbers", "total", "twins")


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_returnflag) AS t FROM lineitem GROUP BY ALL), g AS (SELECT id, string_agg('toc_' || n || ' ' || t, ' ' ORDER BY n) AS sig, string_agg('<' || t || '>', chr(10) ORDER BY n) FILTER (WHERE n IN (1, 3)) AS odd, string_agg('<' || t || '>', chr(10) ORDER BY n) FILTER (WHERE n = 2) AS second, count(*) FILTER (WHERE n IN (1, 3)) AS n_odd, count(*) FILTER (WHERE n = 2) AS n_second FROM s GROUP BY 1),
  r AS (SELECT *, CASE WHEN sig = 'toc_1 A' THEN 1 WHEN starts_with(sig || ' ', 'toc_1 A toc_2 N ') THEN 2 WHEN starts_with(sig || ' ', 'toc_1 A ') THEN 3 WHEN starts_with(sig || ' ', 'toc_1 R ') THEN 4 END AS rule FROM g)
  SELECT id, CASE WHEN rule IS NULL THEN 'missing_selection' ELSE 'ok' END AS status, rule, CASE WHEN rule IN (1, 3) THEN n_odd WHEN rule IS NOT NULL THEN n_second END::INT AS chosen, CASE WHEN rule IN (1, 3) THEN coalesce(odd, '') WHEN rule IS NOT NULL THEN coalesce(second, '') END AS content FROM r""")
def chosen_sections(spark, d):
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])  # noqa: E741
    found = l.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index")).agg(F.min("l_returnflag").alias("title")).withColumns({"html": F.concat(F.lit("<"), F.col("title"), F.lit(">")), "error": F.lit(None).cast("string")})
    rules = spark.createDataFrame([(3, "toc_1 A*", ["toc_1", "toc_3"]), (2, "toc_1 A toc_2 N *", ["toc_2"]), (1, "toc_1 A", ["toc_1", "toc_3"]), (4, "toc_1 R*", ["toc_2"]), (5, "toc_1 A toc_2 N*", ["toc_9"])], "rule int, signature string, toc_ids array<string>")
    return pages.choose_sections(found, rules, "id")


_VIEW = """n AS (SELECT 'c' || c_custkey AS id, c_name AS label, c_mktsegment AS type, 'n' || c_nationkey % 4 AS grp FROM customer), e AS (SELECT o_orderkey::VARCHAR AS id, 'c' || o_custkey AS source, 'c' || (o_custkey * 7 % 150 + 1) AS target, o_orderpriority AS relation, o_orderstatus AS category, o_totalprice AS weight, o_orderkey % 2 = 0 AS directed FROM orders),
  g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e WHERE source <> target) GROUP BY 1)"""


def _view(spark, d):
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    nodes = c.select(name(F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("n"), F.col("c_nationkey") % 4).alias("group"), F.array("c_mktsegment").alias("tags"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("properties"))
    edges = o.select(F.col("o_orderkey").cast("string").alias("id"), name(F.col("o_custkey")).alias("source"), name(F.col("o_custkey") * 7 % 150 + 1).alias("target"), F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("category"), F.col("o_totalprice").alias("weight"), (F.col("o_orderkey") % 2 == 0).alias("directed"), F.create_map(F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("properties"))
    return nodes, edges


def _shown(nodes, edges):
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@query(f"""WITH {_VIEW}, v AS (SELECT n.id FROM n LEFT JOIN g ON node = n.id WHERE type IN ('BUILDING', 'MACHINERY') AND grp IN ('n0', 'n1', 'n2') AND coalesce(degree, 0) >= 3),
  w AS (SELECT e.id, source, target FROM e WHERE category = 'F' AND weight >= 1000 AND directed AND source IN (FROM v) AND target IN (FROM v))
  SELECT 'edge' AS kind, id FROM w UNION ALL SELECT 'node', id FROM v WHERE id IN (SELECT source FROM w UNION SELECT target FROM w)""")
def visible_graph_all(spark, d):
    f = graph.Filters(types=("BUILDING", "MACHINERY"), groups=("n0", "n1", "n2"), min_degree=3, categories=("F",), min_weight=1000, direction="directed", hide_isolated=True)
    return _shown(*graph.visible_subgraph(*_view(spark, d), f))


@query(f"""WITH {_VIEW}, v AS (SELECT n.id FROM n LEFT JOIN g ON node = n.id WHERE (type = 'BUILDING' OR coalesce(degree, 0) >= 12) AND (lower(label) LIKE '%customer#0000001%' OR grp = 'nation:1' OR EXISTS (FROM customer WHERE 'c' || c_custkey = n.id AND 'nation:' || c_nationkey LIKE '%customer#0000001%'))),
  w AS (SELECT e.id FROM e WHERE (relation = '1-URGENT' OR NOT directed) AND source IN (FROM v) AND target IN (FROM v))
  SELECT 'edge' AS kind, id FROM w UNION ALL SELECT 'node', id FROM v""")
def visible_graph_any(spark, d):
    f = graph.Filters(types=("BUILDING",), min_degree=12, relations=("1-URGENT",), direction="undirected", any_of=True)
    return _shown(*graph.visible_subgraph(*_view(spark, d), f, search=" Customer#0000001 "))


@query(f"""WITH {_DISCLOSED} SELECT company_id AS company_key, max(company_name) AS company_name, count(*)::BIGINT AS disclosure_count, min(disclosed_at) AS first_disclosed_at, max(disclosed_at) AS last_disclosed_at FROM d GROUP BY 1""")
def company_artifact(spark, d):
    """Written twice into the shared folder, the second time over a changed half, and read back as the index."""
    rows, target = _disclosed(spark, d).withColumn("company_key", F.col("company_id")), f"{shared_folder(spark)}/companies-{uuid.uuid4().hex}"
    stages.refresh_companies(rows.filter(F.pmod(F.col("acpt_no").cast("long"), F.lit(2)) == 0), target)
    stages.refresh_companies(rows, target)
    return stages.company_list(spark, target).select("company_key", "company_name", "disclosure_count", "first_disclosed_at", "last_disclosed_at")


@query(f"""WITH {_DISCLOSED} SELECT id::VARCHAR AS acpt_no, disclosed_date, market FROM d WHERE company_id = '000010' AND disclosed_date BETWEEN '1990-01-01' AND '2030-12-31'""")
def json_category_disclosures(spark, d):
    """Orders as one JSON file a priority in the shared folder, read back for one company."""
    rows, folder = _disclosed(spark, d), f"{shared_folder(spark)}/categories-{uuid.uuid4().hex}"
    item = F.struct("company_id", "company_name", "market", "disclosed_at", F.lit(None).cast("string").alias("disclosed_date"), "title", "acpt_no")
    by = rows.groupBy("title", F.pmod(F.xxhash64("acpt_no"), F.lit(16)).alias("piece")).agg(F.to_json(F.struct(F.collect_list(item).alias("disclosures"))).alias("value"))
    by.select("value").repartition(16).write.option("maxRecordsPerFile", 1).text(folder)
    return json_files.category_disclosures(spark, [folder], "10", "1990-01-01", "2030-12-31").select("acpt_no", "disclosed_date", "market")


_READ = """r AS (SELECT l_suppkey % 40 AS k, l_partkey % 5000 AS no, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS badge, l_orderkey % 3 = 0 AS gap FROM lineitem),
  u AS (SELECT k, no, pos, min(badge) AS badge, bool_and(gap) AS gap FROM r GROUP BY ALL)"""


def _read_rows(spark, d):
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"])  # noqa: E741
    rows = l.groupBy((F.col("l_suppkey") % 40).alias("k"), (F.col("l_partkey") % 5000).alias("no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).agg(F.min("l_returnflag").alias("badge"), F.bool_and(F.col("l_orderkey") % 3 == 0).alias("gap"))
    return rows.select(F.concat(F.lit("c"), "k").alias("company_key"), F.when(~F.col("gap"), F.concat(F.lit("n"), F.col("no") % 7)).alias("company_name"), F.lit("").alias("company_id"), F.when(~F.col("gap"), F.col("badge")).alias("market"), F.array("badge").alias("badges"), F.col("no").cast("string").alias("acpt_no"), F.struct("pos", "k", "no").alias("position"))


@query(f"""WITH {_READ}, f AS (SELECT no, arg_min(k, (pos, k, no)) AS k FROM u GROUP BY 1), d AS (SELECT k, count(*) AS n FROM f GROUP BY 1),
  b AS (SELECT k, badge, min((pos, k, no)) AS o FROM u GROUP BY ALL)
  SELECT 'c' || d.k AS company_key, (SELECT 'n' || arg_min(no, (pos, k, no)) % 7 FROM u WHERE u.k = d.k AND NOT gap) AS company_name, (SELECT arg_min(badge, (pos, k, no)) FROM u WHERE u.k = d.k AND NOT gap) AS market, n AS disclosures, (SELECT string_agg(badge, ', ' ORDER BY o) FROM b WHERE b.k = d.k) AS badges FROM d""")
def merged_companies(spark, d):
    return lookups.merge_companies(_read_rows(spark, d))[0].select("company_key", "company_name", "market", "disclosures", "badges")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey % 900 AS k, 'listing' AS src, 0 AS f FROM orders UNION ALL SELECT o_orderkey, o_custkey % 900, 'category', 1 FROM orders WHERE o_orderkey % 3 = 0)
  SELECT k, arg_max(id, (f, id)) AS id, arg_max(src, (f, id)) AS src FROM a GROUP BY k""")
def union_keep_last(spark, d):
    o = S.table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 900).alias("k"))
    return lookups.union_keep_last([o.withColumn("src", F.lit("listing")), o.filter("id % 3 = 0").withColumn("src", F.lit("category"))], "k", ["id"])


@query("""WITH e AS (SELECT event_type AS code, user_id % 11 AS g, ts::DATE AS day, (ts + INTERVAL 8 HOUR)::DATE AS traded FROM events), c AS (SELECT code, g, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, 'g' || g) AS r FROM c)
  SELECT e.code, count(*) AS disclosures, count(*) FILTER (WHERE traded > day) AS after_close, strftime(min(traded), '%Y-%m-%d') AS first, strftime(max(traded), '%Y-%m-%d') AS last, (SELECT string_agg('g' || g || ':' || n, ', ' ORDER BY r) FROM r WHERE r <= 5 AND r.code = e.code) AS top FROM e GROUP BY e.code""")
def panel_top_groups(spark, d):
    e = S.table(spark, d, "events", ["ts", "event_type", "user_id"])
    rows = e.select(F.col("event_type").alias("code"), F.concat(F.lit("g"), F.col("user_id") % 11).alias("group"), F.to_date("ts").alias("event_date"), F.to_date(F.expr("ts + INTERVAL 8 HOURS")).alias("trade_day"))
    got = lookups.panel_summary(rows, "code", "group")
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_returnflag) AS t FROM lineitem GROUP BY ALL), g AS (SELECT id, count(*) AS c, string_agg('toc_' || n || ' ' || t, ' ' ORDER BY n) AS signature FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY id) AS r FROM g)
  SELECT signature, count(*) AS count, min(c) AS section_count, string_agg(id, ',' ORDER BY id) FILTER (WHERE r <= 3) AS samples FROM r GROUP BY signature""")
def section_patterns(spark, d):
    l = S.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])  # noqa: E741
    found = l.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index")).agg(F.min("l_returnflag").alias("title")).withColumns({"html": F.lit(""), "error": F.lit(None).cast("string")})
    return pages.section_patterns(found, "id").withColumn("samples", F.array_join("samples", ","))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS total, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS page, CASE WHEN o_orderkey % 3 > 0 THEN 12345 END AS pages FROM orders""")
def paginations(spark, d):
    o = S.table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    k = F.col("o_orderkey")
    html = F.concat(F.lit("<p>전체 <em>"), F.format_number("o_custkey", 0), F.lit("</em> 건 : <strong>"), k % 100, F.when(k % 3 > 0, "</strong>/12,345</p>").otherwise("</strong></p>"))
    return o.select(k.alias("id"), pages.pagination(html).alias("p")).select("id", F.col("p.total_items").alias("total"), F.col("p.current_page").alias("page"), F.col("p.total_pages").alias("pages"))


@query("""SELECT o_orderkey::VARCHAR AS acpt_no, CASE WHEN o_orderkey % 3 = 0 THEN 'paid' WHEN o_orderkey % 3 = 1 THEN 'bonus' ELSE 'mixed' END AS kind, CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS tables, CASE o_orderkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 13 END + CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS rows FROM orders""")
def parsed_by_mode(spark, d):
    """Pages of rights issues parsed by their mode: the kind found, and the tables and rows of the base record."""
    docs = _issues(spark, d).select(F.concat(F.lit("folder/"), "id", F.lit(".html")).alias("path"), "title", "html")
    got = modes.parse(docs, "rights_issuance")
    n = F.aggregate(F.transform("tables", lambda t: F.size(t["rows"])), F.lit(0), lambda a, x: a + x)
    return got.select("acpt_no", F.col("fields.kind").alias("kind"), F.size("tables").alias("tables"), n.alias("rows"))


@query("""WITH l AS (SELECT l_orderkey % 20000 AS k FROM lineitem), c AS (SELECT count(*) AS n, count(DISTINCT k) AS d FROM l) SELECT 'a number comes twice' AS rule FROM c WHERE d < n UNION ALL SELECT 'unique is not the number of rows' FROM c WHERE n <> d UNION ALL SELECT 'complete but not all inspected' FROM c WHERE n < n + 5""")
def broken_identities(spark, d):
    """What the counts of a result with repeated numbers break, where the source has as many rows and five are not inspected."""
    l = S.table(spark, d, "lineitem", ["l_orderkey"]).select((F.col("l_orderkey") % 20000).cast("string").alias("acpt_no"))  # noqa: E741
    counts = l.agg(F.count("*").alias("n"), F.count_distinct("acpt_no").alias("d")).first()
    found = modes.count_identities(l, counts["n"] + 5, 0, counts["n"], counts["n"], counts["d"], True)
    return found
