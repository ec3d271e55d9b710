"""Queries over the star-schema tables, each with an independently worded SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys as K
from .functions import text as T
from .operators import asof, barrier, checks, facets, graph, intervals, merge, ohlc, versions
from .plans import predicates as P
from .sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# predicates ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' AND (lower(p_type) = 'economy' OR lower(p_brand) LIKE 'brand#1%')")
def filter_blocks_and_or(spark, d):
    blocks = [P.block("title", "contains", "A"), P.block("market", "equals", "economy", "AND", opens=1), P.block("company_name", "starts_with", "brand#1", "OR", closes=1)]
    return S.table(spark, d, "part").filter(P.compile_blocks(blocks, S.part_columns())).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%ring%') <> (NOT (p_brand >= 'Brand#3'))")
def filter_blocks_xor_not(spark, d):
    blocks = [P.block("title", "contains", "RING"), P.block("company_name", "on_or_after", "Brand#3", "XOR", negate=True)]
    return S.table(spark, d, "part").filter(P.compile_blocks(blocks, S.part_columns())).select("p_partkey")


_OPERATOR_CASES = {
    "contains": ("title", "URG", "lower(title) LIKE '%urg%'"),
    "not_contains": ("title", "urg", "lower(title) NOT LIKE '%urg%'"),
    "exact_match": ("submitter", "O", "submitter = 'O'"),
    "equals": ("submitter", "o", "lower(submitter) = 'o'"),
    "not_equals": ("submitter", "o", "lower(submitter) <> 'o'"),
    "starts_with": ("title", "1-", "starts_with(lower(title), '1-')"),
    "ends_with": ("title", "M", "lower(title) LIKE '%m'"),
    "in": ("market", "building, MACHINERY", "lower(market) IN ('building', 'machinery')"),
    "before": ("disclosed_date", "1996-01-01", "disclosed_date < '1996-01-01'"),
    "after": ("disclosed_date", "1996-01-01", "disclosed_date > '1996-01-01'"),
    "on_or_before": ("disclosed_date", "1996-01-01", "disclosed_date <= '1996-01-01'"),
    "on_or_after": ("disclosed_date", "1996-01-01", "disclosed_date >= '1996-01-01'"),
    "between": ("disclosed_date", "1996-01-01..1997-01-01", "disclosed_date BETWEEN '1996-01-01' AND '1997-01-01'"),
    "exists": ("title", "", "title <> ''"),
    "empty": ("title", "", "title = ''"),
}
_DISCLOSURES = """d AS (
  SELECT o_orderkey AS id, o_orderkey::VARCHAR AS acpt_no, c_custkey::VARCHAR AS company_id, c_name AS company_name, c_mktsegment AS market,
         o_orderpriority AS title, o_orderstatus AS submitter, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS disclosed_at,
         strftime(o_orderdate, '%Y-%m-%d') AS disclosed_date, year(o_orderdate)::INT AS year
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_DISCLOSURES} " + " UNION ALL ".join(f"SELECT '{op}' AS operator, count(*)::BIGINT AS matched FROM d WHERE {sql}" for op, (_, _, sql) in _OPERATOR_CASES.items()))
def filter_all_operators(spark, d):
    rows = S.order_disclosures(spark, d)
    columns = {f: F.col(f) for f in P.FIELDS}
    counts = rows.agg(*[F.count_if(P.compile_blocks([P.block(f, op, v)], columns)).alias(op) for op, (f, v, _) in _OPERATOR_CASES.items()])
    return counts.unpivot([], list(_OPERATOR_CASES), "operator", "matched")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'hot gear')")
def title_expression(spark, d):
    return S.table(spark, d, "part").filter(P.compile_title("Red and not bolt OR 'hot Gear'", F.col("p_name"))).select("p_partkey", "p_name")


@query("""SELECT CASE WHEN contains(t, 'URGENT') OR contains(t, 'HIGH') THEN 'hot' WHEN contains(t, '-') AND NOT (contains(t, 'LOW') OR contains(t, 'MED')) THEN 'mid' ELSE '기타' END AS "group", count(*)::BIGINT AS n
  FROM (SELECT trim(o_orderpriority) AS t FROM orders) GROUP BY 1""")
def keyword_groups(spark, d):
    groups = P.parse_groups([{"group": "hot", "keywords": "URGENT, HIGH"}, {"group": "mid", "keywords": "- and not (LOW || MED)"}])
    return facets.group_counts(S.order_disclosures(spark, d).select("title"), P.classify(F.col("title"), groups))


@query(r"""WITH d AS (SELECT doc_id, text, text LIKE '%(%' OR text LIKE '%)%' AS par FROM documents), c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE par),
  s AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS s FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)), e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s),
  o AS (SELECT doc_id, max(i) FILTER (WHERE ch = '(' AND depth = 1) AS opened, arg_max(depth, i) > 0 AS open FROM e GROUP BY 1), p AS (SELECT e.doc_id, max(i) AS shut FROM e JOIN o ON o.doc_id = e.doc_id WHERE open AND ch = ')' AND i > opened GROUP BY 1),
  q AS (SELECT p.doc_id, shut, coalesce(min(i), 1000000000) AS again FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND ch = '(' AND i > shut GROUP BY ALL),
  k AS (SELECT e.doc_id, string_agg(ch, '' ORDER BY i) FILTER (WHERE ch NOT IN ('(', ')') AND (depth = 0 OR i > shut AND i < again)) AS kept FROM e LEFT JOIN q ON q.doc_id = e.doc_id GROUP BY 1)
  SELECT d.doc_id, trim(regexp_replace(CASE WHEN par THEN coalesce(kept, '') ELSE text END, '\s+', ' ', 'g')) AS cleaned FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def clean_search_titles(spark, d):
    return S.table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", T.collapse_spaces(T.clean_search(F.col("text"))).alias("cleaned"))


@query(f"""WITH {_DISCLOSURES}, twice AS (SELECT * FROM d UNION ALL SELECT * REPLACE (id + 100000000 AS id) FROM d WHERE id % 3 = 0),
  m AS (SELECT *, row_number() OVER (PARTITION BY acpt_no ORDER BY year, id) AS r, count(*) OVER (PARTITION BY acpt_no) AS copies FROM twice WHERE lower(title) LIKE '%urgent%' AND market = 'BUILDING')
  SELECT id, acpt_no, copies::BIGINT AS copies FROM m WHERE r = 1""")
def filter_dedup_sorted(spark, d):
    rows = S.order_disclosures(spark, d)
    twice = rows.unionByName(rows.filter("id % 3 = 0").withColumn("id", F.col("id") + 100000000))
    where = P.compile_blocks([P.block("title", "contains", "urgent"), P.block("market", "exact_match", "BUILDING", "AND")], {f: F.col(f) for f in P.FIELDS})
    out = merge.first_row(twice.filter(where), "acpt_no", ["year", "id"])
    return out.select("id", "acpt_no", F.col("n_rows").alias("copies"))


# facets -------------------------------------------------------------------------------------------------


@query(f"WITH {_DISCLOSURES} SELECT title, sum(n)::BIGINT AS disclosures FROM (SELECT year, title, count(DISTINCT acpt_no) AS n FROM d GROUP BY ALL) GROUP BY title")
def title_facet(spark, d):
    return facets.title_facet(S.order_disclosures(spark, d))


@query(f"""WITH {_DISCLOSURES} SELECT company_id, company_name, market, count(*)::BIGINT AS n, min(disclosed_date) AS first, max(disclosed_date) AS last FROM d
  WHERE company_name LIKE '%00%' GROUP BY ALL ORDER BY n DESC, company_name, company_id LIMIT 30""")
def company_search(spark, d):
    return facets.company_search(S.order_disclosures(spark, d), "00", limit=30)


@query(f"""WITH {_DISCLOSURES}, t AS (SELECT company_id, title, min((year, id)) AS o FROM d GROUP BY ALL)
  SELECT d.company_id, any_value(company_name) AS company_name, any_value(market) AS market, count(*)::BIGINT AS n, min(disclosed_date) AS first, max(disclosed_date) AS last,
         (SELECT string_agg(title, ', ' ORDER BY o) FROM t WHERE t.company_id = d.company_id) AS titles FROM d GROUP BY d.company_id""")
def company_classification(spark, d):
    return facets.company_classification(S.order_disclosures(spark, d))


@query("""SELECT 'first' AS segment, count(*)::BIGINT AS inspected, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS matched, max(event_id) AS cursor FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)
  UNION ALL SELECT 'rest', count(*)::BIGINT, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT, max(event_id) FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)""")
def offset_resume(spark, d):
    e = S.table(spark, d, "events", ["event_id", "event_type"])
    half = e.agg(F.max("event_id")).first()[0] // 2
    hit = F.col("event_type") == "purchase"
    first = facets.resume(e.filter(F.col("event_id") <= half), "event_id", -1, hit).withColumn("segment", F.lit("first"))
    return first.unionByName(facets.resume(e, "event_id", half, hit).withColumn("segment", F.lit("rest")))


@query(f"WITH {_DISCLOSURES} SELECT year, count(*)::BIGINT AS expected, count(*)::BIGINT AS actual, true AS ok FROM d GROUP BY year")
def manifest_reconciliation(spark, d):
    rows = S.order_disclosures(spark, d)
    manifest = S.table(spark, d, "orders", ["o_orderdate"]).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("expected"))
    return facets.reconcile(rows, manifest)


@query("""SELECT p_type, count(*)::BIGINT AS n, (SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT p_partkey AS k FROM part q WHERE q.p_type = p.p_type ORDER BY 1 LIMIT 3)) AS samples FROM part p GROUP BY p_type""")
def facet_samples(spark, d):
    return facets.facet_with_samples(S.table(spark, d, "part", ["p_type", "p_partkey"]), "p_type", "p_partkey")


# candles ------------------------------------------------------------------------------------------------

_BARS = """b AS (
  SELECT event_type AS code, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::BIGINT AS volume, sum(value) AS amount FROM events GROUP BY ALL)"""


def _bars(spark, d):
    return S.event_bars(spark, d).withColumn("vwap", T.vwap(F.col("amount"), F.col("volume")))


@query(f"""WITH {_BARS} SELECT code, strftime(date, '%Y-%m-%d') AS trade_day, strftime(date, '%y.%m.%d') AS trade_label, open, high, low, close, volume,
  CASE WHEN close >= open THEN '#16a34a' ELSE '#dc2626' END AS candle_color, least(open, close) AS body_bottom, greatest(open, close) AS body_top FROM b""")
def ohlc_daily(spark, d):
    return ohlc.display(S.event_bars(spark, d)).select("code", "trade_day", "trade_label", "open", "high", "low", "close", "volume", "candle_color", "body_bottom", "body_top")


def _period_sql(label: str) -> str:
    return f"""WITH {_BARS} SELECT code, {label} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume)::BIGINT AS volume,
  round(avg(round_even(amount / volume, 0)), 6) AS vwap FROM b GROUP BY code, {label}"""


@query(_period_sql("(date + ((5 - isodow(date) + 7) % 7)::INT)::DATE"))
def ohlc_weekly(spark, d):
    return ohlc.resample(_bars(spark, d), "week").withColumn("vwap", F.round("vwap", 6))


@query(_period_sql("last_day(date)"))
def ohlc_monthly(spark, d):
    return ohlc.resample(_bars(spark, d), "month").withColumn("vwap", F.round("vwap", 6))


def _n_rows(n: int):
    def run(spark, d):
        return ohlc.n_row_bars(_bars(spark, d), n).select("code", "bar", "date", "open", "high", "low", "close", "volume")

    sql = f"""WITH {_BARS}, r AS (SELECT *, (row_number() OVER (PARTITION BY code ORDER BY date) - 1) // {n} AS bar FROM b)
  SELECT code, bar::BIGINT AS bar, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume)::BIGINT AS volume FROM r GROUP BY code, bar"""
    query(sql, f"ohlc_nrow_{n}")(run)


for _n in (3, 5, 7, 20):
    _n_rows(_n)


@query(f"WITH {_BARS} SELECT code, date, round_even(amount / volume, 0) AS vwap FROM b")
def vwap_round(spark, d):
    return _bars(spark, d).select("code", "date", "vwap")


@query(f"WITH {_BARS} SELECT code, count(*)::BIGINT AS bars, CASE WHEN count(*) <= 180 THEN 'day' WHEN count(*) <= 520 THEN 'week' ELSE 'month' END AS frequency FROM b GROUP BY code")
def auto_frequency(spark, d):
    return ohlc.auto_frequency(S.event_bars(spark, d))


@query(f"WITH {_BARS} SELECT date, code, close AS value FROM b")
def wide_unpivot_roundtrip(spark, d):
    bars = S.event_bars(spark, d)
    codes = sorted(r[0] for r in bars.select("code").distinct().collect())  # the columns of a wide table
    wide = bars.groupBy("date").pivot("code", codes).agg(F.first("close"))
    return S.wide_to_long(wide)


# as-of --------------------------------------------------------------------------------------------------

_ANCHOR = "CASE WHEN hour(ts) * 60 + minute(ts) >= 930 THEN ts::DATE + 1 ELSE ts::DATE END::DATE"


def _events(spark, d):
    e = S.table(spark, d, "events", ["event_id", "ts", "event_type"])
    return e.select("event_id", F.col("event_type").alias("code"), asof.anchor_date(F.col("ts")).alias("anchor"), F.to_date("ts").alias("event_date"))


@query(f"SELECT event_id, {_ANCHOR} AS anchor_date FROM events")
def after_close_anchor(spark, d):
    return _events(spark, d).select("event_id", F.col("anchor").alias("anchor_date"))


_ASOF = f"""WITH {_BARS}, e AS (SELECT event_id, event_type AS code, {_ANCHOR} AS anchor FROM events)
  SELECT e.event_id, e.anchor, b.date AS bar_date, b.open, b.high, b.low, b.close FROM e ASOF JOIN b ON e.code = b.code AND e.anchor <= b.date"""


@query(f"SELECT event_id, bar_date, close FROM ({_ASOF})")
def asof_forward(spark, d):
    return asof.forward_asof(_events(spark, d), S.event_bars(spark, d)).select("event_id", F.col("date").alias("bar_date"), "close")


@query(f"SELECT event_id, bar_date, close FROM ({_ASOF})")
def asof_forward_split(spark, d):
    return asof.forward_asof_small(_events(spark, d), S.event_bars(spark, d)).select("event_id", F.col("date").alias("bar_date"), "close")


@query(f"""WITH b2 AS (SELECT code, min(low) AS f, greatest((max(high) - min(low)) * 0.035, 1.0) AS o FROM (WITH {_BARS} SELECT * FROM b) GROUP BY code), p AS ({_ASOF}),
  x AS (SELECT p.*, b2.f, b2.o FROM p JOIN events USING (event_id) JOIN b2 ON b2.code = event_type)
  SELECT event_id, unnest(['x_axis_below', 'x_axis_above', 'candle_center', 'candle_above', 'candle_below']) AS placement,
         unnest([round(f - o * 1.15, 6), round(f + o * 0.9, 6), round((open + close) / 2, 6), round(high + o, 6), round(low - o, 6)]) AS marker_price FROM x""")
def marker_positions(spark, d):
    bars = S.event_bars(spark, d)
    points = asof.forward_asof(_events(spark, d), bars)
    scaled = ohlc.with_markers(points, bars, "candle_above")
    scale = bars.groupBy("code").agg(F.min("low").alias("f"), F.greatest((F.max("high") - F.min("low")) * 0.035, F.lit(1.0)).alias("o"))
    each = F.array(*[F.struct(F.lit(p).alias("placement"), F.round(ohlc.marker_price(p, F.col("f"), F.col("o")), 6).alias("marker_price")) for p in ohlc.PLACEMENTS])
    return scaled.join(scale, "code").select("event_id", F.inline(each))


# labels -------------------------------------------------------------------------------------------------


def _barrier_sql(basis: str, upper: float, lower: float, days: int) -> str:
    hi, lo = ("high", "low") if basis == "intraday" else ("close", "close")
    up, low = f"e.base * (1 + {upper} / 100.0)", f"e.base * (1 - {lower} / 100.0)"
    return f"""WITH {_BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i, count(*) OVER (PARTITION BY code) AS total FROM b),
  e AS (SELECT x.event_id, x.code, r.i, r.total, r.close AS base FROM (SELECT event_id, event_type AS code, ts::DATE AS day FROM events) x ASOF LEFT JOIN r ON x.code = r.code AND x.day <= r.date),
  h AS (SELECT e.event_id, min(r.i) AS hit FROM e JOIN r ON e.code = r.code AND r.i BETWEEN e.i + 1 AND e.i + {days} AND (r.{hi} >= {up} OR r.{lo} <= {low}) GROUP BY e.event_id),
  j AS (SELECT e.*, h.hit, t.date AS td, t.close AS tc, t.{hi} >= {up} AS on_up, t.{lo} <= {low} AS on_low, v.date AS vd, v.close AS vc, {up} AS up, {low} AS low
        FROM e LEFT JOIN h USING (event_id) LEFT JOIN r t ON t.code = e.code AND t.i = h.hit LEFT JOIN r v ON v.code = e.code AND v.i = e.i + {days}),
  s AS (SELECT *, i IS NOT NULL AND i + {days} <= total AND NOT ({str(basis == 'intraday').lower()} AND coalesce(on_up AND on_low, false)) AS done FROM j)
  SELECT event_id, CASE WHEN done THEN 'completed' ELSE 'failed' END AS status, CASE WHEN done THEN CASE WHEN hit IS NULL THEN 'vertical' WHEN on_up THEN 'upper' ELSE 'lower' END END AS barrier,
         CASE WHEN done THEN coalesce(td, vd) END AS touched_date, CASE WHEN done THEN CASE WHEN hit IS NULL THEN 0 WHEN on_up THEN 1 ELSE -1 END END::INT AS label,
         round(CASE WHEN done THEN ((CASE WHEN hit IS NULL THEN vc WHEN {str(basis == 'close').lower()} THEN tc WHEN on_up THEN up ELSE low END) - base) / base * 100 END, 6) AS return_pct FROM s"""


def _label(spark, d, p: barrier.Params) -> DataFrame:
    return barrier.triple_barrier(_events(spark, d).select("event_id", "code", "event_date"), S.event_bars(spark, d), p)




@query(_barrier_sql("intraday", 400, 80, 5))
def triple_barrier_intraday(spark, d):
    return _label(spark, d, barrier.Params("intraday", 400, 80, 5)).select("event_id", "status", "barrier", "touched_date", "label", F.round("return_pct", 6).alias("return_pct"))


@query(_barrier_sql("close", 150, 60, 7))
def triple_barrier_close(spark, d):
    return _label(spark, d, barrier.Params("close", 150, 60, 7)).select("event_id", "status", "barrier", "touched_date", "label", F.round("return_pct", 6).alias("return_pct"))


@query(f"SELECT status, barrier, count(*)::BIGINT AS n FROM ({_barrier_sql('close', 150, 60, 7)}) GROUP BY ALL")
def triple_barrier_summary(spark, d):
    return _label(spark, d, barrier.Params("close", 150, 60, 7)).groupBy("status", "barrier").agg(F.count("*").alias("n"))


@query(f"""WITH {_BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i, count(*) OVER (PARTITION BY code) AS total FROM b),
  e AS (SELECT x.event_id, x.code, r.i, r.total, r.close AS base FROM (SELECT event_id, event_type AS code, ts::DATE AS day FROM events) x ASOF LEFT JOIN r ON x.code = r.code AND x.day <= r.date),
  h AS (SELECT e.event_id, min(r.i) AS hit FROM e JOIN r ON e.code = r.code AND r.i BETWEEN e.i + 1 AND e.i + 6 AND (r.high >= e.base * 2 OR r.low <= e.base * (1 - 0.9)) GROUP BY e.event_id),
  j AS (SELECT e.*, h.hit, t.high AS th, x.close AS xc FROM e LEFT JOIN h USING (event_id) LEFT JOIN r t ON t.code = e.code AND t.i = h.hit LEFT JOIN r x ON x.code = e.code AND x.i = coalesce(h.hit, least(e.i + 6, e.total)))
  SELECT outcome, count(*)::BIGINT AS n, round(avg(ret), 6) AS avg_return FROM (
    SELECT CASE WHEN i IS NULL OR NOT base > 0 THEN 'no price' WHEN hit IS NULL THEN 'timeout' WHEN th >= base * 2 THEN 'upper' ELSE 'lower' END AS outcome, CASE WHEN base > 0 THEN (xc / base - 1) * 100 END AS ret FROM j) GROUP BY outcome""")
def backtest_client(spark, d):
    out = barrier.client_backtest(_events(spark, d).select("event_id", "code", "event_date"), S.event_bars(spark, d), 100, 90, 6)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("return_pct"), 6).alias("avg_return"))


@query("SELECT count(*) FILTER (WHERE event_id % 3 <> 0)::BIGINT AS created, count(*) FILTER (WHERE event_id % 3 = 0)::BIGINT AS reused FROM events")
def barrier_store_reuse(spark, d):
    new = S.table(spark, d, "events", ["event_id", "event_type"])
    return barrier.store(new, new.filter("event_id % 3 = 0"), ["event_id"])[1]


@query("""SELECT u.code, count(*)::BIGINT AS disclosures, count(*) FILTER (WHERE hour(ts) * 60 + minute(ts) >= 930)::BIGINT AS after_close, min(ts::DATE) AS first, max(ts::DATE) AS last
  FROM (SELECT *, event_type AS code FROM events) u GROUP BY u.code""")
def company_panel_summary(spark, d):
    e = _events(spark, d)
    return e.groupBy("code").agg(F.count("*").alias("disclosures"), F.count_if(F.col("anchor") > F.col("event_date")).alias("after_close"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))


# intervals ----------------------------------------------------------------------------------------------

_RUNS = """l AS (SELECT o_custkey AS k, o_orderdate::DATE AS dt, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY ALL),
  n AS (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY k ORDER BY dt) AS fresh FROM l), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY k ORDER BY dt) AS run FROM n),
  i AS (SELECT k AS custkey, v AS status, min(dt) AS start_date, max(dt) AS last, run FROM g GROUP BY k, v, run),
  x AS (SELECT custkey, status, start_date, coalesce(lead(start_date) OVER (PARTITION BY custkey ORDER BY run) - 1, last)::DATE AS end_date FROM i)"""


def _islands(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey"]).select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("dt"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return intervals.islands(o, "custkey", "dt", "status", "o_orderkey")


@query(f"WITH {_RUNS} SELECT * FROM x")
def market_history_intervals(spark, d):
    return _islands(spark, d)


@query(f"WITH {_RUNS} SELECT custkey, DATE '1997-06-30' AS probe, status FROM x WHERE DATE '1997-06-30' BETWEEN start_date AND end_date")
def market_at_date(spark, d):
    runs = _islands(spark, d)
    probes = S.table(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("custkey"), F.lit("1997-06-30").cast("date").alias("probe"))
    return intervals.value_at(runs, probes, "custkey", "probe", "status")


@query("""WITH r AS (SELECT o_custkey AS custkey, o_orderdate::DATE AS s, (o_orderdate::DATE + 200)::DATE AS e FROM orders),
  g AS (SELECT *, s - max(e) OVER (PARTITION BY custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1 AS gap FROM r)
  SELECT custkey, count(*)::BIGINT AS ranges, NOT bool_or(coalesce(gap, false)) AS connected FROM g GROUP BY custkey""")
def date_ranges_connected(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderdate"]).select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("start_date"))
    return intervals.connected(o.withColumn("end_date", F.date_add("start_date", 200)), "custkey")


@query("""WITH a AS (SELECT o_orderkey, o_custkey AS custkey, o_orderdate::DATE AS s FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT o_custkey AS custkey, o_orderdate::DATE AS e FROM orders WHERE o_orderstatus = 'F')
  SELECT custkey, s AS start_date, (SELECT min(e) FROM t WHERE t.custkey = a.custkey AND t.e > a.s) AS end_date, (SELECT min(e) FROM t WHERE t.custkey = a.custkey AND t.e > a.s) IS NULL AS is_active FROM a""")
def graph_termination_close(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_orderstatus"]).select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("x"), "o_orderstatus")
    starts, ends = o.filter("o_orderstatus = 'O'").select("custkey", F.col("x").alias("start_date")), o.filter("o_orderstatus = 'F'").select("custkey", F.col("x").alias("end_date"))
    return intervals.close_open(starts, ends, ["custkey"])


# versions and merges ------------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn = m")
def family_latest_only(spark, d):
    c = S.table(spark, d, "conversations", ["conv_id", "turn"])
    w = Window.partitionBy("conv_id")
    rows = c.withColumns({"current_sequence": F.row_number().over(w.orderBy("turn")) - 1, "family_member_count": F.count("*").over(w)})
    return versions.latest_only(rows).select("conv_id", "turn")


_VERSIONS = """v AS (SELECT o_custkey AS family, row_number() OVER w AS version, o_orderstatus, o_orderpriority, o_totalprice::VARCHAR AS p, strftime(o_orderdate, '%Y-%m-%d') AS dt,
         lag(o_orderstatus) OVER w AS b1, lag(o_orderpriority) OVER w AS b2, lag(strftime(o_orderdate, '%Y-%m-%d')) OVER w AS b3, o_totalprice AS n4, lag(o_totalprice) OVER w AS b4 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  c AS (SELECT family, version, 'status' AS field, b1 AS before, o_orderstatus AS after FROM v WHERE version > 1 AND b1 <> o_orderstatus
  UNION ALL SELECT family, version, 'priority', b2, o_orderpriority FROM v WHERE version > 1 AND b2 <> o_orderpriority
  UNION ALL SELECT family, version, 'date', b3, dt FROM v WHERE version > 1 AND b3 <> dt)"""


def _changes(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    rows = o.select(F.col("o_custkey").alias("family"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return versions.changes(rows, "family", ["o_orderdate", "o_orderkey"], ["status", "priority", "date"])


@query(f"WITH {_VERSIONS} SELECT family, version::INT AS version, field, before, after FROM c")
def change_log_fields(spark, d):
    return _changes(spark, d)


@query(f"""WITH {_VERSIONS} SELECT family, version::INT AS version, count(*)::BIGINT AS changed_fields, count(*) FILTER (WHERE field = 'status' OR field = 'date' AND abs(TRY_CAST(before AS DATE) - TRY_CAST(after AS DATE)) > 30)::BIGINT AS major_fields,
  CASE WHEN count(*) FILTER (WHERE field = 'status' OR field = 'date' AND abs(TRY_CAST(before AS DATE) - TRY_CAST(after AS DATE)) > 30) > 0 THEN 'major' ELSE 'minor' END AS severity FROM c GROUP BY ALL""")
def change_log_severity(spark, d):
    return versions.change_log(_changes(spark, d), "family", {"status": True, "date": True}, {"date": 30}, {})


_CELLS = """t AS (SELECT 0 AS source, l_partkey::VARCHAR AS code, l_shipdate::DATE AS date, max(l_quantity) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL
  UNION ALL SELECT 1, l_partkey::VARCHAR, l_shipdate::DATE, max(CASE WHEN l_linenumber <> 3 THEN l_quantity END) FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)"""


def _cells(spark, d):
    rows = S.table(spark, d, "lineitem", ["l_partkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linenumber"])
    group = lambda x, v: x.groupBy(F.col("l_partkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("date")).agg(F.max(v).alias("value"))
    return merge.tag([group(rows.filter("l_returnflag <> 'R'"), F.col("l_quantity")), group(rows.filter("l_returnflag <> 'A'"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))])


@query(f"WITH {_CELLS} SELECT code, date, count(DISTINCT value)::BIGINT AS n_values FROM t GROUP BY code, date HAVING count(DISTINCT value) > 1")
def merge_conflicts(spark, d):
    return merge.conflicts(_cells(spark, d))


@query(f"WITH {_CELLS} SELECT code, date, coalesce(max(value) FILTER (WHERE source = 1), max(value) FILTER (WHERE source = 0)) AS value FROM t GROUP BY code, date")
def merge_last_non_null(spark, d):
    return merge.last_non_null(_cells(spark, d))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_last_row(spark, d):
    return merge.last_row(S.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {_CELLS}, p AS (SELECT count(*) AS common, count(*) FILTER (WHERE a.value <> b.value) AS different FROM t a JOIN t b USING (code, date) WHERE a.source = 0 AND b.source = 1 AND a.value IS NOT NULL AND b.value IS NOT NULL)
  SELECT 0 AS a, 1 AS b, common::BIGINT AS common, different::BIGINT AS different, CASE WHEN different > 0 THEN 'conflict' ELSE 'overlap' END AS relation FROM p""")
def containment(spark, d):
    return merge.containment(_cells(spark, d))


@query("""SELECT ts::DATE AS date, ((SELECT count(DISTINCT user_id % 40) FROM events) - count(DISTINCT user_id % 40))::BIGINT AS missing FROM events WHERE event_type = 'purchase' GROUP BY 1
  HAVING count(DISTINCT user_id % 40) < (SELECT count(DISTINCT user_id % 40) FROM events)""")
def rectangular_gaps(spark, d):
    e = S.table(spark, d, "events", ["ts", "user_id", "event_type"]).select(F.to_date("ts").alias("date"), (F.col("user_id") % 40).alias("code"), "event_type")
    return merge.gaps(e.filter("event_type = 'purchase'"), e)


@query(f"""WITH {_CELLS} SELECT count(value)::BIGINT AS non_null, (count(DISTINCT date) * count(DISTINCT code))::BIGINT AS total, round(1 - count(value) / (count(DISTINCT date) * count(DISTINCT code)), 6) AS missing_ratio FROM t WHERE source = 1""")
def account_quality(spark, d):
    return merge.account_quality(_cells(spark, d).filter("source = 1"))


# graphs -------------------------------------------------------------------------------------------------

_EDGES = """e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'IN_REGION' AS relation, 'en' || n_nationkey AS id, NULL::DATE AS start_date FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION', 'es' || s_suppkey, DATE '1995-01-01' + (s_suppkey % 1000)::INT FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION', 'ec' || c_custkey, DATE '1995-01-01' + (c_custkey % 1000)::INT FROM customer)"""


def _edges(spark, d):
    n, s, c = S.table(spark, d, "nation"), S.table(spark, d, "supplier"), S.table(spark, d, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    day = lambda k: F.date_add(F.lit("1995-01-01").cast("date"), (F.col(k) % 1000).cast("int"))
    parts = [
        n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit("IN_REGION").alias("relation"), name("en", "n_nationkey").alias("id"), F.lit(None).cast("date").alias("start_date")),
        s.select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"), F.lit("IN_NATION").alias("relation"), name("es", "s_suppkey").alias("id"), day("s_suppkey").alias("start_date")),
        c.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("IN_NATION").alias("relation"), name("ec", "c_custkey").alias("id"), day("c_custkey").alias("start_date")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_EDGES} SELECT node, count(*)::BIGINT AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


_HOPS = "WITH RECURSIVE {edges}, b AS (SELECT source AS node, target AS other FROM e {where} UNION ALL SELECT target, source FROM e {where}), w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT b.other, w.depth + 1 FROM w JOIN b USING (node) WHERE w.depth < {depth}) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node"


def _start(spark, node="r1"):
    return spark.sql(f"SELECT '{node}' AS node")


@query(_HOPS.format(edges=_EDGES, where="", depth=2))
def graph_neighborhood_2hop(spark, d):
    return graph.neighborhood(_edges(spark, d), _start(spark), 2)


@query(_HOPS.format(edges=_EDGES, where="WHERE start_date IS NULL OR start_date <= DATE '1996-01-01'", depth=3))
def graph_neighborhood_asof(spark, d):
    return graph.neighborhood(_edges(spark, d), _start(spark), 3, "1996-01-01")


_HELD = "a AS (SELECT l_suppkey AS source, l_partkey AS target, round(sum(l_extendedprice), 2) AS weight FROM lineitem GROUP BY ALL), q AS (SELECT *, count(*) OVER (PARTITION BY target) AS n, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source || '-' || target) AS r FROM a)"


@query(f"""WITH {_HELD} SELECT source::VARCHAR AS source, target, round(weight, 2) AS weight, 1::BIGINT AS investors FROM q WHERE n <= 3 OR r <= 3
  UNION ALL SELECT 'collapsed_' || target, target, round(sum(weight), 2), count(*)::BIGINT FROM q WHERE n > 3 AND r > 3 GROUP BY target""")
def graph_collapse_minor(spark, d):
    rows = S.table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_extendedprice"]).groupBy(F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").alias("target")).agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))
    edges = rows.withColumns({"relation": F.lit("ACQUIRED"), "id": F.concat("source", F.lit("-"), F.col("target").cast("string"))})
    return graph.collapse_minor(edges, threshold=3).withColumn("weight", F.round("weight", 2))


@query(f"""WITH RECURSIVE {_EDGES}, k AS (SELECT source, target FROM e WHERE relation = 'IN_REGION' UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), b AS (SELECT source AS node, target AS other FROM k UNION ALL SELECT target, source FROM k),
  w AS (SELECT 'n1' AS node, ['n1'] AS path UNION ALL SELECT b.other, list_append(w.path, b.other) FROM w JOIN b USING (node) WHERE w.node <> 'n2' AND len(w.path) <= 5 AND NOT list_contains(w.path, b.other))
  SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM w WHERE node = 'n2'""")
def graph_paths(spark, d):
    edges = _edges(spark, d).filter("relation = 'IN_REGION'").select("source", "target", "id")
    world = S.table(spark, d, "region", ["r_regionkey"]).select(F.concat(F.lit("r"), "r_regionkey").alias("source"), F.lit("world").alias("target"), F.concat(F.lit("w"), "r_regionkey").alias("id"))
    return graph.simple_paths(edges.unionByName(world), "n1", "n2", 5).select(F.array_join("path", ">").alias("path"), "hops")


@query(_HOPS.format(edges=_EDGES, where="", depth=6).replace("'r1'", "'s1'").replace("AS depth FROM w GROUP", "AS hops FROM w GROUP"))
def graph_shortest_path(spark, d):
    return graph.shortest_hops(_edges(spark, d), "s1")


_CHAIN = """x AS (SELECT 'company_' || o_custkey AS s, 'issuance_event_' || o_orderkey AS t FROM orders WHERE o_custkey = 7), y AS (SELECT DISTINCT x.t AS s, 'security_' || l_partkey AS t FROM x JOIN lineitem ON 'issuance_event_' || l_orderkey = x.t),
  z AS (SELECT DISTINCT 'company_inv_' || l_suppkey AS t FROM lineitem JOIN y ON y.t = 'security_' || l_partkey)"""


@query(f"WITH {_CHAIN} SELECT 'company_7' AS node, 0 AS depth UNION ALL SELECT DISTINCT t, 1 FROM x UNION ALL SELECT DISTINCT t, 2 FROM y UNION ALL SELECT t, 3 FROM z")
def graph_control_chain(spark, d):
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    o, li = S.table(spark, d, "orders", ["o_custkey", "o_orderkey"]), S.table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"])
    edge = lambda df, a, b, rel: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"))
    edges = edge(o, name("company_", "o_custkey"), name("issuance_event_", "o_orderkey"), "EXECUTED").unionByName(edge(li, name("issuance_event_", "l_orderkey"), name("security_", "l_partkey"), "ISSUED")).unionByName(edge(li, name("company_inv_", "l_suppkey"), name("security_", "l_partkey"), "ACQUIRED"))
    rules = [("company_", "EXECUTED", True), ("issuance_event_", "ISSUED", True), ("security_", "ACQUIRED", False)]
    return graph.control_chain(edges, _start(spark, "company_7"), rules)


@query(f"""WITH {_EDGES}, deg AS (SELECT node, count(*) AS n, bool_and(relation = 'IN_NATION') AS addr FROM (SELECT source AS node, relation FROM e UNION ALL SELECT target, relation FROM e) GROUP BY node)
  SELECT node, CASE WHEN node LIKE 'r%' AND n > 3 THEN 'medium' WHEN addr AND n > 5 THEN 'high' END AS level FROM deg WHERE node LIKE 'r%' AND n > 3 OR addr AND n > 5""")
def graph_risk_rules(spark, d):
    edges = _edges(spark, d).withColumn("category", F.when(F.col("relation") == "IN_NATION", F.lit("address")).otherwise(F.lit("other")))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("type", F.when(F.col("id").startswith("r"), F.lit("Person")).otherwise(F.lit("Company")))
    return graph.risks(nodes, edges)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def graph_shared_properties(spark, d):
    s = S.table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).withColumnRenamed("s_suppkey", "id")
    return graph.all_pairs(s, ["s_nationkey"], 100_000).select("a", "b")


@query("SELECT min(s_suppkey) OVER (PARTITION BY s_nationkey) AS a, s_suppkey AS b FROM supplier QUALIFY s_suppkey <> min(s_suppkey) OVER (PARTITION BY s_nationkey)")
def graph_shared_properties_star(spark, d):
    s = S.table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).withColumnRenamed("s_suppkey", "id")
    return graph.shared_properties(s, ["s_nationkey"]).select("a", "b")


@query("""SELECT l_suppkey AS a, l_partkey AS b, count(*)::BIGINT AS n, (count(*) - 1)::INT AS last_slot FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def graph_duplicate_edges(spark, d):
    e = S.table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"]).select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("SUPPLIES").alias("relation"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_suppkey", "l_partkey")
    out = graph.duplicate_edges(e).filter("n > 1")
    return out.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max("n").alias("n"), F.max("slot").alias("last_slot"))


@query("SELECT 'error' AS level, 'missing end' AS issue, 'o' || o_orderkey AS subject FROM orders WHERE o_custkey % 50 = 0 UNION ALL SELECT 'error', 'weight not positive', 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def graph_validation(spark, d):
    o = S.table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = o.select(name("o", "o_orderkey").alias("id"), name("c", "o_custkey").alias("source"), name("x", "o_orderkey").alias("target"), F.lit("PLACED").alias("relation"), F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.lit(1.0)).alias("weight"))
    nodes = S.table(spark, d, "customer", ["c_custkey"]).filter("c_custkey % 50 <> 0").select(name("c", "c_custkey").alias("id"), F.lit("x").alias("label")).unionByName(o.select(name("x", "o_orderkey").alias("id"), F.lit("y").alias("label")))
    return graph.validate(nodes, edges)


# scalar functions ---------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '-?[0-9][0-9,\s]*[0-9]|-?[0-9]'), lambda r: CASE WHEN regexp_matches(regexp_replace(r, '\s', '', 'g'), '^-?[0-9]{1,3}(,[0-9]{3})+$') THEN 1 ELSE len(regexp_extract_all(r, '-?[0-9][0-9,]*')) END)), CASE WHEN text IS NOT NULL THEN 0 END)::INT AS n_ints,
  TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '-?[0-9]+\.?[0-9]*'), '') AS DOUBLE) AS first_number FROM documents""")
def parse_ints_dates(spark, d):
    t = F.col("text")
    return S.table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.size(T.parse_ints(t)).alias("n_ints"), T.find_number(t).alias("first_number"))


@query("""SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) >= 6 THEN 'A' || c_custkey ELSE 'A' || lpad(c_custkey::VARCHAR, 6, '0') END AS stock, CASE WHEN length(c_custkey::VARCHAR) >= 6 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS company,
  CASE length(c_custkey::VARCHAR) WHEN 6 THEN c_custkey::VARCHAR WHEN 5 THEN c_custkey || '0' ELSE CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 6, '0') END END AS inferred FROM customer""")
def key_normalisation(spark, d):
    c = F.col("c_custkey").cast("string")
    return S.table(spark, d, "customer", ["c_custkey"]).select("c_custkey", K.stock_column(c).alias("stock"), K.company_code(c).alias("company"), K.infer_stock_code(c).alias("inferred"))


@query("""SELECT regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '\\s+', ' ', 'g') AS heading, count(*)::BIGINT AS n FROM pages GROUP BY 1""".replace("\\\\", "\\"))
def page_sections(spark, d):
    heading = F.regexp_replace(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1), r"\s+", " ")
    return facets.group_counts(S.table(spark, d, "pages", ["html"]), heading, "heading")


@query("SELECT o_orderkey, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y년 %-m월 %-d일') AS korean, o_orderdate::DATE AS parsed, o_orderdate::DATE AS found FROM orders")
def korean_dates(spark, d):
    korean = F.concat(F.year("o_orderdate"), F.lit("년 "), F.month("o_orderdate"), F.lit("월 "), F.day("o_orderdate"), F.lit("일"))
    rows = S.table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.to_date("o_orderdate").alias("day"), korean.alias("korean"))
    return rows.select("*", T.parse_date(F.col("korean")).alias("parsed"), T.find_date(F.col("korean")).alias("found"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY year(o_orderdate)) AS total, year(o_orderdate)::INT AS year FROM orders),
  g AS (SELECT year, ((r - 1) // 100 + 1)::BIGINT AS page, count(*) AS actual, any_value(total) AS total FROM p GROUP BY year, page) SELECT year, page, actual::BIGINT AS actual, CASE WHEN page < ceil(total / 100) THEN 100 ELSE total - 100 * (ceil(total / 100) - 1) END::BIGINT AS expected FROM g""")
def page_row_check(spark, d):
    w = Window.partitionBy("year")
    o = S.table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).withColumn("year", F.year("o_orderdate"))
    p = o.withColumns({"r": F.row_number().over(w.orderBy("o_orderkey")), "total": F.count("*").over(w)})
    g = p.groupBy("year", (F.floor((F.col("r") - 1) / 100) + 1).alias("page")).agg(F.count("*").alias("actual"), F.max("total").alias("total"))
    return g.select("year", "page", "actual", T.expected_rows(F.col("total"), F.col("page"), F.ceil(F.col("total") / 100), 100).cast("long").alias("expected"))


# checks, samples, subgraphs -----------------------------------------------------------------------------


@query("""SELECT 'missing' AS issue, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'duplicate', o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) > 1""")
def membership_differences(spark, d):
    c, o = S.table(spark, d, "customer", ["c_custkey"]), S.table(spark, d, "orders", ["o_custkey"])
    return checks.membership(c, o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '%7%' AND event_type IN ('view', 'click')")
def record_filters(spark, d):
    e = S.table(spark, d, "events", ["event_id", "event_type", "props"])
    k = F.get_json_object("props", "$.k")
    return e.filter(checks.record_filter(k, "contains", "7") & checks.record_filter(F.col("event_type"), "in", ["view", "click"])).select("event_id")


@query("""WITH p AS (SELECT event_type AS level, hour(ts)::INT AS report, count(*) AS n FROM events GROUP BY ALL)
  SELECT level, report, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY level), 6) AS share FROM p""")
def warning_rollup(spark, d):
    e = S.table(spark, d, "events", ["event_type", "ts"]).select(F.col("event_type").alias("level"), F.hour("ts").alias("report"))
    return checks.rollup(e, "level", "report")


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark, d):
    return checks.seeded_sample(S.table(spark, d, "documents", ["doc_id"]), "doc_id", 11, 25)


@query("""SELECT o_custkey AS custkey, greatest((max(o_orderdate::DATE) - 89)::DATE, DATE '1996-01-01') AS quarter, least(DATE '1996-01-01', min(o_orderdate::DATE)) AS everything FROM orders GROUP BY 1""")
def range_presets(spark, d):
    o = S.table(spark, d, "orders", ["o_custkey", "o_orderdate"]).groupBy(F.col("o_custkey").alias("custkey")).agg(F.max(F.to_date("o_orderdate")).alias("e"), F.min(F.to_date("o_orderdate")).alias("s"))
    floor = F.lit("1996-01-01").cast("date")
    return o.select("custkey", checks.range_preset(F.col("e"), F.col("s"), 90, floor).alias("quarter"), checks.range_preset(F.col("e"), F.col("s"), None, floor).alias("everything"))


@query("""SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS field, unnest([count(nullif(o_orderstatus, '')), count(nullif(o_orderpriority, '')), count(o_totalprice)])::BIGINT AS filled,
  unnest([count(*) - count(nullif(o_orderstatus, '')), count(*) - count(nullif(o_orderpriority, '')), count(*) - count(o_totalprice)])::BIGINT AS "empty" FROM orders""")
def field_completeness(spark, d):
    return checks.completeness(S.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"])


@query(f"""WITH {_EDGES}, n AS (SELECT DISTINCT source AS id FROM e UNION SELECT target FROM e), v AS (SELECT id FROM n WHERE id NOT LIKE 'c%'), k AS (SELECT * FROM e WHERE relation = 'IN_NATION' AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v))
  SELECT id, 'edge' AS kind FROM k UNION ALL SELECT id, 'node' FROM v WHERE id IN (SELECT source FROM k UNION SELECT target FROM k)""")
def visible_subgraph(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    shown, kept = graph.visible(nodes, edges, ~F.col("id").startswith("c"), F.col("relation") == "IN_NATION", hide_isolated=True)
    return kept.select("id", F.lit("edge").alias("kind")).unionByName(shown.select("id", F.lit("node").alias("kind")))


@query(f"WITH {_EDGES}, r AS (SELECT 'r1' AS node UNION SELECT source FROM e WHERE target = 'r1') SELECT DISTINCT id, source, target FROM e WHERE source IN (SELECT node FROM r) OR target IN (SELECT node FROM r)")
def graph_incident_edges(spark, d):
    edges = _edges(spark, d).select("id", "source", "target")
    return graph.incident_edges(edges, graph.neighborhood(edges, _start(spark), 1), 2)


@query(f"""WITH {_DISCLOSURES} SELECT id, row_number() OVER (ORDER BY disclosed_at DESC, company_name DESC, title DESC, year, id)::INT AS rank FROM d WHERE market = 'MACHINERY' AND contains(lower(title), 'low') ORDER BY rank LIMIT 50""")
def result_order(spark, d):
    where = P.compile_blocks([P.block("market", "equals", "machinery"), P.block("title", "contains", "low", "AND")], {f: F.col(f) for f in P.FIELDS})
    top = facets.filter_disclosures(S.order_disclosures(spark, d), where).limit(50)  # a page of results
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("disclosed_at"), F.desc("company_name"), F.desc("title"), "year", "id")).alias("rank"))


@query(f"WITH {_DISCLOSURES} SELECT title, count(*)::BIGINT AS n FROM d WHERE year = 1997 GROUP BY title ORDER BY n DESC, min(id) LIMIT 3")
def top_titles(spark, d):
    rows = S.order_disclosures(spark, d).filter("year = 1997")
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(3).drop("first")
