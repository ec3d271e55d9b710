import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, barrier, facets, graph, intervals, merge, ohlc, versions


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("A", "2025-01-02", 100, 101, 99, 100, 1000), ("A", "2025-01-03", 101, 106, 100, 102, 1100), ("A", "2025-01-06", 102, 103, 96, 97, 1200), ("A", "2025-01-07", 97, 98, 94, 95, 1300)]
    return spark.createDataFrame([(c, day(d), *map(float, v)) for c, d, *v in rows], "code string, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize(
    ("params", "expected"),
    [
        (barrier.Params("intraday", 5, 3, 3), ("completed", "upper", 1, day("2025-01-03"), 105.0)),
        (barrier.Params("close", 5, 3, 3), ("completed", "lower", -1, day("2025-01-06"), 97.0)),
        (barrier.Params("close", 20, 20, 2), ("completed", "vertical", 0, day("2025-01-06"), 97.0)),
        (barrier.Params("intraday", 5, 3, 4), ("failed", None, None, None, None)),
    ],
)
def test_triple_barrier(spark, bars, params, expected):
    events = spark.createDataFrame([(1, "A", day("2025-01-01"))], "id int, code string, event_date date")
    r = barrier.triple_barrier(events, bars, params).first()
    assert (r.status, r.barrier, r.label, r.touched_date, r.touched_price) == expected


def test_event_after_last_bar_fails(spark, bars):
    events = spark.createDataFrame([(1, "A", day("2025-02-01")), (2, "B", day("2025-01-01"))], "id int, code string, event_date date")
    assert {r.error for r in barrier.triple_barrier(events, bars).collect()} == {barrier.NO_PRICE}


def test_params():
    assert barrier.Params(upper_pct=5.0).key() == barrier.Params(upper_pct=5).key()
    with pytest.raises(ValueError):
        barrier.Params(basis="open")


def test_asof_both_ways(spark, bars):
    events = spark.createDataFrame([(1, "A", day("2025-01-03")), (2, "A", day("2025-01-04")), (3, "A", day("2025-01-08")), (4, "A", day("2024-12-25"))], "id int, code string, anchor date")
    expected = {1: day("2025-01-03"), 2: day("2025-01-06"), 4: day("2025-01-02")}
    assert {r.id: r.date for r in asof.forward_asof(events, bars).collect()} == expected
    assert {r.id: r.date for r in asof.forward_asof_small(events, bars).collect()} == expected


def test_asof_over_more_than_a_year(spark):
    bars = spark.createDataFrame([(c, day(d), 1.0, 1.0, 1.0, 1.0) for c, d in (("A", "2020-01-02"), ("A", "2023-06-01"), ("B", "2024-01-02"))], "code string, date date, open double, high double, low double, close double")
    events = spark.createDataFrame([(1, "A", day("2020-01-03")), (2, "A", day("2019-01-01")), (3, "B", day("1999-01-01")), (4, "A", day("2023-06-02")), (5, "A", None), (6, "A", day("2020-01-03"))], "id int, code string, anchor date")
    found = asof.forward_asof_small(events, bars)
    assert found.columns == ["id", "code", "anchor", "date", "open", "high", "low", "close"]
    assert sorted((r.id, r.date) for r in found.collect()) == [(1, day("2023-06-01")), (2, day("2020-01-02")), (3, day("2024-01-02")), (6, day("2023-06-01"))]


def test_anchor(spark):
    rows = spark.sql("SELECT timestamp'2025-01-02 15:29:59' a, timestamp'2025-01-02 15:30:00' b").select(asof.anchor_date(F.col("a")), asof.anchor_date(F.col("b"))).first()
    assert tuple(rows) == (day("2025-01-02"), day("2025-01-03"))


def test_candles(bars):
    week = ohlc.resample(bars, "week").orderBy("date").collect()
    assert [(r.date, r.open, r.high, r.low, r.close, r.volume) for r in week] == [(day("2025-01-03"), 100, 106, 99, 102, 2100), (day("2025-01-10"), 102, 103, 94, 95, 2500)]
    three = ohlc.n_row_bars(bars, 3).orderBy("bar").collect()
    assert [(r.date, r.open, r.close) for r in three] == [(day("2025-01-06"), 100, 97), (day("2025-01-07"), 97, 95)]
    with pytest.raises(ValueError):
        ohlc.period_label(F.col("date"), "year")


def test_islands_and_lookup(spark):
    rows = [("x", "2024-01-02", "Q"), ("x", "2024-01-03", "Q"), ("x", "2024-01-05", "P"), ("x", "2024-01-08", "P"), ("y", "2024-01-02", "P"), ("y", "2024-01-03", "P"), ("y", "2024-01-05", None)]
    df = spark.createDataFrame([(k, day(d), v) for k, d, v in rows], "k string, d date, v string")
    out = intervals.islands(df, "k", "d", "v")
    assert sorted(map(tuple, out.collect())) == [("x", "P", day("2024-01-05"), day("2024-01-08")), ("x", "Q", day("2024-01-02"), day("2024-01-04")), ("y", "P", day("2024-01-02"), day("2024-01-03"))]
    probes = spark.createDataFrame([("x", day("2024-01-04")), ("y", day("2024-02-01"))], "k string, p date")
    assert list(map(tuple, intervals.value_at(out, probes, "k", "p", "v").collect())) == [("x", day("2024-01-04"), "Q")]


def test_versions(spark):
    rows = spark.createDataFrame([("f", 0, "2024년 1월 1일", "100"), ("f", 1, "2024년 1월 3일", "100.5"), ("f", 2, "2024년 2월 3일", None)], "family string, seq int, date string, amount string")
    diffs = versions.changes(rows, "family", ["seq"], ["date", "amount"])
    log = {r.version: (r.changed_fields, r.major_fields, r.severity) for r in versions.change_log(diffs, "family", {"date": True, "amount": True}, {"date": 3}, {"amount": 1.0}).collect()}
    assert log == {2: (2, 0, "minor"), 3: (2, 2, "major")}


def test_merge(spark):
    cells = spark.createDataFrame([(0, "a", 1, 1.0), (1, "a", 1, 2.0), (0, "b", 1, 3.0), (1, "b", 1, None)], "source int, code string, date int, value double")
    assert [tuple(r) for r in merge.conflicts(cells).collect()] == [("a", 1, 2)]
    assert {r.code: r.value for r in merge.last_non_null(cells).collect()} == {"a": 2.0, "b": 3.0}
    with pytest.raises(Exception, match="conflicting"):
        merge.coalesce_merge(cells).collect()


def test_graph(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "c"), ("e4", "c", "d"), ("e5", "d", "d")], "id string, source string, target string").withColumns({"relation": F.lit("R"), "start_date": F.lit(None).cast("date")})
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {"a": 2, "b": 2, "c": 3, "d": 2}
    assert sorted(r.path for r in graph.simple_paths(edges, "a", "d", 3).collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    assert {r.node: r.depth for r in graph.neighborhood(edges, spark.sql("SELECT 'a' AS node"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node: r.hops for r in graph.shortest_hops(edges, "b").collect()} == {"b": 0, "a": 1, "c": 1, "d": 2}
    nodes = spark.createDataFrame([("a", "A"), ("b", ""), ("c", "C")], "id string, label string")
    found = {(r.issue, r.subject) for r in graph.validate(nodes, edges.withColumn("weight", F.lit(1.0))).collect()}
    assert found == {("missing end", "e4"), ("missing end", "e5"), ("self-loop", "e5"), ("blank label", "b")}


def test_walks_reach_the_fixpoint(spark):
    levels = [e for i in range(5) for e in ((f"company_{i}", f"issuance_event_{i}", "EXECUTED"), (f"issuance_event_{i}", f"security_{i}", "ISSUED"), (f"company_{i + 1}", f"security_{i}", "ACQUIRED"))]
    edges = spark.createDataFrame([*levels, ("company_5", "issuance_event_0", "EXECUTED")], "source string, target string, relation string")
    rules = [("company_", "EXECUTED", True), ("issuance_event_", "ISSUED", True), ("security_", "ACQUIRED", False)]
    chain = {r.node: r.depth for r in graph.control_chain(edges, spark.sql("SELECT 'company_0' AS node"), rules).collect()}
    assert len(chain) == 16 and chain["company_5"] == 15
    line = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "source string, target string")
    assert {r.node: r.hops for r in graph.shortest_hops(line, "0").collect()} == {str(i): i for i in range(13)}


def test_facets_resume(spark):
    rows = spark.range(10).withColumnRenamed("id", "seq")
    assert tuple(facets.resume(rows, "seq", 6, F.col("seq") % 2 == 0).first()) == (3, 1, 9)
