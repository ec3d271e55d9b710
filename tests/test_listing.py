import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import asof, listing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_search_errors_and_precedence(spark):
    rows = spark.createDataFrame([(1, 2024, "a", "m", "t1", "n", "s", "2024-01-02 10:00", "2024-01-02"), (2, 2024, "a", "m", "t2", "n", "s", "2024-01-03 10:00", "2024-01-03"), (3, 2024, "b", "k", "t3", "n", "s", "", "")], "id int, year int, acpt_no string, market string, title string, company_name string, submitter string, disclosed_at string, disclosed_date string")
    assert [r.id for r in listing.search(rows, market=listing.ALL_MARKETS).collect()] == [1, 3]
    with pytest.raises(Exception, match="no date"):
        listing.search(rows, start="2024-01-01").collect()
    assert [r.id for r in listing.search(rows, market="m", start="2024-01-03", end="2024-02-01").collect()] == [2]
    assert listing.search(rows, blocks=F.lit(True), title=F.lit(False)).count() == 2
    assert listing.search(rows, exclude=F.lit(True)).count() == 0


def test_segments(spark):
    a, b = spark.range(0, 4), spark.range(4, 6)
    assert listing.merge_segments([(a, 0, 4), (b, 4, 6)]).count() == 6
    with pytest.raises(ValueError):
        listing.merge_segments([(a, 0, 4), (b, 5, 6)])
    with pytest.raises(Exception, match="segments share"):
        listing.merge_segments([(a, 0, 4), (spark.range(3, 6), 4, 6)]).collect()


def test_text_errors(spark):
    assert one(spark, T.year_of(F.col("d")), d="2024-01-01") == 2024
    with pytest.raises(Exception, match="no year"):
        one(spark, T.year_of(F.col("d")), d="24-01")
    assert one(spark, T.json_number(F.col("d")), d=1.5) == 1.5
    with pytest.raises(Exception, match="not finite"):
        one(spark, T.json_number(F.col("d")), d=float("inf"))


@pytest.mark.parametrize(
    ("result", "remarks", "status"),
    [("미가결", "", "rejected"), ("가결되지 않음", "", "rejected"), ("원안대로 가결", "", "passed"), ("가결", "안건 철회", "withdrawn"), ("", "자동폐기", "not_tabled"), ("불상정", "", "not_tabled"), ("미결", "", "unresolved"), ("보류", "가결", None), ("승인되었음", "", "passed")],
)
def test_agenda_status(spark, result, remarks, status):
    assert one(spark, T.agenda_status(F.col("r"), F.col("m")), r=result, m=remarks) == status


@pytest.mark.parametrize(("title", "kind"), [("무상증자 및 유상증자", "bonus"), ("유무상 증자 결정", "mixed"), ("유상 증자", "paid"), ("합병", "unknown")])
def test_issuance_type(spark, title, kind):
    assert one(spark, T.issuance_type(F.col("t")), t=title) == kind


def test_asof_over_a_gap_of_years(spark):
    day = datetime.date
    events = spark.createDataFrame([(1, "a", day(2020, 1, 1)), (2, "a", day(2024, 5, 1)), (3, "a", day(2024, 5, 2)), (4, "b", day(2020, 1, 1)), (5, "a", day(2020, 1, 1))], "event_id int, code string, anchor date")
    bars = spark.createDataFrame([("a", day(2024, 5, 1), 7.0), ("a", day(2019, 1, 1), 3.0), ("b", day(2019, 12, 31), 1.0)], "code string, date date, close double")
    for join in (asof.forward_asof, asof.forward_asof_small):
        found = join(events, bars, keep=("date", "close"))
        assert sorted((r.event_id, r.date, r.close) for r in found.collect()) == [(1, day(2024, 5, 1), 7.0), (2, day(2024, 5, 1), 7.0), (5, day(2024, 5, 1), 7.0)]


def test_first_candidate_and_unlisted(spark):
    c = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y"), ("j", 0, "z")], "key string, rank int, code string")
    rows = spark.createDataFrame([("y", 1), ("y", 2)], "code string, id int")
    assert sorted((r.key, r.id) for r in listing.first_candidate(c, rows, "key", "code").collect()) == [("k", 1), ("k", 2)]
    found = spark.createDataFrame([("y", "n", 2)], "code string, name string, n long")
    mapping = spark.createDataFrame([("y", "n"), ("q", "m")], "code string, name string")
    assert listing.add_unlisted(found, mapping, "code", "name").count() == 2 and listing.add_unlisted(found, mapping, "code", "name", "KOSPI").count() == 1


def test_page_counts_of_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("b", 2, 5), ("b", 2, 6), (None, 2, 7)], "acpt_no string, page int, id int")
    assert sorted(map(tuple, listing.page_counts(rows).collect())) == [(1, 2, 1, 1), (2, 4, 2, 2)]


def test_change_matrix_of_many_versions(spark):
    rows = spark.createDataFrame([(1, "x", v, v * 10) for v in (12, 3, 1, 7, 5)] + [(1, "x", 3, 99), (2, "y", 1, None)], "family int, field string, version int, value int")
    got = {(r.family, r.field): [tuple(v) for v in r.versions] for r in listing.change_matrix(rows, "family", "field", "version", "value").collect()}
    assert got == {(1, "x"): [(1, 10), (3, 99), (5, 50), (7, 70), (12, 120)], (2, "y"): [(1, None)]}
