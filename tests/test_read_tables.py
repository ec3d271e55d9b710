"""Documents read with all their tables: the same tables as in rows, in as many tasks as a shuffle has, without a shuffle of what was read."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_meeting_tables import AGENDA, CORRECTION, DATE, ELECTION, GROUPED, PURPOSE
from tidemark import queries, queries_lookups, queries_meetings, queries_records  # noqa: F401
from tidemark.functions import text as T
from tidemark.operators import meeting_tables as M
from tidemark.sources import html_tables as H

PAGES = [(1, CORRECTION + AGENDA + GROUPED + ELECTION + PURPOSE + DATE), (2, None), (3, "<table><tr><td rowspan=0>x</td></tr></table>"), (4, "<p>x</p>"), (5, GROUPED + "<table><tr><td></td></tr></table>")]


class Calls:
    def handle_starttag(self, tag, attrs):
        self.calls.append((tag, attrs))

    def handle_endtag(self, tag):
        self.calls.append("/" + tag)

    def handle_data(self, data):
        if self.calls and self.calls[-1][0] == "text":
            data = self.calls.pop()[1] + data
        self.calls.append(("text", data))


def test_short_way_equals_the_parser():
    def calls(base, page):
        reader = type("R", (Calls, base), {})(convert_charrefs=True)
        reader.calls = []
        reader.feed(page)
        reader.close()
        return reader.calls

    pool = ["<table>", "</table>", "<tr>", '<TD Rowspan="2">', "<td rowspan=2 colspan='3'>", "</td >", "<br/>", "<br />", "<td rowspan>", "a &amp; b", "&lt", " ", "x < y", "<", ">", '"', "<!-- c -->", "<script>a<b</script>", "<title>", '<td a="x>y">', "<a href=/x/y>", "<a b=c/>", "<a b= c>", "</ td>", "</td x>", "<b:c d>", "<?x?>", "</>"]
    rnd, short = random.Random(5), 0
    for _ in range(20000):
        page = "".join(rnd.choice(pool[:14] if rnd.random() < 0.7 else pool) for _ in range(rnd.randint(0, 8)))
        page = page[: rnd.randint(0, len(page))] if rnd.random() < 0.1 else page
        assert calls(H._Reader, page) == calls(HTMLParser, page), page
        short += len(H._TAG.split(page)) // 6 == page.count("<")
    assert short > 5000


@pytest.mark.parametrize("titles", [None, M.SECTIONS])
def test_documents_hold_the_same_rows(spark, monkeypatch, titles):
    docs = spark.createDataFrame(PAGES, "id int, html string").withColumn("other", F.col("id") * 2)
    read = H.read_tables(docs.coalesce(1), "id", "html", titles, keep=("other",))
    assert {r.id: (r.other, r.error is not None, r.tables == []) for r in read.collect()} == {1: (2, False, False), 2: (4, False, True), 3: (6, True, True), 4: (8, False, True), 5: (10, False, False)}
    rows = H.explode_tables(docs, "id", "html") if titles is None else H.explode_titled(docs, "id", "html", titles)
    one = read.select("id", F.explode("tables").alias("t")).select("id", "t.*").select("id", "table", "title", "spanned", "corrects", F.posexplode("rows").alias("row", "cells"))
    same = [c for c in rows.columns if c != "error"]
    assert sorted(map(str, one.select(*same).collect())) == sorted(map(str, rows.filter("error IS NULL").select(*same).collect()))
    brought = {r.id: r.tables for r in H.gather_tables(rows.filter("error IS NULL"), "id").collect()}
    assert brought[1] == next(r.tables for r in read.collect() if r.id == 1)


def test_meetings_of_documents_and_rows(spark):
    docs = spark.createDataFrame(PAGES, "id int, html string")
    read, rows = H.read_tables(docs, "id", "html", M.SECTIONS), H.explode_titled(docs, "id", "html", M.SECTIONS)
    for made in (M.structured_agendas, M.elections, M.purpose_changes, M.correction_notes):
        got = sorted(map(str, made(read, "id").collect()))
        assert got and got == sorted(map(str, made(rows, "id").collect()))


@pytest.mark.parametrize("name", ["bond_records", "bond_checks", "rights_records", "meeting_elections", "meeting_facts", "structured_agendas", "parsed_by_mode"])
def test_pages_are_read_once_and_stay_where_they_are(spark, name):
    df = queries.QUERIES[name](spark, SF)
    above, _, below = df._jdf.queryExecution().sparkPlan().toString().partition("MapInArrow")
    assert below and "MapInArrow" not in below and "MapInPandas" not in above + below
    assert not any(word in above for word in ("Aggregate", "Window", "Join", "Repartition"))


@pytest.mark.parametrize("made", [queries_records._bonds, queries_meetings._issues, queries_meetings._meeting_rows])
def test_pages_of_one_file_are_read_in_several_tasks(spark, made):
    assert made(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert made(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_repeats_are_dropped_with_one_reading_of_the_texts(spark):
    rows = spark.createDataFrame([(["a", "a", " ", None, "a ", "b", "b"],), ([],), (None,)], "c array<string>")
    plan = rows.select(T.drop_repeats(F.transform("c", lambda x: F.upper(x))).alias("d"))
    assert [r.d for r in plan.collect()] == [["A", "A ", "B"], [], None]
    assert plan._jdf.queryExecution().analyzed().toString().count("upper(") == 1
    clean = spark.createDataFrame([(" a  b\t",), ("a b",), ("a b",), ("　",), ("",), (None,)], "c string").select(T.collapse_spaces(F.col("c")).alias("c"))
    assert [r.c for r in clean.collect()] == ["a b", "a b", "a b", "", "", None]
