import pytest

from tidemark.sources import html_tables as H


def test_spans_expand():
    html = "<table><tr><td rowspan=2>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td>d</td></tr><tr></tr><tr><td>e<br>f</td></tr></table>"
    assert H.tables(html) == [[["a", "b", "b"], ["a", "c", "d"], ["e f"]]]


def test_bad_spans_and_edges():
    with pytest.raises(ValueError):
        H.tables("<table><tr><td rowspan=0>a</td></tr></table>")
    assert H.tables(None) == [] and H.tables("<p>x</p>") == []
    assert H.tables("<table><tr><td>open") == [[["open"]]]
    assert H.tables("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>") == [[["i"]], [["o"]]]


def test_records():
    assert H.records([["k", "k", ""], ["1", "2"]]) == [{"k": "1", "k_1": "2", "unknown": ""}]
    assert H.records([]) == []


def test_explode(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"), (2, None), (3, "<table><tr><td colspan=x>a</td></tr></table>")], "page_id long, html string")
    rows = {(r.page_id, r.row): r.cells for r in H.explode_tables(df, "page_id", "html").filter("error IS NULL").collect()}
    assert rows == {(1, 0): ["a"], (1, 1): ["b"]}
    assert H.explode_tables(df, "page_id", "html").filter("error IS NOT NULL").count() == 1


def test_blank_rows_and_gaps():
    assert H.tables("<table><tr><td>a</td></tr><tr><td> </td><td></td></tr><tr><td>b</td></tr></table>") == [[["a"], ["b"]]]
    wide = "<table><tr><td>a</td><td>b</td><td rowspan=2>c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>"
    assert H.tables(wide) == [[["a", "b", "c"], ["d"], ["e", "f", "c"]]]
