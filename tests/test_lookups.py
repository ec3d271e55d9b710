"""Lookups, choice of sections, the viewer's filter, restartable stages and JSON sources."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries, queries_lookups  # noqa: F401
from tidemark.operators import graph, lookups
from tidemark.sources import json_files, pages, stages

ROWS = "company_id string, company_name string, market string, disclosed_at string, disclosed_date string, title string, title_display string, acpt_no string"


def test_company_disclosures(spark):
    rows = spark.createDataFrame(
        [
            ("06409", "n", "A", "2024-01-03 10:00", "2024-01-03", "Bond_1", None, "2"),
            ("06409", "n", "B", "2024-01-03 10:00", "2024-01-03", "x", "BOND 2", "1"),
            ("06409", "n", "A", "2024-01-02 10:00", "2024-01-02", "right", "", "3"),
            ("06409", "n", "A", "2023-01-02 10:00", "2023-01-02", "bond", "", "4"),
            ("000660", "n", "A", "2024-01-02 10:00", "2024-01-02", "bond", "", "5"),
            (None, None, None, None, None, None, None, None),
        ],
        ROWS,
    )
    ask = lambda code="064090", **how: [r.acpt_no for r in lookups.company_disclosures(rows, code, "2024-01-01", "2024-12-31", **how).collect()]
    assert ask() == ["3", "1", "2"] and ask(keyword="bond") == ["1", "2"] and ask(keyword="d_1") == ["2"] and ask(market="B") == ["1"] and ask("999999") == []
    assert ask("000660") == ["5"] and ask(keyword="B%1") == ["2"] and ask(keyword="\\") == []


def test_company_index_and_export(spark):
    c = spark.createDataFrame([("Ab", "5930", "K", ["x"], 1, 3), ("Ab", "005930", "", ["y", "x"], 2, 9), (" Ab ", "A005930", "Q", None, 3, 1), ("", "1", "Z", ["x"], 4, 5), (None, "1", None, None, 5, 5), ("cd", None, None, [], 0, 9)], "company_name string, company_id string, market string, badges array<string>, position int, disclosures int")
    got, markets = lookups.company_index(c, "AB")
    assert [r.disclosures for r in got.collect()] == [9, 3, 1] and [r.market for r in markets.collect()] == ["전체", "K", "Q", "Z"]
    assert [r.company_id for r in lookups.company_index(c, market="")[0].collect()] == ["005930"] or lookups.company_index(c, market="")[0].count() == 3
    rows = sorted(map(tuple, lookups.unique_companies(c).collect()), key=lambda r: r[4])
    assert rows == [("cd", "", "", "", 0), ("Ab", "A005930", "K", "x, y", 1)]


def test_unique_companies_query_without_keys(spark, tmp_path):
    lines = [(1, 1, 1, "A", "O"), (2, 1, 2, "N", "F"), (None, 1, 3, "R", "O"), (-5, 1, 1, "R", "O"), (1, 1, None, "A", "O"), (0, 2, 1, "A", "O"), (None, 2, 1, "A", "O"), (-8, 2, 2, "N", "F"), (8, 3, None, "N", "O"), (9, 3, 1, "A", None), (8, 4, 2, None, "F"), (10, 4, 1, "R", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 5).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.QUERIES["unique_companies"](spark, str(tmp_path))
    want = con.sql(queries.ORACLES["unique_companies"]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3


def test_metadata(spark):
    r = spark.createDataFrame([("1", None, "old"), ("2", "d", "old"), ("3", "", None), (None, "n", "x")], "acpt_no string, doc_no string, disclosed_at string")
    m = spark.createDataFrame([("1", "K", "Co", "2024", "9", "f", 1, 2), ("2", "", None, " ", "8", "f", None, 2), ("3", None, None, None, None, None, None, None), ("1", "J", "Old", "2023", "7", "f", 1, 2)], "acpt_no string, market string, company_name string, disclosed_at string, doc_no string, family_id string, current_sequence int, family_member_count int")
    got = {x.acpt_no: x for x in lookups.with_metadata(r, m, "bond_issuance").collect()}
    assert (got["1"].doc_no, got["1"].disclosed_at, got["1"].market, got["1"].corp_name, got["1"].family_id, got["1"].current_sequence) == ("9", "2024", "K", "Co", "f", 1)
    assert (got["2"].doc_no, got["2"].disclosed_at, got["2"].family_id) == ("d", "old", None) and got["3"].doc_no == "" and got[None].doc_no == "n"
    assert "corp_name" not in lookups.with_metadata(r, m, "shareholder_meeting").columns


def signature(v):
    """(shape, numbers) in plain Python; shapes compare as values."""
    if isinstance(v, bool) or v is None:
        return ("lit", v), []
    if isinstance(v, list | dict):
        parts = [(k, *signature(x)) for k, x in (sorted(v.items()) if isinstance(v, dict) else enumerate(v))]
        return (type(v).__name__, tuple((k, s) for k, s, _ in parts)), [n for *_, ns in parts for n in ns]
    import re

    m = re.search(r"-?\d+\.?\d*", str(v).replace(",", ""))
    return (("number",), [float(m[0])]) if m else (("lit", v), [])


def test_numeric_signatures(spark):
    values = [{"b": [1, {"c": "x 2,000"}], "a": True}, {"a": True, "b": [7, {"c": "9"}]}, {"a": False, "b": [7, {"c": "9"}]}, [], {}, [[]], [{}], None, "t", "12.5 won", {"a": [[["-3"]]]}, {"a": [[["z"]]]}, [1, 2], [1, [2]], {"k": None}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(98, "{bad"), (99, None)], "id int, j string")
    got = {r.id: (r["shape"], r.numbers) for r in lookups.numeric_signature(df, "id", "j").collect()}
    assert len(got) == len(values) + 2 and got[98][0].endswith("=bad")
    for i, v in enumerate(values):
        assert got[i][1] == signature(v)[1]
        for j, w in enumerate(values):
            assert (got[i][0] == got[j][0]) == (signature(v)[0] == signature(w)[0]), (v, w)


def test_choice_of_sections(spark):
    found = spark.createDataFrame([(1, 1, "A", "<a>", None), (1, 2, "B", "<b>", None), (1, 3, "C", None, None), (2, 1, "A", "<a2>", None), (3, 1, "Z", "<z>", None), (4, None, None, None, "bad")], "id int, index int, title string, html string, error string")
    rules = spark.createDataFrame([(5, "toc_1 A *", ["toc_1"]), (2, "toc_1 A toc_2 B toc_3 C", ["toc_2", "toc_3", "toc_9"]), (3, "toc_1 A toc_2 B*", ["toc_1"]), (4, "toc_1", ["toc_1"])], "rule int, signature string, toc_ids array<string>")
    got = {r.id: tuple(r)[1:] for r in pages.choose_sections(found, rules, "id").collect()}
    assert got == {1: ("ok", 2, 2, "<b>\n"), 2: ("ok", 5, 1, "<a2>"), 3: ("missing_selection", None, None, None)}
    every = rules.unionByName(spark.createDataFrame([(9, "*", ["toc_1"])], rules.schema))
    assert {r.id: r.rule for r in pages.choose_sections(found, every, "id").collect()} == {1: 2, 2: 5, 3: 9}


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "Company", "g1", ["x"], {"p": "Seoul"}), ("b", "Beta", "Person", None, ["y"], {}), ("c", "Gamma", "Company", "g2", None, None), ("d", "Delta", "Person", "g1", ["x", "y"], {"q": "7"})], "id string, label string, type string, group string, tags array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("1", "a", "b", "OWNS", "own", 5.0, True, None), ("2", "b", "c", "KNOWS", "soc", 1.0, False, None), ("3", "a", "c", "OWNS", "own", None, True, None), ("4", "d", "d", "SELF", "own", 9.0, True, None)], "id string, source string, target string, relation string, category string, weight double, directed boolean, properties map<string,string>")
    return nodes, edges


@pytest.mark.parametrize(
    ("filters", "how", "nodes", "edges"),
    [
        ({}, {}, "abcd", "1234"),
        ({"types": ("Company",)}, {}, "ac", "3"),
        ({"groups": ("",)}, {}, "b", ""),
        ({"tags": ("x", "q")}, {}, "ad", "4"),
        ({"min_degree": 2}, {}, "abc", "123"),
        ({"types": ("Company",), "min_degree": 2, "any_of": True}, {}, "abc", "123"),
        ({"types": ("Person",), "tags": ("x",)}, {}, "d", "4"),
        ({"types": ("Person",), "tags": ("x",), "any_of": True}, {}, "abd", "14"),
        ({"relations": ("OWNS",)}, {}, "abcd", "13"),
        ({"categories": ("soc",), "direction": "directed", "any_of": True}, {}, "abcd", "1234"),
        ({"direction": "undirected"}, {}, "abcd", "2"),
        ({"min_weight": 2}, {}, "abcd", "14"),
        ({"min_weight": 2, "relations": ("OWNS",), "hide_isolated": True}, {}, "ab", "1"),
        ({"hide_isolated": True}, {"search": "SEOUL"}, "", ""),
        ({}, {"search": " q:7 "}, "d", "4"),
        ({}, {"search": "eta"}, "b", ""),
        ({}, {"root": "b", "hops": 1}, "abc", "123"),
    ],
)
def test_visible_subgraph(spark, small, filters, how, nodes, edges):
    n, e = graph.visible_subgraph(*small, graph.Filters(**filters), **how)
    assert ("".join(sorted(r.id for r in n.collect())), "".join(sorted(r.id for r in e.collect()))) == (nodes, edges)


def test_hidden_and_unknown(spark, small):
    n, e = graph.visible_subgraph(*small, hidden_nodes=small[0].filter("id = 'c'"), hidden_edges=small[1].filter("id = '4'"))
    assert (n.count(), [r.id for r in e.collect()]) == (3, ["1"])
    with pytest.raises(ValueError, match="direction"):
        graph.Filters(direction="up")


def test_restartable_stage(spark, tmp_path):
    rows = [(2020, "a", 1), (2020, "b", 2), (2021, "c", 3), (2022, "d", 4), (None, "e", 5)]
    table = lambda rows: spark.createDataFrame(rows, "year int, name string, v int")
    target, made = str(tmp_path / "t"), []

    def make(df):
        made.append(sorted({str(r.year) for r in df.select("year").collect()}))
        return df.withColumn("double", F.col("v") * 2)

    stamp = lambda year: {f: os.stat(os.path.join(target, f"year={year}", f)).st_mtime_ns for f in os.listdir(os.path.join(target, f"year={year}"))}
    assert stages.refresh(table(rows), "year", make, target) == {"written": ["2020", "2021", "2022", None], "removed": [], "kept": []}
    kept = stamp(2020)
    assert stages.refresh(table(rows[::-1]), "year", make, target) == {"written": [], "removed": [], "kept": ["2020", "2021", "2022", None]}
    assert len(made) == 1
    changed = [*rows[:2], (2021, "c", 30), (2021, "c", 30), rows[4], (2023, "f", 6)]
    assert stages.refresh(table(changed), "year", make, target) == {"written": ["2021", "2023"], "removed": ["2022"], "kept": ["2020", None]}
    assert made[1] == ["2021", "2023"] and stamp(2020) == kept
    assert sorted((r.name, r.double) for r in spark.read.parquet(target).collect()) == [("a", 2), ("b", 4), ("c", 60), ("c", 60), ("e", 10), ("f", 12)]
    assert stages.refresh(table(changed), "year", make, target, version="2")["kept"] == []


def test_company_artifact(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "old", "1", "A", "2024-01-01", "1", "t1"), ("k1", "new", "1", "B", "2024-02-01", "2", "t2"), ("k2", "x", "2", "A", "2024-01-05", "3", "t3")], "company_key string, company_name string, company_id string, market string, disclosed_at string, acpt_no string, title string")
    target = str(tmp_path / "c")
    assert len(stages.refresh_companies(rows, target)["written"]) == 2
    one = stages.one_company(spark, target, "k1").first()
    assert (one.company_name, one.market, one.disclosure_count, [d.title for d in one.disclosures]) == ("new", "B", 2, ["t1", "t2"])
    more = rows.unionByName(spark.createDataFrame([("k2", "y", "2", "A", "2024-03-05", "4", "t4")], rows.schema))
    assert len(stages.refresh_companies(more, target)["written"]) == 1
    assert {r.company_key: r.disclosure_count for r in stages.company_list(spark, target).collect()} == {"k1": 2, "k2": 2}


def test_json_sources(spark, tmp_path):
    good = {"disclosures": [{"company_id": "64090", "disclosed_at": "2024-01-03 10:00", "acpt_no": "2", "market": "A"}, {"company_key": "064090", "disclosed_date": "2024-01-02", "disclosed_at": "2024-01-02 09:00", "acpt_no": "1", "market": "B"}, {"company_id": "06409"}, {"company_id": "1", "disclosed_date": "2024-01-02"}], "more": 1}
    for name, text in {"good": json.dumps(good, ensure_ascii=False, indent=1), "none": "{}", "bad": "{", "list": "[1]", "type": '{"disclosures": 7}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "filtered.json").write_text(text, encoding="utf-8")
    path = lambda *names: [str(tmp_path / n / "filtered.json") for n in names]
    got = {r.file.split("/")[-2]: r.error for r in json_files.read_objects(spark, path("good", "none", "bad", "list", "type"), json_files.CATEGORY).collect()}
    assert got == {"good": None, "none": None, "bad": "not JSON", "list": "not an object", "type": "wrong type: disclosures"}
    ask = lambda **how: [r.acpt_no for r in json_files.category_disclosures(spark, path("good", "none"), "064090", "2024-01-01", "2024-12-31", **how).collect()]
    assert ask() == ["1", "2"] and ask(market="A") == ["2"]
    with pytest.raises(ValueError, match="category: .*bad.*not JSON"):
        json_files.category_disclosures(spark, path("good", "bad"), "1", "2024-01-01", "2024-12-31")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        json_files.read_objects(spark, path("missing"), json_files.CATEGORY).count()


def test_merged_companies_and_unions(spark):
    rows = spark.createDataFrame([("a", "", "1", None, ["x"], "9", 1), ("b", "B", None, "K", ["y"], "9", 2), ("a", "A", "2", "M", ["z", "x"], "8", 3), ("c", "C", "", "", None, "7", 4)], "company_key string, company_name string, company_id string, market string, badges array<string>, acpt_no string, position int")
    got, counts = lookups.merge_companies(rows)
    assert {tuple(r) for r in got.select("company_key", "company_name", "company_id", "market", "disclosures", "badges").collect()} == {("a", "A", "1", "M", 2, "x, z"), ("c", "C", None, None, 1, "")}
    assert tuple(counts.first()) == (3, 1)
    with pytest.raises(Exception, match="acpt_no is required"):
        lookups.merge_companies(rows.withColumn("acpt_no", F.lit(" ")))[0].collect()
    a = spark.createDataFrame([("k", 1, "a"), ("j", 2, "a"), (None, 3, "a")], "key string, n int, src string")
    b = spark.createDataFrame([("k", 0, "b"), ("k", -1, "b")], "key string, n int, src string")
    assert sorted(map(str, map(tuple, lookups.union_keep_last([a, b], "key", ["n"]).collect()))) == ["('j', 2, 'a')", "('k', 0, 'b')", "(None, 3, 'a')"]
    assert (lookups.resume_at(10, 10, 4), lookups.resume_at(11, 10, 4), lookups.resume_at(11, None, 4)) == (4, 0, 4)
