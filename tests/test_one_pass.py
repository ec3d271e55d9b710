"""Operators that used to shuffle once a step: what they still shuffle."""

import json
import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import queries, queries_lookups, queries_meetings, queries_records  # noqa: F401
from tidemark.operators import build, graph, lookups, meetings


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_signatures_open_values_inside_their_rows(spark):
    values = ['{"a":[1,{"b":"x 2,000 [{"}]}', "[[[[[[7]]]]]]", '"t"', "{", "[", None, '{"a":{}}', "[]", "[null]", '{"a":"\\"]]]]"}']
    got = lookups.numeric_signature(spark.createDataFrame(list(enumerate(values)), "id int, j string"), "id", "j")
    assert shuffles(got) == 0
    rows = {r.id: (r["shape"], r.numbers) for r in got.collect()}
    assert rows[0][1] == [1.0, 2000.0] and rows[1] == (json.dumps(["i" + "0" * 10] * 6, separators=(",", ":")) + "=number", [7.0])
    assert rows[3] == rows[4] == ("[]=bad", []) and rows[5] == ("[]=VOID:null", []) and rows[6] == ('["ka"]=OBJECT<>:{}', []) and rows[7] == ("[]=ARRAY<VOID>:[]", [])


def test_relations_of_rows_apart_by_document_need_no_other_shuffle(spark):
    df = queries.QUERIES["meeting_relations"](spark, SF)
    assert shuffles(df) <= 2  # one a reading of the lines


def test_relations_with_places_told_twice_and_mentions_without_an_entity(spark):
    refs = spark.createDataFrame([("d", 1, "person:0"), ("d", 2, "person:1"), ("d", 2, "person:2"), ("e", 1, "person:9")], "acpt_no string, at int, entity_ref string")
    made = [("d", 1, "1", "@meeting", {"office_type": "b", "outcome": None}, "x"), ("d", 2, "1", "@meeting", {"office_type": "b", "outcome": "passed", "z": ""}, "y"), ("d", 3, "2", "1", {}, "z"), ("d", 4, "8", "@meeting", {"a": "1"}, "w"), ("d", 5, "@company", "agenda:1", None, "v")]
    found = spark.createDataFrame([(d, at, s, t, "candidate_for", a, e) for d, at, s, t, a, e in made], "acpt_no string, at int, source string, target string, type string, attributes map<string,string>, evidence string")
    got = {(r.source_ref, r.target_ref): (r.attributes, r.evidence) for r in meetings.merge_relations(found, refs).collect()}
    assert got == {("person:0", "@meeting"): ({"office_type": "b", "outcome": "passed"}, "y"), ("person:1", "person:0"): ({}, "z"), ("person:2", "person:0"): ({}, "z"), ("@company", "agenda:1"): ({}, "v")}


def test_elections_meet_agendas_in_one_join_by_document(spark):
    rnd = random.Random(4)
    names, offices = ["Kim", "Lee A", "박철수", " ", None], ["auditor", "outside_director", "", None]
    words = {"auditor": "감사", "outside_director": "사외이사", "": "이사", None: ""}
    e, g = [], []
    for d in range(150):
        e += [(f"d{d}", f"{i}", rnd.choice(names), rnd.choice(offices)) for i in range(rnd.randint(0, 4))]
        g += [(f"d{d}", f"{i}", f"{words[rnd.choice(offices)]} {rnd.choice(['', 'Kim', 'lee a', '박철수', 'Kimmy'])}  {rnd.choice(['선임', '재선임', '해임', '보고', '후보'])}", rnd.choice([None, [], ["Kim"], ["Lee A (Lee)", "x"]])) for i in range(rnd.randint(0, 4))]
    elections = spark.createDataFrame(e, "acpt_no string, election_ref string, name string, office string")
    agendas = spark.createDataFrame(g, "acpt_no string, agenda_ref string, title string, candidates array<string>")
    got = meetings.match_elections(elections, agendas)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_pairs(elections, agendas).collect()))


def by_pairs(elections, agendas):
    """The same by joins of pairs, step by step."""
    key = lambda c: meetings.name_key(meetings.person_name(c)["name"])
    title = meetings.clean(F.col("title"))
    g = agendas.select("acpt_no", "agenda_ref", title.alias("title"), F.transform(F.coalesce("candidates", F.array().cast("array<string>")), key).alias("keys"), meetings.office_types(title).alias("offices")).filter("title NOT LIKE '%해임%' AND title RLIKE '선임|후보'")
    e = elections.select("acpt_no", "election_ref", meetings.person_name(F.col("name"))["name"].alias("name"), F.coalesce("office", F.lit("")).alias("office")).filter("name <> ''")
    word = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9가-힣]", " "), F.lit(" "))
    holds = F.contains(word("title"), word("name")) & F.contains(F.lower("title"), F.lower("name"))
    named = e.join(g, "acpt_no").filter((F.array_contains("keys", meetings.name_key(F.col("name"))) | holds) & ((F.size("offices") == 0) | F.array_contains("offices", F.col("office"))))
    hits = named.groupBy("acpt_no", "election_ref").agg(F.count("*").alias("n"), F.min("agenda_ref").alias("agenda_ref"))
    own = g.filter("size(offices) = 1 AND size(keys) = 0 AND title LIKE '%선임%'").groupBy("acpt_no", F.get("offices", F.lit(0)).alias("office")).agg(F.count("*").alias("n"), F.min("agenda_ref").alias("agenda_ref")).filter("n = 1")
    alone = e.filter("office <> ''").groupBy("acpt_no", "office").agg(F.count("*").alias("n"), F.min("election_ref").alias("election_ref")).filter("n = 1")
    rest = alone.drop("n").join(own.drop("n"), ["acpt_no", "office"]).join(hits, ["acpt_no", "election_ref"], "left_anti")
    return hits.filter("n = 1").select("acpt_no", "election_ref", "agenda_ref", F.lit("name").alias("by")).unionByName(rest.select("acpt_no", "election_ref", "agenda_ref", F.lit("office").alias("by")))


def test_a_lookup_joins_the_graph_with_what_it_found(spark):
    nodes, edges = queries_records._rights_graph(spark, SF)
    got = graph.investors_like(nodes, edges, "투자 조합7")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # a node that nothing found leads to is in no group: the grouping of nodes stands above their join with what was found
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Aggregate") and got.count() > 0


def test_records_with_their_meta_need_no_join(spark):
    records = spark.createDataFrame([("1", 1, "t", "k", None, [("a", 5)], [("b", 3)], [("Acme", 2), ("-", 1)])], "acpt_no string, position int, title string, kind string, paid_on date, items array<struct<label:string,amount:bigint>>, purposes array<struct<label:string,amount:bigint>>, people array<struct<label:string,amount:bigint>>")
    meta = spark.createDataFrame([("1", "7", "Seven", "s", None)], "acpt_no string, company_id string, company_name string, submitter string, disclosed_on date")
    names = spark.createDataFrame([("ACME", "company_000009")], "name string, company string")
    for apart, whole in zip(build.issuance_graph(records, meta, names, "d"), build.issuance_graph(records.join(meta, "acpt_no"), None, names, "d"), strict=True):
        assert sorted(map(str, apart.collect())) == sorted(map(str, whole.collect())) != []
