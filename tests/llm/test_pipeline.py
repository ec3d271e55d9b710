import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_models import brute_components
from tidemark.llm._spark import read, star_round


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        out[name] = (docs, new)
        docs = new
    return out


def test_stages_keep_their_columns(spark, stages):
    columns = read(spark, SF, "documents").columns
    for name, (_, new) in list(stages.items())[:-1]:
        assert new.columns == columns and new.count() > 0, name
    assert set(columns) < set(stages["source_mixing"][1].columns)


def test_each_stage_decides(spark, stages):
    labels = read(spark, SF, "labels")
    before, after = stages["toxicity"]
    clean = before.join(labels.filter("toxic = 0"), "doc_id", "left_semi")
    assert after.join(labels.filter("toxic = 1"), "doc_id", "left_semi").count() <= 1
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    before, after = stages["ngram_jaccard_join"]
    groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in groups.items() if i == c}
    before, after = stages["benchmark_decontamination"]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    holding = {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
    assert holding <= gone
    before, after = stages["line_dedup"]
    assert before.count() == after.count() and after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_rows_are_judged_apart_from_their_ids(spark):
    rnd = random.Random(3)
    one, two, three = (" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(3))
    item = read(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(5, one), (3, one), (5, two), (None, two), (None, three), (5, item), (None, item), (6, three), (7, "short"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, one), (5, two), (5, item), (6, three), (7, "short")])
    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if r.text != item)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_round_of_components_has_five_shuffles(spark):
    pairs = spark.createDataFrame([(9, 1), (9, 2), (8, 9), (8, 7), (7, 2), (5, 4)], "u long, v long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = star_round(pairs)
        plan = new._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in new.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in plan.split("\n") if " Exchange " in x and "Reused" not in x]) == 5
    assert len(rows) == len(set(rows)) and all(u > v for u, v in rows) and brute_star(rows) == brute_star([(9, 1), (9, 2), (8, 9), (8, 7), (7, 2), (5, 4)])


def brute_star(edges):
    name = {x: x for e in edges for x in e}
    while any(name[a] != name[b] for a, b in edges):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    return name
