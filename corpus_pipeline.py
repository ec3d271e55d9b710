"""From raw documents to a training mix: five operators, each on what the one before kept.

toxicity rejects documents, line dedup rewrites texts, the n-gram join keeps the smallest id of each
group of near copies, decontamination drops documents that hold benchmark items, mixing repeats what is
left to target weights. STAGES is the order; each stage takes (spark, docs, sf_dir) and returns the
columns of docs (mixing adds `copy`). run() stores each stage's result in the shared folder and deletes what the stage stored on the way.

Defined cases: null and empty texts pass every stage (they are scored by the prior of the toxicity
model); the join and decontamination decide by row, so a null doc_id or one that is shared is judged by its
text alone; rows of equal text are copies of each other, and of a group the row of the smallest doc_id stays (of equal ids, that
of the smallest hash of the whole row; null ids last); extra columns of any name pass through, but for `copy`,
which mixing replaces; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from tidemark.llm._spark import durable, read, release, settled

REJECT_AT = 0.3
MOST_BROADCAST = 400_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("__doc"))
    return toxicity.toxicity(rows, model, ["__doc"]).filter(F.col("__score") < REJECT_AT).select("__doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """(__row, __doc): a key of each row and its columns as one value, stored so that the key stays and no name clashes."""
    return durable(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[docs[c] for c in docs.columns]).alias("__doc")), name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs, "rows")
    texts = rows.select(F.col("__row").alias("doc_id"), F.col("__doc.text").alias("text"))
    groups = ngram_join.jaccard_components(texts)
    linked = durable(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__member"), F.col("component_id").alias("__group")), "linked")
    members = linked.unionByName(linked.select(F.col("__group").alias("__member"), "__group").distinct())
    key = F.struct(F.col("__doc.doc_id").isNull().alias("none"), F.col("__doc.doc_id").alias("id"), F.xxhash64("__doc").alias("hash"), "__row")
    few = linked.count() <= MOST_BROADCAST
    named = rows.join(F.broadcast(members) if few else members, F.col("__row") == F.col("__member")).select("__row", "__group", key.alias("__key"))
    named = durable(named, "named")
    first = named.groupBy("__group").agg(F.min("__key").alias("m")).select(F.col("m.__row").alias("__row"))
    gone = durable(named.join(first, "__row", "left_anti").select(F.col("__row").alias("__gone")), "copies")
    release(linked, named)
    kept = rows.join(F.broadcast(gone) if few else gone, F.col("__row") == F.col("__gone"), "left_anti")
    return kept.select("__doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs, "rows").select("__row", "__doc", F.col("__doc.text").alias("text"))
    return decontam.decontaminate(rows, read(spark, sf_dir, "benchmark"), "__row").select("__doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: Training and the parity join have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        last = i + 1 == len(STAGES)
        docs = (stage if last else settled(stage))(spark, docs, sf_dir)
        if before is not None and not last:
            release(before)
        before = docs
    return docs
