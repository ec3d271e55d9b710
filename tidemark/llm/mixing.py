"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k drawn from a Poisson distribution whose mean is the
source's target share over its present share. The draw inverts the distribution at a hash of seed and
document id, so it is the same on every run and machine. Copies are exploded and shuffled globally by
hash. Defined cases: a null source is a source; a null id draws as the text "null"; rows that repeat an
id get equal counts; a source without a target keeps mean 1; means above 16 are sums of equal parts, so
no probability underflows; an empty table gives an empty table; a column `copy` of docs
is replaced, other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import join_by_weight, read

PART = 16.0
TERMS = 80
MOST_SOURCES = 100_000


def uniform(seed: int, ident: Column, part: Column) -> Column:
    """A hash in [0, 1) from 52 bits of an md5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null")), part.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, targets: dict[str, float] | None, alpha: float, source_col: str) -> DataFrame:
    """(key, mean, n): the mean repetition of each source, from counts over all documents.

    targets: share of the mix by source. None: shares proportional to the source's size to the power alpha.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    sizes = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    if targets is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
        sums = sizes.agg(F.sum("n").alias("n"), F.sum(share).alias("w")).first()
        return sizes.select("key", "n", (share / F.lit(float(sums["w"] or 1)) * F.lit(float(sums["n"] or 0)) / F.col("n")).alias("mean"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.lit(None).cast("double")
    for s, w in targets.items():
        share = F.when(F.col("key") == f"s{s}", F.lit(float(w))).otherwise(share)
    return sizes.select("key", "n", F.coalesce(share * F.lit(float(total)) / F.col("n"), F.lit(1.0)).alias("mean"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs repeated, with `copy` counting from 1, in a global random order.

    The per-source table is broadcast while its counted rows stay below MOST_SOURCES, else joined with
    hot sources kept apart. The one large shuffle deals copies out by a hash of id and copy, so a hot
    source or a much repeated document spreads over all tasks; order within a task follows another hash.
    """
    means = rates(docs, targets, alpha, source_col)
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("mean") / PART).cast("double"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-F.col("l")).alias("p"), F.exp(-F.col("l")).alias("c"), F.array(F.exp(-F.col("l"))).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("l") / k).alias("p"), (a["c"] + a["p"] * F.col("l") / k).alias("c"), F.concat(a["cdf"], F.array(a["c"] + a["p"] * F.col("l") / k)).alias("cdf")),
    )
    means = means.withColumn("parts", parts.cast("int")).withColumn("l", F.col("mean") / F.col("parts")).select("key", "n", "parts", step["cdf"].alias("cdf"))
    names = [c for c in docs.columns if c != "copy"]
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("__doc"), F.col(id_col).alias("__id"), key.alias("__key"), F.monotonically_increasing_id().alias("__place"))
    means = means.select(F.col("key").alias("__of"), "n", F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    if means.count() <= MOST_SOURCES:
        found = keyed.join(F.broadcast(means.drop("n")), F.col("__key") == F.col("__of"), "left")
    else:
        found = join_by_weight(keyed, means.withColumnRenamed("__of", "__key"), "__key", "n")
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: uniform(seed, F.col("__id"), j))
    count = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("__cdf", lambda c: c < u)))
    copies = found.withColumn("__k", count).filter("__k > 0").select("__doc", "__id", "__place", F.explode(F.sequence(F.lit(1), F.col("__k"))).alias("copy"))
    dealt = copies.repartition(F.xxhash64(F.lit(seed), F.col("__id"), F.col("copy"), F.col("__place")))
    return dealt.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), F.col("__id"), F.col("copy"), F.col("__place"))).select("__doc.*", "copy")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), means AS (
  SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS mean FROM sizes
), parts AS (
  SELECT source, greatest(1, ceil(mean / 16))::INT AS m, mean / greatest(1, ceil(mean / 16)) AS l FROM means
), cdf AS (
  SELECT source, m, l, 0 AS k, exp(-l) AS p, exp(-l) AS c FROM parts
  UNION ALL
  SELECT source, m, l, k + 1, p * l / (k + 1), c + p * l / (k + 1) FROM cdf WHERE k < 80
), draws AS (
  SELECT d.doc_id, d.source, j.j, ('0x' || substr(md5('7:' || d.doc_id || ':' || j.j), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.m + 1)) AS j) j
), counts AS (
  SELECT w.doc_id, w.source, count(c.k) AS n FROM draws w
  LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM w.source AND c.c < w.u GROUP BY ALL
)
SELECT d.*, x.copy::INT AS copy FROM documents d JOIN counts c USING (doc_id), LATERAL (SELECT unnest(range(1, c.n + 1)) AS copy) x
"""
