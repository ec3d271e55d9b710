"""Restartable stages: a stage keeps a manifest of what it has read, and a second run rewrites only what has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import replace_tables


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fingerprints(source: DataFrame, part: str) -> DataFrame:
    """(part, rows, digest): what each part of a table holds, whatever the order of its rows. One pass with partial sums.

    The digest is the sum of two 64-bit hashes a row, so repeated rows count, where an xor would lose each second one.
    """
    columns = sorted(source.columns)
    sums = [F.sum(F.xxhash64(F.lit(i), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns]).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return source.groupBy(F.col(part).cast("string").alias("part")).agg(F.count("*").alias("rows"), F.concat_ws(":", *sums).alias("digest"))


def refresh(source: DataFrame, part: str, make: Callable[[DataFrame], DataFrame], target: str, version: str = "1") -> dict[str, list[str]]:
    """Brings target up to date with make(source), by part; make must keep the column `part` and work within one.

    Parts whose rows, or whose `version` of make, differ from the manifest's are made again and replace their folders; parts that the source
    lacks go; all others are neither read by make nor written. The manifest follows last, so a run that dies on the way is made good by the next.
    Returns the names of the parts written, removed and kept: as many as there are parts, by contract few (years, buckets).
    """
    spark = source.sparkSession
    manifest = f"{target}_manifest"
    now = fingerprints(source, part).withColumn("version", F.lit(version))
    old = spark.read.parquet(manifest) if _there(spark, manifest) else now.limit(0)
    key = lambda t: {r["part"]: (r["rows"], r["digest"], r["version"]) for r in t.collect()}
    have, was = key(now), key(old)
    changed = [p for p, v in have.items() if was.get(p) != v]
    gone = [p for p in was if p not in have]
    if changed:
        named = [p for p in changed if p is not None]
        some = F.col(part).cast("string").isin(*named)
        if None in changed:
            some = some | F.col(part).isNull()
        made = make(source.filter(some))
        made.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(target)
    for p in gone:
        _delete(spark, f"{target}/{part}={'__HIVE_DEFAULT_PARTITION__' if p is None else p}")
    if changed or gone:
        fresh = f"{manifest}_{uuid.uuid4().hex}"
        spark.createDataFrame([(p, *v) for p, v in have.items()], "part string, rows long, digest string, version string").coalesce(1).write.parquet(fresh)
        replace_tables(spark, {manifest: fresh})
    order = lambda names: sorted(names, key=lambda p: (p is None, p))
    return {"written": order(changed), "removed": order(gone), "kept": order(set(have) - set(changed))}


def company_artifact(rows: DataFrame) -> DataFrame:
    """One row a company: name, code, market, how many disclosures, the first and the last, all of them in order, and its bucket.

    rows: (company_key, company_name, company_id, market, disclosed_at, acpt_no, title). The name, code and market are those of the last disclosure. A company's
    disclosures are one value here by contract, so that a panel reads a company in one row.
    """
    each = F.struct("disclosed_at", "acpt_no", "title")
    last = lambda c: F.max_by(c, each).alias(c)
    out = rows.groupBy("company_key").agg(last("company_name"), last("company_id"), last("market"), F.count("*").alias("disclosure_count"), F.min("disclosed_at").alias("first_disclosed_at"), F.max("disclosed_at").alias("last_disclosed_at"), F.array_sort(F.collect_list(each)).alias("disclosures"))
    return out.withColumn("bucket", company_bucket(F.col("company_key")))


def company_bucket(key, buckets: int = 64):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def refresh_companies(rows: DataFrame, target: str) -> dict[str, list[str]]:
    """The artifact of companies, in buckets by key; only buckets whose rows have changed are written."""
    return refresh(rows.withColumn("bucket", company_bucket(F.col("company_key"))), "bucket", company_artifact, target)


def company_list(spark: SparkSession, target: str) -> DataFrame:
    """The index: all companies without their disclosures, which the scan leaves out."""
    return spark.read.parquet(target).drop("disclosures", "bucket")


def one_company(spark: SparkSession, target: str, key: str) -> DataFrame:
    """One company in full. Its bucket is worked out first, so that one folder is read."""
    bucket = spark.range(1).select(company_bucket(F.lit(key))).first()[0]
    return spark.read.parquet(target).filter((F.col("bucket") == bucket) & (F.col("company_key") == key)).drop("bucket")
