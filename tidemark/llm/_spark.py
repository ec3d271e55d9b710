"""Shared helpers: durable intermediate tables, joins on hot keys, components."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() also folds other alphabets)."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the session names none, a temporary folder serves a session that runs in one process, as in tests;
    any other session is refused, as its executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master or 'this session'} needs a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    if _open:
        _open[-1].append(out)
    return out


#: Tables stored by the queries that run now, the innermost last.
_open: list[list[DataFrame]] = []


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Stores the result of `query` and deletes every other table that it stored on the way."""

    @functools.wraps(query)
    def run(*args, **kwargs) -> DataFrame:
        _open.append([])
        try:
            out = durable(query(*args, **kwargs), query.__name__)
        finally:
            made = _open.pop()
        release(*made[:-1])
        if _open:
            _open[-1].append(out)
        return out

    return run


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, and let Spark drop shuffle files nothing refers to."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def join_by_weight(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", most: int = 5000) -> DataFrame:
    """Equi-join left to right (one row a key) where one key may hold a large share of left.

    right carries in `weight` how many rows of left its key has (or more). Keys with at least 1/most of
    all weight are at most `most`, so they are broadcast; the rest go through a shuffle join in which no
    key has more than that share. how: left or inner. Null keys match nothing. left is read twice, so it
    should be a stored table.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first()["t"]
    cut = max(200, int(total) // most)
    payload = [c for c in right.columns if c not in (key, weight)]
    heavy = right.filter(F.col(weight) >= cut).select(F.col(key).alias("__k"), F.struct(*payload).alias("__p"))
    light = right.filter(F.col(weight) < cut).select(F.col(key).alias("__k2"), F.struct(*payload).alias("__p2"))
    hot = left.join(F.broadcast(heavy), F.col(key) == F.col("__k"), "left")
    done = hot.filter(F.col("__k").isNotNull()).select(*[left[c] for c in left.columns], *[F.col(f"__p.{c}").alias(c) for c in payload])
    rest = hot.filter(F.col("__k").isNull()).select(*[left[c] for c in left.columns])
    rest = rest.join(light, F.col(key) == F.col("__k2"), how).select(*[F.col(c) for c in left.columns], *[F.col(f"__p2.{c}").alias(c) for c in payload])
    return done.unionByName(rest)


def star_round(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v after a large-star and a small-star step. Rows that both steps repeat are dropped once, at the end: each edge
    gives one row at most, and minima need no distinct rows, so a round has five shuffles."""
    both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.join(least, F.col("u") == F.col("k")).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    small = large.join(low, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) with component the smallest node reachable, for every node of an edge.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node hooks its larger
    neighbours to its smallest one. A round is one job, its edges written to the shared folder; it ends when a round
    leaves count and checksum of the edges as they were. Nothing is collected; hot nodes are in
    joins, which adaptive execution splits, and in minima, which are summed up before the shuffle.
    """
    last, before = None, None
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    for _ in range(rounds):
        seen = Observation()
        pairs = durable(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "cc")
        if last is not None:
            release(last)
        now = (seen.get["n"], seen.get["x"])
        if now == before or not now[0]:
            break
        last, before = pairs, now
        pairs = star_round(pairs)
    else:
        raise RuntimeError("components did not settle")
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
