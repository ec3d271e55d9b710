"""Merging of overlapping value sets in long form (code, date, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag(frames: list[DataFrame]) -> DataFrame:
    """Frames in one, with their place as `source`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)])


def conflicts(tagged: DataFrame) -> DataFrame:
    """(code, date, n_values) of cells with more than one value. min <> max finds them without a distinct."""
    w = tagged.filter("value IS NOT NULL").groupBy("code", "date").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.collect_set("value").alias("s"))
    return w.filter("a <> b").select("code", "date", F.size("s").cast("long").alias("n_values"))


def coalesce_merge(tagged: DataFrame) -> DataFrame:
    """(code, date, value), an error if any cell has two values."""
    cells = tagged.groupBy("code", "date").agg(F.min("value").alias("value"), F.max("value").alias("__b"))
    same = F.when(F.col("value").eqNullSafe(F.col("__b")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("conflicting values: "), F.col("code"), F.lit(" "), F.col("date").cast("string"))).cast("double"))
    return cells.select("code", "date", same.alias("value"))


def last_non_null(tagged: DataFrame) -> DataFrame:
    """(code, date, value): the value of the last source that has one."""
    full = F.col("value").isNotNull()
    return tagged.groupBy("code", "date").agg(F.max_by(F.when(full, F.col("value")), F.when(full, F.col("source"))).alias("value"))


def last_row(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__r = 1").drop("__r")


def first_row(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, and how many it had as `n_rows`."""
    w = Window.partitionBy(key)
    return rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("n_rows", F.count("*").over(w)).filter("__r = 1").drop("__r")


def containment(tagged: DataFrame) -> DataFrame:
    """(a, b, relation) of sources: equal, a_in_b, b_in_a, overlap or conflict, for sources that share a cell.

    One grouping by cell; the pairs are of sources, not of rows. Sources number few (files of an account).
    """
    sizes = tagged.groupBy("source").agg(F.count("value").alias("n"))
    cells = tagged.filter("value IS NOT NULL").groupBy("code", "date").agg(F.array_sort(F.collect_set(F.struct("source", "value"))).alias("s"))
    left = cells.select(F.explode("s").alias("x"), "s").select(F.col("x.source").alias("a"), F.col("x.value").alias("v"), F.explode("s").alias("y")).filter("a < y.source")
    shared = left.groupBy("a", F.col("y.source").alias("b")).agg(F.count("*").alias("common"), F.count_if(F.col("v") != F.col("y.value")).alias("different"))
    na, nb = (sizes.select(F.col("source").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    full = shared.join(na, "a").join(nb, "b")
    a_in, b_in = F.col("common") == F.col("n_a"), F.col("common") == F.col("n_b")
    kind = F.when(F.col("different") > 0, F.lit("conflict")).when(a_in & b_in, F.lit("equal")).when(a_in, F.lit("a_in_b")).when(b_in, F.lit("b_in_a")).otherwise(F.lit("overlap"))
    return full.select("a", "b", "common", "different", kind.alias("relation"))


def gaps(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(date, missing): dates that lack some code. Counts per date against the number of codes: no cross join."""
    total = codes.select("code").distinct().agg(F.count("*").alias("__n"))
    return rows.groupBy("date").agg(F.count_distinct("code").alias("__c")).join(F.broadcast(total)).filter("__c < __n").select("date", (F.col("__n") - F.col("__c")).alias("missing"))


def account_quality(rows: DataFrame) -> DataFrame:
    """One row: non-null cells, cells of the full grid, missing share to six digits."""
    sums = rows.agg(F.count("value").alias("non_null"), (F.count_distinct("date") * F.count_distinct("code")).alias("total"))
    return sums.withColumn("missing_ratio", F.round(F.lit(1) - F.try_divide("non_null", "total"), 6))
