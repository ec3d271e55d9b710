"""Intervals: gaps and islands, point lookup, connectivity, close joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, date: str, value: str, order: str | None = None) -> DataFrame:
    """(key, value, start_date, end_date) of runs of equal values. Nulls are skipped and split no run; of a
    date the last row by `order` counts; a run ends the day before the next starts, the last one at its last date."""
    latest = rows.filter(F.col(value).isNotNull()).groupBy(key, date).agg(F.max_by(value, F.col(order or value)).alias(value))
    w = Window.partitionBy(key).orderBy(date)
    before = F.lag(value).over(w)
    marked = latest.withColumn("__new", (before.isNull() | (before != F.col(value))).cast("int"))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__run").agg(F.first(value).alias(value), F.min(date).alias("start_date"), F.max(date).alias("__last"))
    after = F.lead("start_date").over(Window.partitionBy(key).orderBy("__run"))
    return runs.select(key, value, "start_date", F.coalesce(F.date_sub(after, 1), F.col("__last")).alias("end_date"))


def value_at(intervals: DataFrame, probes: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """probes with the value of the interval that holds their date; the latest start wins; no interval, no row."""
    hit = probes.join(intervals, key).filter(F.col(date).between(F.col("start_date"), F.col("end_date")))
    return hit.groupBy(key, date).agg(F.max_by(value, F.struct("start_date", "end_date")).alias(value))


def connected(ranges: DataFrame, key: str) -> DataFrame:
    """(key, ranges, connected): whether a key's date ranges leave no gap of more than a day."""
    w = Window.partitionBy(key).orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.datediff("start_date", F.max("end_date").over(w)) > 1
    return ranges.withColumn("__gap", F.coalesce(gap, F.lit(False))).groupBy(key).agg(F.count("*").alias("ranges"), (~F.bool_or("__gap")).alias("connected"))


def close_open(starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """starts (keys, start_date) closed by the earliest later end (keys, end_date); is_active where none is."""
    both = starts.select(*keys, F.col("start_date").alias("d"), F.lit(1).alias("k")).unionByName(ends.select(*keys, F.col("end_date").alias("d"), F.lit(0).alias("k")))
    # days run backwards and of one day starts come first, so an end closes only starts of days before it and the frame only grows
    back = Window.partitionBy(*keys).orderBy(F.desc("d"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("end_date", F.min(F.when(F.col("k") == 0, F.col("d"))).over(back)).filter("k = 1")
    return out.select(*keys, F.col("d").alias("start_date"), "end_date", F.col("end_date").isNull().alias("is_active"))
