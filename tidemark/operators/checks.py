"""Integrity checks, record filters, rollups and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(issue, key): keys missing from actual, unexpected in it, or repeated in it. One full join of counts."""
    a = expected.select(F.col(key).alias("__k")).distinct()
    b = actual.groupBy(F.col(key).alias("__k2")).agg(F.count("*").alias("n"))
    both = a.join(b, F.col("__k") == F.col("__k2"), "full")
    issue = F.when(F.col("__k2").isNull(), F.lit("missing")).when(F.col("__k").isNull(), F.lit("unexpected")).when(F.col("n") > 1, F.lit("duplicate"))
    return both.select(issue.alias("issue"), F.coalesce("__k", "__k2").alias(key)).filter("issue IS NOT NULL")


def record_filter(field: Column, operator: str, value: str | list[str] | None = None) -> Column:
    """contains, equals, in or exists on a parsed field; arrays and structs compare by their JSON text."""
    text = F.coalesce(field, F.lit(""))
    if operator == "exists":
        return text != ""
    if operator == "equals":
        return text == value
    if operator == "contains":
        return text.contains(value)
    if operator == "in":
        return text.isin(list(value or []))
    raise ValueError(f"unknown operator {operator}")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as record_filter reads it."""
    kind = dict(df.dtypes)[name]
    return F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(name).cast("string")


def rollup(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, n, share): counts of a level and its share of the level above."""
    per = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    total = per.groupBy(outer).agg(F.sum("n").alias("total"))
    return per.join(total, outer).select(outer, inner, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in the order of a hash of seed and key: the same ones however the table is laid out."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def range_preset(end: Column, first: Column, days: int | None, floor: Column) -> Column:
    """First day shown: `days` back from the end and not before the floor; all days: the earliest row, if that is earlier."""
    if days is None:
        return F.least(floor, first)
    return F.greatest(F.date_sub(end, days - 1), floor)


def segments(parts: list[DataFrame], key: str) -> DataFrame:
    """Consecutive parts of a scan in one; a key that two parts hold is an error."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    overlap = tagged.groupBy(key).agg(F.count_distinct("__part").alias("n")).filter("n > 1").limit(1).count()
    if overlap:
        raise ValueError("segments overlap")
    return tagged.drop("__part")


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, empty) by field."""
    sums = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in fields])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), (F.col("__n") - F.col(f)).alias("empty")) for f in fields])))
