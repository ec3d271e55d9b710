"""Versions in correction families: latest only, consecutive differences and their weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def families(items: DataFrame, docs: str = "docs") -> DataFrame:
    """items (family, docs: array of doc numbers) kept if every doc is known and there are two or more: rows (family, doc_no, sequence, members)."""
    rows = items.select("family", F.size(docs).alias("members"), F.posexplode(docs).alias("sequence", "doc_no"))
    return rows.filter("members >= 2")


def resolve(members: DataFrame, known: DataFrame) -> DataFrame:
    """Families of which each doc_no is known; one missing member discards the family."""
    hit = members.join(known.select("doc_no", F.lit(True).alias("__found")).distinct(), "doc_no", "left")
    whole = F.min(F.coalesce("__found", F.lit(False))).over(Window.partitionBy("family"))
    return hit.withColumn("__whole", whole).filter("__whole").drop("__whole", "__found")


def latest_only(rows: DataFrame, sequence: str = "current_sequence", members: str = "family_member_count") -> DataFrame:
    """The last of each family; rows without a family stay."""
    return rows.filter(F.col(members).isNull() | F.col(sequence).isNull() | (F.col(sequence) == F.col(members) - 1))


def changes(rows: DataFrame, family: str, order: list[str], fields: list[str]) -> DataFrame:
    """(family, version, field, before, after) for fields that differ from the version before; compared as text, null-safe."""
    w = Window.partitionBy(family).orderBy(*order)
    pairs = [F.struct(F.lit(f).alias("field"), F.lag(F.col(f).cast("string")).over(w).alias("before"), F.col(f).cast("string").alias("after")) for f in fields]
    seen = rows.select(family, F.row_number().over(w).alias("version"), F.array(*pairs).alias("all")).filter("version > 1")
    return seen.select(family, "version", F.inline("all")).filter(~F.col("before").eqNullSafe(F.col("after")))


def is_major(field: Column, before: Column, after: Column, days: dict[str, int], percents: dict[str, float], never: tuple[str, ...] = ("회차",)) -> Column:
    """Whether a change counts: dates must move by more than `days`, numbers by more than `percents` of the new value."""
    out = ~before.eqNullSafe(after) & ~field.isin(*never) if never else ~before.eqNullSafe(after)
    for name, most in days.items():
        near = F.abs(F.datediff(T.find_date(before), T.find_date(after))) <= most
        out = out & ~((field == name) & F.coalesce(near, F.lit(False)))
    for name, most in percents.items():
        a, b = T.find_number(before), T.find_number(after)
        near = F.when(b == 0, a == b).otherwise(F.abs(F.try_divide(b - a, b)) * 100 <= most)
        out = out & ~((field == name) & F.coalesce(near, F.lit(False)))
    return out


def change_log(diffs: DataFrame, family: str, major: dict[str, bool], days: dict[str, int], percents: dict[str, float]) -> DataFrame:
    """(family, version, changed_fields, major_fields, severity)."""
    table = F.col("field").isin(*[k for k, v in major.items() if v])
    weight = table & is_major(F.col("field"), F.col("before"), F.col("after"), days, percents)
    out = diffs.groupBy(family, "version").agg(F.count("*").alias("changed_fields"), F.count_if(weight).alias("major_fields"))
    return out.withColumn("severity", F.when(F.col("major_fields") > 0, F.lit("major")).otherwise(F.lit("minor")))
