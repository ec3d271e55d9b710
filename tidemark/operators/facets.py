"""Searches and counts over disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def filter_disclosures(rows: DataFrame, where: Column, newest_first: tuple[str, ...] = ("disclosed_at", "company_name", "title")) -> DataFrame:
    """Rows that match, one for each acpt_no (the first by year and id), with `rank` in result order."""
    match = rows.filter(where)
    once = match.withColumn("__r", F.row_number().over(Window.partitionBy("acpt_no").orderBy("year", "id"))).filter("__r = 1").drop("__r")
    return once.orderBy(*[F.desc(c) for c in newest_first], "year", "id")


def title_facet(rows: DataFrame) -> DataFrame:
    """(title, disclosures): distinct acpt_no by title in each year, summed over years; blank titles are left out."""
    per_year = rows.groupBy("year", F.col("title")).agg(F.count_distinct("acpt_no").alias("n"), F.min("id").alias("first"))
    return per_year.groupBy(T.strip(F.col("title")).alias("title")).agg(F.sum("n").alias("disclosures"), F.min(F.struct("year", "first")).alias("__f")).filter("title <> ''").orderBy("__f").drop("__f")


def company_search(rows: DataFrame, keyword: str = "", market: str = "", limit: int = 30) -> DataFrame:
    """Companies by count: (company_id, company_name, market, n, first, last)."""
    low = keyword.strip().lower()
    match = rows
    if low:
        match = match.filter(F.lower("company_name").contains(low) | F.lower("company_id").contains(low))
    if market:
        match = match.filter(F.col("market") == market)
    out = match.groupBy("company_id", "company_name", "market").agg(F.count("*").alias("n"), F.min("disclosed_date").alias("first"), F.max("disclosed_date").alias("last"))
    return out.orderBy(F.desc("n"), "company_name", "company_id").limit(max(1, limit))


def company_classification(rows: DataFrame) -> DataFrame:
    """One row a company: first non-empty name and market, first and last date, distinct titles in order of appearance."""
    order = F.struct("year", "id")
    some = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), order))
    titles = rows.groupBy("company_id", "title").agg(F.min(order).alias("o")).groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "title"))), lambda x: x["title"]), ", ").alias("titles"))
    base = rows.groupBy("company_id").agg(some("company_name").alias("company_name"), some("market").alias("market"), F.count("*").alias("n"), F.min("disclosed_date").alias("first"), F.max("disclosed_date").alias("last"))
    return base.join(titles, "company_id")


def group_counts(rows: DataFrame, group: Column, name: str = "group") -> DataFrame:
    return rows.groupBy(group.alias(name)).agg(F.count("*").alias("n"))


def facet_with_samples(rows: DataFrame, value: str, position: str, k: int = 3) -> DataFrame:
    """(value, n, samples): counts and the first k positions of each. Ranks are cut before anything is collected."""
    rank = F.row_number().over(Window.partitionBy(value).orderBy(position))
    first = rows.withColumn("__r", rank).filter(F.col("__r") <= k).groupBy(value).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", position))), lambda x: x[position].cast("string")), ",").alias("samples"))
    return rows.groupBy(value).agg(F.count("*").alias("n")).join(first, value)


def resume(rows: DataFrame, seq: str, offset: int, where: Column) -> DataFrame:
    """(inspected, matched, cursor) of the part of a scan behind `offset`; seq is stored, so files are pruned by it."""
    rest = rows.filter(F.col(seq) > offset)
    return rest.agg(F.count("*").alias("inspected"), F.count_if(where).alias("matched"), F.coalesce(F.max(seq), F.lit(offset)).alias("cursor"))


def reconcile(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(year, expected, actual, ok): stored counts against counted ones, from both sides."""
    actual = rows.groupBy("year").agg(F.count("*").alias("actual"))
    both = manifest.join(actual, "year", "full").na.fill(0, ["expected", "actual"])
    return both.select("year", "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def unique_titles(rows: DataFrame, text: Column, position: str) -> DataFrame:
    """Distinct cleaned titles with the position where each first appears."""
    return rows.select(T.collapse_spaces(T.clean_search(text)).alias("title"), position).filter("title <> ''").groupBy("title").agg(F.min(position).alias("first"), F.count("*").alias("n"))
