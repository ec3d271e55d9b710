"""Listings and records: scans, lookups, rollups and checks over disclosures, codes and parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import merge

#: Fixed value: the name under which all markets are asked for.
ALL_MARKETS = "전체"


def scan_from(rows: DataFrame, year_counts: DataFrame, offset: int) -> DataFrame:
    """Rows in (year, id) order behind the first `offset`. Years that the offset covers are pruned whole by their stored counts."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = year_counts.select("year", "n", before.alias("before")).filter(F.col("before") + F.col("n") > offset)  # a row a year
    part = rows.join(F.broadcast(left.select(F.col("year").alias("__y"), "before")), F.col("year") == F.col("__y"))
    at = F.row_number().over(Window.partitionBy("year").orderBy("id"))
    return part.withColumn("__at", at + F.col("before")).filter(F.col("__at") > offset).select(*rows.columns)


def in_dates(rows: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= day <= end. A row without a day is an error, not a miss, once dates are asked for."""
    if start is None and end is None:
        return rows
    given = F.when(F.coalesce(F.col(day), F.lit("")) == "", F.raise_error(F.lit("a row has no date to filter by")).cast("string")).otherwise(F.col(day))
    where = F.lit(True)
    where = where & (given >= start) if start is not None else where
    return rows.filter(where & (given <= end) if end is not None else where)


def search(rows: DataFrame, *, acpt_nos: DataFrame | None = None, market: str = "", start: str | None = None, end: str | None = None, blocks: Column | None = None, title: Column | None = None, keywords: Column | None = None, exclude: Column | None = None, company: str = "", submitter: str = "") -> DataFrame:
    """The whole filter: ids, market, dates, then blocks or else a title expression or else keywords; excluded
    keywords (which a title expression switches off), company and submitter; one row an acpt_no, newest first."""
    found = rows if acpt_nos is None else rows.join(acpt_nos.select("acpt_no").distinct(), "acpt_no", "left_semi")
    if market and market != ALL_MARKETS:
        found = found.filter(F.col("market") == market)
    found = in_dates(found, "disclosed_date", start, end)
    for first in (blocks, title, keywords):
        if first is not None:
            found = found.filter(first)
            break
    if exclude is not None and title is None:
        found = found.filter(~exclude)
    for column, part in (("company_name", company), ("submitter", submitter)):
        if part:
            found = found.filter(F.contains(T.fold(F.col(column)), F.lit(part.casefold())))
    once = merge.first_row(found, "acpt_no", ["year", "id"])
    return once.orderBy(F.desc("disclosed_at"), F.desc("company_name"), F.desc("title"), "year", "id")


def first_candidate(candidates: DataFrame, rows: DataFrame, key: str, code: str) -> DataFrame:
    """rows of the first candidate code (by `rank`) of each key that has any row."""
    have = candidates.join(rows.select(code).distinct(), code, "left_semi").groupBy(key).agg(F.min_by(code, "rank").alias(code))
    return have.join(rows, code)


def last_lookup(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """left joined to the last right row of each key by position."""
    values = [c for c in right.columns if c not in (key, position)]
    last = right.groupBy(key).agg(F.max_by(F.struct(*values), position).alias("__v")).select(key, *[F.col(f"__v.{c}").alias(c) for c in values])
    return left.join(last, key)


def add_unlisted(found: DataFrame, mapping: DataFrame, code: str, name: str, market: str = ALL_MARKETS) -> DataFrame:
    """found plus the codes of the mapping that have no row, with n = 0; only when all markets are asked for."""
    if market not in ("", ALL_MARKETS):
        return found
    more = mapping.join(found.select(code), code, "left_anti").select(code, name, F.lit(0).cast("long").alias("n"))
    return found.unionByName(more, allowMissingColumns=True)


def page_counts(rows: DataFrame, key: str = "acpt_no", page: str = "page") -> DataFrame:
    """(page, source, written, duplicates): rows of each page, how many keys it is the first to have, and the rows left over.

    Rows that repeat a key on one page are written once. Rows are summed by key and page first, so a hot key is a row a page.
    """
    each = rows.groupBy(key, page).agg(F.count("*").alias("n"))
    first = F.col(page) == F.min(page).over(Window.partitionBy(key))
    counted = each.select(page, "n", first.cast("long").alias("new")).groupBy(page)
    return counted.agg(F.sum("n").alias("source"), F.sum("new").alias("written"), (F.sum("n") - F.sum("new")).alias("duplicates"))


def ordered_union(rows: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """(key, items): the distinct items of all arrays of a key, by first appearance, joined by ", "."""
    each = rows.select(key, order, F.posexplode(items).alias("__p", "__v")).groupBy(key, "__v").agg(F.min(F.struct(order, "__p")).alias("__o"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]), ", ").alias(items))


def page_of(rows: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Rows of one page and, in has_more, whether one follows. One row more than asked for is read."""
    w = Window.orderBy(*order)
    cut = rows.orderBy(*order).limit(page * size + 1)
    seen = cut.withColumn("__r", F.row_number().over(w)).withColumn("has_more", F.max("__r").over(Window.partitionBy(F.lit(1))) > page * size)
    return seen.filter(F.col("__r").between((page - 1) * size + 1, page * size)).drop("__r")


def change_matrix(long: DataFrame, family: str, field: str, version: str, value: str) -> DataFrame:
    """(family, field, versions): for each field its (version, value) in order of versions, however many there are."""
    cells = long.groupBy(family, field, version).agg(F.max(value).alias(value))
    return cells.groupBy(family, field).agg(F.array_sort(F.collect_list(F.struct(F.col(version).alias("version"), F.col(value).alias("value")))).alias("versions"))


def family_members(docs: DataFrame, records: DataFrame, family: str = "family", doc: str = "doc_no") -> DataFrame:
    """docs of families whose members all have a record and that have two at least."""
    known = docs.join(records.select(F.col(doc).alias("__doc")).distinct(), F.col(doc) == F.col("__doc"), "left")
    whole = known.groupBy(family).agg(F.every(F.col("__doc").isNotNull()).alias("all"), F.count("*").alias("members")).filter("all AND members > 1")
    return docs.join(whole.select(family, "members"), family)


def merge_segments(segments: list[tuple[DataFrame, int, int]], key: str = "id") -> DataFrame:
    """Segments (rows, start, end) of one scan as one: each must start where the one before ended, and no key may come twice."""
    for (_, _, end), (_, start, _) in zip(segments, segments[1:], strict=False):
        if end != start:
            raise ValueError(f"a segment starts at {start}, the one before ends at {end}")
    rows = segments[0][0]
    for more, _, _ in segments[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    copies = rows.groupBy(key).agg(F.count("*").alias("n")).select(F.col(key).alias("__k"), "n")
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("segments share "), F.col("__k").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(copies, F.col(key) == F.col("__k")).filter(twice).drop("__k", "n")


def axis_difference(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """(value, side): the values of an axis that one of two tables has and the other lacks."""
    x, y = (t.select(axis).distinct() for t in (a, b))
    return x.join(y, axis, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, axis, "left_anti").withColumn("side", F.lit("right")))


def recomputed(stored: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(key, state): equal, changed, missing or extra, by a hash of each record in canonical field order."""
    digest = lambda t, name: t.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in t.columns if c != key)), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(stored, "a").join(digest(again, "b"), key, "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").otherwise("changed")
    return both.select(key, state.alias("state"))


def integrity(files: DataFrame, manifest: DataFrame, fingerprint: str, key: str = "path") -> DataFrame:
    """(key, state): unverified without an entry of this fingerprint, mismatch when size or digest differ, else verified."""
    known = manifest.filter(F.col("fingerprint") == fingerprint).select(F.col(key).alias("__k"), F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    both = files.join(known, F.col(key) == F.col("__k"), "left")
    same = (F.octet_length("content") == F.col("__size")) & (F.sha2(F.col("content").cast("binary"), 256) == F.col("__sha"))
    return both.select(key, F.when(F.col("__k").isNull(), "unverified").when(same, "verified").otherwise("mismatch").alias("state"))


def stamp_ok(c: Column) -> Column:
    """Whether a text is a day and a minute, both of which exist."""
    return F.coalesce(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")).isNotNull(), F.lit(False))
