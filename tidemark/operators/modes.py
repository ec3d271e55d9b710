"""Parsing by mode: what all records share, the fields that a mode adds, previews, and checks of counts of a filter's result.

docs: (path, title, html), one row a page. The number of a record is its file's name without the ending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html_tables
from . import meeting_tables, rights
from . import records as R

#: How much of a page's tables a preview shows.
MOST_TABLES, MOST_ROWS = 12, 120


def number_of(path: Column) -> Column:
    """The name of a file without its folders and its last ending."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _read(docs: DataFrame, titles: tuple[str, ...] = ()) -> DataFrame:
    """(acpt_no, title, tables, error): the pages with all their tables."""
    return html_tables.read_tables(docs.select(number_of(F.col("path")).alias("acpt_no"), "title", "html"), "acpt_no", "html", titles, keep=("title",))


def _base(mode: str) -> list[Column]:
    lines = lambda t: F.transform(F.filter(t["rows"], lambda cells: F.exists(cells, lambda c: c != "")), T.drop_repeats)
    each = F.transform("tables", lambda t: F.struct(t["table"].alias("index"), lines(t).alias("rows")))
    return [F.col("acpt_no"), F.lit(mode).alias("mode"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.filter(each, lambda t: F.size(t["rows"]) > 0).alias("tables"), F.col("error")]


def base_records(docs: DataFrame, mode: str) -> DataFrame:
    """(acpt_no, mode, title, tables, error): tables as (index, rows), rows without blanks and repeats of the cell before; tables without such rows are left out."""
    return _read(docs).select(*_base(mode))


def _bonds(pages: DataFrame) -> DataFrame:
    return R.bond_fields(pages, None, "page").withColumn("warnings", R.bond_warnings())


def _rights(pages: DataFrame) -> DataFrame:
    return rights.with_warnings(rights.rights_fields(pages, None, "page"))


def _meetings(pages: DataFrame) -> DataFrame:
    phase = F.lower(T.meeting_phase(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", "")))
    pick = lambda items, *names: F.array_sort(F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in names])))
    some = lambda items: F.when(F.size(items) > 0, items)
    found = pages.select("page", "tables", phase.alias("phase")).select(
        "page",
        "phase",
        meeting_tables.date_of("tables", F.col("phase")).alias("meeting_date"),
        R.let(pick(meeting_tables.agendas_of("tables"), "agenda_ref", "number", "title", "candidate", "status"), some).alias("agendas"),
        R.let(pick(meeting_tables.elections_of("tables"), "office", "row", "name", "birth_month", "term"), some).alias("elections"),
        R.let(pick(meeting_tables.changes_of("tables"), "row", "category", "before", "after", "content"), some).alias("purpose_changes"),
    )
    return found


#: What each mode adds to a base record; the last two have tables only, as no fields are known of them.
MODES: dict[str, Callable[[DataFrame], DataFrame] | None] = {"bond_issuance": _bonds, "rights_issuance": _rights, "shareholder_meeting": _meetings, "asset_transaction": None, "security_transaction": None}
#: Modes that find a record in every page.
WHOLE = ("rights_issuance", "shareholder_meeting")


def parse(docs: DataFrame, mode: str) -> DataFrame:
    """Base records with the fields of a mode, as one struct `fields` (null where the mode finds no record). An unknown mode is an error that names all others.

    The base record goes along with its page as the page's id, so a page is read once; pages without a record, which only some modes have, come from a second reading.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode: {mode!r}. supported modes: {', '.join(sorted(MODES))}")
    make = MODES[mode]
    if make is None:
        return base_records(docs, mode)
    read = _read(docs, meeting_tables.SECTIONS if mode == "shareholder_meeting" else ())
    found = make(read.select(F.struct(*_base(mode)).alias("page"), "title", "tables"))
    fields = F.struct(*[F.col(c) for c in found.columns if c != "page"]).alias("fields")
    if mode in WHOLE:
        return found.select("page.*", fields)
    named = found.select(F.col("page.acpt_no").alias("__a"), fields)
    return base_records(docs, mode).join(named, F.col("acpt_no") == F.col("__a"), "left").drop("__a")


def compact_tables(tables: Column) -> Column:
    """(shown, omitted_rows) of tables: the first MOST_TABLES, and of these the first MOST_ROWS rows in all; each shown table tells how many of its rows are left out."""
    def step(acc: Column, t: Column) -> Column:
        room = F.lit(MOST_ROWS) - acc["n"]
        take = F.least(room, F.size(t["rows"]))
        more = (F.size(acc["shown"]) < MOST_TABLES) & (room > 0)
        one = F.struct(t["index"].alias("index"), F.slice(t["rows"], 1, take).alias("rows"), (F.size(t["rows"]) - take).alias("omitted_rows"))
        return F.struct(F.when(more, F.concat(acc["shown"], F.array(one))).otherwise(acc["shown"]).alias("shown"), F.when(more, acc["n"] + take).otherwise(acc["n"]).alias("n"), (acc["all"] + F.size(t["rows"])).alias("all"))

    empty = F.struct(F.array().cast("array<struct<index:int,rows:array<array<string>>,omitted_rows:int>>").alias("shown"), F.lit(0).alias("n"), F.lit(0).alias("all"))
    return F.aggregate(tables, empty, step, lambda acc: F.struct(acc["shown"].alias("shown"), (acc["all"] - acc["n"]).alias("omitted_rows")))


def preview(docs: DataFrame, mode: str, where: Column | None = None, limit: int = 3) -> DataFrame:
    """The first `limit` records by number that pass `where` (over acpt_no, title and fields), with their tables compacted. The limit is what a preview is."""
    found = parse(docs, mode)
    if where is not None:
        found = found.filter(F.coalesce(where, F.lit(False)))
    return found.orderBy("acpt_no").limit(limit).withColumn("source", compact_tables(F.col("tables"))).drop("tables")


def count_identities(result: DataFrame, source_rows: int, offset: int, inspected: int, returned: int, unique: int, complete: bool) -> DataFrame:
    """(rule) that counts of a filter's result break; empty for a sound one. result has acpt_no; one pass over it.

    Rows all have a number, none twice; returned and unique are the rows there are; the offset is within the source; a complete run has inspected all behind it, and no
    run more than that.
    """
    number = F.nullif(F.trim(F.coalesce("acpt_no", F.lit(""))), F.lit(""))
    counts = result.agg(F.count("*").alias("rows"), F.count(number).alias("named"), F.count_distinct(number).alias("distinct"))
    target = source_rows - offset
    rules = {
        "a row has no number": F.col("named") < F.col("rows"),
        "a number comes twice": F.col("distinct") < F.col("named"),
        "returned is not the number of rows": F.col("rows") != returned,
        "unique is not the number of rows": F.col("rows") != unique,
        "the offset is beyond the source": F.lit(offset > source_rows),
        "more inspected than there is": F.lit(inspected > max(target, 0)),
        "complete but not all inspected": F.lit(complete and inspected != target),
        "more returned than inspected": F.col("rows") > inspected,
    }
    return counts.select(F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))).alias("rule"))


def public(rows: DataFrame) -> DataFrame:
    """Rows without the helper columns of filters."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__filter_")])


#: Options of groups that stand for several groups.
GROUP_OPTIONS = {"shareholder_meeting": ("주주총회",), "bond_issuance": ("CB", "EB", "BW"), "rights_issuance": ("유상증자",)}


def in_group(group: Column, option: str = "전체") -> Column:
    """Whether a row's group belongs to the option chosen; all do if all are asked for."""
    chosen = (option or "").strip() or "전체"
    return F.lit(True) if chosen == "전체" else F.coalesce(group.isin(*GROUP_OPTIONS.get(chosen, (chosen,))), F.lit(False))
