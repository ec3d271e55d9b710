"""Meetings out of table grids: structured agendas, elections, the date, changes of purpose, notes of corrections; and names by what stands before them.

rows: documents of html_tables.read_tables with SECTIONS as titles, each answered where it is, or rows of explode_titled (id, table, row, cells, title, spanned, corrects),
which are brought together by document first. The columns *_of say the same of one document's tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import html_tables
from . import records as R
from .meetings import clean

#: Titles of sections of elections with the office elected, that of changes of purpose, and labels of dates by phase.
ELECTIONS = {"이사선임 세부내역": "director", "사외이사선임 세부내역": "outside_director", "감사선임 세부내역": "auditor", "감사위원선임 세부내역": "audit_committee_member"}
PURPOSES = "사업목적 변경 세부내역"
SECTIONS = (*ELECTIONS, PURPOSES)
DATE_LABELS = {"result": ("주주총회일자", "주주총회일자(시간)"), "notice": ("일시", "주주총회예정일", "주주총회예정일자")}
NOTE_LABEL = "기타투자판단에참고할사항"
_NO_NAME = r"^(?:-|성명|해당(?:사항)?없음|(?:후보자?)?(?:미정|미확정)|(?:후보자?|선임)?예정(?:자)?)$"
_NO_AGENDA = r"^(?:-|해당(?:사항)?없음|없음|미정|미확정|추후(?:결정|확정))$"
_DATE = r"(?U)((?:19|20)\d{2})\s*[년./-]\s*(\d{1,2})\s*[월./-]\s*(\d{1,2})\s*일?"


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\[\]【】「」]", "")


def _row_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(c), r"(?U)^\s*\d+\s*[.)]\s*", ""), r"(?U)\s+", "")


def _heads(cells: Column) -> Column:
    return F.transform(cells, _compact)


def _cell(heads: Column, cells: Column, name: str, nth: int = 1) -> Column:
    """The cell under the nth column of a name; null without one."""
    if nth == 1:
        return F.get(cells, F.array_position(heads, name).cast("int") - 1)
    places = F.filter(F.transform(heads, lambda h, i: F.when(h == name, i)), lambda i: i.isNotNull())
    return F.get(cells, F.get(places, F.lit(nth - 1)))


def _documents(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, tables): documents of read_tables as they are, or rows of explode_titled brought together by document."""
    return rows.select(id_col, "tables") if "tables" in rows.columns else html_tables.gather_tables(rows.filter("error IS NULL"), id_col)


def _listed(docs: DataFrame, id_col: str, found: Column) -> DataFrame:
    """One row for each struct that is found in a document."""
    return docs.select(id_col, F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select(id_col, "x.*")


def _headed(tables: str, *names: str, titles: tuple[str, ...] = ()) -> Column:
    """Tables outside of corrections, behind one of the titles if there are any, whose first row (`first`, compact) has all the names."""
    plain = F.filter(tables, lambda t: F.coalesce(~t["corrects"], F.lit(False)) & (F.coalesce(t["title"].isin(*titles), F.lit(False)) if titles else F.lit(True)))
    told = F.transform(plain, lambda t: F.struct(t["title"].alias("title"), t["spanned"].alias("spanned"), t["rows"].alias("rows"), _heads(F.get(t["rows"], 0)).alias("first")))
    return F.filter(told, lambda t: reduce(lambda a, b: a & b, [F.array_contains(t["first"], n) for n in names]))


def agendas_of(tables: str) -> Column:
    """The structured agendas of a document's tables, as an array."""

    def read(t: Column) -> Column:
        first, second = t["first"], _heads(F.get(t["rows"], 1))
        grouped = t["spanned"] & (F.size(t["rows"]) > 1)
        merged = R.let(second, lambda below: F.transform(first, lambda h, i: F.when((F.coalesce(F.get(below, i), F.lit("")) != "") & (F.get(below, i) != h), F.get(below, i)).otherwise(h)))

        def row(heads: Column, cells: Column, i: Column) -> Column:
            filled = lambda name: F.nullif(clean(_cell(heads, cells, name)), F.lit(""))
            title = clean(F.when(grouped & F.array_contains(heads, "안건"), _cell(heads, cells, "안건")).otherwise(_cell(first, cells, "회의목적사항")))
            results = F.array_contains(heads, "가결여부")
            said, notes = filled("가결여부"), filled("비고")
            return F.struct(
                clean(_cell(heads, cells, "번호")).alias("number"), title.alias("title"), filled("결의구분").alias("resolution_type"), filled("후보자").alias("candidate"), said.alias("result_raw"),
                F.when(results, X.agenda_status(said, notes)).alias("status"), notes.alias("remarks"), F.when(results, "result").otherwise("notice").alias("phase"), i.alias("row"),
            )

        every = R.let(F.when(grouped, merged).otherwise(first), lambda heads: F.transform(t["rows"], lambda cells, i: F.when(cells.isNotNull() & (i >= F.when(grouped, 2).otherwise(1)), row(heads, cells, i))))
        return F.filter(every, lambda x: x.isNotNull() & (x["number"] != "") & ~_compact(x["number"]).isin("번호", "찬성률") & (x["title"] != "") & ~_compact(x["title"]).rlike(_NO_AGENDA))

    names = ("number", "title", "resolution_type", "candidate", "result_raw", "status", "remarks", "phase")
    kept = R.let(F.get(_headed(tables, "번호", "회의목적사항"), 0), read)
    return F.transform(kept, lambda x, i: F.struct(F.concat(F.lit("agenda:"), i).alias("agenda_ref"), *[x[n].alias(n) for n in names]))


def structured_agendas(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, agenda_ref, number, title, resolution_type, candidate, result_raw, status, remarks, phase) of the first table of agendas.

    Its first row names number and purpose; where that row has spans, names in the second row come before it. A column of results makes it a result.
    """
    return _listed(_documents(rows, id_col), id_col, agendas_of("tables"))


def elections_of(tables: str) -> Column:
    """The elections that a document's tables list, as an array."""
    mode = r"(?U)^(.+?)\s*\((상근|비상근)\)$"
    offices = F.create_map(*[F.lit(x) for pair in ELECTIONS.items() for x in pair])

    def row(t: Column, cells: Column, i: Column) -> Column:
        value = lambda name: F.coalesce(_cell(t["first"], cells, name), F.lit(""))
        whole = clean(_cell(t["first"], cells, "성명"))
        return F.struct(
            F.element_at(offices, t["title"]).alias("office"), i.alias("row"), F.when(whole.rlike(mode), clean(F.regexp_extract(whole, mode, 1))).otherwise(whole).alias("name"), F.nullif(F.regexp_extract(whole, mode, 2), F.lit("")).alias("employment_mode"),
            value("출생년월").alias("birth_month"), value("임기").alias("term"), value("신규선임여부").alias("is_new"), value("상근여부").alias("is_full_time"), value("주요경력(현직포함)").alias("career"), value("이사등으로재직중인다른법인명(직위)").alias("other_company"),
        )

    every = F.flatten(F.transform(_headed(tables, "성명", titles=tuple(ELECTIONS)), lambda t: F.transform(t["rows"], lambda cells, i: F.when(cells.isNotNull() & (i > 0), row(t, cells, i)))))
    return F.filter(every, lambda x: x.isNotNull() & (_compact(x["name"]) != "") & ~F.lower(_compact(x["name"])).rlike(_NO_NAME))


def elections(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, office, row, name, employment_mode, birth_month, term, is_new, is_full_time, career, other_company) of the tables behind the titles of elections.

    Rows whose name stands for nobody go. (상근) or (비상근) behind a name is no part of it.
    """
    return _listed(_documents(rows, id_col), id_col, elections_of("tables"))


def changes_of(tables: str) -> Column:
    """The changes of purpose that a document's tables list, as an array."""

    def row(t: Column, cells: Column, i: Column) -> Column:
        value = lambda name, nth=1: F.coalesce(_cell(t["first"], cells, name, nth), F.lit(""))
        return F.struct(i.alias("row"), value("구분").alias("category"), value("내용").alias("own"), value("내용", 2).alias("next"), value("이유").alias("reason"))

    every = F.flatten(F.transform(_headed(tables, "구분", "내용", titles=(PURPOSES,)), lambda t: F.transform(t["rows"], lambda cells, i: F.when(cells.isNotNull() & (i > 0), row(t, cells, i)))))
    kept = F.filter(every, lambda x: x.isNotNull() & (x["category"] != "") & ~x["own"].isin("변경전", "내용"))
    changed = lambda x: x["category"] == "사업목적 변경"
    return F.transform(kept, lambda x: F.struct(x["row"].alias("row"), x["category"].alias("category"), F.when(changed(x), x["own"]).alias("before"), F.when(changed(x), x["next"]).alias("after"), F.when(~changed(x), x["own"]).alias("content"), x["reason"].alias("reason")))


def purpose_changes(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, row, category, before, after, content, reason) of the table behind the title of changes of purpose."""
    return _listed(_documents(rows, id_col), id_col, changes_of("tables"))


def _dated(tables: str, phase: str) -> Column:
    """The first row that a label of the phase heads, outside of corrections."""
    plain = F.flatten(F.transform(F.filter(tables, lambda t: F.coalesce(~t["corrects"], F.lit(False))), lambda t: t["rows"]))
    return F.get(F.filter(plain, lambda cells: _row_label(F.get(cells, 0)).isin(*DATE_LABELS[phase])), 0)


def _date(cells: Column) -> Column:
    text = F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), " ")

    def read(t: Column) -> Column:
        part = lambda i, width: F.lpad(F.regexp_extract(t, _DATE, i), width, "0")
        return F.when(t.rlike(_DATE), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))

    return R.let(text, read)


def date_of(tables: str, phase: Column) -> Column:
    """The date by the first row that a label of the phase heads; null if it gives no date that exists."""
    return F.coalesce(*[F.when(phase == p, _date(_dated(tables, p))) for p in DATE_LABELS])


def meeting_date(rows: DataFrame, phases: DataFrame, id_col: str) -> DataFrame:
    """(id, meeting_date) of all phases, which are (id, phase); see date_of. Only the dates are joined."""
    told = _documents(rows, id_col).select(id_col, *[_date(_dated("tables", p)).alias(f"__{p}") for p in DATE_LABELS])
    chosen = F.coalesce(*[F.when(F.col("phase") == p, F.col(f"__{p}")) for p in DATE_LABELS])
    return phases.select(id_col, "phase").join(told, id_col, "left").select(id_col, chosen.alias("meeting_date"))


def notes_of(tables: str) -> Column:
    """What a document's corrections put in place of the note for investors, as an array."""
    heads = F.array(F.lit("정정항목"), F.lit("정정전"), F.lit("정정후"))
    begin = lambda t: F.array_position(F.transform(t["rows"], lambda cells: F.coalesce(F.transform(cells, clean) == heads, F.lit(False))), True) - 1

    def read(t: Column) -> Column:
        told = lambda at: F.transform(t["rows"], lambda cells, i: F.when((at >= 0) & (i > at) & (F.size(cells) == 3), F.struct(t["table"].alias("table"), i.alias("row"), _row_label(F.get(cells, 0)).alias("label"), clean(F.get(cells, 2)).alias("text"))))
        return R.let(begin(t), told)

    every = F.flatten(F.transform(F.filter(tables, lambda t: F.coalesce(t["corrects"], F.lit(False))), read))
    kept = F.filter(every, lambda x: x.isNotNull() & (x["label"] == NOTE_LABEL) & (x["text"] != ""))
    return F.transform(kept, lambda x: F.struct(x["table"].alias("table"), x["row"].alias("row"), x["text"].alias("text")))


def correction_notes(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, table, row, text): what corrections put in place of the note for investors, in tables whose heads are just the three of a correction."""
    return _listed(_documents(rows, id_col), id_col, notes_of("tables"))


#: Names of auditors and voting agents, and the words before them that tell what they do.
STAKEHOLDERS = {"auditor": r"[A-Za-z0-9가-힣&·ㆍ.㈜]{1,30}회계법인", "agent": r"한국예탁결제원|[A-Za-z0-9가-힣&·ㆍ.㈜]{1,30}증권(?:㈜|주식회사)?"}
ANCHORS = {"external_auditor_of": r"외부\s*감사인", "electronic_voting_manager_for": r"전자\s*투표|전자\s*위임장", "transferee_of": r"양수인", "transferor_of": r"양도인", "proposed_allottee_of": r"배정\s*대상자", "merger_target_of": r"합병\s*대상"}


def anchored_spans(docs: DataFrame, id_col: str, text_col: str, kinds: dict[str, str] | None = None, anchors: dict[str, str] | None = None, reach: int = 200) -> DataFrame:
    """(id, kind, start, end, text, relation, anchor_start): each span of a kind with the nearest anchor that begins before it, within `reach` characters.

    Spans of one kind do not overlap; those without an anchor have no relation. Patterns must have no group and match no empty text. Positions are running sums
    of what stands between matches; the as-of join is one window over a document's spans and anchors by position. Only matches are shuffled, once, by document.
    """
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__t"))

    def matches(pattern: str) -> Column:
        return F.arrays_zip(F.regexp_extract_all("__t", F.lit(f"({pattern})"), F.lit(1)).alias("text"), F.split("__t", pattern, -1).alias("before"))

    named = [(role, kind, p) for role, made in (("span", kinds or STAKEHOLDERS), ("anchor", anchors or ANCHORS)) for kind, p in made.items()]
    tagged = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), matches(p).alias("z")) for role, kind, p in named])
    each = rows.select(id_col, F.explode(tagged).alias("k")).select(id_col, "k.role", "k.kind", F.posexplode("k.z").alias("i", "z"))
    each = each.filter("z.text IS NOT NULL").select(id_col, "role", "kind", "i", "z.text", F.length("z.before").alias("gap"), F.length("z.text").alias("size")).repartition(id_col)
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(id_col, "role", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    order = Window.partitionBy(id_col).orderBy("start", F.col("role").desc(), "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("role") == "anchor", F.struct(F.col("start").alias("at"), F.col("kind").alias("relation"))), ignorenulls=True).over(order)
    found = each.withColumn("anchor", at).filter("role = 'span'")
    near = (F.col("anchor.at") < F.col("start")) & (F.col("start") - F.col("anchor.at") <= reach)
    return found.select(id_col, "kind", "start", "end", "text", F.when(near, F.col("anchor.relation")).alias("relation"), F.when(near, F.col("anchor.at")).alias("anchor_start"))
