"""Shareholder meetings: agendas out of free lines, elections put to agendas, mentions merged into entities and relations.

Everything is local to a document (acpt_no), so no step gathers more than one document's lines in a task; documents are spread
by key. Lines come as (acpt_no, phase, at, line), at giving their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Heads of sections that list reports, and of those that list agendas.
REPORT_SECTIONS = ("보고사항", "보고안건", "보고의안")
AGENDA_SECTIONS = ("부의안건", "부의사항", "부의의안", "결의사항", "의결사항", "의결의안", "결의안건", "의결안건", "심의의안", "안건")
#: Marks before a point, numbers of an agenda, and offices that a title may name.
BULLETS = "*○●⊙ㅇ◆◇□■└·ㆍ-"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
NUMBER = r"\d+(?:\s*[-－.]\s*\d+)*"
OFFICES = ("사내이사", "사외이사", "독립이사", r"기타\s*비상무이사", "비상무이사", "비상임이사", "감사위원", "감사")

_MARK = rf"(?:\(\s*\d+\s*\)|\d+\s*[.)]|[가-하]\s*[.)]|[①-⑳]|[{BULLETS}]\s*[.]?)"
#: What starts an agenda anywhere: a number with the word for agenda. (pattern, group of the number, group of the title)
_NUMBERED = rf"(?U)^\s*(?:{_MARK}\s*)*[\[<【(]?\s*(?:(?:제\s*)?({NUMBER})\s*호(?:\s*의\s*안)?|제\s*({NUMBER})\s*안|안건\s*({NUMBER}))\s*[\]>】)]?\s*[:：.]?\s*(.*)$"
#: What starts one inside a section of agendas only, in the order of trial.
_LISTED = (
    rf"(?U)^\s*(\d+(?:\s*[-－.]\s*\d+)+)\s*(?:[.)]\s*)?(.+)$",
    r"(?U)^\s*\(\s*(\d+)\s*\)\s*(.+)$",
    rf"(?U)^\s*({NUMBER})\s*[.)]\s*(.+)$",
    r"(?U)^\s*([①-⑳])\s*(.+)$",
    r"(?U)^\s*([가-하])\s*[.)]\s*(.+)$",
)
_POINT = rf"(?U)^\s*[{BULLETS}]\s*(.+)$"
_INLINE = rf"(?U)[ \t\[<【({BULLETS[:-1]}.\-]*(?:(?:제\s*)?{NUMBER}\s*호(?:\s*의\s*안)?|제\s*{NUMBER}\s*안|안건\s*{NUMBER}\s*[:：])"
_ARROW = r"(?:→|⇒|=>|->)"
_OUTCOME = rf"(?U)^(.*?)(?:{_ARROW}\s*(.+)|\(\s*([^()]*)\s*\)|\s+-\s+(.+))\s*$"
_CANDIDATE = rf"(?U)(?:{'|'.join(OFFICES)})\s*([가-힣]{{2,5}}|[A-Za-z]+(?:\s+[A-Za-z]+){{0,3}})\s*(?:신규\s*)?(?:선임|재선임)"
_BREAK = "\x1f"


def clean(c: Column) -> Column:
    """White space of any kind collapsed and stripped."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x{a0}]+", " "), F.lit(" "))


def _number(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "－.", "--")


def _group(line: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(line, pattern, i)


def agenda_start(line: Column, active: Column) -> Column:
    """(number, title) if the line starts an agenda, else null. Without a word for agenda it must stand in a section of agendas."""
    made = lambda number, title: F.struct(number.alias("number"), clean(title).alias("title"))
    numbers = [F.nullif(_group(line, _NUMBERED, i), F.lit("")) for i in (1, 2, 3)]
    found = F.when(line.rlike(_NUMBERED), made(_number(F.coalesce(*numbers)), _group(line, _NUMBERED, 4)))
    listed = F.lit(None)
    point = clean(_group(line, _POINT, 1))
    for i, pattern in reversed(list(enumerate(_LISTED))):
        own = _group(line, pattern, 1)
        number = F.position(own, F.lit(CIRCLED)).cast("string") if i == 3 else own if i == 4 else _number(own)
        listed = F.when(line.rlike(pattern), made(number, _group(line, pattern, 2))).otherwise(listed)
    any_listed = line.rlike("(?U)" + "|".join(f"(?:{p.removeprefix('(?U)')})" for p in _LISTED))
    bullet = F.when(~any_listed & line.rlike(_POINT) & point.rlike(r"(?U)의\s*건|승인|선임|변경"), made(F.lit(None).cast("string"), point))
    return F.coalesce(found, F.when(active, F.coalesce(listed, bullet)))


def section_kind(line: Column) -> Column:
    """report or agenda if the line is the head of a section, else null."""
    edge = F.lit("<>(){}:：")
    name = F.btrim(F.regexp_replace(line, r"(?U)[\s\[\]【】「」]", ""), edge)
    name = F.btrim(F.regexp_replace(name, r"(?U)^(?:\(\s*\d+\s*\)|\d+\s*[.)]|[가-하]\s*[.)]|[-※])", ""), edge)
    return F.when(name.isin(*REPORT_SECTIONS), "report").when(name.isin(*AGENDA_SECTIONS), "agenda")


def split_outcome(title: Column) -> Column:
    """(title, outcome): what follows an arrow, or a status in brackets at the end or after a dash, is the outcome; else it is null."""
    arrow = F.nullif(_group(title, _OUTCOME, 2), F.lit(""))
    said = clean(F.coalesce(arrow, F.nullif(_group(title, _OUTCOME, 3), F.lit("")), F.nullif(_group(title, _OUTCOME, 4), F.lit("")), F.lit("")))
    parts = title.rlike(_OUTCOME) & (arrow.isNotNull() | X.agenda_status(said, F.lit("")).isNotNull())
    return F.when(parts, F.struct(clean(_group(title, _OUTCOME, 1)).alias("title"), said.alias("outcome"))).otherwise(F.struct(title.alias("title"), F.lit(None).cast("string").alias("outcome")))


def follows(a: Column, b: Column) -> Column:
    """Whether number b (1-2) may come after number a: a child, a later first part, or a later sibling."""
    whole = r"^\d+(?:-\d+)*$"
    x, y = (F.transform(F.split(F.coalesce(c, F.lit("")), "-"), lambda t: t.try_cast("long")) for c in (a, b))
    child = (F.size(y) > F.size(x)) & (F.slice(y, 1, F.size(x)) == x)
    sibling = (F.size(y) == F.size(x)) & (F.slice(y, 1, F.size(y) - 1) == F.slice(x, 1, F.size(x) - 1)) & (F.element_at(y, -1) > F.element_at(x, -1))
    return F.coalesce(a.rlike(whole) & b.rlike(whole) & (child | (F.get(y, 0) > F.get(x, 0)) | sibling), F.lit(False))


def split_agendas(line: Column) -> Column:
    """The agendas of one line, where numbers follow each other: an array with the whole line if there are none to part."""
    pieces = F.split(F.regexp_replace(line, _INLINE, f"{_BREAK}$0"), _BREAK)
    head = agenda_start(F.get(pieces, 1), F.lit(True))
    first = F.struct(F.array(F.concat(F.get(pieces, 0), F.get(pieces, 1))).alias("parts"), head["number"].alias("last"))

    def step(acc: Column, piece: Column) -> Column:
        number = agenda_start(piece, F.lit(True))["number"]
        known = F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1)
        longer = F.concat(known, F.array(F.concat(F.element_at(acc["parts"], -1), piece)))
        new = follows(acc["last"], number)
        return F.struct(F.when(new, F.concat(acc["parts"], F.array(piece))).otherwise(longer).alias("parts"), F.when(new, number).otherwise(acc["last"]).alias("last"))

    folded = F.aggregate(F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0))), first, step)["parts"]
    parted = F.filter(F.transform(folded, clean), lambda x: x != "")
    return F.when((F.size(pieces) > 2) & head.isNotNull() & (F.size(parted) > 0), parted).otherwise(F.array(line))


def agenda_lines(cells: DataFrame) -> DataFrame:
    """(acpt_no, phase, at, line) of (acpt_no, phase, cell): the cell's lines, cleaned, without blanks and dashes, parted where one holds several agendas."""
    each = cells.select("acpt_no", "phase", F.posexplode(F.split(F.coalesce("cell", F.lit("")), r"\r\n|[\n\r]")).alias("i", "raw")).select("acpt_no", "phase", "i", clean(F.col("raw")).alias("line")).filter("line NOT IN ('', '-')")
    parts = each.select("acpt_no", "phase", "i", F.posexplode(split_agendas(F.col("line"))).alias("j", "line"))
    return parts.select("acpt_no", "phase", F.struct("i", "j").alias("at"), "line")


def legacy_agendas(lines: DataFrame) -> DataFrame:
    """Agendas of documents whose lines list them: (acpt_no, agenda_ref, number, title, candidate, result_raw, status).

    A head of a section turns listing on or off and ends the agenda before it. A line that starts an agenda ends the one before, which
    is left out if it was only the head of this one (1 before 1-1, without an outcome). In results, an outcome (a line of its
    own, behind an arrow, or a status in brackets) ends the title, and all lines after it belong to it. title is all lines
    as they stand. Running counts over the lines of a document say all this, in one shuffle by document.
    """
    order = Window.partitionBy("acpt_no").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = lines.filter("phase IN ('notice', 'result')").withColumn("section", section_kind(F.col("line")))
    t = t.withColumn("active", F.coalesce(F.last("section", ignorenulls=True).over(so_far), F.lit("agenda")) == "agenda")
    t = t.withColumn("start", F.when(F.col("section").isNull(), agenda_start(F.col("line"), F.col("active"))))
    t = t.withColumn("block", F.count_if(F.col("section").isNotNull() | F.col("start").isNotNull()).over(so_far))
    block = Window.partitionBy("acpt_no", "block")
    in_block = block.orderBy("at")
    t = t.withColumn("head", F.first(F.col("start")).over(in_block))
    t = t.withColumn("said", split_outcome(F.when(F.col("start").isNotNull(), F.col("start.title")).otherwise(F.col("line"))))
    result = F.col("phase") == "result"
    titled = F.coalesce(F.count_if(F.col("said.title") != "").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    outcome = result & F.col("start").isNull() & titled & (X.agenda_status(F.col("line"), F.lit("")).isNotNull() | F.col("line").rlike(rf"^\s*{_ARROW}"))
    t = t.withColumn("outcome", F.coalesce(outcome, F.lit(False)))
    first = F.col("outcome") | (result & (F.coalesce(F.col("said.outcome"), F.lit("")) != ""))
    t = t.withColumn("after", F.count_if(first).over(in_block.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    title = F.when(~F.col("after") & ~F.col("outcome"), F.nullif(F.col("said.title"), F.lit("")))
    said = F.when(F.col("after") | F.col("outcome"), F.col("line")).when(result, F.nullif(F.col("said.outcome"), F.lit("")))
    joined = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("at", c.alias("v")))), lambda x: x["v"].isNotNull()), lambda x: x["v"]), " ")
    found = t.groupBy("acpt_no", "block").agg(F.first("phase").alias("phase"), F.min_by("section", "at").alias("section"), F.min_by("head", "at").alias("head"), joined(F.col("line")).alias("raw"), joined(title).alias("name"), joined(said).alias("result_raw"))
    next_head = F.lead("head.number").over(Window.partitionBy("acpt_no").orderBy("block"))
    parent = (F.col("result_raw") == "") & F.coalesce(next_head.startswith(F.concat("head.number", F.lit("-"))), F.lit(False))
    kept = found.withColumn("parent", parent).filter("head IS NOT NULL AND NOT parent AND name <> ''")
    ref = F.concat(F.lit("agenda:"), F.row_number().over(Window.partitionBy("acpt_no").orderBy("block")) - 1)
    return kept.select(
        "acpt_no",
        ref.alias("agenda_ref"),
        F.col("head.number").alias("number"),
        F.col("raw").alias("title"),
        F.nullif(clean(_group(F.col("name"), _CANDIDATE, 1)), F.lit("")).alias("candidate"),
        F.nullif(F.col("result_raw"), F.lit("")).alias("result_raw"),
        X.agenda_status(F.col("result_raw"), F.lit("")).alias("status"),
    )


def office_types(title: Column) -> Column:
    """Offices that a title names, as an array: audit_committee_member, outside_director, auditor, director."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", "")
    own = r"사내이사|기타비상무이사|비상무이사|비상임이사"
    auditor = r"(?:상근|비상근)?감사(?!위원|위원회|보고|의견|보수)(?:의)?(?=후보|선임|재선임|해임|[가-힣A-Za-z.'-]{2,30}(?:신규|재)?선임|$)"
    director = rf"{own}|(?<!사외)(?<!독립)(?<!사내)(?<!비상무)(?<!비상임)(?<!기타비상무)이사(?!회|보수)"
    outside = t.rlike("사외이사|독립이사")
    found = [
        F.when(t.rlike("감사위원"), "audit_committee_member"),
        F.when(outside & ~t.contains("사외이사가아닌감사위원"), "outside_director"),
        F.when(t.rlike(auditor), "auditor"),
        F.when(t.rlike(director) & (~outside | t.contains("사외이사가아닌감사위원") | t.rlike(own)), "director"),
    ]
    return F.array_compact(F.array(*found))


def person_name(c: Column) -> Column:
    """(name, alias): the Latin name in brackets behind a name is its alias."""
    pattern = r"(?U)^(.+?)\s*\(([A-Za-z][A-Za-z .'-]+)\)$"
    t = clean(c)
    return F.when(t.rlike(pattern), F.struct(clean(_group(t, pattern, 1)).alias("name"), clean(_group(t, pattern, 2)).alias("alias"))).otherwise(F.struct(t.alias("name"), F.lit(None).cast("string").alias("alias")))


def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s·ㆍ,]", ""))


def match_elections(elections: DataFrame, agendas: DataFrame) -> DataFrame:
    """(acpt_no, election_ref, agenda_ref, by): the agenda that each election is about.

    elections: (acpt_no, election_ref, name, office). agendas: (acpt_no, agenda_ref, title, candidates). First by name: an
    agenda of appointment or candidates that lists the person, or holds the name as a word, and names no other office only; it holds if it is the only one. An
    election that no agenda names falls to the one unnamed agenda of its office alone, if it is that office's only election. Ambiguous ones
    have no row. Names and titles are read once each; both come together in one shuffle by document, and are compared there, a document's elections times its agendas.
    """
    blank = F.array().cast("array<string>")
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9가-힣]", " "), F.lit(" "))
    raw = F.coalesce("title", F.lit(""))  # cleaning moves no letter, so the plain title tells as well what is left out
    g = agendas.filter(F.col("acpt_no").isNotNull() & ~raw.contains("해임") & raw.rlike("선임|후보")).select("acpt_no", "agenda_ref", clean(F.col("title")).alias("title"), F.transform(F.coalesce("candidates", blank), lambda c: name_key(person_name(c)["name"])).alias("keys"))
    g = g.withColumns({"low": F.lower("title"), "offices": office_types(F.col("title")), "own": F.col("title").contains("선임")})
    g = g.groupBy("acpt_no").agg(F.collect_list(F.struct("agenda_ref", "keys", "low", spaced(F.col("low")).alias("spaced"), "offices", "own")).alias("g"))
    e = elections.filter(F.col("acpt_no").isNotNull() & F.col("name").rlike(r"(?U)[^\s\x{a0}]")).select("acpt_no", "election_ref", person_name(F.col("name"))["name"].alias("name"), F.coalesce("office", F.lit("")).alias("office"))
    e = e.withColumns({"low": F.lower("name"), "key": name_key(F.col("name"))})
    e = e.groupBy("acpt_no").agg(F.collect_list(F.struct("election_ref", "office", "low", spaced(F.col("low")).alias("word"), "key")).alias("e"))
    both = e.join(g, "acpt_no")
    fits = lambda x, y: (F.array_contains(y["keys"], x["key"]) | (F.contains(y["spaced"], x["word"]) & F.contains(y["low"], x["low"]))) & ((F.size(y["offices"]) == 0) | F.array_contains(y["offices"], x["office"]))
    named = F.transform("e", lambda x: F.struct(x["election_ref"].alias("election_ref"), x["office"].alias("office"), F.transform(F.filter("g", lambda y: fits(x, y)), lambda y: y["agenda_ref"]).alias("hits")))
    both = both.select("acpt_no", named.alias("e"), F.filter("g", lambda y: (F.size(y["offices"]) == 1) & (F.size(y["keys"]) == 0) & y["own"]).alias("own"))
    of = lambda ref: F.flatten(F.transform(F.filter("e", lambda x: x["election_ref"].eqNullSafe(ref)), lambda x: x["hits"]))
    made = lambda ref, agenda, how: F.struct(ref.alias("election_ref"), agenda.alias("agenda_ref"), F.lit(how).alias("by"))
    by_name = F.filter(F.transform(F.array_distinct(F.transform("e", lambda x: x["election_ref"])), lambda ref: F.struct(ref.alias("ref"), of(ref).alias("hits"))), lambda x: F.size(x["hits"]) == 1)
    alone = F.filter("e", lambda x: (x["office"] != "") & (F.size(F.filter("e", lambda z: z["office"] == x["office"])) == 1) & (x["election_ref"].isNull() | (F.size(of(x["election_ref"])) == 0)))
    unnamed = F.filter(F.transform(alone, lambda x: F.struct(x["election_ref"].alias("ref"), F.filter("own", lambda y: F.get(y["offices"], 0) == x["office"]).alias("own"))), lambda x: F.size(x["own"]) == 1)
    found = F.concat(F.transform(by_name, lambda x: made(x["ref"], F.get(x["hits"], 0), "name")), F.transform(unnamed, lambda x: made(x["ref"], F.get(x["own"], 0)["agenda_ref"], "office")))
    return both.select("acpt_no", F.explode(found).alias("x")).select("acpt_no", "x.*")


def merge_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, references) of (acpt_no, at, kind, name, birth_month, evidence), kind person or organization.

    A person is a name (without its alias, spaces and dots) and a month of birth, an organization a name, inside one document. The first
    mention names it and numbers it among its kind; aliases and evidence are listed once each, in order. references gives each
    mention (acpt_no, at) its entity_ref; blank names have none. Equal keys are groups of one document, so merging needs no global components.
    """
    who = person_name(F.col("name"))
    plain = F.col("kind") != "person"
    name = F.when(plain, F.btrim(clean(F.col("name")), F.lit("-–—,; "))).otherwise(who["name"])
    m = mentions.select("acpt_no", "at", "kind", name.alias("name"), F.when(~plain, who["alias"]).alias("alias"), F.when(~plain, clean(F.col("birth_month"))).alias("birth_month"), clean(F.col("evidence")).alias("evidence"))
    m = m.withColumns({"key": name_key(F.col("name")), "birth_month": F.coalesce("birth_month", F.lit(""))}).filter("key NOT IN ('', '-')")
    m = m.withColumn("birth_month", F.when(F.col("birth_month") == "-", "").otherwise(F.col("birth_month")))
    group = ["acpt_no", "kind", "key", "birth_month"]
    once = lambda c: m.filter(F.col(c).isNotNull()).groupBy(*group, c).agg(F.min("at").alias("a")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", c))), lambda x: x[c]).alias(f"{c}s"))
    number = F.concat("kind", F.lit(":"), F.dense_rank().over(Window.partitionBy("acpt_no", "kind").orderBy("first_at", "key", "birth_month")) - 1)
    first = m.groupBy(*group).agg(F.min("at").alias("first_at"), F.min_by("name", "at").alias("name")).withColumn("entity_ref", number)
    entities = first.join(once("alias"), group, "left").join(once("evidence"), group, "left")
    refs = m.select(*group, "at").filter(F.col("acpt_no").isNotNull() & F.col("kind").isNotNull()).withColumn("first_at", F.min("at").over(Window.partitionBy(*group))).select("acpt_no", "at", number.alias("entity_ref"))
    none = F.array().cast("array<string>")
    return entities.select("acpt_no", "entity_ref", "kind", "name", "birth_month", F.coalesce("aliass", none).alias("aliases"), F.coalesce("evidences", none).alias("mentions")), refs


#: Which attribute tells two relations of one type between the same ends apart; of other types office_type, else action.
TOLD_BY = {"subject_of": "action", "serves_at": "position", "external_auditor_of": "state"}


def merge_relations(found: DataFrame, refs: DataFrame) -> DataFrame:
    """(acpt_no, relation_no, source_ref, target_ref, type, attributes, evidence): relations with references rewritten and equal ones merged.

    found: (acpt_no, at, source, target, type, attributes map, evidence); source and target are a mention's place, as text, or a reference that
    starts with @ or agenda. Of an attribute the last value that is not blank holds; offices of an appointment are listed in order in office_types
    when there are several; evidence is that of the last one with an outcome, else of the first. A relation whose mention has no entity goes. Mentions are looked up
    in one map a document, and one aggregation merges: rows that come apart by document are not shuffled again.
    """
    places = refs.groupBy("acpt_no", F.col("at").cast("string").alias("place")).agg(F.collect_list("entity_ref").alias("refs")).filter("place IS NOT NULL")
    known = places.groupBy("acpt_no").agg(F.map_from_entries(F.collect_list(F.struct("place", "refs"))).alias("__known"))

    def end(side: str) -> Column:
        """The references of one end: itself if it is one, else those of the mention that stands there."""
        fixed = F.col(side).rlike("^(@|agenda:)")
        return F.explode(F.when(fixed, F.array(side)).otherwise(F.coalesce(F.col("__known")[F.col(side)], F.array().cast("array<string>"))))

    get = lambda name: clean(F.col("attributes")[name])
    told = F.coalesce(F.nullif(get("office_type"), F.lit("")), get("action"), F.lit(""))
    for kind, attribute in TOLD_BY.items():
        told = F.when(F.col("type") == kind, get(attribute)).otherwise(told)
    t = found.join(known, "acpt_no", "left").withColumn("source_ref", end("source")).withColumn("target_ref", end("target"))
    t = t.select("acpt_no", "source_ref", "target_ref", "type", told.alias("told"), "at", "attributes", "evidence", F.nullif(get("outcome"), F.lit("")).isNotNull().alias("settled"))
    group = ["acpt_no", "source_ref", "target_ref", "type", "told"]
    entries = F.filter(F.transform(F.map_entries("attributes"), lambda x: F.struct(F.col("at").alias("at"), x["key"].alias("k"), x["value"].alias("v"))), lambda x: x["v"] != "")
    evidence = F.coalesce(F.max_by(F.when(F.col("settled"), F.col("evidence")), F.when(F.col("settled"), F.col("at"))), F.min_by("evidence", "at"))
    base = t.groupBy(*group).agg(F.min("at").alias("first_at"), evidence.alias("evidence"), F.array_sort(F.flatten(F.collect_list(entries))).alias("all"))
    base = base.withColumn("keys", F.array_distinct(F.transform("all", lambda x: x["k"])))
    values = lambda k: F.transform(F.filter("all", lambda x: x["k"] == k), lambda x: x["v"])
    offices = F.when((F.col("type") == "subject_of") & (F.col("told") == "appointment"), F.array_distinct(values("office_type")))
    base = base.withColumn("offices", F.when(F.size(offices) > 1, F.array_join(offices, ",")))
    several = lambda k: F.col("offices").isNotNull() & (k == "office_type")
    listed = F.transform("keys", lambda k: F.struct(F.when(several(k), "office_types").otherwise(k).alias("k"), F.when(several(k), F.col("offices")).otherwise(F.element_at(values(k), -1)).alias("v")))
    number = (F.row_number().over(Window.partitionBy("acpt_no").orderBy("first_at")) - 1).alias("relation_no")
    return base.select("acpt_no", number, "source_ref", "target_ref", "type", F.map_from_entries(F.array_sort(listed)).alias("attributes"), "evidence")
