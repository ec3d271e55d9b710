"""Graphs built from parsed records: nodes(id, label, type, ...) and edges(id, source, target, relation, weight, start_date, ...).

records: acpt_no, position (order of reading), title, kind, paid_on, items (label, amount), purposes (label, amount),
people (label, amount). meta: acpt_no, company_id, company_name, market, submitter, disclosed_on (dates, one row an acpt_no).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

#: Relation types with the kinds of their ends, and what follows from a type.
RELATIONS = (
    ("includes", ("meeting",), ("agenda",)),
    ("candidate_for", ("person",), ("company",)),
    ("elected_as", ("person",), ("company",)),
    ("removed_from", ("person",), ("company",)),
    ("resigned_from", ("person",), ("company",)),
    ("subject_of", ("person", "organization"), ("agenda",)),
    ("proposed", ("person", "organization"), ("agenda",)),
    ("serves_at", ("person",), ("organization", "company")),
    ("option_granted_by", ("person",), ("company",)),
    ("external_auditor_of", ("organization",), ("company",)),
    ("electronic_voting_manager_for", ("organization",), ("meeting",)),
    ("electronic_voting_system_provider_for", ("organization",), ("meeting",)),
    ("transferor_of", ("person", "organization"), ("company",)),
    ("transferee_of", ("person", "organization"), ("company",)),
    ("proposed_allottee_of", ("person", "organization"), ("company",)),
    ("merger_target_of", ("organization",), ("company", "agenda")),
    ("acquisition_target_of", ("organization",), ("company", "agenda")),
    ("divestment_target_of", ("organization",), ("company", "agenda")),
    ("shareholder_of", ("person", "organization"), ("company",)),
)
NEEDS_PASSED_RESULT = ("elected_as", "removed_from", "resigned_from", "option_granted_by")
NO_START = ("serves_at", "external_auditor_of", "removed_from", "resigned_from", "transferor_of", "transferee_of", "proposed_allottee_of", "merger_target_of", "acquisition_target_of", "divestment_target_of", "shareholder_of")
FROM_MEETING = ("electronic_voting_manager_for", "electronic_voting_system_provider_for")
ENDED = ("removed_from", "resigned_from")
NO_NAME = ("", "-")


def directory(metas: list[DataFrame]) -> DataFrame:
    """(name, company): normalised company name to node id. Of several ids of a name the last of the last source holds.

    metas: (company_id, company_name, submitter, position), in the order of their sources.
    """
    all_rows = reduce(DataFrame.unionByName, [m.select("company_id", "company_name", "submitter", F.struct(F.lit(i).alias("source"), F.col("position")).alias("at")) for i, m in enumerate(metas)])
    given = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.col("submitter"))
    named = all_rows.select(K.entity_name(given).alias("name"), K.company_code(F.col("company_id")).alias("code"), "at").filter("name <> '' AND code <> ''")
    return named.groupBy("name").agg(F.concat(F.lit("company_"), F.max_by("code", "at")).alias("company"))


def _base(records: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Records whose company is known, with its node, the node of the event and the date."""
    both = records.filter("acpt_no <> ''")
    both = (both if meta is None else both.join(meta, "acpt_no", "left")).withColumn("code", K.company_code(F.col("company_id"))).filter("code <> ''")
    return both.withColumns(
        {
            "company": F.concat(F.lit("company_"), F.col("code")),
            "event": F.concat(F.lit("issuance_event_"), F.col("acpt_no")),
            "day": F.coalesce("disclosed_on", "paid_on"),
        }
    )


def issuance_graph(records: DataFrame, meta: DataFrame | None, names: DataFrame, document_type: str, one_security: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rights (a security an item of positive amount) or, with one_security, of bonds (one a record).

    Company EXECUTED event, event ISSUED security, event FOR_PURPOSE fund usage, investor ACQUIRED the first security, or
    else the event. Of nodes of one id the first read stays; of events the last. Names "-" and blanks are no investors. Records that bear the columns of meta need none.
    A name that fills a third of all rows is a skewed key of the left join to `names`, which AQE splits.
    """
    base = _base(records, meta)
    good = lambda c: F.filter(F.transform(c, lambda x, i: F.struct(x["label"].alias("label"), x["amount"].cast("double").alias("amount"), i.alias("i"))), lambda x: x["amount"] > 0)
    security = F.concat(F.lit("security_"), F.col("acpt_no"))
    named = lambda x: security if one_security else F.concat(security, F.lit("_"), x)
    issued, used = good("items"), good("purposes")
    if one_security:
        issued = F.slice(issued, 1, 1)
    base = base.withColumns({"issued": issued, "used": used, "main": F.coalesce(named(F.get(issued, 0)["label"]) if not one_security else F.when(F.size(issued) > 0, security), F.col("event"))})
    item = base.select("*", F.explode("issued").alias("x"))
    usage = base.select("*", F.explode("used").alias("x"))
    people = base.select("acpt_no", "position", "code", "main", "day", F.posexplode("people").alias("i", "x")).select("*", F.trim("x.label").alias("label"), F.coalesce(F.col("x.amount").cast("double"), F.lit(0.0)).alias("amount"))
    people = people.filter(~F.col("label").isin(*NO_NAME)).withColumn("name", K.entity_name(F.col("label"))).join(names, "name", "left")
    kind = K.investor_kind(F.col("label"))
    own = F.when(kind == "Person", F.concat_ws("_", F.lit("person"), "code", "name")).when(kind == "Company", F.concat(F.lit("company_inv_"), F.col("name"))).otherwise(F.concat(F.lit("org_"), F.col("name")))
    people = people.withColumns({"investor": F.coalesce("company", own), "type": F.when(F.col("company").isNotNull(), "Company").otherwise(kind)})

    node = lambda df, id, label, type, amount, step, i: df.select(id.alias("id"), label.alias("label"), type.alias("type"), amount.cast("double").alias("amount"), F.struct(F.col("position"), F.lit(step).alias("step"), i.cast("int").alias("i")).alias("at"))
    none = F.lit(None)
    usage_id = F.concat(F.lit("fund_usage_"), F.col("acpt_no"), F.lit("_"), F.col("x.label"))
    nodes = reduce(
        DataFrame.unionByName,
        [
            node(base, F.col("company"), F.coalesce("company_name", "submitter", F.lit("알수없음")), F.lit("Company"), none, 0, F.lit(0)),
            node(item, named(F.col("x.label")), F.col("x.label"), F.lit("Security"), F.col("x.amount"), 2, F.col("x.i")),
            node(usage, usage_id, F.col("x.label"), F.lit("FundUsage"), F.col("x.amount"), 3, F.col("x.i")),
            node(people, F.col("investor"), F.col("label"), F.col("type"), none, 4, F.col("i")),
        ],
    )
    firsts = nodes.groupBy("id").agg(F.min_by(F.struct("label", "type", "amount"), "at").alias("n"))
    events = node(base, F.col("event"), F.coalesce("kind", F.lit("")), F.lit("IssuanceEvent"), none, 1, F.lit(0)).groupBy("id").agg(F.max_by(F.struct("label", "type", "amount"), "at").alias("n"))
    all_nodes = firsts.unionByName(events).select("id", "n.*")

    edge = lambda df, source, target, relation, weight, i: df.select(F.concat_ws(":", "acpt_no", F.col("position").cast("string"), F.lit(relation), i.cast("string")).alias("id"), source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), weight.cast("double").alias("weight"), F.col("day").alias("start_date"), F.lit(document_type).alias("document_type"), "acpt_no")
    edges = reduce(
        DataFrame.unionByName,
        [
            edge(base, F.col("company"), F.col("event"), "EXECUTED", none, F.lit(0)),
            edge(item, F.col("event"), named(F.col("x.label")), "ISSUED", F.col("x.amount"), F.col("x.i")),
            edge(usage, F.col("event"), usage_id, "FOR_PURPOSE", F.col("x.amount"), F.col("x.i")),
            edge(people, F.col("investor"), F.col("main"), "ACQUIRED", F.col("amount"), F.col("i")),
        ],
    )
    return all_nodes, edges


def meeting_rows(meetings: DataFrame) -> DataFrame:
    """Meetings that count: not corrected later, with company, name, contents, date and title."""
    full = reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in ("acpt_no", "company_id", "company_name", "meeting_date", "title")])
    return meetings.filter(full & ~F.coalesce("has_later_correction", F.lit(False)) & F.coalesce("parsed", F.lit(False)))


def meeting_edges(meetings: DataFrame) -> DataFrame:
    """(source, target, relation, start_date): company HELD meeting."""
    code = K.company_code(F.col("company_id"))
    return meeting_rows(meetings).select(F.concat(F.lit("company_"), code).alias("source"), F.concat(F.lit("shareholder_meeting_"), F.col("acpt_no")).alias("target"), F.lit("HELD").alias("relation"), F.col("meeting_date").alias("start_date"))


def relation_edges(relations: DataFrame, refs: DataFrame) -> DataFrame:
    """Relations of documents as edges with dates and whether they hold.

    relations: acpt_no, relation, source_ref, target_ref, evidence, phase, outcome, is_current, state, event_date,
    meeting_date. refs: acpt_no, ref, kind, id; a ref that a document gives twice, or that holds an @, is none.
    One stays if its type is known, both refs are of kinds the type allows and its evidence is not blank; changes of
    office and options also need phase result and outcome passed.
    """
    spark = relations.sparkSession
    rules = spark.createDataFrame([(r, list(s), list(t)) for r, s, t in RELATIONS], "relation string, source_kinds array<string>, target_kinds array<string>")
    once = refs.filter(~F.col("ref").contains("@")).groupBy("acpt_no", "ref").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("id").alias("id")).filter("n = 1").drop("n")
    end = lambda side: once.select("acpt_no", F.col("ref").alias(f"{side}_ref"), F.col("kind").alias(f"{side}_kind"), F.col("id").alias(side))
    typed = relations.withColumn("relation", F.lower(F.trim("relation"))).filter("trim(evidence) <> ''").join(F.broadcast(rules), "relation")  # as many rules as are listed above
    typed = typed.filter(~F.col("relation").isin(*NEEDS_PASSED_RESULT) | ((F.col("phase") == "result") & (F.col("outcome") == "passed")))
    both = typed.join(end("source"), ["acpt_no", "source_ref"]).join(end("target"), ["acpt_no", "target_ref"])
    both = both.filter("array_contains(source_kinds, source_kind) AND array_contains(target_kinds, target_kind)")
    r = F.col("relation")
    state = F.lower(F.trim("state"))
    active = (
        F.when(r == "elected_as", True)
        .when(r.isin(*ENDED), False)
        .when(r.isin("serves_at", "shareholder_of"), F.col("is_current"))
        .when(r == "external_auditor_of", F.when(state == "current", True).when(state == "former", False))
    )
    start = F.when(r.isin(*NO_START), None).when(r.isin(*FROM_MEETING), F.col("meeting_date")).otherwise(F.col("event_date"))
    return both.select("acpt_no", "source", "target", F.upper("relation").alias("relation"), start.alias("start_date"), F.when(r.isin(*ENDED), F.col("meeting_date")).alias("end_date"), active.alias("is_active"))


def meeting_graph(meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of meetings that count, in the columns of issuance_graph: company HELD meeting."""
    m = meeting_rows(meetings).withColumn("code", K.company_code(F.col("company_id")))
    company, meeting = F.concat(F.lit("company_"), F.col("code")), F.concat(F.lit("shareholder_meeting_"), F.col("acpt_no"))
    none = F.lit(None).cast("double")
    firms = m.groupBy(company.alias("id")).agg(F.min_by("company_name", "acpt_no").alias("label")).select("id", "label", F.lit("Company").alias("type"), none.alias("amount"))
    held = m.groupBy(meeting.alias("id")).agg(F.min("title").alias("label")).select("id", "label", F.lit("ShareholderMeeting").alias("type"), none.alias("amount"))
    edges = m.select(F.concat_ws(":", "acpt_no", F.lit("HELD")).alias("id"), company.alias("source"), meeting.alias("target"), F.lit("HELD").alias("relation"), none.alias("weight"), F.col("meeting_date").alias("start_date"), F.lit("주주총회").alias("document_type"), "acpt_no")
    return firms.unionByName(held), edges


#: Types whose last reading holds where several families tell of one node; of all others the first holds.
LAST_HOLDS = ("IssuanceEvent",)


def one_graph(families: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The graphs of several record families, in their order of reading, as one: nodes of one id become one, edges keep their family.

    One partial aggregation by node id; an edge's id gets the number of its family in front, so that none can meet.
    """
    told = reduce(DataFrame.unionByName, [n.select("id", "label", "type", F.col("amount").cast("double").alias("amount"), F.lit(i).alias("family")) for i, (n, _) in enumerate(families)])
    value = F.struct("label", "type", "amount")
    last = F.col("type").isin(*LAST_HOLDS)
    kept = told.groupBy("id").agg(F.min_by(F.when(~last, value), F.when(~last, F.col("family"))).alias("first"), F.max_by(F.when(last, value), F.when(last, F.col("family"))).alias("last"), F.count("*").alias("families"))
    nodes = kept.select("id", F.coalesce("first", "last").alias("n"), "families").select("id", "n.*", "families")
    edges = reduce(DataFrame.unionByName, [e.withColumn("id", F.concat(F.lit(f"{i}:"), F.col("id"))) for i, (_, e) in enumerate(families)])
    return nodes, edges
