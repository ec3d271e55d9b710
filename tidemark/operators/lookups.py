"""Lookups and lists that panels ask for: disclosures of a company, the index of companies, exports, stored results, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from . import listing
from .records import let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The word for all markets, and modes of parsing whose records bear the company's name.
ALL_MARKETS = "전체"
NAMED_MODES = ("bond_issuance", "rights_issuance")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def like(c: Column, keyword: str) -> Column:
    """Whether a text holds the keyword, A-Z in any case; % and _ stand for any run and any one character, as in LIKE."""
    fold = str.maketrans(UPPER, UPPER.lower())
    pattern = "%" + keyword.translate(fold).replace("\\", "\\\\") + "%"
    return F.coalesce(F.translate(c, UPPER, UPPER.lower()).like(pattern), F.lit(False))


def company_disclosures(rows: DataFrame, code: str, start: str, end: str, keyword: str = "", market: str = ALL_MARKETS) -> DataFrame:
    """Disclosures of a company between two days, by time and number.

    The ways to write its code are tried in turn, and the first that has any row here holds. company_id, disclosed_date and market reach the
    scan as they are; the one row that tells which way holds is all that is broadcast.
    """
    ways = [r[0] for r in rows.sparkSession.range(1).select(F.explode(K.code_candidates(F.lit(code)))).collect()]  # at most three
    kept = rows.filter(F.col("company_id").isin(*ways) & F.col("disclosed_date").between(start, end))
    if keyword.strip():
        kept = kept.filter(like(F.col("title"), keyword.strip()) | like(F.col("title_display"), keyword.strip()))
    if market.strip() not in ("", ALL_MARKETS):
        kept = kept.filter(F.col("market") == market.strip())
    rank = F.array_position(F.array(*[F.lit(w) for w in ways]), F.col("company_id"))
    best = kept.agg(F.min(rank).alias("__best"))
    return kept.join(F.broadcast(best), rank == F.col("__best")).drop("__best").orderBy("disclosed_at", "acpt_no")


def company_index(companies: DataFrame, keyword: str = "", market: str = ALL_MARKETS) -> tuple[DataFrame, DataFrame]:
    """(companies whose name holds the keyword, those with most disclosures first; all markets there are, sorted behind the word for all)."""
    kept = companies
    if keyword.strip():
        kept = kept.filter(F.contains(F.lower(F.coalesce("company_name", F.lit(""))), F.lit(keyword.strip().casefold())))
    if market != ALL_MARKETS:
        kept = kept.filter(F.coalesce("market", F.lit("")) == market)
    found = companies.filter(~_blank(F.col("market"))).select(F.trim("market").alias("market")).distinct().withColumn("place", F.lit(1))
    every = companies.sparkSession.range(1).select(F.lit(ALL_MARKETS).alias("market"), F.lit(0).alias("place"))
    return kept.orderBy(F.desc("disclosures"), F.coalesce("company_name", F.lit(""))), every.unionByName(found).orderBy("place", "market").select("market")


def unique_companies(companies: DataFrame, position: str = "position") -> DataFrame:
    """(company_name, stock_code, market, flags, position): one row a name and code, in order of first appearance.

    The first market that is not blank holds; flags are all badges in order of appearance. Rows without a name go. All by partial aggregation.
    """
    named = companies.select(F.trim("company_name").alias("company_name"), K.export_code(F.coalesce("company_id", F.lit(""))).alias("stock_code"), F.trim(F.coalesce("market", F.lit(""))).alias("market"), "badges", F.col(position).alias("position"))
    named = named.filter(~_blank(F.col("company_name")))
    key = F.struct("company_name", "stock_code")
    has = F.col("market") != ""
    rows = named.groupBy("company_name", "stock_code").agg(F.coalesce(F.min_by(F.when(has, F.col("market")), F.when(has, F.col("position"))), F.lit("")).alias("market"), F.min("position").alias("position"))
    flags = listing.ordered_union(named.withColumn("key", key).filter("badges IS NOT NULL"), "key", "badges", "position").select("key.*", F.col("badges").alias("flags"))
    return rows.join(flags, ["company_name", "stock_code"], "left").select("company_name", "stock_code", "market", F.coalesce("flags", F.lit("")).alias("flags"), "position")


def stored_results(results: DataFrame, ticker: str = "", parameter_hash: str = "") -> DataFrame:
    """Results of labels, of a ticker and of one set of parameters if they are given, by the time of the event."""
    for column, value in (("ticker", ticker), ("parameter_hash", parameter_hash)):
        if value:
            results = results.filter(F.col(column) == value)
    return results.orderBy("event_datetime", "disclosure_id")


def with_metadata(records: DataFrame, meta: DataFrame, mode: str) -> DataFrame:
    """Parsed records with what the listing knows of them, by acpt_no; records that it knows nothing of stay as they are.

    meta: (acpt_no, market, company_name, disclosed_at, doc_no, family_id, current_sequence, family_member_count). disclosed_at and market replace, doc_no fills
    a blank, the three columns of a family come together, and the company's name only in modes whose records bear it. Of several rows of a
    number the last by disclosed_at counts.
    """
    names = ["market", "company_name", "disclosed_at", "doc_no", "family_id", "current_sequence", "family_member_count"]
    last = meta.groupBy("acpt_no").agg(F.max_by(F.struct(*names), F.struct("disclosed_at", "doc_no")).alias("__m")).withColumnRenamed("acpt_no", "__a")
    both = records.join(last, records["acpt_no"] == F.col("__a"), "left")
    m = lambda c: F.col(f"__m.{c}")
    family = ~_blank(m("family_id")) & m("current_sequence").isNotNull() & m("family_member_count").isNotNull()
    old = lambda c, kind="string": F.col(c) if c in records.columns else F.lit(None).cast(kind)
    new = {
        "disclosed_at": F.when(~_blank(m("disclosed_at")), F.trim(m("disclosed_at"))).otherwise(old("disclosed_at")),
        "doc_no": F.when(_blank(old("doc_no")) & ~_blank(m("doc_no")), m("doc_no")).otherwise(old("doc_no")),
        "market": F.when(~_blank(m("market")), m("market")).otherwise(old("market")),
        "family_id": F.when(family, m("family_id")).otherwise(old("family_id")),
        "current_sequence": F.when(family, m("current_sequence")).otherwise(old("current_sequence", "int")),
        "family_member_count": F.when(family, m("family_member_count")).otherwise(old("family_member_count", "int")),
    }
    if mode in NAMED_MODES:
        new["corp_name"] = F.when(~_blank(m("company_name")), m("company_name")).otherwise(old("corp_name"))
    return both.withColumns(new).drop("__a", "__m")


def _depth(text: Column) -> Column:
    """How deep the brackets of a JSON text stand in each other, outside of its strings."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"([\[\]{}])"), F.lit(1))
    step = lambda s, m: let(s["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1), lambda now: F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most")))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


_LEAVES = "array<struct<path:array<string>,what:string,number:double>>"


def _opened(node: Column, bad: Column) -> Column:
    """(leaf, inside) of a value with its path: what a leaf is, or the values one level further in."""
    number = r"-?[0-9]+\.?[0-9]*"
    path, v = node["path"], node["v"]
    deeper = lambda name, value: F.struct(F.concat(path, F.array(name)).alias("path"), value.alias("v"))

    def leaf(kind: Column) -> Column:
        text, plain = v.cast("string"), F.coalesce(kind, F.lit("VOID"))
        found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), number, 0)
        is_number = ~plain.isin("BOOLEAN", "VOID") & ~plain.startswith("OBJECT") & ~plain.startswith("ARRAY") & (F.coalesce(found, F.lit("")) != "")
        what = F.when(bad, "bad").when(is_number, "number").otherwise(F.concat(plain, F.lit(":"), F.coalesce(text, F.lit("null"))))
        return F.struct(path.alias("path"), what.alias("what"), F.when(is_number, found.cast("double")).alias("number"))

    def open_(kind: Column) -> Column:
        an_object = F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))
        a_list = F.coalesce(kind.startswith("ARRAY<") & ((kind != "ARRAY<VOID>") | (v.cast("string") != "[]")), F.lit(False))
        fields = F.transform(F.map_entries(v.cast("map<string,variant>")), lambda e: deeper(F.concat(F.lit("k"), e["key"]), e["value"]))
        items = F.transform(v.cast("array<variant>"), lambda x, i: deeper(F.concat(F.lit("i"), F.lpad(i.cast("string"), 10, "0")), x))
        return F.struct(F.when(~an_object & ~a_list, leaf(kind)).alias("leaf"), F.when(an_object, fields).when(a_list, items).alias("inside"))

    return let(F.schema_of_variant(v), open_)


def numeric_signature(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, shape, numbers) of JSON of any depth: what it is made of, with numbers taken out, and these in order.

    Two values have one shape if they differ in numbers alone. Objects read by key, lists by place; a text that holds a number counts as its first
    number, booleans and all else by value. Each round opens one level of a value, as VARIANT, inside its row: nothing is shuffled and a text is parsed once. One pass before finds
    the deepest value, and so the number of rounds. Text that is no JSON has the shape "bad".
    """
    parsed = F.try_parse_json(json_col)
    rounds = rows.agg(F.max(F.when(parsed.isNotNull(), _depth(F.col(json_col))))).first()[0] or 0
    level = rows.select(F.col(id_col).alias("__id"), F.col(json_col).isNotNull().alias("__given"), parsed.alias("__v"))
    level = level.select("__id", (F.col("__v").isNull() & F.col("__given")).alias("__bad"), F.array(F.struct(F.array().cast("array<string>").alias("path"), F.col("__v").alias("v"))).alias("__todo"), F.array().cast(_LEAVES).alias("__done"))
    for _ in range(rounds + 1):
        level = level.select("__id", "__bad", F.transform("__todo", lambda n: _opened(n, F.col("__bad"))).alias("__open"), "__done")
        inside = F.flatten(F.filter(F.transform("__open", lambda o: o["inside"]), lambda x: x.isNotNull()))
        level = level.select("__id", "__bad", inside.alias("__todo"), F.concat("__done", F.filter(F.transform("__open", lambda o: o["leaf"]), lambda x: x.isNotNull())).alias("__done"))
    level = level.select("__id", F.array_sort("__done").alias("__all"))
    shape = F.array_join(F.transform("__all", lambda x: F.concat(F.to_json(x["path"]), F.lit("="), x["what"])), ";")
    return level.select(F.col("__id").alias(id_col), shape.alias("shape"), F.transform(F.filter("__all", lambda x: x["number"].isNotNull()), lambda x: x["number"]).alias("numbers"))


def merge_companies(rows: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(companies, counts): records of companies merged by key, each disclosure counted once over all of them.

    rows: (company_key, company_name, company_id, market, badges, acpt_no, position), one row a disclosure, in order of reading. Of a number that comes twice the first row
    keeps it, whatever its company; a row without a number is an error. A company whose disclosures others had first is not listed. Name, code and market are the
    first that are not blank among its rows; badges are listed once, in order. counts: (kept, duplicates). Firsts by number are one partial aggregation.
    """
    number = F.trim(F.coalesce("acpt_no", F.lit("")))
    checked = rows.withColumn("acpt_no", F.when(number == "", F.raise_error(F.lit("acpt_no is required for classification records")).cast("string")).otherwise(number))
    first = checked.groupBy("acpt_no").agg(F.min_by("company_key", F.col(position)).alias("company_key"), F.count("*").alias("n"))
    kept = first.groupBy("company_key").agg(F.count("*").alias("disclosures"))
    filled = lambda c: F.min_by(F.when(~_blank(F.col(c)), F.col(c)), F.when(~_blank(F.col(c)), F.col(position))).alias(c)
    named = rows.groupBy("company_key").agg(filled("company_name"), filled("company_id"), filled("market"))
    badges = listing.ordered_union(rows.filter("badges IS NOT NULL"), "company_key", "badges", position)
    companies = named.join(kept, "company_key").join(badges, "company_key", "left").withColumn("badges", F.coalesce("badges", F.lit("")))
    return companies, first.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def union_keep_last(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The frames one below the other; of each key the last row of the last frame that has it stays, in the place of that row. Rows without a key all stay."""
    told = [f.withColumn("__frame", F.lit(i)) for i, f in enumerate(frames)]
    every = told[0]
    for f in told[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    columns = [c for c in every.columns if c != "__frame"]
    place = F.struct("__frame", *order)
    last = every.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), place).alias("__r")).select("__r.*")
    return last.unionByName(every.filter(F.col(key).isNull()).drop("__frame"))


def panel_summary(rows: DataFrame, by: str, group: str, k: int = 5) -> DataFrame:
    """(by, disclosures, after_close, first, last, top): counts, the range of trading days, and the k groups with most rows, ties by name.

    rows: (by, group, trade_day, event_date). Groups are counted before any are ranked, so the window holds a row a group.
    """
    counts = rows.groupBy(by, group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), group))
    top = counts.withColumn("__r", rank).filter(F.col("__r") <= k).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.concat(F.col(group), F.lit(":"), F.col("n")).alias("t")))), lambda x: x["t"]), ", ").alias("top"))
    base = rows.groupBy(by).agg(F.count("*").alias("disclosures"), F.count_if(F.col("trade_day") > F.col("event_date")).alias("after_close"), F.min("trade_day").alias("first"), F.max("trade_day").alias("last"))
    return base.join(top, by)


def resume_at(total: int, expected: int | None, offset: int) -> int:
    """Where a scan goes on: behind the offset, or at 0 if the source no longer counts what it did."""
    return 0 if expected is not None and total != expected else offset
