"""Fields of rights issues (paid, bonus or both) out of the grids of their tables.

A field is a path of labels in a row's first cells and the value its last cell. Where a title says both, a row that reads
"무상증자" alone parts the paid rows from the bonus rows. grid: rows of all tables (id, table, row, cells); titles: (id, title).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import records as R

#: Labels by what they head, kinds of stock with the words for them, and the heads of the table of targets.
PRIMARY = ("신주의 종류와 수", "신주 발행가액")
MARKERS = ("유상증자", "무상증자")
TARGET_HEADERS = ("제3자배정 대상자", "배정주식수")
BEFORE = ("증자전 발행주식총수 (주)", "증자전 발행주식총수")
PER_SHARE = ("1주당 신주배정주식수 (주)", "1주당 신주배정주식수")
STOCKS = (("보통주식", ("보통주식", "보통주")), ("기타주식", ("기타주식", "기타주", "우선주식", "우선주", "종류주식", "종류주")))
NOT_APPLICABLE = "not_applicable"
KINDS = ("common", "other")


def _plain(words: str) -> str:
    return words.replace(" ", "")


def _is(r: Column, cell: int, labels: tuple[str, ...]) -> Column:
    """Whether a cell of a row is one of the labels. Labels that start with a number lose it as the cell does."""
    return F.coalesce(r[f"label{cell}"].isin(*[_plain(w) for w in labels]), F.lit(False))


def sections(grid: DataFrame, titles: DataFrame | None, id_col: str) -> DataFrame:
    """One row a document: its kind and error, `rows` of the tables that count, in order, those of the main section in `top` and of the bonus part in `bonus`, and
    `asks` (the first table that heads a column of targets and one of their stock: table, row, both columns).

    A document without a title, of a title that names no issue, or of both kinds without the row that parts them has an error and no section.
    Documents of read_tables stay where they are; only a grid in rows is shuffled, once, by document.
    """
    docs = R.by_document(grid, titles, id_col, "left").select(id_col, F.trim(F.coalesce("title", F.lit(""))).alias("title"), R.document_lines("tables").alias("all"))
    lone = lambda r: (F.size(r["line"]) == 1) & T.normalize_label(F.replace(F.get(r["line"], 0), F.lit(" "), F.lit(""))).isin(*MARKERS)
    told = F.transform(
        "all",
        lambda r: F.struct(r["table"].alias("table"), r["row"].alias("row"), F.struct(r["table"].alias("table"), r["row"].alias("row")).alias("at"), r["cells"].alias("cells"), r["line"].alias("line"), lone(r).alias("marker"), *[R.cell_label(r["line"], n).alias(f"label{n}") for n in (1, 2, 3)]),
    )
    docs = docs.withColumn("all", told).withColumn("heads", R.table_heads("all"))
    headed = F.filter("heads", lambda h: reduce(lambda a, b: a & b, [R._has(h["line"], w) for w in TARGET_HEADERS]))
    counting = F.filter("all", lambda r: r["marker"] | ((F.size(r["line"]) >= 2) & _is(r, 1, PRIMARY)))
    docs = docs.withColumns({"asks": R.asking_table("heads", TARGET_HEADERS), "count": F.array_distinct(F.transform(F.concat(counting, headed), lambda r: r["table"]))})
    docs = docs.select(id_col, "title", "asks", F.filter("all", lambda r: F.array_contains("count", r["table"])).alias("rows"), T.issuance_type(F.col("title")).alias("kind"))
    docs = docs.withColumn("parts_at", F.get(F.filter("rows", lambda r: r["marker"] & _is(r, 1, (MARKERS[1],))), 0)["at"])
    both = F.col("kind") == "mixed"
    error = F.when(F.col("title") == "", "no title").when(F.col("kind") == "unknown", "title names no issue").when(both & F.col("parts_at").isNull(), "no row parts paid from bonus")
    docs = docs.withColumn("error", R.once(error))
    fine = F.col("error").isNull()
    return docs.withColumns({
        "top": F.filter("rows", lambda r: fine & F.when(both, r["at"] < F.col("parts_at")).otherwise(True)),
        "bonus": F.filter("rows", lambda r: fine & F.when(both, r["at"] > F.col("parts_at")).otherwise(F.col("kind") == "bonus")),
    })


def _first(flag: str, rank: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """value of the first row (of the lowest rank) that fits; null if it has none."""
    return R.let(R.first_row(flag, rank), value)


def _last(r: Column, cells: Column | int) -> Column:
    """The last cell of a row longer than its labels."""
    return F.when(F.size(r["line"]) > cells, F.element_at(r["line"], -1))


def _stock(flag: str, labels: tuple[str, ...], unit: str, words: tuple[str, ...], fixed_price: bool = False, alone: bool = False) -> Column:
    """The last cell of the first row under labels for one kind of stock. fixed_price: or one cell further in, behind the fixed price; alone: or of
    a row of a label and a value."""
    names = tuple(f"{w} ({unit})" for w in words)
    fits = lambda r: _is(r, 2, names)
    deep = lambda r: _is(r, 2, ("확정발행가",)) & _is(r, 3, names)

    def rank(r: Column) -> Column:
        found = F.when(fits(r), 0)
        if fixed_price:
            found = found.when(deep(r), 1)
        if alone:
            found = found.otherwise(2)
        return F.when(_is(r, 1, labels), found)

    def value(r: Column) -> Column:
        cells = F.lit(2)
        if fixed_price:
            cells = F.when(fits(r), 2).otherwise(3)
        if alone:
            cells = F.when(fits(r), 2).when(F.size(r["line"]) == 2, 1).otherwise(99)
        return _last(r, cells)

    return _first(flag, rank, value)


def _pair(values: list[Column]) -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), v.alias("amount")) for (label, _), v in zip(STOCKS, values, strict=True)])


def _stock_status(items: str) -> Column:
    """parsed if any amount is above 0, explicit_zero if any says 0, else source_not_found."""
    some = lambda test: F.exists(items, lambda x: F.coalesce(test(x["amount"]), F.lit(False)))
    return F.when(some(lambda a: a > 0), R.FOUND).when(some(lambda a: a == 0), R.ZERO).otherwise(R.MISSING)


def _targets() -> Column:
    """Of a document: its targets (label, amount), whether all of them are hidden, whether a table asks for any."""
    inside = F.filter("rows", lambda r: (r["table"] == F.col("asks.table")) & (r["row"] > F.col("asks.row")))

    def one(r: Column) -> Column:
        raw = F.get(r["cells"], F.col("asks.a") - 1)
        given = T.parse_ints(raw)
        return F.struct(F.get(r["cells"], F.col("asks.n") - 1).alias("label"), raw.alias("raw"), F.when(F.size(given) > 0, F.aggregate(given, F.lit(0).cast("long"), lambda x, y: x + y)).alias("amount"))

    none = F.array().cast("array<struct<label:string,raw:string,amount:bigint>>")
    read = F.when(F.col("asks").isNotNull(), F.transform(inside, one)).otherwise(none)
    hidden = lambda x: F.coalesce((F.trim(x["label"]) == "-") & x["raw"].isNotNull() & x["amount"].isNull(), F.lit(False))
    named = lambda xs: F.filter(xs, lambda x: x["label"].isNotNull() & ~x["label"].isin("", "-") & x["amount"].isNotNull())
    return R.let(read, lambda xs: F.struct(
        F.transform(named(xs), lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("amount"))).alias("targets"),
        ((F.size(xs) > 0) & F.forall(xs, hidden)).alias("undisclosed"),
        (F.col("error").isNull() & F.col("asks").isNotNull()).alias("listed"),
    ))


def rights_fields(grid: DataFrame, titles: DataFrame | None, id_col: str) -> DataFrame:
    """One record a document: kind, error, fields of the main section, those of a bonus part (bonus_*), and `status` by field.

    Amounts by kind of stock are (label, amount) for common and other stock, null where no row gives them. Prices, purposes, method,
    payment date and targets do not apply to a bonus issue and are null there. grid: documents of read_tables with their title, or rows beside titles.
    """
    docs = sections(grid, titles, id_col)
    purpose = lambda r: F.struct(T.purpose_label(F.get(r["line"], 1)).alias("label"), T.parse_int(F.element_at(r["line"], -1), True).alias("amount"))
    one = lambda flag, *labels: _first(flag, lambda r: F.when(_is(r, 1, labels), 0), lambda r: _last(r, 1))
    stock = lambda name, flag, labels, unit, **how: [_stock(flag, labels, unit, words, **how).alias(f"__{name}_{k}") for k, (_, words) in zip(KINDS, STOCKS, strict=True)]
    per_share = lambda flag: [_stock(flag, PER_SHARE, "주", words, alone=i == 0).alias(f"__{flag}_per_{KINDS[i]}") for i, (_, words) in enumerate(STOCKS)]
    got = docs.select(
        id_col,
        "title",
        "kind",
        "error",
        *stock("counts", "top", PRIMARY[:1], "주"),
        *stock("before", "top", BEFORE, "주"),
        *stock("prices", "top", PRIMARY[1:], "원", fixed_price=True),
        *stock("bonus_counts", "bonus", PRIMARY[:1], "주"),
        *stock("bonus_before", "bonus", BEFORE, "주"),
        *per_share("top"),
        *per_share("bonus"),
        F.transform(F.filter("top", lambda r: _is(r, 1, ("자금조달의 목적",)) & (F.size(r["line"]) >= 3)), purpose).alias("__purposes"),
        one("top", "증자방식").alias("method"),
        one("top", "납입일").alias("payment_date"),
        one("top", "신주권교부예정일").alias("delivery_date"),
        one("top", "신주의 상장 예정일").alias("listing_date"),
        one("top", "신주배정기준일").alias("record_date"),
        one("bonus", "신주배정기준일").alias("bonus_record_date"),
        one("bonus", "신주권교부예정일").alias("bonus_delivery_date"),
        one("bonus", "신주의 상장 예정일").alias("bonus_listing_date"),
        _targets().alias("__given"),
    ).withColumns({c: F.col(f"__given.{c}") for c in ("targets", "undisclosed", "listed")})
    read = lambda name: _pair([T.parse_int(F.col(f"__{name}_{k}"), True) for k in KINDS])
    text = lambda flag: F.array(*[F.nullif(F.nullif(F.trim(f"__{flag}_per_{k}"), F.lit("")), F.lit("-")) for k in KINDS])
    pays = F.col("kind").isin("paid", "mixed") & F.col("error").isNull()
    counts_bonus = F.col("kind").isin("bonus", "mixed") & F.col("error").isNull()
    got = got.withColumns({n: read(n) for n in ("counts", "before", "prices", "bonus_counts", "bonus_before")})
    got = got.withColumns({"price_status": _stock_status("prices"), "counts_status": _stock_status("counts"), "before_status": _stock_status("before")})
    kept = F.transform(F.filter("__purposes", lambda p: p["label"].isNotNull() & (p["amount"] != 0)), lambda p: F.struct(p["label"].alias("label"), p["amount"].alias("amount")))
    any_amount = F.exists("__purposes", lambda p: p["amount"].isNotNull())
    asked = F.coalesce(F.col("method").contains("제3자배정"), F.lit(False)) & ~F.col("title").contains("종속회사")
    whole = R.without_total("targets", R.total("counts"))
    given = F.size(whole) > 0
    got = got.withColumns(
        {
            "purposes": F.when(pays & any_amount, kept),
            "purpose_status": F.when(F.size(kept) > 0, R.FOUND).when(any_amount, R.ZERO).otherwise(R.MISSING),
            "target_status": F.when(F.col("undisclosed"), R.ZERO).when(F.col("listed"), F.when(given, R.FOUND).otherwise(R.MISSING)).when(asked, R.MISSING),
            "targets": F.when(F.col("undisclosed"), F.array(F.struct(F.lit("-").alias("label"), F.lit(0).cast("long").alias("amount")))).when(F.col("listed"), F.when(given, whole)).when(~asked, F.array().cast("array<struct<label:string,amount:bigint>>")),
        }
    )
    got = got.withColumns({f: F.when(pays, F.col(f)) for f in ("prices", "targets", "method", "payment_date")})
    found = lambda f: F.when(F.col(f).isNull() | (F.col(f) == ""), R.MISSING).otherwise(R.FOUND)
    money = lambda s: F.when(pays, s).otherwise(NOT_APPLICABLE)
    status = {
        "counts": F.col("counts_status"),
        "before": F.col("before_status"),
        "prices": money(F.col("price_status")),
        "purposes": money(F.col("purpose_status")),
        "targets": money(F.col("target_status")),
        "method": money(found("method")),
        "payment_date": money(found("payment_date")),
        "delivery_date": found("delivery_date"),
        "listing_date": found("listing_date"),
    }
    got = got.withColumn("status", F.create_map(*[x for f, s in sorted(status.items()) for x in (F.lit(f), s)]))
    bonus = lambda c: F.when(counts_bonus, c)
    return got.select(
        id_col, "title", "kind", "error", "counts", "before", "prices", "purposes", "method", "payment_date", "delivery_date", "listing_date", "targets", F.when(pays, F.col("record_date")).alias("record_date"), F.when(pays, text("top")).alias("per_share"),
        *[bonus(F.col(c)).alias(c) for c in ("bonus_counts", "bonus_before", "bonus_record_date", "bonus_delivery_date", "bonus_listing_date")], bonus(text("bonus")).alias("bonus_per_share"), "status",
    )


def with_warnings(found: DataFrame) -> DataFrame:
    """rights_fields with `warnings`: what does not add up, (level, warning), behind a strong one for each field that has no source."""
    said_zero = lambda items: F.exists(items, lambda x: F.coalesce(x["amount"] == 0, F.lit(False)))
    common = F.coalesce(F.get("before", F.lit(0))["amount"] == 0, F.lit(False))
    sums = R.rights_warnings("counts", "before", "purposes", "prices", "targets", said_zero("counts"), said_zero("before"), common)
    lost = F.transform(F.filter(F.map_entries("status"), lambda s: s["value"] == R.MISSING), lambda s: F.struct(F.lit("strong").alias("level"), F.concat(s["key"], F.lit(": no source")).alias("warning")))
    return found.withColumn("warnings", F.when(F.col("error").isNull(), F.concat(lost, sums)))


def to_records(found: DataFrame, id_col: str, position: str | None = None) -> DataFrame:
    """rights_fields in the shape that build.issuance_graph reads; documents with an error have none."""
    day = T.find_date(F.col("payment_date"))
    at = F.col(position) if position else F.col(id_col).cast("long")
    return found.filter("error IS NULL").select(F.col(id_col).cast("string").alias("acpt_no"), at.alias("position"), "title", "kind", day.alias("paid_on"), F.col("counts").alias("items"), "purposes", F.col("targets").alias("people"))
