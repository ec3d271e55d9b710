"""Parsed records of bonds and rights: fields out of table grids, checks of sums, exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html_tables
from . import merge

#: Labels by the cell they stand in. Of several labels the first that is there counts.
MAIN_TABLE = ("사채의 종류", "사채의 권면", "자금조달의 목적")
EXERCISE_TARGET = ("전환대상", "교환대상", "인수권행사대상", "전환에 따라", "교환에 따라", "인수권행사에 따라", "전환으로 발행할", "교환으로 발행할", "인수권행사로 발행할", "신주인수권행사에 따라")
EXERCISE_PRICE = ("전환가액", "교환가액", "행사가액", "전환가격", "교환가격", "행사가격")
EXERCISE_PERIOD = ("전환청구기간", "교환청구기간", "권리행사기간", "행사기간")
INVESTOR_HEADERS = ("발행 대상자명", "발행권면")
NO_INVESTOR = ("", "-", "합계", "총계", "계")
TOTAL_WORDS = ("계", "합계", "소계", "총계")
FOUND, ZERO, MISSING = "parsed", "explicit_zero", "source_not_found"


def _has(row: Column, words: str) -> Column:
    """Whether a row's text, or that text without spaces, holds the words."""
    return _holds(F.array_join(row, " "), words)


def _holds(text: Column, words: str) -> Column:
    return text.contains(words) | F.replace(text, F.lit(" "), F.lit("")).contains(words.replace(" ", ""))


def logical_rows(grid: DataFrame) -> DataFrame:
    """Grid rows (id, table, row, cells) with `line`: the cells without blanks and repeats of the one before."""
    filled = F.exists("cells", lambda c: c.rlike(f"[^{T.WHITE}]"))
    return grid.filter(filled).withColumn("cells", F.transform("cells", lambda c: T.collapse_spaces(c))).withColumn("line", T.drop_repeats(F.col("cells")))


def by_document(grid: DataFrame, titles: DataFrame | None, id_col: str, how: str) -> DataFrame:
    """(id, title, tables): one row a document. Of a grid in rows (id, table, row, cells) these are brought together and joined to titles; documents as read_tables
    gives them, with their title, stay where they are."""
    if "tables" in grid.columns:
        return grid.select(id_col, "title", "tables")
    found = html_tables.gather_tables(grid.withColumn("cells", F.transform("cells", lambda c: T.collapse_spaces(c))), id_col)
    return titles.select(id_col, "title").join(found, id_col, how).withColumn("tables", F.coalesce("tables", F.array().cast(html_tables.TABLES)))


def document_lines(tables: str) -> Column:
    """The rows of all tables of a document in order, (table, row, cells, line) as in logical_rows. Cells come without white space to collapse."""
    every = F.flatten(F.transform(tables, lambda t: F.transform(t["rows"], lambda cells, i: F.struct(t["table"].alias("table"), i.alias("row"), cells.alias("cells")))))
    full = F.filter(every, lambda r: F.exists(r["cells"], lambda c: c != ""))
    return F.transform(full, lambda r: F.struct(r["table"].alias("table"), r["row"].alias("row"), r["cells"].alias("cells"), T.drop_repeats(r["cells"]).alias("line")))


def cell_label(line: Column, n: int) -> Column:
    """normalize_label of the nth cell of a document's line."""
    return T.without_number(F.replace(F.get(line, n - 1), F.lit(" "), F.lit("")))


def once(c: Column) -> Column:
    """c as a column that a filter above does not work out anew: the optimizer moves filters, and all they stand on, below projections but not below this."""
    return F.explode_outer(F.array(c))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def table_heads(rows: str) -> Column:
    """The first row of each table."""
    return F.filter(rows, lambda r, i: (i == 0) | (F.get(F.col(rows), i - 1)["table"] != r["table"]))


def asking_table(heads: str, words: tuple[str, str]) -> Column:
    """(table, row, n, a) of the first table whose head has both words, in different cells: the places of these cells, from 1."""
    place = lambda cells, w: F.array_position(F.transform(cells, lambda c: _holds(c, w)), True).cast("int")
    both = F.filter(heads, lambda h: reduce(lambda x, y: x & y, [_has(h["line"], w) for w in words]))
    found = F.transform(both, lambda h: F.struct(h["table"].alias("table"), h["row"].alias("row"), place(h["cells"], words[0]).alias("n"), place(h["cells"], words[1]).alias("a")))
    return F.get(F.filter(found, lambda x: (x["n"] > 0) & (x["a"] > 0) & (x["n"] != x["a"])), 0)


def first_row(rows: str, rank: Callable[[Column], Column]) -> Column:
    """The first of the rows with the lowest rank that any row has; null if all have none."""
    return let(F.transform(rows, rank), lambda ranks: F.get(F.col(rows), F.array_position(ranks, F.array_min(ranks)).cast("int") - 1))


def bond_fields(grid: DataFrame, titles: DataFrame | None, id_col: str) -> DataFrame:
    """One record a bond document that has a main table: its fields, and in `status` by field whether it was found.

    grid: documents of read_tables with their title, or rows of all tables of the documents (id, table, row, cells) beside titles (id, title). A document is one row, and each
    field the first row of its tables with a label; only rows that come apart are shuffled, once, by document.
    """
    bare = lambda w: w.replace(" ", "")
    end = lambda r: F.element_at(r["line"], -1)
    docs = by_document(grid, titles, id_col, "right").select(id_col, "title", document_lines("tables").alias("__rows"))
    docs = docs.withColumn("__told", F.transform("__rows", lambda r: F.struct(r["table"].alias("table"), F.array_join(r["line"], " ").alias("text"))))
    holding = [F.transform(F.filter("__told", lambda r: _holds(r["text"], w)), lambda r: r["table"]) for w in MAIN_TABLE]
    docs = docs.withColumns({"__table": once(F.array_min(reduce(F.array_intersect, holding))), "__heads": table_heads("__rows")}).filter(F.col("__table").isNotNull())
    docs = docs.withColumn("__asks", asking_table("__heads", INVESTOR_HEADERS))
    mine = F.filter("__rows", lambda r: r["table"] == F.col("__table"))
    docs = docs.withColumn("__main", F.transform(mine, lambda r: F.struct(r["row"].alias("row"), r["line"].alias("line"), *[cell_label(r["line"], n).alias(f"label{n}") for n in (1, 2, 3)])))
    given = F.filter("__rows", lambda r: (r["table"] == F.col("__asks.table")) & (r["row"] > F.col("__asks.row")))
    investor = F.transform(given, lambda r: F.struct(F.coalesce(F.get(r["cells"], F.col("__asks.n") - 1), F.lit("")).alias("name"), T.parse_int(F.get(r["cells"], F.col("__asks.a") - 1), True).alias("amount")))

    def first(cell: int, words: tuple[str, ...], prefix: bool = False, also: Callable[[Column], Column] | None = None, longer: int | None = None, value: Callable[[Column], Column] = end) -> Column:
        """value of the first row whose cell is (or starts with) the first of the words that any row has; null if it is too short."""

        def rank(r: Column) -> Column:
            told = r[f"label{cell}"]
            found = F.coalesce(*[F.when(told.startswith(bare(w)) if prefix else told == bare(w), F.lit(i)) for i, w in enumerate(words)])
            return found if also is None else F.when(also(r), found)

        return let(first_row("__main", rank), lambda row: F.when(F.size(row["line"]) > (cell if longer is None else longer), value(row)))

    purpose = lambda r: F.struct(r["row"].alias("row"), T.purpose_label(F.get(r["line"], 1)).alias("label"), F.when(F.size(r["line"]) > 2, T.parse_int(end(r), True)).alias("amount"))
    got = docs.select(
        id_col,
        "title",
        first(2, ("회차",), value=lambda r: F.get(r["line"], 2)).alias("round"),
        first(2, EXERCISE_TARGET, prefix=True).alias("target"),
        F.coalesce(F.exists("__main", lambda r: r["label2"] == "원화기준(원)"), F.lit(False)).alias("__won"),
        first(2, ("원화기준 (원)",)).alias("__a"),
        first(1, ("사채의 권면",), prefix=True).alias("__b"),
        F.transform(F.filter("__main", lambda r: r["label1"] == "자금조달의목적"), purpose).alias("__purposes"),
        first(2, tuple(f"{w} (원/주)" for w in EXERCISE_PRICE)).alias("__price"),
        first(1, ("납입일",)).alias("payment_date"),
        first(1, ("사채만기일", "사채만기")).alias("maturity_date"),
        first(1, ("사채발행방법",)).alias("method"),
        first(2, EXERCISE_PERIOD, also=lambda r: r["label3"] == "시작일", longer=3).alias("exercise_start"),
        first(2, EXERCISE_PERIOD, also=lambda r: r["label3"] == "종료일", longer=3).alias("exercise_end"),
        F.filter(F.coalesce(investor, F.array().cast("array<struct<name:string,amount:bigint>>")), lambda i: ~i["name"].isin(*NO_INVESTOR) & i["amount"].isNotNull()).alias("__people"),
    )
    paid = F.filter("__purposes", lambda p: p["label"].isNotNull() & (p["amount"] != 0))
    got = got.withColumn("investors", F.when(F.size("__people") > 0, F.col("__people")))
    got = got.withColumns(
        {
            "type": T.bond_type(F.coalesce("title", F.lit(""))),
            "amount": T.parse_int(F.when(F.col("__won"), F.col("__a")).otherwise(F.col("__b")), True),
            "exercise_price": T.parse_price(F.col("__price")),
            "purposes": F.transform(paid, lambda p: F.struct(p["label"].alias("label"), p["amount"].alias("amount"))),
        }
    )
    any_amount = F.exists("__purposes", lambda p: p["amount"].isNotNull())
    plain = ("round", "type", "target", "exercise_price", "payment_date", "maturity_date", "method", "exercise_start", "exercise_end", "investors")
    status = {f: F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), MISSING).otherwise(FOUND) for f in plain}
    status["amount"] = F.when(F.col("amount").isNull(), MISSING).when(F.col("amount") == 0, ZERO).otherwise(FOUND)
    status["purposes"] = F.when(F.size("purposes") > 0, FOUND).when(any_amount, ZERO).otherwise(MISSING)
    got = got.withColumn("status", F.create_map(*[x for f, s in sorted(status.items()) for x in (F.lit(f), s)]))
    return got.select(id_col, "title", "round", "type", "target", "amount", "purposes", "exercise_price", "payment_date", "maturity_date", "method", "exercise_start", "exercise_end", "investors", "status")


def total(items: str | Column) -> Column:
    """Sum of the amounts of (label, amount) items; 0 for none."""
    return F.aggregate(F.coalesce(F.transform(items, lambda x: F.coalesce(x["amount"].cast("long"), F.lit(0).cast("long"))), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)


def _grouped(c: Column) -> Column:
    return F.format_number(c, 0)


def _any(items: str) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def bond_warnings(amount: str = "amount", purposes: str = "purposes", people: str = "investors") -> Column:
    """Warnings where the purposes or the investors do not add up to the amount."""
    off = lambda items, words: F.when(F.col(amount).isNotNull() & _any(items) & (total(items) != F.col(amount)), F.concat(F.lit(words), F.lit("("), _grouped(total(items)), F.lit(")가 발행금액("), _grouped(F.col(amount)), F.lit(")과 일치하지 않습니다.")))
    return F.array_compact(F.array(off(purposes, "발행목적: 자금조달 목적 합계"), off(people, "투자자: 발행권면총액 합계")))


def without_total(targets: str, stock_total: Column) -> Column:
    """Targets without a last line that is their total: labelled so, and all add up to twice the stock."""
    t, end = F.col(targets), F.element_at(targets, -1)
    named = F.arrays_overlap(F.split(F.trim(end["label"]), r"\s+"), F.array(*[F.lit(w) for w in TOTAL_WORDS]))
    twice = (F.size(t) >= 2) & (stock_total > 0) & (total(targets) == 2 * stock_total) & (end["amount"] == stock_total)
    return F.when(twice & named, F.slice(t, 1, F.size(t) - 1)).otherwise(t)


def rights_warnings(counts: str = "counts", before: str = "before", purposes: str = "purposes", prices: str = "prices", targets: str = "targets", zero_counts: Column | None = None, zero_before: Column | None = None, zero_common: Column | None = None) -> Column:
    """(level, warning) of a rights record. Prices, purposes and targets that do not apply are null.

    zero_counts, zero_before, zero_common: whether the source says 0 for new shares, for shares before, for common shares before.
    """
    stock, given = total(counts), total(targets)
    price_of = lambda label: F.element_at(F.filter(prices, lambda p: p["label"] == label), -1)["amount"].cast("long")
    worth = F.filter(F.transform(counts, lambda c: F.when(price_of(c["label"]) > 0, F.coalesce(c["amount"].cast("long"), F.lit(0).cast("long")) * price_of(c["label"]))), lambda x: x.isNotNull())
    value = F.when(F.size(worth) > 0, F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x))
    kinds = F.filter(counts, lambda c: c["amount"] > 0)
    warn = lambda when, level, *parts: F.when(when, F.struct(F.lit(level).alias("level"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("warning")))
    no = F.lit(False)
    return F.array_compact(
        F.array(
            warn(_any(targets) & (given != stock), "weak", "발행대상자: 배정주식수 합계(", _grouped(given), ")가 신주의 종류와 수 합계(", _grouped(stock), ")와 일치하지 않습니다."),
            warn(_any(purposes) & value.isNotNull() & (value != total(purposes)), "weak", "발행목적: 신주의 종류와 수와 발행가액의 곱(", _grouped(value), ")이 자금조달 목적 합계(", _grouped(total(purposes)), ")와 일치하지 않습니다."),
            warn(F.size(kinds) > 1, "medium", "신주의 종류와 수: 0이 아닌 주식 종류가 둘 이상입니다. 종류: ", F.array_join(F.transform(kinds, lambda c: c["label"]), ", ")),
            warn(_any(counts) & (stock == 0) & (no if zero_counts is None else zero_counts), "weak", "신주의 종류와 수: 모든 주식 종류의 수량이 0입니다."),
            warn(_any(before) & (total(before) == 0) & (no if zero_before is None else zero_before), "weak", "증자 전 발행주식총수: 모든 주식 종류의 수량이 0입니다."),
            warn(no if zero_common is None else zero_common, "strong", "증자 전 발행주식총수: 보통주식 수량이 원문에서 0 또는 대시로 명시되었습니다."),
        )
    )


def export_rows(frames: list[DataFrame], latest: tuple[str, list[str]] | None = None) -> DataFrame:
    """Records of any fields in one table: title and acpt_no first, then all other fields by name.

    latest: (family, order) keeps the last record of each family; records without a family all stay.
    """
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if latest:
        family, order = latest
        own = all_rows.filter(F.col(family).isNull())
        all_rows = merge.last_row(all_rows.filter(F.col(family).isNotNull()), family, order).unionByName(own)
    lead = [c for c in ("title", "acpt_no") if c in all_rows.columns]
    return all_rows.select(*lead, *sorted(set(all_rows.columns) - set(lead)))


def label_row(rows: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, line, value): the first row of each document with a cell of that label, and the cell behind it."""
    want = label.replace(" ", "")
    hit = rows.filter(F.exists("line", lambda c: T.normalize_label(c) == want))
    first = hit.groupBy(id_col).agg(F.min_by("line", F.struct("table", "row")).alias("line"))
    place = F.array_position(F.transform("line", lambda c: T.normalize_label(c)), want)
    return first.select(id_col, "line", F.get("line", place.cast("int")).alias("value"))


def recent(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """rows in order of download: keys descending and, among equals, the last read first."""
    return rows.orderBy(*[F.desc(k) for k in keys], F.desc(position))


def correction_counts(rows: DataFrame, by: str) -> DataFrame:
    """(by, records, corrections, latest): how many records are corrections, and how many no later one corrects."""
    return rows.groupBy(by).agg(F.count("*").alias("records"), F.count_if("is_correction_report").alias("corrections"), F.count_if(~F.col("has_later_correction")).alias("latest"))
