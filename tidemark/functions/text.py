"""Text, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes for white space, as a regex class.
WHITE = r"\s\x0B\x1C-\x1F\x85   -     　"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE}]+", "")


def collapse_spaces(c: Column) -> Column:
    """White space of any kind as one space, none at the ends. Texts that are so already, as most cells are, cost one look."""
    return F.when(c.rlike(rf"[{WHITE}&&[^ ]]|  |\A | \z"), strip(F.regexp_replace(c, f"[{WHITE}]+", " "))).otherwise(c)


def fold(c: Column) -> Column:
    """Case folding: lower(), plus the sharp s, the one common letter on which they differ."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def clean_search(c: Column) -> Column:
    """Drops parenthesised text, nested levels included.

    A stray ) goes alone, ) right behind a closed group go with it. A ( that is never closed drops all up
    to the last ) behind it, or to the end if there is none. One fold over the pieces between parentheses keeps the depth,
    what is outside, and what stood behind the last ) of a group still open; its steps are as many as the parentheses.
    """
    pieces = F.split(c, "[()]", -1)
    steps = F.arrays_zip(F.regexp_extract_all(c, F.lit("([()])"), F.lit(1)).alias("mark"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("piece"))
    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.get(pieces, 0).alias("out"), F.lit("").alias("after"))

    def step(s: Column, x: Column) -> Column:
        d, piece = s["depth"], x["piece"]
        opened = x["mark"] == "("
        depth = F.when(opened, d + 1).otherwise(F.greatest(d - 1, F.lit(0)))
        closed = F.when(opened & (d == 0), F.lit(False)).when(~opened & (d > 0), F.lit(True)).otherwise(s["closed"])
        out = F.when(depth == 0, F.concat(s["out"], piece)).otherwise(s["out"])
        after = F.when(depth == 0, F.lit("")).when(~opened | (d == 0), piece).otherwise(F.concat(s["after"], F.lit("("), piece))
        return F.struct(depth.alias("depth"), closed.alias("closed"), out.alias("out"), after.alias("after"))

    def rest(s: Column) -> Column:
        # what followed the last ) of an open group is read again as plain text; a ( in it opens without end
        return F.when((s["depth"] > 0) & s["closed"], F.concat(s["out"], F.substring_index(s["after"], "(", 1))).otherwise(s["out"])

    folded = F.aggregate(steps, first, step, rest)
    return F.when(c.contains("(") | c.contains(")"), folded).otherwise(c)


def date_part(c: Column) -> Column:
    return F.split_part(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(1))


def parse_date(c: Column) -> Column:
    """ISO dates, or year, month and day before 년, 월 and 일; null otherwise."""
    pattern = r"([0-9]{4})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"
    part = lambda i: F.lpad(F.regexp_extract(c, pattern, i), 4 if i == 1 else 2, "0")
    return F.coalesce(F.try_to_date(F.substring(strip(c), 1, 10), "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"))


def find_date(c: Column) -> Column:
    """The first date anywhere in a text (year, month, day with 년월, dots or dashes), else eight digits in all."""
    pattern = r"([0-9]{4})\s*[년.\-]\s*([0-9]{1,2})\s*[월.\-]\s*([0-9]{1,2})"
    part = lambda i: F.lpad(F.regexp_extract(c, pattern, i), 4 if i == 1 else 2, "0")
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(c.rlike(pattern), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")).when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def find_number(c: Column) -> Column:
    """The first number in a text, commas dropped."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?[0-9]+\.?[0-9]*", 0).try_cast("double")


def parse_int(c: Column, dash_as_zero: bool = False) -> Column:
    found = F.replace(F.regexp_extract(c, r"-?[0-9][0-9,]*", 0), F.lit(","), F.lit("")).try_cast("long")
    return F.when(strip(c) == "-", F.lit(0).cast("long")).otherwise(found) if dash_as_zero else found


def parse_ints(c: Column) -> Column:
    """All integers of a text. A run of digits, commas and spaces that is one grouped number without its spaces is mended first."""
    runs = F.regexp_extract_all(c, F.lit(rf"(-?[0-9][0-9,{WHITE}]*[0-9]|-?[0-9])"), F.lit(1))
    found = F.transform(runs, lambda r: F.when(remove_spaces(r).rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+$"), F.array(remove_spaces(r))).otherwise(F.regexp_extract_all(r, F.lit(r"(-?[0-9][0-9,]*)"), F.lit(1))))
    return F.transform(F.flatten(found), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))


def without_number(c: Column) -> Column:
    """Without a leading number (digits or Roman, of one or two levels as in 2-1) with its dot."""
    number = r"(?:[0-9]+|[ivxlcdm]+|[\x{2160}-\x{217f}]+)"
    return F.regexp_replace(c, rf"(?i)^{number}(?:-{number})?\.", "")


def normalize_label(c: Column) -> Column:
    """Without white space and a leading number with its dot."""
    return without_number(remove_spaces(c))


def drop_repeats(a: Column) -> Column:
    """An array of texts without blanks and without repeats of the one before. The texts are worked out once, not once an element."""
    full = F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.get(F.transform(F.array(full), lambda f: F.filter(f, lambda x, i: (i == 0) | (x != F.get(f, i - 1)))), 0)


def title_flags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1)))


def expected_rows(total: Column, page: Column, pages: Column, size: Column | int) -> Column:
    """Rows that page `page` of `pages` should list."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when((page < 1) | (page > pages), F.lit(0)).when(page < pages, size).otherwise(total - size * (pages - 1))


def issuance_type(c: Column) -> Column:
    """From a title without spaces: mixed issues are named as such, and bonus comes before paid."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    kinds = {"유무상증자": "mixed", "무상증자": "bonus", "유상증자": "paid"}
    return F.coalesce(*[F.when(t.contains(word), F.lit(kind)) for word, kind in kinds.items()], F.lit("unknown"))


def bond_type(c: Column) -> Column:
    """CB, EB or BW, only when exactly one of them is named."""
    names = F.array(*[F.when(c.contains(word), F.lit(kind)) for word, kind in (("전환사채", "CB"), ("교환사채", "EB"), ("신주인수권부사채", "BW"))])
    found = F.filter(names, lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, found[0])


def meeting_phase(c: Column) -> Column:
    return F.when(c.contains("주주총회결과"), F.lit("RESULT")).when(c.contains("소집결의") | c.contains("소집공고"), F.lit("NOTICE"))


#: What a meeting's result (and, for the first two, its remarks) says of an agenda, in the order of their weight.
AGENDA_STATUS = (
    ("withdrawn", True, r"(?:안건|의안)(?:을|를)?철회"),
    ("not_tabled", True, r"불상정|미상정|자동폐기|(?:안건|의안)(?:을|를)?폐기"),
    ("rejected", False, r"부결|미가결|가결(?:되지|되지않|안됨|아니)"),
    ("passed", False, r"가결(?:됨)?$|원안(?:대로)?승인(?:됨)?$|승인(?:됨|되었음)$"),
    ("unresolved", False, r"미결"),
)


def agenda_status(result: Column, remarks: Column) -> Column:
    alone, both = remove_spaces(F.coalesce(result, F.lit(""))), remove_spaces(F.concat_ws("", result, remarks))
    return F.coalesce(*[F.when((both if with_remarks else alone).rlike(pattern), F.lit(status)) for status, with_remarks, pattern in AGENDA_STATUS])


#: Fixed values.
NO_LETTER = " -_/·,"


def purpose_label(c: Column) -> Column:
    """A funding purpose without its unit of money; null when nothing is left."""
    t = F.regexp_replace(collapse_spaces(c), r"\(\s*원\s*\)", "")
    t = collapse_spaces(F.btrim(F.regexp_replace(t, r"\s*원$", ""), F.lit(NO_LETTER)))
    return F.when(t != "", t)


def year_of(c: Column) -> Column:
    """The year a date text starts with; an error unless these are four digits."""
    head = F.substring(strip(F.coalesce(c, F.lit(""))), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no year in "), F.coalesce(c, F.lit("null")))).cast("int"))


def parse_price(c: Column) -> Column:
    """A number in a text, commas dropped, as double; null without one."""
    return F.replace(F.regexp_extract(c, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def json_number(c: Column) -> Column:
    """The number itself, null as null; NaN and infinities are errors."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("double")).otherwise(c)


def codes_hash(codes: Column) -> Column:
    """sha256 of an array of codes, one after the other."""
    return F.sha2(F.concat_ws("", codes).cast("binary"), 256)


def viewer_call(c: Column) -> Column:
    """(acpt_no, doc_no) out of a call of openDisclsViewer."""
    pattern = r"""openDisclsViewer\(\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]*)['"]\s*\)"""
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("acpt_no"), F.regexp_extract(c, pattern, 2).alias("doc_no")))


def vwap(amount: Column, volume: Column) -> Column:
    """Rounded half to even; null where volume is 0."""
    return F.bround(F.try_divide(amount, volume), 0)


def canonical_hash(**fields: Column) -> Column:
    """sha256 of JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])), 256)
