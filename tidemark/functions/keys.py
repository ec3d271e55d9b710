"""Normalised keys of companies, stocks and entities, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of legal form that are no part of a name.
LEGAL_FORMS = ("(주)", "㈜", "주식회사", "(유)", "유한회사")


def zfill(c: Column, width: int) -> Column:
    """Left-pads with zeros and, unlike lpad, never cuts."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def _digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def stock_column(c: Column) -> Column:
    """Column name of a stock: A-codes stay, digits become A and six digits, anything else stays."""
    t = F.upper(F.trim(c))
    return F.when(t.startswith("A"), t).when(_digits(t), F.concat(F.lit("A"), zfill(t, 6))).otherwise(t)


def company_code(c: Column) -> Column:
    t = F.trim(c)
    return F.when(_digits(t), zfill(t, 6)).otherwise(t)


def code_candidates(c: Column) -> Column:
    """Codes to try in order: the padded one, the one without a leading A, digits without trailing zeros (5 or more long)."""
    code = company_code(c)
    bare = F.when((F.length(code) == 7) & code.startswith("A"), F.substring(code, 2, 6))
    short = F.regexp_replace(code, "0+$", "")
    return F.array_distinct(F.filter(F.array(code, bare, F.when(_digits(code) & (F.length(short) >= 5), short)), lambda x: x.isNotNull() & (x != "")))


def infer_stock_code(c: Column) -> Column:
    t = F.trim(c)
    return F.when(_digits(t), F.when(F.length(t) == 6, t).when(F.length(t) == 5, F.concat(t, F.lit("0"))).when(F.length(t) < 5, F.lpad(t, 6, "0")))


def export_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    inferred = infer_stock_code(t)
    return (
        F.when(t.rlike("^A[A-Z0-9]{6}$"), t)
        .when(inferred.isNotNull(), F.concat(F.lit("A"), inferred))
        .when(t.rlike("^[A-Z0-9]{5,6}$"), F.concat(F.lit("A"), t))
        .otherwise(F.lit(""))
    )


def code_from_column(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return (
        F.when(t.rlike("^A[A-Z0-9]{6}$"), F.substring(t, 2, 6))
        .when(t.rlike("^[A-Z0-9]{6}$"), t)
        .otherwise(F.nullif(F.regexp_extract(t, "(?:^|_)([A-Z0-9]{6})$", 1), F.lit("")))
    )


def entity_name(c: Column) -> Column:
    """Upper-case, without legal forms and white space."""
    out = F.upper(c)
    for form in LEGAL_FORMS:
        out = F.replace(out, F.lit(form), F.lit(""))
    return F.regexp_replace(out, r"\s+", "")


def investor_kind(c: Column) -> Column:
    """Company, Organization or Person from a name."""
    t = F.trim(F.coalesce(c, F.lit("")))
    company = t.rlike(r"주식회사|\(주\)|㈜|회사")
    organization = company | t.rlike(r"조합|펀드|투자|은행|증권|보험|신탁|재단|기금|캐피탈|파트너스|홀딩스|(?i)\b(fund|inc|ltd|llc|corp|bank|capital)\b")
    return F.when(t == "", F.lit("Organization")).when(organization, F.when(company, F.lit("Company")).otherwise(F.lit("Organization"))).when(F.length(t).between(2, 4), F.lit("Person")).otherwise(F.lit("Organization"))
