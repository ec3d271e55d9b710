"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, scheme separators, identifier
cues) in one pass; a deterministic parser at each anchor expands to both sides and validates. Base kinds
are email, ip, card and phone, each the leftmost non-overlapping matches of its grammar. Added kinds:
url (only those that carry user information), iban, ssn and account (each within REACH of a cue of any case,
or of the one before; ibans and ssns validated).
Defined cases: null or empty text has no spans; positions are code points, end exclusive; repeated rows
are judged alike; other columns pass through, but for __spans, which is replaced. Every parser is linear in the text.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._bytes import append_columns
from ._spark import LOWER, UPPER, read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account"}
REACH = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"://[^\s/?#@]+@[^\s/?#@]+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Each at most REACH characters on, the match itself of any length.
_NEAR = {
    kind: re.compile(rf"(?s:.{{0,{REACH}}}?)({body})")
    for kind, body in {
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "account": r"(?<![A-Za-z0-9])[0-9]{6,17}(?![A-Za-z0-9])",
    }.items()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _valid_end(m: re.Match) -> int:
    """Where the longest valid IBAN at the start of a match ends, which may have run on into the next words; 0 if there is none."""
    found, end = m[1], m.end()
    while found and not _mod97(found):
        found = found.rpartition(" ")[0]
        end = m.start(1) + len(found)
    return end if found else 0


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 0))
    found.add_word("@", ("at", 0))
    found.add_word("+", ("plus", 0))
    found.add_word("://", ("scheme", 2))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue) - 1))
    found.make_automaton()
    return found


#: A-Z to a-z one for one, so that positions hold; no other anchor has letters.
_FOLD = str.maketrans(UPPER, LOWER)
_anchors: ahocorasick.Automaton | None = None


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind in the order of KINDS."""
    global _anchors
    if _anchors is None:
        _anchors = _automaton()
    spans: list[tuple[int, int, int]] = []
    email = ip = card = phone = 0
    ends = dict.fromkeys(_NEAR, 0)
    for at, (kind, back) in _anchors.iter(text.translate(_FOLD)):
        at -= back
        if kind == "digit":
            if at >= card:
                if m := _CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, 2, card))
                else:
                    card = at + 1
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(_octet(x) for x in m.groups()):
                        spans.append((at, 1, ip))
                else:
                    ip = _RUN.match(text, at).end()
        elif kind == "at":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                email = m.end()
                spans.append((start, 0, email))
        elif kind == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((at, 3, phone))
        elif kind == "scheme":
            if m := _AUTHORITY.match(text, at):
                start = at
                while start > max(0, at - 20) and text[start - 1] in _SCHEME:
                    start -= 1
                if start < at:
                    spans.append((start, 4, m.end()))
        else:
            begin = at + back + 1
            pos, limit = max(begin, ends[kind]), begin + REACH
            while pos <= limit and (m := _NEAR[kind].match(text, pos)) and m.start(1) <= limit:
                if end := _valid_end(m) if kind == "iban" else m.end():
                    spans.append((m.start(1), KINDS.index(kind), end))
                    pos, limit = end, end + REACH
                    ends[kind] = end
                else:
                    pos = m.start(1) + 1
    return [(s, e, KINDS[k]) for s, k, e in sorted(spans)]


def pii(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns with __spans, an array of (start, end, kind) by start, then kind as in KINDS."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col))
        rows = [[{"start": s, "end": e, "kind": k} for s, e, k in find(t)] if t else [] for t in (x.as_py() for x in texts)]
        return [pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))]

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    return append_columns(docs, make, [T.StructField("__spans", T.ArrayType(span))], keep)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(__spans, x -> x.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [f"CAST(size(filter(__spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE]
    return out.selectExpr("doc_id", *counts, f"sha2(CAST({joined.format(base)} AS BINARY), 256) AS base_sha256", f"{joined.format('__spans')} AS spans")
