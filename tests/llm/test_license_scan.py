"""Licence scans against regular expressions and planted templates."""

import random
import re

import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from tidemark import llm
from tidemark.llm import license_scan
from tidemark.llm._bytes import MARKS, Chunk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels) by the contract."""
    words = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for p, label in license_scan.BASE for q in [p.split()] for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def even_index():
    return license_scan.build_index(np.ones(len(license_scan.vocabulary())))


def found(texts, index):
    raw = [t.encode() for t in texts]
    c = Chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), MARKS)
    out = [set() for _ in texts]
    for who, t, *_ in license_scan.find(c, index)[0]:
        out[who].add(license_scan.TEMPLATES[t][0])
    return out


def noise(rnd, n):
    return " ".join("".join(rnd.choice("etaoinsr") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_every_template_is_found_in_noise():
    rnd, index = random.Random(1), even_index()
    texts = [f"{noise(rnd, 300)}. {t.upper()}; {noise(rnd, 50)}" for _, t, _ in license_scan.TEMPLATES]
    for (label, *_), got in zip(license_scan.TEMPLATES, found(texts, index), strict=True):
        assert got == {label}


def test_phrases_are_mandatory_and_drift_is_borne():
    index = even_index()
    label, text, must = license_scan.TEMPLATES[0]
    words = text.split()
    some = " ".join(words[:20] + "by John Smith of Acme and others".split() + words[20:])
    broken = text.replace("free of charge", "for a fee").replace(must[1], "to deal")
    both = f"{text} \n {license_scan.TEMPLATES[3][1]}"
    spread = " filler words that go on and on ".join(words)
    gpl = "This work is licensed under the GNU General Public License, version 3."
    cases = [some, broken, both, spread, gpl, "general public version of the license", "the licence of the mit"]
    assert found(cases, index) == [{"mit"}, set(), {"mit", "apache-2"}, set(), {"gpl-3"}, set(), set()]
    # nothing reaches over two texts
    assert found([" ".join(words[:30]), " ".join(words[30:])], index) == [set(), set()]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "Under the MIT License"), (4, "Under the MIT License"), (None, "CC-BY-NC-SA 4.0"), (5, "É" * 10 + " under the mit license" * 20_000), (6, "under the\x00MIT\nlicense apache license version 2")]
    df = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, __base string, __N_WORDS int")
    out = license_scan.licenses(df, license_scan.idf(df), df.columns).collect()
    got = sorted(((r.doc_id, r["__n_words"], len(r["__base"])) for r in out), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 4, 1), (4, 4, 1), (None, 6, 1), (5, 80_001, 20_000), (6, 8, 2)], key=str)
    assert {x.label for r in out if r.doc_id is None for x in r["__licenses"]} == {"cc-by-nc-sa"}
    assert license_scan.licenses(df.limit(0), license_scan.idf(df.limit(0)), ["doc_id"]).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_on_whole_documents(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in llm.QUERIES["op12_license_scan"](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        labels = set(filter(None, r.labels.split(",")))
        assert labels >= set(filter(None, r.base_labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
        gpl = "gnu general public license version 3" in " ".join(WORD.findall((text or "").translate(LOWER)))
        assert labels - set(r.base_labels.split(",")) == ({"gpl-3"} if gpl else set())
