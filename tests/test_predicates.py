import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import keys as K
from tidemark.functions import text as T
from tidemark.plans import predicates as P


def strip_parens(text):
    """Brute force: groups in parentheses go; an unclosed one goes up to the last ) behind it, or to the end."""
    out, i = [], 0
    while i < len(text):
        if text[i] == ")":
            i += 1
        elif text[i] != "(":
            out.append(text[i])
            i += 1
        else:
            depth, j = 0, i
            while j < len(text):
                depth += (text[j] == "(") - (text[j] == ")")
                j += 1
                if not depth:
                    break
            if depth:
                last = text.rfind(")", i)
                i = last + 1 if last >= 0 else len(text)
            else:
                while j < len(text) and text[j] == ")":
                    j += 1
                i = j
    return "".join(out)


def test_clean_search_matches_brute_force(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab()( )") for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["a(b(c)d", "a(b))c", "x)y(z", "(", ")"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_search(F.col("t")).alias("c")).collect()
    wrong = [(r.t, r.c, strip_parens(r.t)) for r in rows if r.c != strip_parens(r.t)]
    assert not wrong, wrong[:5]
    assert all(P.clean_literal(t) == strip_parens(t) for t in texts)


@pytest.mark.parametrize(
    "blocks",
    [
        [P.block("title", "contains", "a", connector="AND")],
        [P.block("title", "contains", "a"), P.block("title", "contains", "b", "AND"), P.block("title", "contains", "c", "OR")],
        [P.block("title", "contains", "a", opens=1)],
        [P.block("title", "contains", "a", closes=1)],
        [P.block("title", "contains", " ")],
        [P.block("nothing", "contains", "a")],
        [P.block("title", "between", "1")],
        [P.block("title", "contains", "a", opens=True)],
    ],
)
def test_bad_blocks(blocks):
    with pytest.raises(ValueError):
        P.validate_blocks(blocks)


def test_precedence_and_operators(spark):
    rows = spark.createDataFrame([("Alpha (x) Beta", "KOSPI"), ("alphabeta", "KOSDAQ"), ("", "KOSPI"), (None, None)], "title string, market string")
    columns = {"title": F.col("title"), "market": F.col("market")}

    def hits(*blocks):
        return [bool(r[0]) for r in rows.select(P.compile_blocks(list(blocks), columns)).collect()]

    assert hits(P.block("title", "equals", "alphabeta", ignore_spaces=True, clean_search=True)) == [True, True, False, False]
    assert hits(P.block("title", "exact_match", "alphabeta")) == [False, True, False, False]
    assert hits(P.block("title", "empty")) == [False, False, True, True]
    assert hits(P.block("title", "contains", "alpha"), P.block("market", "equals", "kospi", "XOR")) == [False, True, True, False]
    assert hits(P.block("title", "exists", negate=True), P.block("market", "in", "kospi, x", "AND")) == [False, False, True, False]


def test_expressions(spark):
    rows = spark.createDataFrame([("red bolt",), ("Blue gear and ring",), ("plain",)], "t string")
    get = lambda c: [bool(r[0]) for r in rows.select(c).collect()]
    assert get(P.compile_title("red or (blue and not bolt)", F.col("t"))) == [True, True, False]
    assert get(P.compile_title("'gear and'", F.col("t"))) == [False, True, False]
    assert get(P.compile_title("", F.col("t"))) == [True, True, True]
    for bad in ("a b", "a and", "(a", "'a", "and a"):
        with pytest.raises(ValueError):
            P.compile_title(bad, F.col("t"))
    assert get(P.compile_keyword("red bolt || Blue", F.col("t"))) == [True, True, False]
    assert get(P.compile_keyword("(red", F.col("t"))) == [False, False, False]
    assert [r[0] for r in rows.select(P.classify(F.col("t"), [("g", ["gear && ring"])])).collect()] == [P.OTHER, "g", P.OTHER]
    assert P.split_keywords("a, b(c, d), a") == ["a", "b(c, d)"]


def test_keys_and_text(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    assert value(K.stock_column(F.lit("1234567"))) == "A1234567"
    assert value(K.stock_column(F.lit(" 660 "))) == "A000660"
    assert value(K.code_candidates(F.lit("A064090"))) == ["A064090", "064090"]
    assert value(K.infer_stock_code(F.lit("06409"))) == "064090"
    assert value(K.export_code(F.lit("0066A"))) == "A0066A"
    assert value(K.code_from_column(F.lit("이름_00A660"))) == "00A660"
    assert value(K.entity_name(F.lit("(주) 가 나"))) == "가나"
    assert value(K.investor_kind(F.lit("더블엠인베스트먼트(주)"))) == "Company"
    assert value(K.investor_kind(F.lit("홍길동"))) == "Person"
    assert str(value(T.parse_date(F.lit("2024년 3월 5일")))) == "2024-03-05"
    assert value(T.parse_date(F.lit("2024년 13월 5일"))) is None
    assert str(value(T.find_date(F.lit("납입일: 2024. 3. 5")))) == "2024-03-05"
    assert value(T.parse_ints(F.lit("1,000, 2 3, 456,789")))[:1] == [1000]
    assert value(T.find_number(F.lit("약 1,234.5원"))) == 1234.5
    assert value(T.bond_type(F.lit("전환사채권발행결정"))) == "CB"
    assert value(T.bond_type(F.lit("전환사채 및 교환사채"))) is None
    assert value(T.vwap(F.lit(5.0), F.lit(2.0))) == 2.0
    assert value(T.vwap(F.lit(5.0), F.lit(0.0))) is None
    assert value(T.drop_repeats(F.array(*map(F.lit, ["a", "", "a", "b", "a"])))) == ["a", "b", "a"]


def grouped_ints(text):
    """Brute force: a run of digits, commas and spaces that is one grouped number without its spaces is one number."""
    def mend(m):
        merged = m[0].replace(" ", "")
        return merged if re.fullmatch(r"-?[0-9]{1,3}(,[0-9]{3})+", merged) else m[0]

    mended = re.sub(r"-?[0-9][0-9,\s]*[0-9]|-?[0-9]", mend, " ".join(text.split()))
    return [int(x.replace(",", "")) for x in re.findall(r"-?[0-9][0-9,]*", mended)]


def test_text_queries_keep_every_document(spark, tmp_path):
    rnd = random.Random(5)
    texts = ["a (b (c) d) e", "open (x", "stray ) y", "sum 1, 234 won", "in 2024, 100 5", "-1, 234, 567", "1,23 4", "12, 5"]
    texts += ["".join(rnd.choice(["(", ")", "a", " b"]) for _ in range(12)) for _ in range(150)]
    texts += ["".join(rnd.choice(["1", "234", ",", ", ", " ", "-", "x", "56"]) for _ in range(9)) for _ in range(300)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cleaned = {r.doc_id: r.cleaned for r in queries.QUERIES["clean_search_titles"](spark, str(tmp_path)).collect()}
    assert cleaned == {i: " ".join(strip_parens(t).split()) for i, t in rows}
    assert {r.doc_id: r.n_ints for r in queries.QUERIES["parse_ints_dates"](spark, str(tmp_path)).collect()} == {i: len(grouped_ints(t)) for i, t in rows}
    ints = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", T.parse_ints(F.col("text")).alias("x")).collect()
    assert {r.doc_id: r.x for r in ints} == {i: [v if v < 2**63 else None for v in grouped_ints(t)] for i, t in rows}


def test_sql_of_hard_texts(spark, tmp_path):
    """The SQL of both queries over whole texts agrees on nested, stray and unclosed parentheses and on broken numbers too."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("()ab ") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    texts += ["".join(rnd.choice(["1", "23", ",", ", ", " ", "-", "456", "x", ".", "789"]) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("clean_search_titles", "parse_ints_dates"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        rel = con.sql(queries.ORACLES[name]).select(", ".join(df.columns))
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rel.fetchall()))
