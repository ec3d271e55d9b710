"""URL filter, mixing, chat, decontamination, line dedup against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import llm
from tidemark.llm import chat, decontam, line_dedup, mixing, url_filter
from tidemark.llm._spark import LOWER, UPPER, durable


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(llm.ORACLES[name])
    order = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x", "http://example.org/en/1?q", "https://x.org/", "https://x.org", "http://b.com/fr/a", "http://com/de/", "http://notexample.org/es/", None, "no scheme", "", "ftp://h?x#y", "http://pokervip.top/promo/bonus"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, extra int")
    rows = url_filter.url_filter(stored(df), url_filter.train(url_filter.labelled_urls(spark))).orderBy("page_id").collect()
    assert [r.host for r in rows[:2]] == ["a.example.org", "example.org"]
    assert [(r.rule, r.verdict) for r in rows[:6]] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, rows[3].verdict), ("com/fr/", "allow"), ("com/de/", "block")]
    assert rows[6].rule == "org/" and [(r.host, r.path) for r in rows[7:11]] == [("", ""), ("", ""), ("", ""), ("h", "")]
    assert rows[11].verdict == "block" and rows[0].extra == 1
    assert url_filter.url_filter(df.limit(0), ([0.0] * url_filter.DIM, 0.0)).count() == 0


def stored(df):
    """As a table on disk: expressions over rows given in the plan are worked out by the planner, unfolded and slowly."""
    return durable(df, "given")


def plain_verdict(url, rules):
    """(host, path, rule, action) by the contract, in plain Python."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(UPPER, LOWER)), m[2]) if m else ("", "")
    fits = [(a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[1]), default=(None, None))  # the first of the longest
    return host, path, best[1], best[0]


def test_url_filter_on_whole_pages(spark):
    """Every column of the contract for every page, by the contract's rules in plain Python; hosts and words of the pages are in no label."""
    pages = duckdb.sql("SELECT page_id, url FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    words = {w for ws, _, _ in url_filter.labelled_hosts() for w in ws} | set(url_filter.TAILS)
    planted = {w for bad in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for w in bad.split("-")}
    assert not words & planted and not any("example." in h for _, h, _ in url_filter.labelled_hosts())
    got = {r.page_id: r for r in llm.QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == len(pages)
    for i, u in pages:
        host, path, rule, action = plain_verdict(u, url_filter.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (action or ("block" if got[i].score >= 0.5 else "allow"))


ORDINARY = """https://github.com/apache/spark https://www.bbc.co.uk/news https://en.wikipedia.org/wiki/Tree https://www.harvard.edu/ https://arxiv.org/abs/1706.03762
https://stackoverflow.com/questions/1 https://www.nytimes.com/2020/01/01/us/a.html https://docs.python.org/3/ https://www.lemonde.fr/ https://www.spiegel.de/politik/
https://www.nasa.gov/missions https://www.who.int/ https://medium.com/@a/b https://www.amazon.com/dp/B000 https://news.ycombinator.com/item?id=1 https://www.ikea.com/se/
https://elpais.com/ https://www.reuters.com/world/ https://kernel.org/ https://www.mozilla.org/en-US/ http://A.COM?x http://essex.ac.uk/""".split()


def scores(spark, urls, model):
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string").transform(stored)
    return [r.score for r in url_filter.url_filter(df, model, rules=[]).orderBy("i").collect()]


def test_ordinary_and_unknown_urls_are_allowed(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    assert sum(s >= 0.5 for s in scores(spark, ORDINARY, model)) <= 1
    assert all(s < 0.5 for s in scores(spark, [None, "", "no scheme", "http://", "http://q.zz/"], model))


def test_url_words_left_out_of_training(spark):
    """A split by word: every host with a held-out word is out of training. The n-grams of other words find a third of them."""
    unwanted = [w for words in url_filter.UNWANTED.values() for w in words.split()]
    held = {*unwanted[2::5], *url_filter.WANTED[2::5]}
    model = url_filter.train(url_filter.labelled_urls(spark, tuple(held)))
    rows = [(h, y) for ws, h, y in url_filter.labelled_hosts() if held & set(ws)]
    found = np.array(scores(spark, [f"http://{h}.com/" for h, _ in rows], model)) >= 0.5
    y = np.array([y for _, y in rows])
    assert found[y > 0].mean() >= 0.3 and found[y == 0].mean() <= 0.05


def test_url_filter_edges(spark):
    rules = [("allow", "a.org", "/x/"), ("block", "a.org", "/x/"), ("block", "org", "/")]
    rows = [(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (2, "http://b.a.org/x/" + "y" * 200_000), (None, None), (3, "http://org/")]
    df = spark.createDataFrame([(*r, "own", 1.5) for r in rows], "page_id long, url string, host string, score double").withColumn("rule", F.lit(7))
    out = url_filter.url_filter(stored(df), ([0.0] * url_filter.DIM, -1.0), rules).collect()
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in out) == [("1", "a.org/x/", "allow")] * 2 + [("2", "a.org/x/", "allow"), ("3", "org/", "block"), ("None", None, "allow")]
    assert {r.host for r in out} == {"a.org", "b.a.org", "", "org"} and len(set(out[0].asDict())) == len(out[0])


def expected_turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort(key=lambda x: x[0])
        under = "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    bits = ["<|end|>", "<|turn|>", "</s>[INST] ok [/INST]", "\\", "<\\", "[\\<", "word ", "é\n", "", "<|text|>"]
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for c in range(40) for t in range(rnd.randint(1, 30))]
    rows += [(99, 0, "system", "only"), (98, 0, "assistant", "x " * 5000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, window int")
    for budget, history in ((60, 20), (1024, 192), (10, 0)):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.chat_windows(df, budget, history)).collect()}
        assert got == expected_turns(rows)
    windows = chat.chat_windows(df, 60, 20)
    assert windows.filter("n_repeated > 0").count() > 0
    assert windows.filter("conv_id % 3 = 0 AND conv_id < 40 AND NOT startswith(formatted, '<|turn|>system')").count() == 0
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def test_chat_windows_hold_the_budget(spark):
    rnd = random.Random(4)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "w " * (rnd.randint(1, 60) if t == 0 else rnd.choice([5, 300, 500, 700, 900]))) for c in range(20) for t in range(40)]
    rows += [(50, 0, "system", "w " * 10), (50, 1, "user", "w " * 3000), (50, 2, "assistant", "w " * 30), (51, 0, "system", "w"), (52, 0, "system", "w " * 2000), (52, 1, "user", "w")]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert windows.filter("conv_id < 50").agg(F.max("n_tokens")).first()[0] <= 1024
    assert {r.n_turns for r in windows.filter("conv_id = 50 AND n_tokens > 1024").collect()} == {2}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == expected_turns(rows)


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None, "t", i) for i in range(6000)], "doc_id long, source string, text string, copyx int")
    out = mixing.mix(docs, {"a": 0.25})
    n = Counter(r.source for r in out.select("source").collect())
    assert abs(n["a"] - 1500) < 200 and abs(n[None] - 2000) < 200
    draws = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert draws(out) == draws(mixing.mix(docs.repartition(7), {"a": 0.25}))
    one = spark.createDataFrame([(1, "rare"), (2, "b"), (3, "b")], "doc_id long, source string")
    big = mixing.mix(one, {"rare": 100.0}).filter("source = 'rare'").count()
    assert 220 < big < 380  # a Poisson draw of mean 300, past where exp(-mean) is exact
    assert mixing.mix(docs.limit(0)).count() == 0


def test_line_dedup_edges(spark):
    long = "x" * 40
    rows = [(i, f"  {long.upper()}\t\nkeep {i}\n{long}") for i in range(1, 6)] + [(7, None), (8, ""), (9, long[:-1] + "\n" + long[:-1]), (10, "é" * 50), (None, long)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, key string")).collect()}
    assert out[5].text == rows[4][1] and out[5]["__n_dropped"] == 0
    assert all(out[i].text == f"keep {i}" and out[i]["__n_dropped"] == 2 and out[i]["__n_lines"] == 3 for i in range(1, 5))
    assert (out[7].text, out[7]["__n_lines"], out[8].text, out[9]["__n_dropped"], out[None].text, out[1].key) == ("", 1, "", 0, long, "n")
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


QUESTION = "The Story of Peter and his 12 apples: he sold 5 of them for 30 dollars in Berlin."


def test_decontamination(spark):
    texts = {
        1: f"Something before. {QUESTION} And after.",
        2: "Intro. The Story of Maria and his 77 apples: he sold 8 of them for 41 dollars in Paris.",
        3: "The Story of Maria and his 77 apples: he sold 77 of them for 41 dollars in Maria.",
        4: "Nothing of that kind here, only plain words that run on for a while.",
        5: None,
        6: "",
        7: "short one here",
        8: "the story of apples " * 2000,
    }
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, QUESTION), (10, "short one here"), (11, None)], "item_id long, text string")
    found = {(r[0], r[1]): r.exact for r in decontam.find_leaks(docs.select("doc_id", "text"), bench).collect()}
    assert found == {(1, 9): True, (2, 9): False, (7, 10): True}
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {3, 4, 5, 6, 8}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_slots_that_break_the_map_cost_their_own_windows_only(spark):
    plain = "river stone garden window yellow mountain paper candle bridge silver forest winter".split()
    words = [w for i in range(6) for w in (*plain[i:], *plain[:i], "near", "5", "ships")]
    copied = list(words)
    copied[[i for i, w in enumerate(words) if w == "5"][3]] = "8"
    short = "he sold 5 of the apples for 30 dollars"
    asked = [(1, " ".join(words)), (2, QUESTION), (3, short), (4, "lost " + " and ".join(f"ship {n} was seen near rock {n + 1}" for n in (12, 44, 71)))]
    docs = [
        (1, " ".join(copied)),
        (2, "The Story of Maria and his 77 apples: he sold 4 of them for 4 dollars in Paris."),
        (3, "he sold 4 of the apples for 4 dollars"),
        (4, "The Story of Maria and his 77 apples: he sold 77 of them for 77 dollars in Maria."),
    ]
    found = {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert found[1, 1] == (len(words) - 7 - 8, False) and found[2, 2] == (11, False)


def test_texts_of_one_id_are_compared_apart(spark):
    docs = spark.createDataFrame([(1, QUESTION), (1, "The Story of Maria and his 77 apples: he sold 77 of them for 41 dollars in Maria."), (2, "x"), (2, "Word. " + QUESTION)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, QUESTION)], "item_id long, text string")
    assert {(r.doc_id, r.exact) for r in decontam.find_leaks(docs, bench).collect()} == {(1, True), (2, True)}


def test_planted_items_are_found(spark):
    """Every copy of an item, as it is, in capitals and in title case; the digits of a fourth copy are others."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    change = {0: str, 1: str.upper, 2: str.title, 3: lambda t: re.sub(r"[0-9]+", lambda m: str(int(m[0]) + 1000), t)}
    docs = spark.createDataFrame([(4 * i + k, f"Some words here.\n{f(t)}\nmore words follow") for i, t in items for k, f in change.items()], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert {(4 * i + k, i) for i, _ in items for k in change} <= found


def test_verbatim_copies_in_documents_are_found(spark):
    """Brute force: every document of sf0.1 that holds a whole item, in whatever case, is reported."""
    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    sf = "/root/testdata/sf0.1"
    items = [(i, f" {words(t)} ") for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()]
    docs = [(d, f" {words(t)} ") for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    held = {(d, i) for d, t in docs for i, w in items if w in t}
    got = {(r.doc_id, r.item_id) for r in llm.QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    assert len(held) > 200 and held <= got and len(got) <= 1.2 * len(held)


def test_escape(spark):
    rows = spark.createDataFrame([("a<\\[b\\\\",), ("",), ("<|x",)], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in rows)


def test_clashing_columns_and_null_ids(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i if i % 3 else None, words(30), ("a", None)[i % 2]) for i in range(300)] + [(7, "same text here", "a")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = ["key", "copy", "mean", "n", "parts", "cdf", "__key", "__id", "__doc", "__place", "__k", "__parts", "__d", "__bad", "__t", "d", "t", "w", "h", "x", "item", "size", "p", "of", "fp", "__drop", "__row"]
    wide = docs.select("*", *[F.lit(j).alias(c) for j, c in enumerate(extra)])
    out = mixing.mix(wide, {"a": 0.5})
    assert set(out.columns) == set(wide.columns) and out.count() > 200 and out.agg(F.max("copy")).first()[0] < 20
    assert out.filter("doc_id IS NULL").count() > 0
    bench = spark.createDataFrame([(9, QUESTION)], "item_id long, text string")
    leaking = wide.limit(40).unionByName(wide.limit(1).withColumn("text", F.lit(QUESTION)).withColumn("doc_id", F.lit(1000).cast("long")))
    clean = decontam.decontaminate(leaking.drop("__bad"), bench)
    assert clean.columns == leaking.drop("__bad").columns and clean.filter("doc_id = 1000").count() == 0 and clean.count() == 40
    named = docs
    for j, c in enumerate(["key", "n", "__id", "__drop", "__d", "__text", "__own", "__h", "__kept", "__n_lines", "a.b"]):
        named = named.withColumn(c, F.lit(j))
    lines = line_dedup.line_dedup(named)
    assert set(lines.columns) == {*named.columns, "__n_dropped"} and lines.filter("__id = 2 AND __drop = 3 AND `a.b` = 10 AND __own = 6").count() == 350
    assert lines.count() == 350 and lines.filter("doc_id IS NULL AND text IS NULL").count() == 0
