"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

Rules, features and scores are DataFrame functions, one pass without a shuffle. The regression is fitted on a small labelled URL table by
full-batch gradient steps. Defined cases: a null url, or one without "://", has empty host and path, matches no rule
and is judged by the model's intercept, which allows it; of rules with the same host and path the first one listed holds;
repeated pages are judged alike; very long urls are read whole; an empty table gives an empty table; columns of
pages that bear the name of a new column are replaced, all others pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ascii_lower, read

DIM = 1 << 14
MOST_LABELLED = 10_000
GRAMS = (3, 4)

#: action, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The small labelled table: words that unwanted hosts are made of, by kind, and words of ordinary hosts.
UNWANTED = {
    "gambling": "betting gambling poker roulette jackpot slots lotto bingo blackjack wager bookmaker baccarat craps sportsbook",
    "drugs": "viagra cialis levitra tramadol xanax pharmacy steroids meds kamagra phentermine oxycodone",
    "sex": "porn xxx sex escorts camgirls nude milf hentai erotic hookup fetish strip",
    "junk": "backlinks doorway autoblog clickbait bulkmail popunder banners affiliates pixel doubleclick sponsored impressions adverts",
    "fraud": "payday loans replica warez crack keygen torrents phishing giveaway forex doubler hacked",
}
TAILS = "online club shop zone world live best top royal easy bonus deals hub max pro vip".split()
WANTED = """
garden news museum wiki weather kitchen travel journal bikes school theater hospital archive station music photo law stories birds
maps hiking chess poems street letter science history health nature forest river mountain bridge village market baker reading
writing teacher student physics chemistry biology geology mathematics statistics language grammar dictionary translation culture
heritage painting sculpture cinema film orchestra choir dance sports football tennis running swimming sailing rowing cycling cooking
recipes bread cheese vegetables fruit house home family children parents friends community council parliament ministry court police
rescue railway airport harbour shipping transport engineering software compiler database network protocol security research
institute academy college bank insurance furniture clothing shoes jewelry hardware electronics camera laptop phone garage motors
energy solar water paper print publisher magazine radio television podcast gallery design studio architect builder carpenter
electric dental clinic nursing pets horses dogs cats fishing camping climbing skiing hotel cafe restaurant brewery winery coffee
tea chocolate pizza noodle festival wedding toys games puzzles crafts knitting quilt woodwork pottery astronomy planet ocean island
coast valley county city town metro union society alliance foundation charity church temple daily weekly times post herald tribune
press review forum blog notes docs guide handbook manual tutorial course lecture library code git cloud server mail search map
corner center modern person perfect portal report orange north western southern eastern winter summer spring autumn concert element
open source project data science build release version driver memory process thread window linux unix parser editor terminal
country region district province capital embassy consulate passport visa customs border harbor pilot captain sailor soldier veteran
lawyer notary accountant auditor broker trader farmer fisher miner painter plumber tailor butcher florist gardener optician dentist
""".split()
WANTED_ENDS = [".com/", ".org/about", ".edu/courses/intro-101", ".net/articles/2019/07/a-long-walk", ".co.uk/news/story?id=4", ".de/", ".fr/contact.html", ".io/docs/start#install", ".gov/reports/2020.pdf", ".info/wiki/Main_Page", ".top/blog", ".xyz/", ".shop/", ".org/", ".net/", ".info/", ".biz/", ".ru/2/", ".org/en-GB/", ".co.uk/"]
UNWANTED_ENDS = [".com/", ".net/join?aff=7", ".top/", ".xyz/promo/bonus", ".biz/signup?ref=12", ".info/", ".org/", ".ru/go/offer", ".de/", ".co.uk/", ".shop/deal"]


def labelled_hosts() -> list[tuple[tuple[str, ...], str, int]]:
    """(the words it is made of, host without its end, label), in varied patterns; ordinary hosts hold the same tails."""
    rows: list[tuple[tuple[str, ...], str, int]] = []
    for words in UNWANTED.values():
        for i, w in enumerate(words.split()):
            t, u = TAILS[(3 * i + 1) % len(TAILS)], TAILS[(5 * i + 4) % len(TAILS)]
            rows += [((w,), h, 1) for h in (f"www.{w}{t}", f"{u}-{w}", f"{w}{24 * (i + 1)}", f"my{w}.{t}site")]
    for i, w in enumerate(WANTED):
        v, t = WANTED[(7 * i + 11) % len(WANTED)], TAILS[i % len(TAILS)]
        rows += [((w,), h, 0) for h in ((f"www.{w}", f"{w}{i}") if i % 2 else (f"the{w}", f"en.{w}.{w[:2]}{w[-3:]}"))]
        rows += [((w, v), h, 0) for h in (f"{w}-{v}", f"www.{v}{w}")] + [((w,), f"{w}-{t}" if i % 3 else f"{t}{w}", 0)]
    return rows


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    ok = F.contains(url, F.lit("://"))
    host = F.when(ok, ascii_lower(F.regexp_extract(url, found, 1))).otherwise(F.lit(""))
    path = F.when(ok, F.regexp_extract(url, found, 2)).otherwise(F.lit(""))
    return host, path


def features(host: Column, path: Column) -> tuple[Column, Column]:
    """Buckets of the distinct character n-grams of host and of path. All digits count as 0: numbers say nothing of a site."""

    def of_size(text: Column, mark: str, n: int) -> Column:
        every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # linear, where substring() counts from the start each time
        return F.transform(every, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(DIM)).cast("int"))

    def grams(text: Column, mark: str) -> Column:
        text = F.translate(text, "123456789", "000000000")
        return F.array_distinct(F.concat(*[of_size(text, mark, n) for n in GRAMS]))

    return grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(F.concat(path, F.lit("$")), "p")


def _margin(feats: tuple[Column, Column], weights: list[float], bias: float) -> Column:
    """weights travel as one constant, folded once, not as one literal a bucket. Host and path are scaled apart, so a long path hides no host."""
    w = F.split(F.lit(",".join(f"{x:.5g}" for x in weights)), ",").cast("array<double>")
    parts = [F.aggregate(f, F.lit(0.0), lambda a, i: a + F.element_at(w, i + 1)) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")) for f in feats]
    return parts[0] + parts[1] + F.lit(bias)


def train(labelled: DataFrame, steps: int = 600, rate: float = 3.0, decay: float = 1e-4, prior: float = 0.2) -> tuple[list[float], float]:
    """Fit weights and intercept on (url, label 0 or 1), a table of at most MOST_LABELLED rows by contract. prior: how much unwanted urls
    weigh in all; below a half, a url that says nothing is allowed.

    Its buckets come from the same DataFrame functions as in scoring; the gradient steps over them are
    plain matrix products on the driver, as every step as a job would compile its own plan.
    """
    host, path = url_parts(F.col("url"))
    h, p = features(host, path)
    rows = labelled.select("label", h.alias("h"), p.alias("p")).limit(MOST_LABELLED + 1).collect()
    if not 0 < len(rows) <= MOST_LABELLED:
        raise ValueError(f"expected 1 to {MOST_LABELLED} labelled urls")
    used, at = np.unique(np.concatenate([r[c] for r in rows for c in "hp"]).astype(int), return_inverse=True)
    size = np.array([len(r[c]) for r in rows for c in "hp"])
    x, y = np.zeros((len(rows), len(used))), np.array([float(r["label"]) for r in rows])
    np.add.at(x, (np.repeat(np.repeat(np.arange(len(rows)), 2), size), at), np.repeat(1 / np.sqrt(np.maximum(size, 1)), size))
    share = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    w, bias = np.zeros(len(used)), 0.0
    last, last_bias = w, bias
    for t in range(steps):  # Nesterov's steps; rate is below 2 over the curvature, which is at most 1/2
        ahead, ahead_bias = w + t / (t + 3) * (w - last), bias + t / (t + 3) * (bias - last_bias)
        g = share * (y - 1 / (1 + np.exp(-(x @ ahead + ahead_bias))))
        last, last_bias = w, bias
        w, bias = ahead + rate * (x.T @ g - decay * ahead), ahead_bias + rate * g.sum()
    whole = np.zeros(DIM)
    whole[used] = w
    return whole.tolist(), float(bias)


def labelled_urls(spark: SparkSession, without: tuple[str, ...] = ()) -> DataFrame:
    """(url, label), with a url that says nothing among the ordinary ones. without: words whose hosts are left out, for tests on words that training has not seen."""
    kept = [(h, y) for words, h, y in labelled_hosts() if not set(words) & set(without)]
    each = [("http" + "s" * (i % 2) + "://" + h + (UNWANTED_ENDS[i % len(UNWANTED_ENDS)] if y else WANTED_ENDS[i % len(WANTED_ENDS)]), y) for i, (h, y) in enumerate(kept)]
    rows = ", ".join(f"('{u}', {y})" for u, y in [*each, ("", 0)])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def url_filter(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", block_at: float = 0.5) -> DataFrame:
    """pages plus host, path, rule, score and verdict. A single pass without a shuffle."""
    host, path = url_parts(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last to fit holds
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    score = 1 / (1 + F.exp(-_margin(features(F.col("host"), F.col("path")), *model)))
    out = out.withColumn("rule", rule).withColumn("score", score)
    return out.withColumn("verdict", F.coalesce(action, F.when(F.col("score") >= block_at, F.lit("block")).otherwise(F.lit("allow"))))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_urls(spark))
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "score")
