"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, quantities with units, and names turn into typed placeholders, the
rest is stripped of marks and lower-cased (A-Z). Windows of `width` template words of every document are
hash-joined with those of the benchmark, and a window counts only if the values under its placeholders
are the item's own or follow the map from item to document that most of its run follows, so a question with
other numbers and names is found, and chance matches of placeholders are not. A text with SHOUTED or Title Cased stretches is
windowed a second time with its names as plain words, as every item is, so copies in capitals are found. Everything runs as
DataFrame functions.

Defined cases: null or empty texts match nothing; an item with fewer words than `width` is one window of
all its words; windows with fewer than `width` / 2 plain words (or half of a short item) are not used,
unless an item has no others; repeated items or documents are reported once an id, and texts that share
an id are compared apart; exact means that no window matched with other values; a null id of a document is
kept out (it can't be reported), a null item_id is an item; empty tables give empty results; other
columns pass through decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import LOWER, UPPER, durable, read, settled

#: Units after numbers.
UNITS = "km m cm mm kg g mg lb oz l ml mi ft in h hr hrs hours min minutes s sec seconds days weeks months years mph kmh usd eur gbp dollars euros percent degrees c f k".split()
MARKS = ".,;:!?()[]{}\"'`|*#<>«»„“”…-–—/\\%$€£+=_&~^"
NUM, QTY, UNIT, NAME = "\ue001", "\ue002", "\ue003", "\ue004"
MOST_BROADCAST = 400_000
#: Values of a run that may meet one that is taken: 5 apples, 30 dollars -> 4 apples, 4 dollars.
MERGES = 1


def marked(text: Column) -> Column:
    """The text with NUM, QTY, UNIT and NAME before what they are to replace.

    Passes over the whole text, each led by a character that is rare, are many times cheaper than a lambda
    over words. A name is a capitalised word that does not start a sentence or a line.
    """
    s = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(". "))
    s = F.regexp_replace(s, r"\p{Lu}(?<=[^\s.!?:]\s\p{Lu})", f"{NAME}$0")
    s = F.regexp_replace(s, r"[0-9](?<![\p{L}\p{N}.,][0-9])[0-9.,]*+[a-zA-Z]{1,3}(?![\p{L}\p{N}])", f"{QTY}$0")
    s = F.regexp_replace(s, rf"[0-9](?<![\p{{L}}\p{{N}}.,{QTY}][0-9])[0-9.,]*+(?![\p{{L}}\p{{N}}])", f"{NUM}$0")
    s = F.regexp_replace(s, rf"({NUM}\S+\s+)((?i)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    return s


def words_of(s: Column, names: bool = True) -> Column:
    """Template words of a marked text; a placeholder is a mark with its value behind it. Without names, names are plain words and all alphabets are lower-cased."""
    s = F.translate(s if names else F.lower(s), UPPER + MARKS + ("" if names else NAME), LOWER)
    return F.filter(F.split(s, r"[\s\x0B]+"), lambda t: t != "")


def template(text: Column) -> Column:
    return words_of(marked(text))


def shouted(s: Column) -> Column:
    """Whether a marked text holds SHOUTED, Title Cased or similar stretches: five names with at most a word between each two."""
    return F.rlike(s, F.lit(rf"{NAME}\S+(?:\s+\S+)??(?:\s+{NAME}\S+(?:\s+[^{NAME}\s]\S*)?){{4}}"))


def _placed(t: Column) -> Column:
    return (t >= NUM) & (t < "\ue005")


def _value(t: Column) -> Column:
    """What a placeholder stands for; null for a plain word."""
    return F.when(_placed(t), F.lower(F.substr(t, F.lit(2))))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda t: F.xxhash64(F.when(_placed(t), F.substring(t, 1, 1)).otherwise(t)))


def _windows(h: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(h) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(h, i + 1, width)).alias("w")))).otherwise(F.array().cast("array<struct<p:int,w:bigint>>"))


def _sized(h: Column, width: int) -> Column:
    return F.transform(_windows(h, width), lambda x: F.struct(F.lit(width).alias("z"), x["p"].alias("p"), x["w"].alias("w")))


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item, size, p, w, of): the windows of every item, with names as placeholders and as plain words; size is a window's length."""
    items = benchmark.select(F.col(id_col).alias("item"), marked(F.col(text_col)).alias("s")).select("item", words_of(F.col("s")).alias("pairs"), words_of(F.col("s"), False).alias("bare")).filter(F.size("pairs") > 0)
    items = items.withColumn("size", F.least(F.lit(width), F.size("pairs")))
    both = F.arrays_zip(_windows(_hashes(F.col("pairs")), F.col("size")).alias("x"), _windows(_hashes(F.col("bare")), F.col("size")).alias("y"))
    rows = items.select("item", "pairs", "size", F.explode(both).alias("z"))
    plain = F.size(F.filter(F.slice("pairs", F.col("z.x.p") + 1, F.col("size")), lambda y: ~_placed(y)))
    rows = rows.select("item", "size", F.col("z.x.p").alias("p"), F.array_distinct(F.array("z.x.w", "z.y.w")).alias("ws"), (plain * 2 >= F.col("size")).alias("usable"))
    best = rows.groupBy(F.col("item").alias("__i"), F.col("size").alias("__s")).agg(F.max("usable").alias("any"), F.count_if("usable").alias("good"), F.count("*").alias("all"))
    kept = rows.join(best, F.col("item").eqNullSafe(F.col("__i")) & (F.col("size") == F.col("__s"))).filter(F.col("usable") | ~F.col("any"))
    return kept.select("item", "size", "p", F.explode("ws").alias("w"), F.when(F.col("any"), F.col("good")).otherwise(F.col("all")).alias("of"))


def fitting_windows(seen: DataFrame) -> DataFrame:
    """(d, item, of, p, fits, exact): each matched window, whether its values fit its run, and whether they are the item's own.

    A run is what one text shares with an item at one shift. Each item value stands for the document value
    it meets in most windows, and a window fits if all its values agree with that map or are identical.
    Up to MERGES values may become one that another already became; in a run that merges more, a
    document value counts only for the item value it meets most.
    """
    run = ["d", "t", "item", "copy", "of", "size", "shift"]
    spot = lambda p: F.sequence(p, p + F.col("size") - 1)
    pairs = lambda p: F.filter(F.transform(spot(p), lambda i: F.struct(F.get("item_values", i).alias("a"), F.get("doc_values", i + F.col("shift")).alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    wins = F.transform("ps", lambda p: F.struct(p.alias("p"), F.array_distinct(pairs(p)).alias("m")))
    each = seen.withColumn("copy", F.xxhash64("item_values")).select(*run, F.inline(wins)).select(*run, "p", F.inline_outer("m")).repartition(*run)
    same = F.col("a") == F.col("b")
    each = each.withColumn("n", F.count("*").over(Window.partitionBy(*run, "a", "b")))
    by_item = Window.partitionBy(*run, "a").orderBy(F.desc("n"), F.desc(same), "b", "p")
    each = each.withColumns({"maps": F.col("b") == F.first("b").over(by_item), "head": F.row_number().over(by_item) == 1})
    by_doc = Window.partitionBy(*run, "b").orderBy(F.desc("maps"), F.desc("n"), F.desc(same), "a", "p")
    each = each.withColumn("back", F.col("a") == F.first("a").over(by_doc))
    each = each.withColumn("merged", F.count_if(F.col("head") & ~F.col("back")).over(Window.partitionBy(*run)))
    good = F.col("maps") & (F.col("back") | (F.col("merged") <= MERGES))
    wins = each.groupBy(*run, "p").agg(F.coalesce(F.every(good), F.lit(True)).alias("fits"), F.coalesce(F.every(same), F.lit(True)).alias("exact"))
    wins = wins.withColumn("fits", F.col("fits") | F.col("exact"))
    return wins.withColumn("any", F.max("fits").over(Window.partitionBy(*run))).filter("any").select("d", "item", "of", "p", "fits", "exact")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_cover: float = 0.5, min_windows: int = 6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, cover, exact): documents that hold at least `min_windows` windows of an item, or `min_cover` of them.

    One pass templates a text and makes its windows of all sizes. The benchmark's windows are counted and
    broadcast up to MOST_BROADCAST rows, else joined by hash, where adaptive execution splits what one frequent window
    brings. Only matches are shuffled, and only documents with a match are read a second time, for their values.
    """
    bench = durable(benchmark_windows(benchmark, width, item_col, item_text), "bench")
    n = bench.count()
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most `width` numbers
    small = n <= MOST_BROADCAST
    digest = F.xxhash64(F.col(text_col)).alias("t")
    hashed = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("d"), digest, marked(F.col(text_col)).alias("s"))
    hashed = hashed.select("d", "t", _hashes(words_of(F.col("s"))).alias("h"), F.when(shouted(F.col("s")), _hashes(words_of(F.col("s"), False))).alias("bare"))
    every = F.flatten(F.array(*[_sized(F.col(h), z) for z in sizes or [width] for h in ("h", "bare")]))
    each = hashed.select("d", "t", F.explode(every).alias("x")).select("d", "t", F.col("x.z").alias("z"), F.col("x.p").alias("at"), F.col("x.w").alias("w"))
    b = bench.select("item", F.col("size"), "p", F.col("w").alias("__w"), "of")
    hits = each.join(F.broadcast(b) if small else b, (F.col("w") == F.col("__w")) & (F.col("z") == F.col("size"))).select("d", "t", "item", "of", "size", "p", (F.col("at") - F.col("p")).alias("shift"))
    runs = durable(hits.groupBy("d", "t", "item", "of", "size", "shift").agg(F.collect_set("p").alias("ps")), "leaks")
    ids = runs.select(F.col("d").alias("__d")).distinct()
    near = ids.count() <= MOST_BROADCAST
    plain = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text"))
    there = plain.join(F.broadcast(ids) if near else ids, F.col("d") == F.col("__d"), "left_semi").select("d", F.xxhash64("text").alias("t"), F.transform(template(F.col("text")), _value).alias("doc_values")).dropDuplicates(["d", "t"])
    asked = benchmark.select(F.col(item_col).alias("item"), F.transform(template(F.col(item_text)), _value).alias("item_values"))
    seen = runs.join(there, ["d", "t"]).join(F.broadcast(asked) if small else asked, runs["item"].eqNullSafe(asked["item"])).select("d", "t", runs["item"], "of", "size", "shift", "ps", "item_values", "doc_values")
    total = fitting_windows(seen).groupBy("d", "item", "of", "p").agg(F.max("fits").alias("fits"), F.max("exact").alias("exact"))
    total = total.groupBy("d", "item", "of").agg(F.count_if("fits").alias("n_windows"), F.min("exact").alias("exact"))
    cover = F.col("n_windows") / F.col("of")
    return total.filter((cover >= min_cover) | (F.col("n_windows") >= min_windows)).select(F.col("d").alias(id_col), F.col("item").alias(item_col), "n_windows", cover.alias("cover"), "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that leak an item."""
    bad = durable(find_leaks(docs, benchmark, id_col=id_col, **how).select(F.col(id_col).alias("__bad")).distinct(), "leaky")
    few = bad.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(bad) if few else bad, docs[id_col] == bad["__bad"], "left_anti")


@settled
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
