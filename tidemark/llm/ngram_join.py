"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles. Its sketch has P words of 64 bits; each shingle
picks one word by hash and XORs its own hash into it. A shingle in one set but not in the other changes
one word only, so the number of differing words never exceeds the symmetric difference. Sets of sizes a
and b with Jaccard similarity t or more differ in at most D = (a + b)(1 - t)/(1 + t) shingles. Documents
of a size band share P; each emits its filled words, in its own band and, where larger partners stand in
the next one, in that band too.

Pigeonhole, twice. Of K filled words at least K - D are those of any partner, so a document with fewer words
that another document holds has no partner and is out. Of the S held words of the others at most D - (K - S)
may differ, so with the rarest first, the first D - (K - S) + c of them hold c words of any partner, c up
to MATCHES. Only these are joined. How often a word occurs orders words and drops nothing. Sets with no
more than D filled words (chance keeps them rare) also emit one word of their band.

A word that few documents hold gives pairs, and a pair needs its c words. A word of many gives a star, and
documents connected by stars are a family. Its members are verified against one of them first, which settles a
family of near copies in linear time; who fails meets all members, in pairs of blocks, as matrix products
that return a spanning forest instead of all pairs. Words whose shingles are all frequent (a list of
at most FREQUENT shingles) go by a key of word and document, so none fills a task. Exact copies are one node
throughout. Components are found by large-star and small-star steps.

Shingles are compared by 64-bit hashes and equal sets told by 128 bits; nodes of the candidate search carry
56 bits, and classes that share them are all verified. Defined cases: null, empty or white text has no
shingles and is linked with nothing; 1 to k - 1 words are one shingle; rows that share a doc_id are judged
each by its own text; a null doc_id stays in the result, can be linked, and never names a
component unless it holds no other; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import SPACES, Chunk, chunks, mix
from ._spark import components, durable, join_by_weight, read, release

SMALL = 6
MATCHES = 4
BLOCK = 512
FREQUENT = 200_000
#: Shingles a sketch word holds at the upper end of a band, on average.
LOAD = 2.8
#: Low bits of a node: 1 for the next band, 2 for the words a pair must share, 5 for the size in steps of about 1.2.
INFO = 255


class Sets:
    """Sorted distinct shingle hashes of the texts of a chunk: of text i, all[first[i]:first[i + 1]]."""

    def __init__(self, c: Chunk, k: int):
        runs, owner = c.shingles(k)
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
        self.all, self.owner = runs[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(c.n + 1))
        self.size = np.diff(self.first)

    def _totals(self, salt: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.all ^ np.uint64(salt)))])
        return total[self.first[1:]] - total[self.first[:-1]]

    def digest(self) -> tuple[np.ndarray, list[bytes]]:
        """Of each set the 56 bits of its node, and 128 bits."""
        n = self.size.astype(np.uint64)
        a, b = mix(self._totals(0x1F83D9ABFB41BD6B) + n), mix(self._totals(0x5BE0CD19137E2179) ^ n)
        raw = np.stack([a, b], 1).tobytes()
        return a & ~np.uint64(INFO), [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _lead(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sketch(sets: Sets, use: np.ndarray, up: int, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, text, need, common) of the filled words of the texts in `use`, in their own band (up 0) or the next (up 1).

    need: how many words a text is sure to share with any partner in this band. common: all shingles frequent.
    """
    n = sets.size.astype(np.int64)
    band = np.frexp(np.maximum(n, 1).astype(float))[1] - 1 + up
    top = 1 << (band + 1)
    use = use & (n > 0) & ((100 * n >= percent * (1 << band)) if up else True)
    width = np.where(use, np.maximum(64, np.ceil(top / LOAD)).astype(np.int64), 0)
    at = np.concatenate([[0], np.cumsum(width)])
    mine = use[sets.owner]
    owner, runs = sets.owner[mine], sets.all[mine]
    slot = ((runs >> np.uint64(7)) % np.maximum(width[owner], 1).astype(np.uint64)).astype(np.int64) + at[owner]
    words, filled, rare = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool), np.zeros(at[-1], bool)
    np.bitwise_xor.at(words, slot, mix(runs ^ np.uint64(0xA24BAED4963EE407)))
    filled[slot] = True
    if len(frequent):
        rare[slot[frequent[np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)] != runs]] = True
    else:
        rare[slot] = True
    place = np.flatnonzero(filled)
    text = np.searchsorted(at, place, "right") - 1
    word = mix(words[place] ^ mix((place - at[text]).astype(np.uint64) * np.uint64(64) + band[text].astype(np.uint64)))
    most = (n + np.minimum(100 * n // percent, top - 1)) * (100 - percent) // (100 + percent)
    need = np.bincount(text, minlength=len(n)) - most
    thin = np.flatnonzero(use & (need <= 0))
    word = np.concatenate([word, mix(band[thin].astype(np.uint64) ^ np.uint64(0xFEDCBA9876543210))])
    text, common = np.concatenate([text, thin]), np.concatenate([~rare[place], np.ones(len(thin), bool)])
    return word, text, need[text], common


def digests(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, fp, node, shingle, count): a row for each document; and, with null fp, shingles frequent in a batch."""
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n", "fp", "node", "shingle", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads = _lead(batch, id_col), []
            for i, c in chunks(_lead(batch, text_col), SPACES):
                s = Sets(c, k)
                heads.append(s.all)
                node, fp = s.digest()
                none = pa.nulls(c.n, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(i, c.n), pa.array(s.size.astype(np.int64)), pa.array(fp, pa.binary()), pa.array(node.view(np.int64)), none, none], names=names)
            hash_, count = np.unique(np.concatenate(heads) if heads else np.zeros(0, np.uint64), return_counts=True)
            often = count >= max(4, batch.num_rows // 1000)
            m = int(often.sum())
            if m:
                yield pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(hash_[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n long, fp binary, node long, shingle long, count long")


def emissions(docs: DataFrame, often, k: int, percent: int, text_col: str) -> DataFrame:
    """(sig, id, need, salt) of all documents; equal sets within an Arrow batch emit once. salt: 0, or that of a common word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for _, c in chunks(_lead(batch, text_col), SPACES):
                s = Sets(c, k)
                node, fp = s.digest()
                fresh = np.array([not (x in seen or seen.add(x)) for x in fp], bool)
                step = (np.log(np.maximum(s.size, 1)) / np.log(1.2)).astype(np.uint64) & np.uint64(31)
                for up in (0, 1):
                    sig, text, need, common = sketch(s, fresh, up, percent, often.value)
                    sure = np.clip(need, 1, MATCHES).astype(np.uint64) - np.uint64(1)
                    ident = node[text] | step[text] << np.uint64(3) | sure << np.uint64(1) | np.uint64(up)
                    salt = np.where(common, ident | np.uint64(1), np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ident.view(np.int64)), pa.array(need.astype(np.int32)), pa.array(salt.view(np.int64))], names=["sig", "id", "need", "salt"])

    return docs.select(text_col).mapInArrow(run, "sig long, id long, need int, salt long")


def shingle_sets(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(fp, n, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(_lead(batch, text_col), SPACES):
                s = Sets(c, k)
                lists = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(s.all.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.digest()[1], pa.binary()), pa.array(s.size.astype(np.int64)), lists], names=["fp", "n", "shingles"])

    return docs.select(text_col).mapInArrow(run, "fp binary, n long, shingles array<long>")


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    parent, kept = list(range(n)), []
    for a, b in pairs:
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def link_block(sets: list[np.ndarray], side: np.ndarray, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides of a block pair."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    col, owner = col[shared], owner[shared]
    used, col = np.unique(col, return_inverse=True)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for at in range(0, len(used), columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[lo:hi], col[lo:hi] - at] = 1
        common += m[left] @ m[right].T
    both = n[left][:, None] + n[right][None, :] - common
    a, b = np.nonzero(100 * common.astype(np.int64) >= percent * both.astype(np.int64))
    return _forest(zip(left[a].tolist(), right[b].tolist(), strict=True), len(sets))


def _masked(c: str, mask: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(mask))


def held_words(docs: DataFrame, often, k: int, percent: int, text_col: str) -> DataFrame:
    """(sig, id, common): of each document that may have a partner, the rarest of its words that others hold, as many as pigeonholes ask for."""
    rows = emissions(docs, often, k, percent, text_col)
    by = Window.partitionBy("sig", "salt")
    seen = rows.select("*", F.count("*").over(by).alias("df"), F.min("id").over(by).alias("lo"), F.max("id").over(by).alias("hi"))
    seen = seen.filter("salt <> 0 OR lo <> hi").select("sig", "id", "need", F.when(F.col("salt") != 0, F.lit(1 << 62)).otherwise(F.col("df")).alias("df"))
    mine = seen.repartition("id").groupBy("id", "sig").agg(F.min("need").alias("need"), F.max("df").alias("df"))
    each = Window.partitionBy("id")
    mine = mine.select("*", F.count("*").over(each).alias("s"), F.min("need").over(each).alias("least")).filter("s >= least")
    mine = mine.withColumn("r", F.row_number().over(each.orderBy("df", "sig"))).filter(F.col("r") <= F.col("s") - F.col("least") + F.least(F.lit(MATCHES), F.greatest(F.lit(1), F.col("least"))))
    return mine.select("sig", "id", (F.col("df") == F.lit(1 << 62)).alias("common"))


def candidates(held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((a, b) nodes that share their c words, (a, b) star edges of words of many)."""
    common, node = held.filter("common"), F.lit(~INFO)
    tops = common.groupBy("sig").agg(F.min("id").alias("top"), F.max("id").alias("low")).filter("top <> low").select(F.col("sig").alias("s"), "top")
    stars = common.join(tops, F.col("sig") == F.col("s")).select(F.col("top").alias("a"), F.col("id").alias("b"))
    by = Window.partitionBy("sig")
    recent = by.orderBy("id").rowsBetween(-SMALL, -1)
    runs = held.filter("NOT common").select("id", F.count("*").over(by).alias("size"), F.min("id").over(by).alias("top"), F.collect_list("id").over(recent).alias("others"))
    slack = int(np.ceil(np.log(100 / percent) / np.log(1.2))) + 1
    away = lambda o: F.pmod(F.shiftright(o.bitwiseAND(F.lit(255)), 3) - F.shiftright(F.col("id").bitwiseAND(F.lit(255)), 3) + slack, F.lit(32))
    few = F.filter("others", lambda o: (o != F.col("id")) & (away(o) <= 2 * slack))
    runs = runs.filter("size > 1").select("id", (F.col("size") > SMALL + 1).alias("star"), F.when(F.col("size") <= SMALL + 1, few).otherwise(F.array("top")).alias("others"))
    edges = runs.select("id", "star", F.explode("others").alias("o")).filter("id <> o")
    edges = edges.groupBy(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"), "star").agg(F.count("*").alias("shared"))
    sure = F.least(F.shiftright(_masked("a", 6), 1), F.shiftright(_masked("b", 6), 1)) + 1
    # a pair that meets in no star shares all the words it is sure to share in runs of few
    edges = edges.filter(F.col("star") | (F.col("shared") >= sure)).select("a", "b", "star").unionByName(stars.select("a", "b", F.lit(True).alias("star")))
    edges = durable(edges.select(F.col("a").bitwiseAND(node).alias("a"), F.col("b").bitwiseAND(node).alias("b"), "star").filter("a <> b").distinct(), "edges")
    return edges.filter("NOT star").select("a", "b"), edges.filter("star").select("a", "b")


def jaccard_links(docs: DataFrame, table: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between classes of equal sets (their fp), enough to connect all that link."""
    spark = docs.sparkSession
    hot = table.filter("fp IS NULL").groupBy("shingle").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "shingle").limit(FREQUENT).select("shingle").toArrow()
    often = spark.sparkContext.broadcast(np.sort(hot.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    held = durable(held_words(docs, often, k, percent, text_col), "words")
    often.unpersist()
    pairs, stars = candidates(held, percent)
    release(held)
    family = durable(components(stars).withColumnsRenamed({"node": "node", "component": "family"}), "families")

    # the sets of all candidates; classes that share a node stand for each other
    classes = table.filter("fp IS NOT NULL AND n > 0").groupBy("fp", "node").agg(F.min(id_col).alias("rep"))
    twins = classes.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").select("node")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(family.select("node")).unionByName(twins).distinct()
    wanted = durable(classes.join(wanted, "node", "left_semi"), "wanted")
    chosen = docs.select(id_col, text_col).join(wanted.select(F.col("rep").alias("__rep")).distinct(), F.col(id_col) == F.col("__rep"), "left_semi")
    if wanted.filter("rep IS NULL").limit(1).count():
        chosen = chosen.unionByName(docs.filter(F.col(id_col).isNull()).select(id_col, text_col))
    sets = shingle_sets(chosen, k, text_col).join(wanted.select("fp", "node"), "fp")
    sets = durable(sets.dropDuplicates(["fp"]), "sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")

    i = F.size(F.array_intersect("s_a", "s_b"))
    links = lambda df: df.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").withColumn("i", i).filter(f"100 * i >= {percent} * (n_a + n_b - i)").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    shared = twins.select(F.col("node").alias("a"), F.col("node").alias("b"))
    direct = links(pairs.unionByName(shared).join(a, "a").join(b, "b"))
    to_first = durable(links(family.filter("node <> family").select(F.col("family").alias("a"), F.col("node").alias("b")).join(b, "b").join(a, "a")), "first")

    # members that their family's first does not settle meet all members
    firsts = family.select("family").distinct().select(F.col("family").alias("node"), "family")
    members = family.join(sets.select("node", "fp"), "node").select("family", "fp").distinct()
    settled = to_first.select(F.col("b").alias("fp")).unionByName(firsts.join(sets.select("node", "fp"), "node").select("fp"))
    rest = durable(members.join(settled.distinct(), "fp", "left_anti"), "rest")
    sizes = members.groupBy("family").agg(F.count("*").alias("w")).join(rest.groupBy("family").agg(F.count("*").alias("v")), "family")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = durable(sizes.select("family", "w", "v", parts("v").alias("left"), parts("w").alias("right")), "sizes")
    deal = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = join_by_weight(rest, sizes.select("family", "v", "left", "right"), "family", "v", "inner").select("family", "fp", F.lit(0).alias("side"), deal("left").alias("x"), spread("right").alias("y"))
    two = join_by_weight(durable(members.join(sizes.select("family"), "family", "left_semi"), "members"), sizes.select("family", "w", "left", "right"), "family", "w", "inner").select("family", "fp", F.lit(1).alias("side"), spread("left").alias("x"), deal("right").alias("y"))
    blocks = one.unionByName(two).join(sets.select("fp", "shingles"), "fp")

    def link(group: pa.Table) -> pa.Table:
        fp, column = group.column("fp"), group.column("shingles").combine_chunks()
        at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        found = link_block([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], group.column("side").to_numpy(), percent)
        return pa.table({"a": fp.take(pa.array([i for i, _ in found], pa.int64())), "b": fp.take(pa.array([j for _, j in found], pa.int64()))})

    linked = blocks.groupBy("family", "x", "y").applyInArrow(link, "a binary, b binary")
    return durable(direct.unionByName(to_first).unionByName(linked).filter("a <> b"), "links")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    table = durable(digests(docs, k, percent, id_col, text_col), "digests")
    joined = components(jaccard_links(docs, table, k, percent, id_col, text_col))
    heads = table.filter("fp IS NOT NULL AND n > 0").groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("w"))
    grouped = heads.join(joined, F.col("fp") == F.col("node"), "inner").select("fp", "w", "rep", "component")
    names = grouped.groupBy("component").agg(F.min("rep").alias("__first"))
    linked = grouped.join(names, "component").select("fp", "w", "__first")
    alone = heads.join(joined.select("node"), F.col("fp") == F.col("node"), "left_anti").filter("w > 1").select("fp", "w", F.col("rep").alias("__first"))
    heads = durable(linked.unionByName(alone), "heads")
    rows = table.filter("fp IS NOT NULL").select(id_col, "n", "fp")
    found = join_by_weight(rows, heads, "fp", "w")
    return found.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("__first", F.col(id_col)).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
