"""The trie of conversation prefixes, with sums over every subtree.

Each turn becomes a 128-bit digest; a node is a depth and the xor of the digests of its turns, each salted
with its place. Nodes are one aggregation over (conversation, depth); what a subtree holds then comes by pointer jumping:
in round k every node passes its sums to its 2**k-th ancestor and doubles its pointer, so a chain of
any length takes a logarithm of rounds, and a node with a third of all children is a partial sum, not a group.

Texts are read once and never shuffled. Places in a conversation come from one global order (ranges, sorted) and
counts a range, and xors of long conversations from blocks, so that no task needs a whole conversation.
The ids that end in a node are joined in pieces and hashed as a stream.

Defined cases: a null role or text is empty; rows of one turn order by role, then by the first 32 characters of the
text, then by digest, nulls first; a null conv_id has no name to be a member by, so its rows take no part; repeated
rows are turns of their own; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import durable, read, release, settled
from .structure_repair import CRC32

BLOCK_BITS = 12
PIECE_BITS = 8
KEY = ["depth", "x", "y"]


def place_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, a, b, chars) from pos 0, (conv_id, n)): digests, places and lengths of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.substring(role, 1, 32).alias("role"),
        F.substring(text, 1, 32).alias("text"),
        F.xxhash64(F.lit(1), F.length(role), role, text).alias("a"),
        F.xxhash64(F.lit(2), F.length(role), role, text).alias("b"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", "turn", "role", "text", "a", "b"]
    laid = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars", F.monotonically_increasing_id().alias("row"))
    laid = durable(laid, "turns").withColumn("part", F.shiftright("row", 33))
    part = laid.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = durable(part.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), (before - F.col("first")).alias("shift"), "size"), "parts")
    placed = laid.join(part, (F.col("conv_id") == F.col("__c")) & (F.col("part") == F.col("__p"))).select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "a", "b", "chars")
    return placed, part.groupBy(F.col("__c").alias("conv_id")).agg(F.sum("size").alias("n"))


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, up_x, up_y, chars): the digest of each prefix and of the one before."""
    salted = placed.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("s"), F.xxhash64("b", "pos", "a").alias("t"), "chars", F.shiftright("pos", BLOCK_BITS).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    near = salted.select("*", F.bit_xor("s").over(inside).alias("xs"), F.bit_xor("t").over(inside).alias("xt"))
    whole = salted.groupBy("conv_id", "block").agg(F.bit_xor("s").alias("ws"), F.bit_xor("t").alias("wt"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.bit_xor("ws").over(earlier).alias("bs"), F.bit_xor("wt").over(earlier).alias("bt")).filter("__b > 0")
    both = near.join(base, (F.col("conv_id") == F.col("__c")) & (F.col("block") == F.col("__b")), "left")
    x = F.col("xs").bitwiseXOR(F.coalesce("bs", F.lit(0)))
    y = F.col("xt").bitwiseXOR(F.coalesce("bt", F.lit(0)))
    return both.select("conv_id", (F.col("pos") + 1).alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("s")).alias("up_x"), y.bitwiseXOR(F.col("t")).alias("up_y"), "chars")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the pieces of each node, which come in order, and hashes them as they come."""
    key, state = None, None

    def made(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for *now, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        yield made(done)
    if key is not None:
        yield made([(*key, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of (depth, x, y, conv_id): ids ascending, joined by commas."""
    row = F.monotonically_increasing_id()
    laid = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").select(*KEY, "conv_id", F.shiftright(row, PIECE_BITS).alias("piece"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = laid.groupBy(*KEY, "piece").agg(ids.alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(_digest, "depth long, x long, y long, ends_sha256 string")


def roll_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """(id, n_leaves, saved_tokens) summed over each subtree of nodes (id, parent, depth, leaves, saved), by pointer jumping."""
    own = nodes.select("id", "leaves", "saved")
    active, gains = nodes.filter("parent IS NOT NULL").select("id", F.col("parent").alias("jump"), "depth", "leaves", "saved"), []
    kept = []
    reach = 1
    while reach <= deepest:
        gain = durable(active.groupBy(F.col("jump").alias("to")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most")), "gains")
        gains.append(gain)
        reach *= 2
        if reach > deepest:
            break
        above = active.select(F.col("id").alias("mid"), F.col("jump").alias("far"))
        step = active.filter(F.col("depth") >= reach).join(above, F.col("jump") == F.col("mid")).join(gain, F.col("id") == F.col("to"), "left")
        active = durable(step.select("id", F.col("far").alias("jump"), "depth", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved")), "jumps")
        kept.append(active)
    release(*kept)
    for gain in gains:
        own = own.unionByName(gain.select(F.col("to").alias("id"), F.col("more").alias("leaves"), F.col("most").alias("saved")))
    return own.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node, named by its smallest member and its depth: the first `depth` turns of `conv_id`.

    placed: (conv_id, pos, a, b, chars); lengths: (conv_id, n) of every member, 0 for one without turns.
    """
    steps = prefixes(placed).join(lengths.select(F.col("conv_id").alias("__c"), "n"), F.col("conv_id") == F.col("__c"))
    steps = steps.select("conv_id", *KEY, "up_x", "up_y", "chars", (F.col("n") == F.col("depth")).alias("ends"))
    nil = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = lengths.select("conv_id", *[nil.alias(k) for k in KEY], none.alias("up_x"), none.alias("up_y"), nil.alias("chars"), (F.col("n") == 0).alias("ends"))
    steps = durable(steps.unionByName(root), "prefixes")
    made = steps.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("up_x", "up_y", "chars")])
    made = durable(made.withColumn("id", F.monotonically_increasing_id()), "nodes")
    deepest = made.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    up = made.select(F.col("depth").alias("__d"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = made.join(up, (F.col("depth") - 1 == F.col("__d")) & (F.col("up_x") == F.col("__x")) & (F.col("up_y") == F.col("__y")), "left")
    linked = durable(linked.select("id", "conv_id", *KEY, "parent", "parent_conv_id", "n_convs", "chars"), "linked")
    children = linked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("__of")).agg(F.count("*").alias("__n"))
    nodes = linked.join(children, F.col("id") == F.col("__of"), "left").select(linked["*"], F.coalesce("__n", nil).alias("n_children"))
    nodes = durable(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "counted")
    sums = roll_up(nodes, deepest)
    ends = end_digests(steps.filter("ends").select(*KEY, "conv_id"))
    ends = ends.select(*[F.col(k).alias(f"__{k}") for k in KEY], "ends_sha256")
    out = nodes.join(sums.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"))
    out = out.join(ends, (F.col("depth") == F.col("__depth")) & (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def share_heads(placed: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilding: each conversation c opens with the first h turns of c - c % 100, h = crc32(c) % 6."""
    head = F.col("conv_id") - F.col("conv_id") % 100
    hours = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("long")
    of = lengths.select("conv_id", "n", head.alias("head"), F.when(head == F.col("conv_id"), F.lit(0)).otherwise(hours).alias("h"))
    at = lengths.select(F.col("conv_id").alias("__head"), F.col("n").alias("__n"))
    of = of.join(at, F.col("head") == F.col("__head"), "left")
    taken = F.least("h", F.coalesce("__n", F.lit(0)))
    of = durable(of.select(F.col("conv_id").alias("__c"), "head", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")), "heads")
    own = placed.join(of, (F.col("conv_id") == F.col("__c")) & (F.col("pos") >= F.col("h"))).select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "a", "b", "chars")
    first = placed.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < 5))
    lent = of.filter("h > 0").join(first, (F.col("head") == F.col("conv_id")) & (F.col("pos") < F.col("h"))).select(F.col("__c").alias("conv_id"), "pos", "a", "b", "chars")
    return own.unionByName(lent), of.select(F.col("__c").alias("conv_id"), F.col("total").alias("n"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(*place_turns(turns))


@settled
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*share_heads(*place_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


OP13_SQL = (
    r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1
), c AS (
  SELECT n.conv_id, n.conv_id - n.conv_id % 100 AS b, CRC % 6 AS h, coalesce(m.n, 0) AS bn
  FROM n LEFT JOIN n m ON m.conv_id = n.conv_id - n.conv_id % 100
), r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.b AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, c.bn) + t.pos - c.h, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), k AS (
  SELECT conv_id, pos + 1 AS d, length(text) AS chars,
         string_agg(md5(length(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), kk AS (
  SELECT *, lag(key) OVER w AS up, lead(d) OVER w IS NULL AS ends FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), node AS (
  SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM kk GROUP BY d, key
), kids AS (SELECT up AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), below AS (
  SELECT DISTINCT a.key AS top, x.key AS key FROM k a JOIN k x ON x.conv_id = a.conv_id AND x.d >= a.d
), sums AS (
  SELECT below.top AS key, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.chars) AS saved
  FROM below JOIN node ON node.key = below.key LEFT JOIN kids ON kids.key = below.key GROUP BY 1
)
SELECT node.conv_id, node.d::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN sums ON sums.key = node.key LEFT JOIN kids ON kids.key = node.key LEFT JOIN node p ON node.d > 0 AND p.key = node.up
"""
).replace("CRC", CRC32.format("n.conv_id::VARCHAR"))
