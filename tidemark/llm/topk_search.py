"""Exact top-k search by inner product with two cover trees.

Components become floor(256 x), so scores are integers. Queries come to the driver in waves of bounded
size; a wave's cover tree is built once and broadcast. Each task builds cover trees over batches of
candidates and descends both trees together: a pair of nodes is pruned when the largest inner product
that its covering radii allow is below the worst kth score of every query under the query node. Scores
found carry over from batch to batch within a task, so pruning tightens; k rows a query and task then
meet in a ranking by query. No rows are sampled and no partners capped: the result is exact.

Defined cases: a vector that is null or holds null or non-finite components takes no part, as query or
candidate; an empty vector scores 0; vectors of different lengths are compared as if padded with zeros;
ties go to the smaller id; rows with the query's own id are not its candidates; a repeated query id is
one query (its smallest vector), repeated candidates are candidates each; a null id takes no part;
fewer than k candidates: all of them; a score that no long can hold is given as the largest or smallest long, after
ranking by its true value; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import durable, read, settled

LEAF = 48
BATCH = 4096
WAVE = 16_384


class CoverTree:
    """Nodes as arrays. Points of node i are order[lo[i]:hi[i]], all within radius[i] of center[i].

    A node's children cover it at half its radius, their centers picked greedily. A node whose points hardly
    cover each other (high intrinsic dimension) keeps what its first picks leave over as one leaf.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.center, self.radius, self.lo, self.hi, self.kids, self.whole = [], [], [], [], [], set()
        if len(x):
            self._add(0, len(x), None)
            at = 0
            while at < len(self.lo):
                self._split(at)
                at += 1
        self.center = np.array(self.center).reshape(len(self.lo), -1) if self.lo else np.zeros((0, x.shape[1]))
        self.norm = np.sqrt((self.center**2).sum(1))

    def _add(self, lo: int, hi: int, center: np.ndarray | None) -> int:
        pts = self.x[self.order[lo:hi]]
        if center is None:
            mean = pts.mean(0)
            center = pts[np.argmin(((pts - mean) ** 2).sum(1))]
        self.center.append(center)
        self.radius.append(float(np.sqrt(((pts - center) ** 2).sum(1).max())) * (1 + 1e-12))
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append([])
        return len(self.lo) - 1

    def _split(self, node: int) -> None:
        lo, hi, half = self.lo[node], self.hi[node], self.radius[node] / 2
        if hi - lo <= LEAF or half == 0 or node in self.whole:
            return
        left, groups, center = self.order[lo:hi].copy(), [], self.center[node]
        while len(left):
            near = ((self.x[left] - center) ** 2).sum(1) <= half * half
            if near.any():
                groups.append((left[near], center))
                left = left[~near]
            if len(left):
                center = self.x[left[0]]
            if len(groups) >= 24 and sum(len(g) for g, _ in groups) < 8 * len(groups):
                break
        big = [(g, c) for g, c in groups if len(g) > 4]
        rest = [g for g, _ in groups if len(g) <= 4] + ([left] if len(left) else [])
        if not big or (len(big) == 1 and not rest):
            return
        at = lo
        for g, c in big + ([(np.concatenate(rest), None)] if rest else []):
            self.order[at : at + len(g)] = g
            kid = self._add(at, at + len(g), c)
            self.kids[node].append(kid)
            if c is None:  # what covers nothing stays one leaf
                self.whole.add(kid)
            at += len(g)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.ident = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.k = k

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        scores = np.where(own[:, None] == ids[None, :], -np.inf, scores)
        some = np.flatnonzero((scores >= self.score[rows, -1:]).any(1) & (scores.max(1) > -np.inf))
        if not len(some):
            return
        rows, scores = rows[some], scores[some]
        every = np.concatenate([self.score[rows], scores], 1)
        cut = np.partition(every, every.shape[1] - self.k, 1)[:, -self.k]
        r, c = np.nonzero((every >= cut[:, None]) & (every > -np.inf))
        value = every[r, c]
        ident = np.where(c < self.k, self.ident[rows[r], np.minimum(c, self.k - 1)], ids[np.maximum(c - self.k, 0)])
        order = np.lexsort((ident, -value, r))
        r, value, ident = r[order], value[order], ident[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        ok = rank < self.k
        self.score[rows] = -np.inf
        self.ident[rows] = np.iinfo(np.int64).max
        self.score[rows[r[ok]], rank[ok]] = value[ok]
        self.ident[rows[r[ok]], rank[ok]] = ident[ok]


def dual_search(q: CoverTree, q_ids: np.ndarray, r: CoverTree, r_ids: np.ndarray, best: Best) -> int:
    """Offer best every score that may matter; returns how many pairs were scored."""
    if not q.lo or not r.lo:
        return 0
    scored, slack = 0, 1e-6
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        qs = q.order[q.lo[a] : q.hi[a]]
        most = float(q.center[a] @ r.center[b]) + q.radius[a] * r.norm[b] + r.radius[b] * q.norm[a] + q.radius[a] * r.radius[b]
        if most + slack * (1 + abs(most)) < best.score[qs, -1].min():
            continue
        ka, kb = q.kids[a], r.kids[b]
        if not ka and not kb:
            rs = r.order[r.lo[b] : r.hi[b]]
            best.offer(qs, q.x[qs] @ r.x[rs].T, r_ids[rs], q_ids[qs])
            scored += len(qs) * len(rs)
        elif kb and (not ka or r.radius[b] >= q.radius[a]):
            stack += sorted(((a, x) for x in kb), key=lambda p: float(q.center[p[0]] @ r.center[p[1]]) + r.radius[p[1]])
        else:
            stack += [(x, b) for x in ka]
    return scored


def _whole(v: Column) -> Column:
    """Whether a vector takes part: not null, all components present and finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: pa.Array | list, width: int = 0) -> np.ndarray:
    """floor(256 x) as doubles, exact below 2**53, padded with zeros to one width."""
    if isinstance(vectors, list):
        vectors = pa.array(vectors, pa.list_(pa.float64()))
    at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(at)
    width = max(width, int(size.max()) if len(size) else 0, 1)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(at[0], at[-1]) - at[:-1][row]] = np.floor(256 * flat[at[0] : at[-1]])
    return out


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _wave(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task for one wave of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, CoverTree(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, tree = shared.value
        best, exact = Best(len(q_ids), k), True
        big: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                r_ids, r = part.column(0).to_numpy(), _matrix(part.column(1), tree.x.shape[1])
                width = max(r.shape[1], tree.x.shape[1])
                if width > tree.x.shape[1]:
                    tree = CoverTree(_pad(tree.x, width))
                top = max(np.abs(r).max(initial=0), 1) * max(np.abs(tree.x).max(initial=0), 1) * width
                if top < 2**53:
                    dual_search(tree, q_ids, CoverTree(r), r_ids, best)
                else:  # beyond exact doubles: integers of any size
                    exact = False
                    whole = [[int(v) for v in row] for row in r]
                    for i, qv in enumerate(tree.x):
                        ints = [int(v) for v in qv]
                        found = big.setdefault(i, []) + [(-sum(a * b for a, b in zip(ints, v, strict=True)), int(j)) for v, j in zip(whole, r_ids, strict=True) if j != q_ids[i]]
                        big[i] = sorted(found)[:k]
        i, j = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best.ident[i, j]), pa.array(best.score[i, j].astype(np.int64))], names=["query_id", "vec_id", "score"])
        if not exact:
            flat = [(int(q_ids[i]), v, max(-(2**63), min(2**63 - 1, -s))) for i, found in big.items() for s, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query row against every row."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.filter(F.col(id_col).isNotNull() & _whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    asked = queries.filter(F.col(id_col).isNotNull() & _whole(F.col(vector_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector).alias("v"))
    n = asked.count()
    waves = max(1, -(-n * 5 // (4 * wave)))
    parts = None
    for i in range(waves):
        mine = asked if waves == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == i)
        got = sorted(mine.collect())
        part = _wave(rows, np.array([r[0] for r in got], np.int64), _matrix([r[1] for r in got]), k)
        part = part if waves == 1 else durable(part, "wave")
        parts = part if parts is None else parts.unionByName(part)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@settled
def op7_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
