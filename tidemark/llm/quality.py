"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns (all documents; at most 3 ** 8 patterns reach the driver) estimates how
often each labeller is right, without any label. The posterior of each pattern labels a bounded sample
(at most `sample` documents, those of the smallest hashes of doc_id and text), on which a linear scorer over hashed token features is trained;
it scores every document. Defined cases: null or empty text gets no vote but those that an empty text
earns and scores by the intercept; an empty table gives an empty table; repeated rows count and score
alike; a null doc_id is sampled by its text; other columns pass through, but for __score, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import SPACES, Chunk, append_columns, chunks, mix
from ._spark import read

BITS = 16
LABELLERS = ("length", "word_length", "symbols", "capitals", "repeats", "variety", "line_copies", "line_ends")
_SYMBOL, _UPPER, _LETTER, _LEAD, _STOP = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "|#*<>{}[]=_&$%!^~\\"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LEAD[:128] = _LEAD[192:] = True
_STOP[[ord(c) for c in ".!?:;\"')"]] = True


def _per_text(c: Chunk, values: np.ndarray) -> np.ndarray:
    """Sums of a value a byte, over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[c.at[1:]] - total[c.at[:-1]]


def votes(c: Chunk) -> np.ndarray:
    """Votes 1 (good), -1 (bad) or 0 (too little text to tell) of each labeller on each text of the chunk."""
    words, text, h = np.diff(c.first), c.text_of_word(), c.hashes()
    some = np.maximum(words, 1)
    chars, letters = _per_text(c, _LEAD[c.raw]), np.maximum(_per_text(c, _LETTER[c.raw] & _LEAD[c.raw]), 1)
    per_word = (chars - words + 1) / some
    symbols, capitals = _per_text(c, _SYMBOL[c.raw]) / np.maximum(chars, 1), _per_text(c, _UPPER[c.raw]) / letters
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text, again, c.n) / some
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    variety = np.bincount(text[order], new, c.n) / some
    ends, begins, line_text = lines(c)
    filled = ends > begins
    ends, begins, line_text = ends[filled], begins[filled], line_text[filled]
    n_lines = np.bincount(line_text, minlength=c.n)
    lh = c.spans(begins, ends)
    order = np.lexsort((lh, line_text))
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[order][1:] != lh[order][:-1]) | (line_text[order][1:] != line_text[order][:-1])
    copies = 1 - np.bincount(line_text[order], fresh, c.n) / np.maximum(n_lines, 1)
    closed = np.bincount(line_text, _STOP[c.raw[ends - 1]], c.n) / np.maximum(n_lines, 1) if len(ends) else np.zeros(c.n)
    judge = lambda known, good: np.where(known, np.where(good, 1, -1), 0)
    enough = words >= 20
    return np.stack(
        [
            judge((words < 4) | (words >= 50), words >= 50),
            judge(enough, (per_word > 4.2) & (per_word < 6.6)),
            judge(chars >= 40, symbols < 0.01),
            judge(enough, capitals < 0.15),
            judge(enough, repeats < 0.05),
            judge(enough & (words < 2000), variety > 0.45),
            judge(n_lines >= 4, copies < 0.2),
            judge(n_lines >= 2, closed > 0.6),
        ],
        1,
    ).astype(np.int8)


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, starts and texts of the lines of all texts of a chunk, but for empty last lines."""
    breaks = np.flatnonzero(c.raw == 10)
    begins = np.unique(np.concatenate([c.at[:-1], breaks + 1]))
    begins = begins[begins < len(c.raw)]
    text = np.searchsorted(c.at, begins, "right") - 1
    ends = np.append(breaks, len(c.raw))[np.searchsorted(breaks, begins)]
    return np.minimum(ends, c.at[text + 1]), begins, text


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, strength: float = 0.2) -> tuple[np.ndarray, dict]:
    """Posterior of good for each pattern; the estimated share of good and the vote table of each labeller.

    Kinds of bad text exclude each other, so agreement among labellers alone would single out one kind.
    The prior (pseudo-counts, `strength` of all documents) says that a labeller seldom calls a good text
    bad and calls a bad one bad at times.
    """
    n = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(n) % 3
    good = np.where((v == 0).any(1), 0.1, 0.9)
    prior = strength * max(counts.sum(), 1) * np.array([[0.4, 0, 0.6], [0.01, 0, 0.99]])
    for _ in range(rounds):
        share = np.clip((counts * good).sum() / max(counts.sum(), 1), 0.02, 0.98)
        table = np.stack([[[(counts * side * (v[:, j] == k)).sum() + prior[s, k] + 1e-6 for k in range(3)] for j in range(n)] for s, side in enumerate((1 - good, good))])
        table /= table.sum(2, keepdims=True)
        logs = np.log(table)
        logs[:, :, 1] = 0  # not voting tells nothing
        score = np.log(share / (1 - share)) + sum(logs[1, j, v[:, j]] - logs[0, j, v[:, j]] for j in range(n))
        good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return good, {"share": float(share), "votes": dict(zip(LABELLERS, table.transpose(1, 0, 2).tolist(), strict=True))}


def token_features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text): hashed features of each token: last two bytes, shape and length, repetition, the word."""
    h, text = c.hashes(), c.text_of_word()
    if not len(h):
        return np.zeros((0, 4), np.int32), text
    first, last, size = c.raw[c.start], c.raw[c.end - 1], c.end - c.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[c.raw])])
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[c.raw])])
    caps, marks = upper[c.end] - upper[c.start], odd[c.end] - odd[c.start]
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    shape = (np.minimum(caps, 3) * 4 + np.minimum(marks, 3)) * 64 + _UPPER[first] * 32 + _LETTER[last] * 16 + np.minimum(size // 3, 15)
    tail = c.spans(np.maximum(c.end - 2, c.start), c.end)
    salted = [tail, shape.astype(np.uint64) * np.uint64(2654435761), again.astype(np.uint64) + np.uint64(17), h]
    return np.stack([(mix(x ^ np.uint64(977 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int32) for i, x in enumerate(salted)], 1), text


def fit(texts: list[str], good: np.ndarray, epochs: int = 150, rate: float = 0.2, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Linear scorer on mean token features, by Adam on soft labels."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not len(texts):
        return w, bias
    feats, owner = [], []
    for i, c in chunks(pa.array(texts, pa.large_string()), SPACES):
        f, t = token_features(c)
        feats.append(f)
        owner.append(t + i)
    feats, owner = np.concatenate(feats), np.concatenate(owner)
    words = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    key, value = np.unique(np.repeat(owner, 4).astype(np.int64) << BITS | feats.ravel(), return_counts=True)
    row, col = key >> BITS, key & (1 << BITS) - 1
    value = value / words[row]
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(row, value * w[col], len(texts)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / len(texts)
        g, gb = np.bincount(col, value * d[row], 1 << BITS) + decay * w, d.sum()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        fix = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= fix * m1 / (np.sqrt(m2) + 1e-8)
        bias -= fix * b1 / (np.sqrt(b2) + 1e-8)
    return w, float(bias)


def score(c: Chunk, model: tuple[np.ndarray, float]) -> np.ndarray:
    f, t = token_features(c)
    z = np.bincount(t, model[0][f].sum(1), c.n) / np.maximum(np.diff(c.first), 1) + model[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple[np.ndarray, float], dict]:
    """(model, what EM found). Two passes: vote patterns of all documents, then the sample's texts."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [pattern(votes(c)) for _, c in chunks(batch.column(batch.schema.get_field_index(text_col)), SPACES)]
        return [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))]

    field = [T.StructField("__votes", T.LongType())]
    seen = append_columns(docs.select(text_col), make, field, []).groupBy("__votes").count().collect()
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    if not len(seen):
        return (np.zeros(1 << BITS), 0.0), {}
    posterior, found = em(patterns, counts)
    by = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    share = min(1.0, sample / counts.sum())
    key = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))  # of the text too, as ids may be null or shared
    near = docs.select(id_col, text_col).filter(F.pmod(key, F.lit(1 << 30)) < int(min(1.0, 2 * share) * (1 << 30)) + 1)
    picked = near.orderBy(F.pmod(key, F.lit(1 << 30)), key, id_col, text_col).limit(sample)
    rows = append_columns(picked, make, field, [id_col, text_col]).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return fit([r[1] or "" for r in rows], np.array([by[r[2]] for r in rows])), found


def quality(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns with __score, the probability that the text is good. One pass; the model is a broadcast of 0.5 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [score(c, shared.value) for _, c in chunks(batch.column(batch.schema.get_field_index(text_col)), SPACES)]
        return [pa.array(np.concatenate(found) if found else np.zeros(0))]

    return append_columns(docs, make, [T.StructField("__score", T.DoubleType())], keep)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = train(docs)
    out = quality(docs, model, ["doc_id"])
    return out.select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= 0.5).alias("keep"))
