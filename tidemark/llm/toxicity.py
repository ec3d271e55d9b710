"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over hashed words and word beginnings scores each
sentence; noisy-or joins the scores, P = 1 - prod(1 - p_s), so only document labels are needed to train,
and the sentence scores then locate what offends. Nothing but the text is an input of a score.

The training sample is bounded: at most `sample` labelled documents, half of them toxic if there are as
many, chosen by a hash of doc_id; the weights of the loss restore the share of toxic documents among all
labels, times `miss_cost` for what a missed one costs against a clean one. Scoring covers every row. Defined cases: null or empty text, or one without words, scores as a
bag of one empty sentence; a document labelled twice is toxic if any label says so; labels of no document are
ignored; without labels every text gets the prior of an untrained model; repeated rows score alike; other
columns pass through, but for __score and __spans, which are replaced; a null doc_id teaches nothing and counts as not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import MARKS, Chunk, append_columns, chunks, mix
from ._spark import read

BITS = 18
BEGINNINGS = (4, 5, 6, 7, 8)
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n"]] = True
SALTS = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)) for i in range(6)]


def word_features(c: Chunk) -> np.ndarray:
    """Six buckets a word: the word, and its first 4 to 8 bytes, told apart by whether the word goes on."""
    cols = [c.hashes()] + [c.spans(c.start, np.minimum(c.start + n, c.end)) ^ (c.end > c.start + n).astype(np.uint64) for n in BEGINNINGS]
    return np.stack([(mix(h ^ s) >> np.uint64(64 - BITS)).astype(np.int32) for h, s in zip(cols, SALTS, strict=True)], 1)


def sentences(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its sentence in the chunk, and for each sentence its text. Only sentences with words count."""
    stops = np.cumsum(STOPS[c.raw], dtype=np.int64)
    text = c.text_of_word()
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (stops[c.start[1:]] != stops[c.start[:-1]])
    return np.cumsum(new) - 1, text[new]


def word_kinds(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each kind of word, kind of each word, its sentence, text of each sentence).

    Words are reduced to their kinds chunk by chunk, so memory is a few bytes a word.
    """
    keys, tables, words, sent, owner, base, kinds = [], [], [], [], [], 0, 0
    for i, c in chunks(texts, MARKS):
        s, t = sentences(c)
        feats = word_features(c)
        key, first, word = np.unique(feats[:, 0].astype(np.int64) << 36 | feats[:, 1].astype(np.int64) << 18 | feats[:, -1], return_index=True, return_inverse=True)
        keys.append(key)
        tables.append(feats[first])
        words.append((word + kinds).astype(np.int32))
        sent.append((s + base).astype(np.int32))
        owner.append((t + i).astype(np.int32))
        kinds, base = kinds + len(key), base + len(t)
    if not keys:
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int32), *(np.zeros(0, np.int32) for _ in range(3))
    _, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return np.concatenate(tables)[first], of.astype(np.int32)[np.concatenate(words)], np.concatenate(sent), np.concatenate(owner)


def fit(texts: list[str] | pa.Array | pa.ChunkedArray, y: np.ndarray, weight: np.ndarray, epochs: int = 80, rate: float = 0.15, decay: float = 0.07) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept of a sentence; Adam on the loss of documents under noisy-or.

    Weights stay at 0 or above: words only add evidence, so a long sentence cannot drown its worst word. The
    penalty `decay` on weights is a prior, so it counts less the more documents there are.
    """
    w, bias = np.zeros(1 << BITS, np.float32), -9.0
    if not len(texts) or not 0 < y.sum() < len(y):
        return w, bias
    table, word, sent, owner = word_kinds(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    base = len(owner)
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(sent, w[table].sum(1)[word], base) + bias
        p = np.exp(-np.logaddexp(0, -z))
        a = np.bincount(owner, np.logaddexp(0, z), len(y))
        keep = np.exp(-a)
        slope = weight * np.where(y > 0, -keep / np.maximum(1 - keep, 1e-4), 1.0)
        dz = (slope[owner] * p / len(y)).astype(np.float32)
        by_kind = np.bincount(word, dz[sent], len(table))
        g = np.bincount(table.ravel(), np.repeat(by_kind, table.shape[1]), 1 << BITS).astype(np.float32) + decay / len(y)
        gb = float(dz.sum())
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        fix, step = np.sqrt(1 - 0.99**t) / (1 - 0.9**t), rate * min(1.0, 2.0 * (1 - t / (epochs + 1)))
        w = np.maximum(w - step * fix * m1 / (np.sqrt(m2) + 1e-7), 0)
        bias -= step * fix * b1 / (b2**0.5 + 1e-7)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, miss_cost: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fit on a bounded sample. Only ids are ordered; the texts of the chosen ids, a broadcast of at most `sample`, come to the driver."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("y"))
    one = one.filter(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)
    all_of = {r["y"]: r["n"] for r in one.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    halves = [one.filter((F.col("y") > 0) == side).orderBy(F.xxhash64(F.lit(3), F.col(id_col)), id_col).limit(sample // 2) for side in (True, False)]
    picked = halves[0].unionByName(halves[1]).select(F.col(id_col).alias("__id"), "y")
    texts = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(picked), F.col("__d") == F.col("__id")).groupBy("__id").agg(F.max("y").alias("y"), F.min_by("t", "t").alias("t")).toArrow().sort_by("__id")
    y = (rows.column("y").to_numpy() > 0).astype(float)
    toxic = max(y.sum(), 1)
    weight = np.where(y > 0, miss_cost * all_of.get(True, 0) / toxic, all_of.get(False, 0) / max(len(y) - toxic, 1))
    return fit(rows.column("t"), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text", locate: float = 0.1) -> DataFrame:
    """The `keep` columns with __score and __spans: sentences of probability `locate` or more as
    (start, end, score) in code points. One pass over the texts; the model is a broadcast of 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        w, bias = shared.value
        scores = np.full(batch.num_rows, 1 / (1 + np.exp(-bias)))
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, c in chunks(batch.column(batch.schema.get_field_index(text_col)), MARKS):
            sent, text = sentences(c)
            if not len(text):
                continue
            z = np.bincount(sent, w[word_features(c)].sum(1), len(text)) + bias
            a = np.bincount(text, np.logaddexp(0, z), c.n)
            some = np.diff(c.first) > 0
            scores[i : i + c.n][some] = -np.expm1(-a[some])
            hot = np.flatnonzero(z >= np.log(locate / (1 - locate)))
            if len(hot):
                leads = np.concatenate([[0], np.cumsum((c.raw & 0xC0) != 0x80)])
                begin = np.searchsorted(sent, hot)
                last = np.searchsorted(sent, hot, "right") - 1
                for s, b, e in zip(hot, c.start[begin], c.end[last], strict=True):
                    zero = leads[c.at[text[s]]]
                    spans[i + text[s]].append({"start": int(leads[b] - zero), "end": int(leads[e] - zero), "score": float(1 / (1 + np.exp(-z[s])))})
        return [pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return append_columns(docs, make, [T.StructField("__score", T.DoubleType()), T.StructField("__spans", T.ArrayType(span))], keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, train(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"), F.col("__spans").alias("sentences"))
