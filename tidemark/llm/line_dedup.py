"""Line dedup over a whole corpus.

Lines are normalised, hashed and counted in distinct documents; lines of frequent keys are dropped
everywhere but in the largest document id that holds them, and what stays is put together again in its
order. Defined cases: null or empty text is one empty line; a key shorter than `min_chars` code points
never counts; a repeated line in one document counts once but loses every occurrence; documents that
lose all lines keep an empty text; rows that repeat a doc_id are one document for counts and are each
rewritten; a null doc_id counts as no document and keeps its lines; other columns pass through, but
for __n_lines and __n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import LOWER, UPPER, durable, join_by_weight, read, settled


def _keys(lines: Column, min_chars: int) -> Column:
    """128-bit digests of the keys of lines, null where a key is too short."""

    def one(line: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
        return F.when(F.length(line) >= min_chars, F.when(F.length(key) >= min_chars, F.unhex(F.md5(key.cast("binary")))))

    return F.transform(lines, one)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` rewritten, plus __n_lines and __n_dropped.

    Texts are split and hashed once; digests and ids (a tenth of the input or less) are kept in the
    shared folder for counting and matching. Shuffles: partial counts of 16-byte digests; digest and id of each line that might go; the documents
    once by id, for putting lines back. Digests held by a large share of documents are matched by a
    broadcast of at most 5000 rows, so no task gets all documents of one line.
    """
    names = [c for c in docs.columns if c.lower() not in ("__n_lines", "__n_dropped")]
    own = [c for c in names if c not in (id_col, text_col)]
    # all other columns travel as one value, so that no name can clash with those made here
    docs = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__text"), *([F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own")] if own else []))
    lines = F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1)
    held = docs.filter("__d IS NOT NULL").select("__d", F.explode(F.array_distinct(F.filter(_keys(lines, min_chars), lambda k: k.isNotNull()))).alias("__h"))
    held = durable(held, "lines")
    repeated = docs.groupBy("__d").count().filter("count > 1").limit(1).count() > 0
    pairs = held.distinct() if repeated else held
    counts = pairs.groupBy("__h").agg(F.count("*").alias("n"), F.max("__d").alias("keeper")).filter(F.col("n") >= min_docs)
    counts = durable(counts, "line-counts")
    going = join_by_weight(held, counts, "__h", "n", "inner").filter(F.col("__d") != F.col("keeper"))
    per_doc = going.groupBy(F.col("__d").alias("__id")).agg(F.collect_set("__h").alias("__drop"))
    # a null id has nothing to join, so it stays out of the shuffle by id
    found = docs.filter("__d IS NOT NULL").join(per_doc, F.col("__d") == F.col("__id"), "left")
    found = found.unionByName(docs.filter("__d IS NULL"), allowMissingColumns=True)
    tagged = F.arrays_zip(lines.alias("line"), _keys(lines, min_chars).alias("key"))
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.transform(F.filter(tagged, lambda x: x["key"].isNull() | ~F.array_contains(F.col("__drop"), x["key"])), lambda x: x["line"]))
    out = found.withColumn("__n_lines", F.size(lines).cast("long")).withColumn("__kept", kept)
    made = {id_col: F.col("__d"), text_col: F.array_join("__kept", "\n")}
    return out.select(*[made.get(c, F.col(f"__own.`{c}`")).alias(c) for c in names], "__n_lines", (F.col("__n_lines") - F.size("__kept")).alias("__n_dropped"))


@settled
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
