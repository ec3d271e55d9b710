"""JSON files as typed rows, where every file that can't be read so is named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K

MOST_NAMED = 20


def read_objects(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """(file, value, error): one row a file, its object in the given schema, or why there is none.

    Errors: "not JSON", "not an object", or "wrong type: " and the fields whose value the schema can't hold (fields that are missing are null). A path
    that is not there fails before anything runs. Files are read whole, one a row, by Spark's readers, so any store will do.
    """
    fields = T.StructType.fromDDL(schema)
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    parsed = raw.select("file", "raw", F.try_parse_json("raw").alias("v"))
    kind = F.schema_of_variant("v")
    given = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    held = lambda f: F.from_json("raw", T.StructType([f]), {"mode": "PERMISSIVE"})[f.name]
    wrong = F.array_compact(F.array(*[F.when(given(f.name).isNotNull() & (F.schema_of_variant(given(f.name)) != "VOID") & held(f).isNull(), F.lit(f.name)) for f in fields]))
    error = F.when(F.col("v").isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(F.size(wrong) > 0, F.concat(F.lit("wrong type: "), F.array_join(wrong, ", ")))
    return parsed.withColumn("error", error).select("file", F.when(F.col("error").isNull(), F.from_json("raw", fields)).alias("value"), "error")


def load_objects(spark: SparkSession, paths: list[str], schema: str, source: str) -> DataFrame:
    """(file, and the fields): as read_objects, but any bad file is an error that names the source and the first MOST_NAMED files."""
    rows = read_objects(spark, paths, schema)
    bad = rows.filter("error IS NOT NULL").orderBy("file").limit(MOST_NAMED).collect()
    if bad:
        raise ValueError(f"{source}: " + "; ".join(f"{r['file']}: {r['error']}" for r in bad))
    return rows.select("file", "value.*")


CATEGORY = "disclosures array<struct<company_id string, company_key string, company_name string, market string, disclosed_at string, disclosed_date string, title string, acpt_no string>>"
ALL_MARKETS = "전체"


def category_disclosures(spark: SparkSession, paths: list[str], company: str, start: str, end: str, market: str = ALL_MARKETS) -> DataFrame:
    """Disclosures of a company out of the files of categories, between two days, by time and number.

    A row's code is company_id, else company_key; its day is disclosed_date, else the start of disclosed_at. Rows without a day go, and a day that does not
    exist is an error. Files without the list hold none.
    """
    rows = load_objects(spark, paths, CATEGORY, "category").select(F.explode("disclosures").alias("d")).select("d.*")
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    code = K.company_code(F.coalesce(full("company_id"), full("company_key")))
    day = F.coalesce(full("disclosed_date"), full(F.substring("disclosed_at", 1, 10)))
    rows = rows.withColumns({"__code": code, "disclosed_date": day}).filter(F.array_contains(K.code_candidates(F.lit(company)), F.col("__code")) & F.col("disclosed_date").isNotNull())
    date = F.try_to_date("disclosed_date", "yyyy-MM-dd")
    checked = F.when(date.isNull() & F.col("disclosed_date").isNotNull(), F.raise_error(F.concat(F.lit("no such day: "), F.col("disclosed_date"))).cast("date")).otherwise(date)
    rows = rows.filter(checked.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if market not in ("", ALL_MARKETS):
        rows = rows.filter(F.coalesce("market", F.lit("")) == market)
    return rows.drop("__code").orderBy(F.coalesce("disclosed_at", F.lit("")), F.coalesce("acpt_no", F.lit("")))
