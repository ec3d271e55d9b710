"""Readers, and the stand-ins that turn plain tables into disclosures, bars and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge

#: The disclosure table. `disclosed_at` stays text as well, since filters compare it as text.
DISCLOSURES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in "row_no company_key company_name company_id company_cell_text market".split()]
    + [T.StructField("badges", T.ArrayType(T.StringType())), T.StructField("disclosed_at", T.StringType()), T.StructField("disclosed_date", T.DateType())]
    + [T.StructField(n, T.StringType()) for n in "title title_attr title_base title_display".split()]
    + [T.StructField("title_flags", T.ArrayType(T.StringType())), T.StructField("is_correction_report", T.BooleanType()), T.StructField("has_later_correction", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in "acpt_no doc_no submitter source_file".split()]
    + [T.StructField("source_page", T.IntegerType()), T.StructField("year", T.IntegerType())]
)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; a missing column is an error before anything runs."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    missing = set(columns or ()) - set(df.columns)
    if missing:
        raise ValueError(f"{name} lacks {sorted(missing)}")
    return df.select(*columns) if columns else df


def disclosures(spark: SparkSession, path: str, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Year-partitioned disclosures; the year range prunes partitions."""
    df = spark.read.schema(DISCLOSURES).parquet(path)
    if start_year is not None:
        df = df.filter(F.col("year") >= start_year)
    return df.filter(F.col("year") <= end_year) if end_year is not None else df


def write_disclosures(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory a year, rows of a year clustered by company so that file statistics prune lookups."""
    df.repartition("year", F.pmod(F.xxhash64("company_id"), F.lit(16))).sortWithinPartitions("company_id", "id").write.mode(mode).partitionBy("year").parquet(path)


def sink_disclosures(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Writes the first row of each acpt_no by year and returns the manifest (year, rows, companies, unlinked, first_at,
    last_at), counted from what was written and kept in <path>_manifest."""
    once = merge.first_row(df.filter("acpt_no IS NOT NULL"), "acpt_no", order).drop("n_rows").unionByName(df.filter("acpt_no IS NULL"))
    write_disclosures(once, path)
    linked = F.nullif(F.trim("company_key"), F.lit(""))
    spark = df.sparkSession
    found = spark.read.schema(df.schema).parquet(path).groupBy("year").agg(F.count("*").alias("rows"), F.count_distinct(linked).alias("companies"), F.count_if(linked.isNull()).alias("unlinked"), F.min("disclosed_at").alias("first_at"), F.max("disclosed_at").alias("last_at"))
    found.write.mode("overwrite").parquet(f"{path}_manifest")
    return spark.read.parquet(f"{path}_manifest")


def replace_tables(spark: SparkSession, staged: dict[str, str]) -> None:
    """Moves written tables (target to staged path) to their places together. Where one move fails, those made are undone,
    the tables that were there return, and the error is raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    undo: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        source = hadoop.Path(a)
        if not source.getFileSystem(conf).rename(source, hadoop.Path(b)):
            raise OSError(f"can't move {a} to {b}")
        undo.append((b, a))

    kept = []
    try:
        for target, fresh in staged.items():
            place = hadoop.Path(target)
            if place.getFileSystem(conf).exists(place):
                move(target, f"{target}_before")
                kept.append(f"{target}_before")
            move(fresh, target)
    except Exception:
        for b, a in reversed(list(undo)):
            hadoop.Path(b).getFileSystem(conf).rename(hadoop.Path(b), hadoop.Path(a))
        raise
    for old in kept:
        hadoop.Path(old).getFileSystem(conf).delete(hadoop.Path(old), True)


def item_name(names: list[str], item: str) -> str | None:
    """The name that holds an item of prices: the adjusted one (adjOpen) where it is there, else the plain one."""
    by = {n.casefold(): n for n in names}
    return by.get(f"adj{item}".casefold()) or by.get(item.casefold())


def wide_codes(wide: DataFrame, date_col: str = "date") -> list[str]:
    """Codes of a wide table, from its schema alone."""
    return sorted(c for c in wide.columns if c != date_col)


def preview(df: DataFrame, rows: int = 20, columns: int = 12) -> DataFrame:
    """The first columns of the first rows."""
    return df.select(*df.columns[:columns]).limit(rows)


def clean_prices(raw: DataFrame, names: dict[str, str], items: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Columns renamed, texts read as numbers, rows without a date or any number dropped, volume whole."""
    named = raw.withColumnsRenamed(names)
    read = named.select(F.col("date").cast("string").try_cast("date").alias("date"), *[F.col(i).cast("string").try_cast("double").alias(i) for i in items])
    return read.dropna().withColumn("volume", F.col("volume").cast("long"))


def wide_to_long(wide: DataFrame, date_col: str = "date") -> DataFrame:
    """(date, code, value) of a wide table with a column a code; nulls go."""
    codes = [c for c in wide.columns if c != date_col]
    return wide.unpivot(date_col, codes, "code", "value").filter("value IS NOT NULL")


def long_to_bars(long: DataFrame, items: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """One row a code and date with a column an item: the outer zip of item series, in one shuffle."""
    return long.groupBy("code", "date").pivot("item", list(items)).agg(F.first("value", ignorenulls=True))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of events: code is the event type, prices are values in time order, volume their count."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
        F.sum("value").alias("amount"),
    )


def order_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of disclosures."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("acpt_no"),
        F.col("c_custkey").cast("string").alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("market"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("submitter"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("disclosed_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("disclosed_date"),
        F.year("o_orderdate").alias("year"),
    )


def part_columns() -> dict[str, Column]:
    """Parts in the words of the filter language."""
    return {"title": F.col("p_name"), "company_name": F.col("p_brand"), "market": F.col("p_type"), "acpt_no": F.col("p_partkey"), "company_id": F.col("p_size")}
