"""Candles: resampling, n-row bars, display columns, frequency, marker prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP, DOWN = "#16a34a", "#dc2626"
#: Bars up to which a display stays daily, then weekly.
DAY_BARS, WEEK_BARS = 180, 520


def period_label(date: Column, frequency: str) -> Column:
    """The Friday that ends the week, or the last day of the month: calendar days, not trading days."""
    if frequency == "week":
        return F.next_day(F.date_sub(date, 1), "FR")
    if frequency == "month":
        return F.last_day(date)
    if frequency == "day":
        return date
    raise ValueError(f"unknown frequency {frequency}")


def _candle(bars: DataFrame, keys: list, label: Column) -> DataFrame:
    """Aggregates with partial sums on the map side; all order-dependent ones go by date."""
    mean = F.avg("vwap").alias("vwap") if "vwap" in bars.columns else F.lit(None).cast("double").alias("vwap")
    out = bars.groupBy(*keys).agg(
        label.alias("date"),
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
        mean,
    )
    return out.dropna(subset=["open", "high", "low", "close"])


def resample(bars: DataFrame, frequency: str) -> DataFrame:
    """Weekly or monthly candles a code; empty periods have no row, vwap is the unweighted mean."""
    label = period_label(F.col("date"), frequency)
    return _candle(bars, ["code", label.alias("period")], F.first(label)).drop("period")


def n_row_bars(bars: DataFrame, n: int) -> DataFrame:
    """Candles of n rows each, counted from the first row of each code as given (filter dates before)."""
    place = F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1
    return _candle(bars.withColumn("bar", F.floor(place / n).cast("long")), ["code", "bar"], F.max("date"))


def display(bars: DataFrame) -> DataFrame:
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return bars.withColumns(
        {
            "trade_day": F.date_format("date", "yyyy-MM-dd"),
            "trade_label": F.date_format("date", "yy.MM.dd"),
            "candle_color": F.when(F.col("close") >= F.col("open"), F.lit(UP)).otherwise(F.lit(DOWN)),
            "body_bottom": low,
            "body_top": high,
        }
    )


def auto_frequency(bars: DataFrame) -> DataFrame:
    """(code, bars, frequency) by the number of bars of each code."""
    n = F.count("*")
    return bars.groupBy("code").agg(n.alias("bars"), F.when(n <= DAY_BARS, F.lit("day")).when(n <= WEEK_BARS, F.lit("week")).otherwise(F.lit("month")).alias("frequency"))


PLACEMENTS = ("x_axis_below", "x_axis_above", "candle_center", "candle_above", "candle_below")


def marker_price(placement: str, floor: Column, offset: Column) -> Column:
    if placement not in PLACEMENTS:
        raise ValueError(f"unknown placement {placement}")
    return {
        "x_axis_below": floor - offset * 1.15,
        "x_axis_above": floor + offset * 0.9,
        "candle_center": (F.col("open") + F.col("close")) / 2,
        "candle_above": F.col("high") + offset,
        "candle_below": F.col("low") - offset,
    }[placement]


def with_markers(points: DataFrame, bars: DataFrame, placement: str) -> DataFrame:
    """points (with candle columns and code) and marker_price; floor and offset come from all bars of the code.

    One row a code is joined; codes number far fewer than points, and the optimizer picks the join by size.
    """
    scale = bars.groupBy("code").agg(F.min("low").alias("__floor"), F.greatest((F.max("high") - F.min("low")) * 0.035, F.lit(1.0)).alias("__offset"))
    return points.join(scale, "code").withColumn("marker_price", marker_price(placement, F.col("__floor"), F.col("__offset"))).drop("__floor", "__offset")
