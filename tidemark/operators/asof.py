"""Events to trading days: anchors and the forward as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE_MINUTE = 15 * 60 + 30


def anchor_date(ts: Column) -> Column:
    """The day, or from 15:30 on the next calendar day."""
    late = F.hour(ts) * 60 + F.minute(ts) >= CLOSE_MINUTE
    return F.when(late, F.date_add(F.to_date(ts), 1)).otherwise(F.to_date(ts))


def forward_asof(events: DataFrame, bars: DataFrame, on: str = "anchor", key: str = "code", keep: tuple[str, ...] = ("date", "open", "high", "low", "close")) -> DataFrame:
    """Each event with the first bar of its key on or after `on`; events without one are dropped.

    Union and one window: a single shuffle by key, no range join. Dates run backwards, so the frame only grows and
    each row costs one step; of one date bars come before events, so equal dates match.
    """
    bar = F.struct(*[F.col(c) for c in keep])
    payload = [c for c in events.columns if c != key]
    left = events.select(F.col(key), F.col(on).alias("__at"), F.lit(0).alias("__side"), F.struct(*payload).alias("__event"), F.lit(None).cast(bars.select(bar.alias("b")).schema["b"].dataType).alias("__bar"))
    right = bars.select(F.col(key), F.col("date").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), bar.alias("__bar"))
    back = Window.partitionBy(key).orderBy(F.desc("__at"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("__hit", F.last("__bar", ignorenulls=True).over(back))
    return found.filter("__side = 0 AND __hit IS NOT NULL").select(key, *[F.col(f"__event.{c}").alias(c) for c in payload], *[F.col(f"__hit.{c}").alias(c if c not in payload else f"bar_{c}") for c in keep])


def forward_asof_small(events: DataFrame, bars: DataFrame, on: str = "anchor", key: str = "code", keep: tuple[str, ...] = ("date", "open", "high", "low", "close")) -> DataFrame:
    """The same for hot keys: each day that has events finds its bar once, then events meet it by equality.

    Days are distinct under partial aggregation, at most one row a day and key however far the next bar is, and
    the equi-join is one that adaptive execution can split however many events a key has.
    """
    days = events.filter(F.col(key).isNotNull() & F.col(on).isNotNull()).select(F.col(key), F.col(on).alias("__day")).distinct()
    found = forward_asof(days, bars, "__day", key, keep)
    hit = found.select(F.col(key).alias("__k"), F.col("__day"), *[F.col(c).alias(c if c not in events.columns else f"bar_{c}") for c in keep])
    return events.join(hit, (F.col(key) == F.col("__k")) & (F.col(on) == F.col("__day"))).drop("__k", "__day")
