"""Triple-barrier labels, the client variant, and the store of results."""

from __future__ import annotations

from dataclasses import asdict, dataclass
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Messages of failed rows.
NO_PRICE = "No price row found on or after event date"
SHORT = "Not enough price rows for vertical barrier"
BOTH = "Both barriers touched on the same row"


@dataclass(frozen=True)
class Params:
    basis: str = "intraday"
    upper_pct: float = 5.0
    lower_pct: float = 3.0
    vertical_days: int = 20

    def __post_init__(self) -> None:
        if self.basis not in ("intraday", "close"):
            raise ValueError("basis must be intraday or close")
        if not (self.upper_pct > 0 and self.lower_pct > 0 and self.vertical_days > 0):
            raise ValueError("percentages and days must be positive")

    def key(self) -> str:
        whole = {k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in asdict(self).items()}
        return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _paths(bars: DataFrame, days: int) -> DataFrame:
    """Each bar with the `days` bars after it, by one window a code: no self-join."""
    clean = bars.dropna(subset=["open", "high", "low", "close"])
    ahead = Window.partitionBy("code").orderBy("date").rowsBetween(1, days)
    row = F.struct("date", "open", "high", "low", "close")
    before = F.lag("date").over(Window.partitionBy("code").orderBy("date"))
    return clean.select("code", F.col("date").alias("event_bar"), F.col("close").alias("base"), before.alias("__after"), F.collect_list(row).over(ahead).alias("path"))


def _attach(events: DataFrame, paths: DataFrame, date: str) -> DataFrame:
    """Events with the first bar on or after their date. Labels depend on code and bar only, so they are
    worked out once a bar; an event then finds its bar by code and date among the days each bar covers."""
    from .asof import forward_asof

    keys = events.select("code", F.col(date).alias("__d")).distinct()
    hit = forward_asof(keys, paths.withColumnRenamed("event_bar", "date").select("code", "date"), on="__d", keep=("date",))
    hit = hit.select(F.col("code").alias("__c"), F.col("__d").alias("__day"), F.col("date").alias("event_bar"))
    return events.join(hit, (F.col("code") == F.col("__c")) & (F.col(date) == F.col("__day")), "left").drop("__c", "__day")


def label_bars(bars: DataFrame, p: Params) -> DataFrame:
    """(code, event_bar, status, barrier, label, touched_date, touched_price, base, return_pct, error) for every bar as an event row."""
    rows = _paths(bars, p.vertical_days)
    up, low = F.col("base") * (1 + p.upper_pct / 100), F.col("base") * (1 - p.lower_pct / 100)
    full = F.size("path") == p.vertical_days
    above = (lambda x: x["high"] >= up) if p.basis == "intraday" else (lambda x: x["close"] >= up)
    below = (lambda x: x["low"] <= low) if p.basis == "intraday" else (lambda x: x["close"] <= low)
    hit = F.get(F.filter("path", lambda x: above(x) | below(x)), F.lit(0))
    rows = rows.withColumn("hit", hit)
    on_up, on_low = above(F.col("hit")), below(F.col("hit"))
    both = on_up & on_low & F.lit(p.basis == "intraday")
    done = full & (F.col("hit").isNull() | ~both)
    last = F.element_at("path", p.vertical_days)
    barrier = F.when(F.col("hit").isNull(), F.lit("vertical")).when(on_up, F.lit("upper")).otherwise(F.lit("lower"))
    price = F.when(F.col("hit").isNull(), last["close"]).when(F.lit(p.basis == "close"), F.col("hit.close")).when(on_up, up).otherwise(low)
    out = rows.select(
        "code",
        "event_bar",
        "base",
        F.when(done, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(done, barrier).alias("barrier"),
        F.when(done, F.when(F.col("hit").isNull(), F.lit(0)).when(on_up, F.lit(1)).otherwise(F.lit(-1))).alias("label"),
        F.when(done, F.coalesce(F.col("hit.date"), last["date"])).alias("touched_date"),
        F.when(done, price).alias("touched_price"),
        F.when(done, F.lit(None).cast("string")).when(~full, F.lit(SHORT)).otherwise(F.lit(BOTH)).alias("error"),
    )
    return out.withColumn("return_pct", (F.col("touched_price") - F.col("base")) / F.col("base") * 100)


def triple_barrier(events: DataFrame, bars: DataFrame, p: Params = Params(), date: str = "event_date") -> DataFrame:
    """Events (code, `date`, ...) labelled; one without a bar fails. Horizons that run past the last bar fail first."""
    labels = label_bars(bars, p)
    found = _attach(events, labels, date)
    out = found.join(labels, ["code", "event_bar"], "left")
    missing = F.col("event_bar").isNull()
    return out.withColumn("status", F.when(missing, F.lit("failed")).otherwise(F.col("status"))).withColumn("error", F.when(missing, F.lit(NO_PRICE)).otherwise(F.col("error")))


def client_backtest(events: DataFrame, bars: DataFrame, upper: float = 5.0, lower: float = 5.0, days: int = 20, date: str = "event_date") -> DataFrame:
    """The lenient variant: upper tested first, horizon cut at the last bar, exit at the touching bar's close."""
    rows = _paths(bars, days)
    up, low = F.col("base") * (1 + upper / 100), F.col("base") * (1 - lower / 100)
    hit = F.get(F.filter("path", lambda x: (x["high"] >= up) | (x["low"] <= low)), F.lit(0))
    rows = rows.withColumn("hit", hit)
    exit_ = F.when(F.col("hit").isNotNull(), F.col("hit.close")).otherwise(F.element_at(F.concat(F.array("base"), F.transform("path", lambda x: x["close"])), -1))
    good = (F.col("base") > 0) & ~F.isnan("base")
    rows = rows.select(
        "code",
        "event_bar",
        F.when(~good, F.lit("no price")).when(F.col("hit").isNull(), F.lit("timeout")).when(F.col("hit.high") >= up, F.lit("upper")).otherwise(F.lit("lower")).alias("outcome"),
        F.when(good, (exit_ / F.col("base") - 1) * 100).alias("return_pct"),
    )
    out = _attach(events, rows, date).join(rows, ["code", "event_bar"], "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("no price")))


def store(new: DataFrame, old: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): insert-or-ignore on a key. counts has one row: created, reused."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns if c not in keys])
    once = new.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    fresh = once.join(old.select(*keys).distinct(), keys, "left_anti")
    total = new.agg(F.count("*").alias("n"))
    counts = fresh.agg(F.count("*").alias("created")).join(F.broadcast(total)).select("created", (F.col("n") - F.col("created")).alias("reused"))
    return fresh, counts
