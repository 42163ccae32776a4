"""Sliding time windows over trades: several lengths from one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, safe_divide

#: Lengths in seconds.
LENGTHS = (5, 15, 30, 60, 120, 180, 300, 900, 3600)


def sliding(trades: DataFrame, seconds: tuple[int, ...] = LENGTHS) -> DataFrame:
    """At each trade and for each length: volume by side, delta's share, VWAP and count, over the trades up to that time (those of the same microsecond included)."""
    # Time is cut into buckets, each with the trades before it that its windows reach, so that a symbol is many tasks' work;
    # a window's sum is the difference of two sums from the bucket's start, both of which run along with the rows.
    span = max(seconds) * 1_000_000
    width = 4 * span
    rows = trades.withColumn("__us", F.unix_micros("ts")).withColumn("__own", F.floor(F.col("__us") / width))
    late = F.col("__us") >= (F.col("__own") + 1) * width - span
    rows = rows.withColumn("__bucket", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    order = Window.partitionBy("symbol", "__bucket").orderBy("__us")
    now = order.rangeBetween(Window.unboundedPreceding, 0)
    q, sold = F.col("quantity"), F.col("is_buyer_maker")
    made = {}
    for s in seconds:
        past = order.rangeBetween(Window.unboundedPreceding, -s * 1_000_000 - 1)
        within = lambda x, past=past: F.coalesce(F.sum(x).over(now), F.lit(0)) - F.coalesce(F.sum(x).over(past), F.lit(0))
        buy, sell = exact_sum(F.when(~sold, q), within), exact_sum(F.when(sold, q), within)
        made |= {f"buy_{s}": buy, f"sell_{s}": sell, f"delta_ratio_{s}": safe_divide(buy - sell, buy + sell), f"vwap_{s}": safe_divide(exact_sum(F.col("price") * q, within), buy + sell), f"count_{s}": within(F.lit(1))}
    return rows.withColumns(made).where(F.col("__bucket") == F.col("__own")).drop("__us", "__own", "__bucket")


def once(trades: DataFrame) -> DataFrame:
    """Trades whose id is above all before them, in arrival order; with the running signed volume of those kept."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    top = F.max("trade_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = trades.withColumn("__top", top).where(F.col("__top").isNull() | (F.col("trade_id") > F.col("__top"))).drop("__top")
    signed = F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))
    return rows.withColumn("cvd", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
