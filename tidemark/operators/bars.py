"""Bars from ticks and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import INTERVAL_MS, place, safe_divide
from .ordered import numbered


def bucket(ts: Column, tf: str) -> Column:
    """Start of the interval, aligned with the epoch."""
    ms = INTERVAL_MS[tf]
    return F.timestamp_millis(F.floor(F.unix_millis(ts) / ms) * ms)


def ohlcv(ticks: DataFrame, tf: str, quantity: str = "price") -> DataFrame:
    """One bar for each symbol and interval that has ticks (gaps stay). The shuffle carries one partial row for each bar and task."""
    order = place(F.col("ts"), F.col("seq"))
    out = ticks.groupBy("symbol", bucket(F.col("ts"), tf).alias("start")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(quantity).alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("start").alias("ts"), F.lit(0).cast("long").alias("seq"), "open", "high", "low", "close", "volume", "trades")


def valid(bars: DataFrame) -> DataFrame:
    """Bars whose volume isn't negative and whose high isn't below the low."""
    return bars.where("volume >= 0 and high >= low")


def without_noise(trades: DataFrame, tf: str, min_notional: float = 50.0, cut: float = 0.20) -> DataFrame:
    """Trades of enough notional, less those below the quantity at place int(cut * n) of their bar, counted from 0."""
    large = trades.where(F.col("price") * F.col("quantity") >= min_notional).withColumn("start", bucket(F.col("ts"), tf))
    bar = Window.partitionBy("symbol", "start")
    place = F.row_number().over(bar.orderBy("quantity"))
    n = F.count(F.lit(1)).over(bar)
    at = F.floor(n * cut).cast("long") + 1
    ranked = large.withColumn("__place", place).withColumn("__at", at)
    least = F.max(F.when(F.col("__place") == F.col("__at"), F.col("quantity"))).over(bar)
    return ranked.withColumn("__least", least).where("quantity >= __least").drop("__place", "__at", "__least")


def delta_bars(trades: DataFrame, tf: str, filtered: bool = True) -> DataFrame:
    """Bars of signed volume, with empty bars (all zero) between a symbol's first and last, and the running delta."""
    kept = without_noise(trades, tf) if filtered else trades.withColumn("start", bucket(F.col("ts"), tf))
    order = place(F.col("ts"), F.col("trade_id"))
    sold = F.col("is_buyer_maker")
    made = kept.groupBy("symbol", "start").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum(F.when(~sold, F.col("quantity")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(sold, F.col("quantity")).otherwise(0.0)).alias("sell_volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    ms = INTERVAL_MS[tf]
    span = trades.groupBy("symbol").agg(F.min(bucket(F.col("ts"), tf)).alias("a"), F.max(bucket(F.col("ts"), tf)).alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {ms} milliseconds"))).alias("start"))
    zero = {c: 0.0 for c in ("open", "high", "low", "close", "buy_volume", "sell_volume")} | {"trades": 0}
    bars = grid.join(made, ["symbol", "start"], "left").fillna(zero)
    total = F.col("buy_volume") + F.col("sell_volume")
    bars = bars.withColumn("volume", total).withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
    bars = bars.withColumn("delta_ratio", safe_divide(F.col("delta"), F.col("volume"))).withColumn("avg_size", safe_divide(F.col("volume"), F.col("trades")))
    running = Window.partitionBy("symbol").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn("cvd", F.sum("delta").over(running)).select("symbol", F.lit(tf).alias("tf"), F.col("start").alias("ts"), F.lit(0).cast("long").alias("seq"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "delta", "delta_ratio", "avg_size", "trades", "cvd")


def count_bars(trades: DataFrame, bar_count: int = 20) -> DataFrame:
    """Bars of max(1, n // bar_count) trades each; the last takes what is left."""
    rows = numbered(trades, ("symbol",), ("ts", "trade_id"), "__place", "__total")
    size = F.greatest(F.lit(1), F.floor(F.col("__total") / bar_count))
    rows = rows.withColumn("bar", F.floor(F.col("__place") / size).cast("long"))
    return rows.groupBy("symbol", "bar").agg(F.min_by("price", "__place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "__place").alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades"))


def carried_bars(trades: DataFrame, bars: int = 20) -> DataFrame:
    """Equal-time bars up to each symbol's newest trade (which the last one leaves out); empty bars carry the close with volume 0, leading ones are left out."""
    span = trades.groupBy("symbol").agg(F.min(F.unix_millis("ts")).alias("a"), F.max(F.unix_millis("ts")).alias("b")).withColumn("step", (F.col("b") - F.col("a")) / bars).where("step > 0")
    placed = trades.join(F.broadcast(span), "symbol").withColumn("bar", F.floor((F.unix_millis("ts") - F.col("a")) / F.col("step"))).where(F.col("bar") < bars)
    order = place(F.col("ts"), F.col("trade_id"))
    made = placed.groupBy("symbol", "bar").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))
    grid = span.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bars - 1).cast("long"))).alias("bar"))
    before = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(made, ["symbol", "bar"], "left").withColumn("carry", F.last("close", ignorenulls=True).over(before)).where("carry is not null")
    return rows.select("symbol", "bar", *[F.coalesce(c, "carry").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))
