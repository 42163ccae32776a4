"""Funding zones, component scores and the unified score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, ladder, safe_divide, series


def funding_signal(rate: Column) -> tuple[Column, Column]:
    """Contrarian signal of a funding rate, and its strength."""
    p = rate * 100
    far = F.least(F.lit(80.0), 50 + F.abs(p) * 100)
    signal = ladder((p > 0.1, "bearish"), (p > 0.03, "neutral"), (p < -0.1, "bullish"), otherwise="neutral")
    return signal, ladder((F.abs(p) > 0.1, far), (F.abs(p) > 0.03, 55.0), otherwise=50.0)


def with_funding_zone(rows: DataFrame, rate: str = "funding_rate", least: int = 10, history: int = 100) -> DataFrame:
    """Share of the last ``history`` prints before each rate that are below it (an estimate from the rate itself while they are fewer than ``least``), zone, crowd, chase and extreme flags."""
    w = series(("symbol",)).rowsBetween(-history, -1)
    rows = rows.withColumns({"__past": F.collect_list(rate).over(w), "__p": F.col(rate) * 100})
    n, p = F.size("__past"), F.col("__p")
    below = F.size(F.filter("__past", lambda x: x < F.col(rate)))
    estimate = ladder(
        (p > 0.1, 95 + F.least(F.lit(4.0), (p - 0.1) * 20)),
        (p > 0.05, 75 + (p - 0.05) / 0.05 * 20),
        (p > 0.01, 50 + (p - 0.01) / 0.04 * 25),
        (p > -0.01, 50.0),
        (p > -0.05, 25 + (p + 0.05) / 0.06 * 25),
        (p > -0.1, 5 + (p + 0.1) / 0.05 * 20),
        otherwise=F.greatest(F.lit(1.0), 5 - (-0.1 - p) * 20),
    )
    rows = rows.withColumn("funding_percentile", F.when(n >= least, below / n * 100).otherwise(estimate))
    q = F.col("funding_percentile")
    zone = ladder(
        (q >= 95, "extreme_positive"), (q >= 75, "high_positive"), ((q >= 50) & (p > 0.01), "normal_positive"), (q <= 5, "extreme_negative"), (q <= 25, "high_negative"), ((q < 50) & (p < -0.01), "normal_negative"), otherwise="neutral"
    )
    rows = rows.withColumn("funding_zone", zone)
    z = F.col("funding_zone")
    crowd = ladder((z == "extreme_positive", "heavily_long"), (z == "high_positive", "moderately_long"), (z == "extreme_negative", "heavily_short"), (z == "high_negative", "moderately_short"), otherwise="balanced")
    return rows.withColumns({"crowd": crowd, "funding_extreme": z.startswith("extreme"), "funding_chase": z.startswith("normal") | (z == "neutral")}).drop("__past", "__p")


def volume_score(delta_ratio: Column, rv: Column) -> Column:
    return clip(delta_ratio / 0.25, -1.0, 1.0) * clip((rv - 1) / 1.5, 0.0, 1.0)


def oi_score(price_pct: Column, oi_pct: Column) -> Column:
    return F.signum(price_pct) * clip(oi_pct / 2.0, -1.0, 1.0)


def funding_score(zone: Column, oi_pct: Column) -> Column:
    """Crowds that still grow point the other way; more so if extreme."""
    grows = oi_pct > 0.3
    long, short = zone.isin("extreme_positive", "high_positive"), zone.isin("extreme_negative", "high_negative")
    base = F.when(long & grows, -0.7).when(short & grows, 0.7).otherwise(0.0)
    return clip(F.when(zone.startswith("extreme"), base * 1.3).when(zone.startswith("normal") | (zone == "neutral"), base * 0.5).otherwise(base), -1.0, 1.0)


def book_score(imbalance: Column, spoof: Column, bait: Column, absorbed_bid: Column, absorbed_ask: Column) -> Column:
    base = clip(imbalance / 0.25, -1.0, 1.0)
    base = F.when(spoof, base * -0.3).when(bait, base * 0.2).otherwise(base)
    return clip(base + F.when(absorbed_bid, 0.2).when(absorbed_ask, -0.2).otherwise(0.0), -1.0, 1.0)


def with_unified_score(rows: DataFrame, weights: tuple[float, float, float, float] = (0.35, 0.30, 0.25, 0.10)) -> DataFrame:
    """From volume_score, book_score, oi_score, funding_score (null: 0) and rv: total_score, confidence, bias, strength and warning.

    Below a relative volume of 1 the weights of all but volume shrink with it, and
    the weights are scaled to 1 again; below 0.3 the total can't leave the neutral zone.
    """
    part = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("volume_score", "book_score", "oi_score", "funding_score")]
    v, b, o, f = part
    rv = F.col("rv")
    shrink = F.when(rv < 1, clip(0.3 + 0.7 * rv, 0.3, 1.0)).otherwise(1.0)
    others = weights[1] + weights[2] + weights[3]
    total = (weights[0] * v + shrink * (weights[1] * b + weights[2] * o + weights[3] * f)) / (weights[0] + shrink * others)
    edge = 0.25 * 0.99
    rows = rows.withColumn("total_score", F.when(rv < 0.3, clip(total, -edge, edge)).otherwise(total))
    t, size = F.col("total_score"), F.abs("total_score")
    bias = ladder((size < 0.25, "neutral"), (t > 0, "long"), otherwise="short")
    strength = ladder((size >= 0.75, "strong"), (size >= 0.55, "moderate"), otherwise="weak")
    opposed = (f > 0.6) & (t < -0.3) | (f < -0.6) & (t > 0.3)
    warning = ladder((opposed, "funding_opposed"), ((rv < 0.7) & (size > 0.25), "low_volume"), ((F.abs(v) > 0.3) & (F.abs(o) > 0.3) & (v * o < 0), "volume_oi_divergence"), otherwise=None)
    return rows.withColumns({"confidence": F.least(F.lit(100.0), 100 * size / 0.85), "bias": bias, "score_strength": strength, "score_warning": warning})


def summary_vote(results: DataFrame) -> DataFrame:
    """Votes of indicator results (symbol, ts, signal, strength): counts, mean strength and the labelled balance."""
    sign = F.when(F.col("signal") == "bullish", 1).when(F.col("signal") == "bearish", -1).otherwise(0)
    rows = results.groupBy("symbol", "ts").agg(
        F.count(F.when(F.col("signal") == "bullish", 1)).alias("bullish"),
        F.count(F.when(F.col("signal") == "bearish", 1)).alias("bearish"),
        F.count(F.when(F.col("signal") == "neutral", 1)).alias("neutral"),
        F.avg("strength").alias("mean_strength"),
        F.avg(F.col("strength") * sign).alias("balance"),
    )
    b = F.col("balance")
    return rows.withColumn("vote", ladder((b > 20, "strong_bullish"), (b > 5, "bullish"), (b < -20, "strong_bearish"), (b < -5, "bearish"), otherwise="neutral"))


def funding_combo(zone: Column, oi_pct: Column) -> tuple[Column, Column]:
    """What funding and open interest together tell, and its probability in per cent."""
    long, short = zone.isin("extreme_positive", "high_positive"), zone.isin("extreme_negative", "high_negative")
    extreme, rises, falls = zone.startswith("extreme"), oi_pct > 0.3, oi_pct < -0.3
    name = ladder((long & rises, "crowded_longs_rising"), (short & rises, "crowded_shorts_rising"), (extreme & falls, "capitulation"), (extreme, "extreme_exhaustion"), (~long & ~short & rises, "healthy_trend"), otherwise="no_edge")
    return name, ladder(((long | short) & rises, F.when(extreme, 75.0).otherwise(65.0)), (extreme & falls, 80.0), (extreme, 70.0), (~long & ~short & rises, 60.0), otherwise=50.0)
