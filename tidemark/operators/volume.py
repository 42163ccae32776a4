"""Volume analysis of bars: relative volume, place in the range, absorption, sweeps, candle delta, acceleration and exhaustion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ladder, lag, last_rows, safe_divide, series, so_far


def analyzed(bars: DataFrame, period: int = 20) -> DataFrame:
    """volume_ratio to the mean of the last bars, with signal and strength; neutral 50 while they are too few."""
    c, v = F.col("close"), F.col("volume")
    enough = F.count(F.lit(1)).over(last_rows(period)) == period
    ratio = safe_divide(v, F.avg("volume").over(last_rows(period)), 1.0)
    out = bars.withColumns({"__enough": enough, "__ratio": ratio, "__dp": F.coalesce(c - lag("close"), F.lit(0.0)), "__dv": F.coalesce(v - lag("volume"), F.lit(0.0))})
    confirmed = (F.col("__dp") != 0) & (F.col("__dv") > 0)
    side = F.when(F.col("__dp") > 0, "bullish").otherwise("bearish")
    r = F.col("__ratio")
    high = F.least(F.lit(90.0), 50.0 + (r - 1) * 20.0)
    strength = ladder((~F.col("__enough"), 50.0), (r > 2.0, F.when(confirmed, high).otherwise(F.greatest(F.lit(60.0), high - 15.0))), (r > 1.5, F.when(confirmed, 70.0).otherwise(55.0)), (r < 0.5, 30.0), otherwise=50.0)
    signal = F.when(F.col("__enough") & (r > 1.5), side).otherwise("neutral")
    return out.withColumns({"volume_ratio": F.when(F.col("__enough"), r).otherwise(v), "volume_signal": signal, "volume_strength": strength}).drop("__enough", "__ratio", "__dp", "__dv")


def real_move(bars: DataFrame, lookback: int = 20, sweep_lookback: int = 10, meaningful: float = 1.5, absorbed: float = 0.3) -> DataFrame:
    """Whether a move was real: relative volume and its context, place in the range, absorption, liquidity sweep, confidence and signal."""
    w = series()
    c, v = F.col("close"), F.col("volume")
    before = last_rows(lookback, -1)
    avg = F.avg("volume").over(before)
    out = bars.withColumns(
        {
            "__i": F.row_number().over(w),
            "relative_volume": F.when(avg > 0, v / avg).otherwise(1.0),
            "__top": F.max("high").over(last_rows(lookback)),
            "__low": F.min("low").over(last_rows(lookback)),
            "__swing_high": F.max("high").over(last_rows(sweep_lookback, -2)),
            "__swing_low": F.min("low").over(last_rows(sweep_lookback, -2)),
            "__prev": lag("close"),
        }
    )
    rv = F.col("relative_volume")
    out = out.withColumn("volume_context", ladder((rv > 3.0, "extreme"), (rv > meaningful, "high"), (rv > 0.7, "normal"), (rv > 0.3, "low"), otherwise="dead"))
    size = F.col("__top") - F.col("__low")
    pct = F.when((F.col("__i") >= lookback) & (size != 0), (c - F.col("__low")) / size * 100).otherwise(50.0)
    out = out.withColumn("range_percentile", pct)
    p = F.col("range_percentile")
    out = out.withColumn("volume_location", ladder((p > 80, "range_high"), (p < 20, "range_low"), otherwise="mid_range"))
    move = F.abs((c - F.col("__prev")) / F.col("__prev") * 100)
    efficiency = F.when(F.col("__prev") > 0, move).otherwise(0.0) / F.when(rv > 0, rv)
    is_absorbed = (F.col("__i") >= 3) & (rv > meaningful) & (F.coalesce(efficiency, F.lit(0.0)) < absorbed)
    out = out.withColumn("absorption", ladder((~is_absorbed, "none"), (c >= F.col("__prev"), "bid_absorption"), otherwise="ask_absorption"))
    enough = F.col("__i") >= sweep_lookback + 2
    swept_high = enough & (F.col("high") > F.col("__swing_high")) & (c < F.col("__swing_high"))
    swept_low = enough & (F.col("low") < F.col("__swing_low")) & (c > F.col("__swing_low"))
    out = out.withColumn("sweep", ladder((swept_high, "high"), (swept_low, "low"), otherwise="none"))
    out = out.withColumn("sweep_level", ladder((F.col("sweep") == "high", F.col("__swing_high")), (F.col("sweep") == "low", F.col("__swing_low")), otherwise=0.0))
    strong, found, swept = rv > meaningful, F.col("absorption") != "none", F.col("sweep") != "none"
    mid = F.col("volume_location") == "mid_range"
    out = out.withColumn("move_is_real", strong & ~found & ~mid)
    context = F.col("volume_context")
    confidence = (
        50.0
        + ladder((context == "extreme", 20.0), (context == "high", 10.0), (context == "low", -15.0), (context == "dead", -25.0), otherwise=0.0)
        + F.when(mid, -10.0).otherwise(10.0)
        + F.when(found, -5.0).otherwise(0.0)
        + ladder((swept & strong, 15.0), (swept, -5.0), otherwise=0.0)
    )
    up = c > F.col("__prev")
    signal = ladder(
        (F.col("absorption") == "bid_absorption", "bullish"),
        (found, "bearish"),
        (swept & strong, F.when(F.col("sweep") == "low", "bullish").otherwise("bearish")),
        (F.col("move_is_real"), F.when(up, "bullish").otherwise("bearish")),
        (~strong, "suspicious"),
        otherwise="neutral",
    )
    return out.withColumns({"move_confidence": F.greatest(F.lit(0.0), F.least(F.lit(100.0), confidence)), "move_signal": signal}).drop("__i", "__top", "__low", "__swing_high", "__swing_low", "__prev")


def candle_delta() -> Column:
    """Signed volume by a candle's shape: the share of the range below and above the close, all of it along the body of a rangeless bar."""
    span = F.col("high") - F.col("low")
    return F.when(span > 0, F.col("volume") * (2 * (F.col("close") - F.col("low")) / span - 1)).otherwise(0.0)


def with_candle_delta(bars: DataFrame, recent: int = 5) -> DataFrame:
    """candle_delta, its sum over the last bars (fewer at the start), its share of volume in per cent, running sum, bias with strength, and divergence from the price."""
    w = last_rows(recent)
    out = bars.withColumn("candle_delta", candle_delta())
    out = out.withColumns({"recent_delta": F.sum("candle_delta").over(w), "__volume": F.sum("volume").over(w), "cumulative_delta": F.sum("candle_delta").over(so_far())})
    out = out.withColumn("delta_pct", safe_divide(F.col("recent_delta"), F.col("__volume")) * 100)
    d, size = F.col("delta_pct"), F.abs(F.col("delta_pct"))
    bias = ladder((d > 30, "strong_buy"), (d > 10, "buy"), (d < -30, "strong_sell"), (d < -10, "sell"), otherwise="neutral")
    strength = ladder((size > 30, F.least(F.lit(95.0), 70.0 + (size - 30) * 0.5)), (size > 10, 55.0 + (size - 10) * 0.75), otherwise=40.0 + size * 1.5)
    change = F.col("close") - F.first("close").over(w)
    diverged = (change > 0) & (F.col("recent_delta") < 0) | (change < 0) & (F.col("recent_delta") > 0)
    return out.withColumns({"aggression_bias": bias, "delta_strength": strength, "delta_divergence": diverged}).drop("__volume")


def with_acceleration(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """volume_accel to the bar before, its ratio to the recent mean, momentum, state, and the bars in a row that rose or fell (counted back from the current one; the first steady bar ends the count)."""
    previous = lag("volume")
    step = F.when(previous.isNull(), None).when(previous > 0, F.col("volume") / previous).otherwise(1.0)
    out = bars.withColumn("__r", step)
    out = out.withColumns({"volume_vs_avg": safe_divide(F.col("volume"), F.avg("volume").over(last_rows(lookback)), 1.0), "__rs": F.reverse(F.collect_list("__r").over(last_rows(lookback - 1))), "__n": F.row_number().over(series())})
    steady = lambda r: (r <= 1.1) & (r >= 0.9)
    ratios = F.col("__rs")
    ends = F.filter(F.transform(ratios, lambda r, i: F.when(steady(r), i)), lambda i: i.isNotNull())
    run = F.slice(ratios, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(ratios)))
    last_fall = F.coalesce(F.array_max(F.transform(run, lambda r, i: F.when(r < 0.9, i + 1))), F.lit(0))
    last_rise = F.coalesce(F.array_max(F.transform(run, lambda r, i: F.when(r > 1.1, i + 1))), F.lit(0))
    first, second = F.get(ratios, F.lit(0)), F.get(ratios, F.lit(1))
    current = F.coalesce(first, F.lit(1.0))
    state = ladder((F.col("__n") < 3, "steady"), (F.col("volume_vs_avg") >= 3.0, "climax"), (current >= 1.5, "accelerating"), (current <= 0.7, "decelerating"), otherwise="steady")
    out = out.withColumns({"volume_accel": current, "accel_momentum": F.coalesce(first - second, F.lit(0.0)), "accel_state": state, "bars_rising": (F.size(run) - last_fall).cast("int"), "bars_falling": (F.size(run) - last_rise).cast("int")})
    return out.drop("__r", "__rs", "__n")


def with_exhaustion(bars: DataFrame, lookback: int = 5, oi_change: Column | None = None) -> DataFrame:
    """Signs of exhaustion among the last bars (shrinking bodies, falling volume, failed continuation, open interest) and the risk; LOW while the bars are too few."""
    w, n = series(), lookback
    volume, close = F.col("volume"), F.col("close")
    at = lambda x, k: F.lag(x, k).over(w)
    body = F.abs(F.col("close") - F.col("open"))
    out = bars.withColumns({"__n": F.row_number().over(w), "__body": body})
    out = out.withColumns(
        {
            "__avg": F.when(F.col("__n") >= 2 * n, F.avg("volume").over(last_rows(n, -n))).otherwise(F.avg("volume").over(so_far())),
            "__max": F.max("volume").over(last_rows(n)),
            "__early": (at("__body", n - 1) + at("__body", n - 2)) / 2,
            "__late": (F.col("__body") + at("__body", 1)) / 2,
            "__v_early": (at("volume", n - 1) + at("volume", n - 2)) / (n // 2),
            "__v_late": (volume + at("volume", 1) + at("volume", 2)) / (n // 2 + n % 2),
            "__push": at("close", n - 1) - at("close", n),
            "__progress": close - at("close", n - 1),
        }
    )
    enough = F.col("__n") >= n + 1
    spike = F.col("__max") > F.col("__avg") * 1.5
    shrinking = (F.col("__late") < F.col("__early") * 0.5) & spike
    declining = F.col("__v_late") < F.col("__v_early") * 0.7
    push, progress = F.col("__push"), F.col("__progress")
    failed = (F.when(push > 0, progress < push * 0.3).when(push < 0, progress > push * 0.3).otherwise(False)) & spike
    stagnant = (F.abs(oi_change) < 1.0) & spike if oi_change is not None else F.lit(False)
    dropping = ~stagnant & (oi_change < -2.0) if oi_change is not None else F.lit(False)
    flags = [(shrinking, 20.0), (declining, 15.0), (failed, 20.0), (F.coalesce(stagnant, F.lit(False)), 15.0), (F.coalesce(dropping, F.lit(False)), 10.0)]
    count = sum((F.when(f, 1).otherwise(0) for f, _ in flags), F.lit(0))
    confidence = sum((F.when(f, x).otherwise(0.0) for f, x in flags), F.lit(30.0))
    out = out.withColumns({"exhaustion_signs": F.when(enough, count).otherwise(0), "__confidence": confidence, "__spike": spike})
    k, s = F.col("exhaustion_signs"), F.col("__spike")
    risk = ladder((~enough, "low"), ((k >= 4) | (k >= 3) & s, "extreme"), ((k >= 3) | (k >= 2) & s, "high"), (k >= 2, "medium"), otherwise="low")
    out = out.withColumns({"exhaustion_risk": risk, "exhaustion_confidence": F.when(enough, F.least(F.lit(95.0), F.col("__confidence"))).otherwise(30.0)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
