"""Rolling kernels over bars, as window functions.

Every function adds columns to bars (symbol, tf, ts, seq, OHLCV). Windows of one
call share the partitioning by series and the order, so that a chain of them
needs a single shuffle and sort. Values are null until their window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, lag, last_rows, full, safe_divide, series, so_far, true_range


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(last_rows(n)), last_rows(n), n)


def average_last(x: Column, n: int, default: float = 0.0) -> Column:
    """Mean of the last n values, fewer at the start."""
    return F.coalesce(F.avg(x).over(last_rows(n)), F.lit(default))


def rolling_std(x: Column, n: int) -> Column:
    """Population standard deviation of n values."""
    return full(F.stddev_pop(x).over(last_rows(n)), last_rows(n), n)


def with_moments(bars: DataFrame, n: int = 20) -> DataFrame:
    close = F.col("close")
    return bars.withColumns({"sma": sma(close, n), "average_last": average_last(close, n), "rolling_std": rolling_std(close, n), "sum_last": F.sum("close").over(last_rows(n))})


def with_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower and bb_width (per cent of the middle)."""
    close = F.col("close")
    out = bars.withColumns({"bb_mid": sma(close, n), "__std": rolling_std(close, n)})
    out = out.withColumns({"bb_upper": F.col("bb_mid") + width * F.col("__std"), "bb_lower": F.col("bb_mid") - width * F.col("__std")})
    return out.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")) * 100).drop("__std")


def with_vwap(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "tf")) -> DataFrame:
    """Running volume-weighted typical price; the typical price itself while there is no volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    running = series(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn("vwap", safe_divide(F.sum(typical * F.col("volume")).over(running), F.sum("volume").over(running), typical))


def with_true_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """tr, its mean over n bars (atr_sma), its sum, and both as shares of the close."""
    out = bars.withColumn("tr", true_range())
    out = out.withColumns({"atr_sma": full(F.avg("tr").over(last_rows(n)), last_rows(n), n), "tr_sum": full(F.sum("tr").over(last_rows(n)), last_rows(n), n)})
    return out.withColumn("atr_sma_pct", safe_divide(F.col("atr_sma"), F.col("close")))


def with_relative_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """rv: to the mean of the last n bars, this one included (1 before); rv_prior: to that of the n - 1 bars before."""
    volume = F.col("volume")
    mean = F.avg("volume").over(last_rows(n))
    before = last_rows(n - 1, -1)
    enough = F.count(F.lit(1)).over(last_rows(n)) == n
    return bars.withColumns(
        {
            "rv": F.when(enough & (mean > 0), volume / mean).otherwise(1.0),
            "rv_prior": F.when(enough, safe_divide(volume, F.avg("volume").over(before), 1.0)).otherwise(1.0),
            "sma_volume_or_zero": F.coalesce(full(mean, last_rows(n), n), F.lit(0.0)),
        }
    )


def with_price_change(bars: DataFrame, n: int = 20) -> DataFrame:
    """Per cent from the close n - 1 bars ago."""
    first = lag("close", n - 1)
    return bars.withColumn("price_change_pct", F.when(first > 0, (F.col("close") - first) / first * 100))


def with_choppiness(bars: DataFrame, n: int = 14, slope_bars: int = 3, chop: float = 61.8, trend: float = 38.2) -> DataFrame:
    """chop: 100 * log10(sum of true ranges / range) / log10(n), 0 to 100; its slope; CHOP, TRANSITION or TREND.

    A range that is all but zero, or a ratio that has no logarithm, gives 50.
    """
    out = bars.withColumn("tr", true_range())
    ratio = F.sum("tr").over(last_rows(n)) / F.greatest(F.max("high").over(last_rows(n)) - F.min("low").over(last_rows(n)), F.lit(1e-12))
    value = F.when(ratio > 0, 100 * F.log10(ratio) / F.log10(F.lit(float(n)))).otherwise(50.0)
    out = out.withColumn("chop", full(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), last_rows(n), n))
    out = out.withColumn("chop_slope", F.col("chop") - F.lag("chop", slope_bars).over(series()))
    state = ladder((F.col("chop").isNull(), None), (F.col("chop") >= chop, "CHOP"), (F.col("chop") <= trend, "TREND"), otherwise="TRANSITION")
    return out.withColumn("chop_state", state)


def with_roc(bars: DataFrame, lookbacks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Rates of change (per cent) and log returns."""
    made = {}
    for k in lookbacks:
        before = lag("close", k)
        made |= {f"roc_{k}": F.when(before > 0, (F.col("close") - before) / before * 100), f"log_return_{k}": F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before))}
    return bars.withColumns(made)


def with_running_extremes(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"high_so_far": F.max("high").over(so_far()), "low_so_far": F.min("low").over(so_far())})
