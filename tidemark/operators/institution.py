"""Structure with swing strength: breaks beyond a buffer of volatility, sweeps and their confirmation, acceptance, ranges, momentum, and agreement of two intervals.

Every bar is judged by what is known at it: a swing ``SIDE`` bars after its own
bar, a break's acceptance ``HOLD`` bars after the break. Only the confirmation of
a sweep looks at the bars after it, as many as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SERIES, clip, ladder, lag, last_rows, series, so_far
from .kernels import with_relative_volume
from .scan import Kernel, scan
from .smoothing import Average, Range
from .structure import ahead, trend_of

#: Fixed values of the rules: bars on either side of a swing, bars of a hold, relative volume that confirms.
SIDE, HOLD, LOUD = 3, 3, 1.2


class RangeFromZero(Kernel):
    """Wilder's average of true ranges in which the first bar's counts as 0, in per cent of the close; 0 while it isn't known."""

    reads = ("high", "low", "close")
    makes = (("atr_pct", "double"),)

    def __init__(self, n: int = 14):
        self.range, self.mean, self.first = Range(), Average(n, 1 / n), True

    def step(self, high, low, close):
        tr, first, self.first = self.range.push(high, low, close), self.first, False
        mean = self.mean.push(0.0 if first else tr)
        return (mean / close * 100 if mean is not None and close > 0 else 0.0,)


def with_swings(bars: DataFrame, n: int = SIDE) -> DataFrame:
    """atr_pct, rv, and swing_high and swing_low (the extremes of the n bars on either side, beyond their direct neighbours) with strengths: distance to the last swing of the other kind over atr_pct, within 1; 0.5 where either is missing."""
    rows = scan(with_relative_volume(bars), [RangeFromZero])
    around = series().rowsBetween(-n, n)
    full = F.count(F.lit(1)).over(around) == 2 * n + 1
    high, low = F.col("high"), F.col("low")
    next_of = lambda c: F.lead(c).over(series())
    top = full & (high == F.max("high").over(around)) & (high > lag("high")) & (high > next_of("high"))
    bottom = full & (low == F.min("low").over(around)) & (low < lag("low")) & (low < next_of("low"))
    rows = rows.withColumns({"swing_high": F.when(top, high), "swing_low": F.when(bottom, low)})
    # A bar's high counts as the earlier of its two swings.
    before = series().rowsBetween(Window.unboundedPreceding, -1)

    def strength(price: str, other: Column) -> Column:
        share = F.try_divide(F.abs(F.col(price) - other), F.col(price)) * 100
        return F.when(F.col(price).isNotNull(), F.coalesce(F.when((F.col("atr_pct") > 0) & share.isNotNull(), clip(share / F.col("atr_pct"), 0.0, 1.0)), F.lit(0.5)))

    return rows.withColumns({"high_strength": strength("swing_high", F.last("swing_low", ignorenulls=True).over(before)), "low_strength": strength("swing_low", F.last("swing_high", ignorenulls=True).over(so_far()))})


def _last_ones(rows: DataFrame, name: str, value: Column, has: Column, made) -> DataFrame:
    """``made`` over the window of the last five rows that have a value, carried on to the rows between."""
    five = Window.partitionBy(*SERIES, "__has").orderBy("ts", "seq").rowsBetween(-4, 0)
    rows = rows.withColumns({"__has": has, "__value": value})
    rows = rows.withColumn(name, F.when(F.col("__has"), made(F.col("__value"), five)))
    return rows.withColumn(name, F.last(name, ignorenulls=True).over(so_far())).drop("__has", "__value")


def with_levels(rows: DataFrame, n: int = SIDE) -> DataFrame:
    """trend, last_high and last_low, the extremes of the last five swings of each kind, the mean strength of the last five, and whether two swings of a kind are known. Needs :func:`with_swings`."""
    rows = trend_of(rows, n)
    rows = rows.withColumns({"__kh": lag("swing_high", n), "__kl": lag("swing_low", n), "__ks": F.array_compact(F.array(lag("high_strength", n), lag("low_strength", n)))})
    rows = _last_ones(rows, "top", F.col("__kh"), F.col("__kh").isNotNull(), lambda x, w: F.max(x).over(w))
    rows = _last_ones(rows, "bottom", F.col("__kl"), F.col("__kl").isNotNull(), lambda x, w: F.min(x).over(w))
    rows = _last_ones(rows, "__held", F.col("__ks"), F.size("__ks") > 0, lambda x, w: F.flatten(F.collect_list(x).over(w)))
    held = F.slice(F.col("__held"), -F.least(F.lit(5), F.size("__held")), F.lit(5))
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.least(F.lit(5), F.size("__held"))
    known = lambda c: F.count(c).over(so_far()) >= 2
    return rows.withColumns({"swing_strength": F.when(F.col("__held").isNotNull(), mean), "__two_h": known("__kh"), "__two_l": known("__kl")}).withColumnsRenamed({"__two_h": "has_highs", "__two_l": "has_lows"}).drop("__kh", "__kl", "__ks", "__held")


def with_events(rows: DataFrame) -> DataFrame:
    """structure_event (a close beyond the last level and a buffer: with the trend bos, against it choch), whether the closes after a bos hold with volume, and sweeps of the last swings (beyond one and closed back) with their confirmation. Needs :func:`with_levels`."""
    a, close, after = F.col("atr_pct"), F.col("close"), ahead(HOLD)
    far, near = F.greatest(F.lit(0.05), a * 0.15) / 100, F.greatest(F.lit(0.03), a * 0.10) / 100
    high, low = F.col("last_high"), F.col("last_low")
    both = high.isNotNull() & low.isNotNull()
    up, down = both & (close > high * (1 + far)), both & (close < low * (1 - far))
    rises, falls = F.col("trend") == "uptrend", F.col("trend") == "downtrend"
    event = ladder((rises & up, "bos_bullish"), (falls & down, "bos_bearish"), (rises & down, "choch_bearish"), (falls & up, "choch_bullish"), otherwise="none")
    loud = F.max("rv").over(after) >= LOUD
    top, bottom = F.max("close").over(after), F.min("close").over(after)
    rows = rows.withColumn("structure_event", event)
    e, full = F.col("structure_event"), F.count(F.lit(1)).over(after) == HOLD
    held = ladder((~full, None), (e == "bos_bullish", (bottom >= high) & loud), (e == "bos_bearish", (top <= low) & loud), otherwise=None)
    swept_low = F.coalesce(F.col("has_lows") & (F.col("low") < low * (1 - near)) & (close > low), F.lit(False))
    swept_high = F.coalesce(F.col("has_highs") & (F.col("high") > high * (1 + near)) & (close < high), F.lit(False))
    sure = lambda swept, back: swept & F.coalesce(loud & back, F.lit(False))
    return rows.withColumns({"bos_accepted": held, "swept_low": swept_low, "swept_high": swept_high, "low_sweep_confirmed": sure(swept_low, top > close), "high_sweep_confirmed": sure(swept_high, bottom < close)})


def with_state(rows: DataFrame) -> DataFrame:
    """Momentum since the last bos (how soon a bar goes half an atr_pct further: 3 bars fast, 10 slow, else stalled), the range (20 bars without a bos while volatility shrinks) and the strength within 100. Needs :func:`with_events`."""
    w = series()
    is_bos = F.col("structure_event").startswith("bos")
    rows = rows.withColumns({"__leg": F.count(F.when(is_bos, 1)).over(so_far()), "__n": F.row_number().over(w), "__calm": F.avg("atr_pct").over(last_rows(20))})
    leg = Window.partitionBy(*SERIES, "__leg").orderBy("ts", "seq")
    rows = rows.withColumns({"__since": F.row_number().over(leg) - 1, "__way": F.first("structure_event").over(leg), "__price": F.first("close").over(leg), "__held": F.first("bos_accepted").over(leg)})
    broken, since, price = F.col("__leg") > 0, F.col("__since"), F.col("__price")
    move = F.try_divide(F.when(F.col("__way") == "bos_bullish", F.col("high") - price).otherwise(price - F.col("low")), price) * 100
    went = broken & (since > 0) & (move >= 0.5 * F.col("atr_pct"))
    rows = rows.withColumn("__took", F.min(F.when(went, since)).over(leg.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    took = F.col("__took")
    momentum = ladder((~broken | (since == 0), "slow"), (took <= 3, "fast"), (took <= 10, "slow"), (took.isNotNull() | (since > 10), "stalled"), otherwise="slow")
    shrinks = F.when(F.col("__n") < 14, True).otherwise(F.col("atr_pct") < F.when(F.col("__n") >= 20, F.col("__calm")).otherwise(0.0))
    ranging = (~broken | (since >= 20)) & shrinks & F.col("top").isNotNull() & F.col("bottom").isNotNull()
    rows = rows.withColumns({"structure_momentum": momentum, "ranging": ranging, "range_top": F.when(ranging, F.col("top")), "range_bottom": F.when(ranging, F.col("bottom"))})
    trend, held = F.col("trend"), broken & (since >= HOLD)
    turned = F.max(F.col("structure_event").startswith("choch")).over(last_rows(5))
    strength = (
        50.0
        + ladder((trend.isin("uptrend", "downtrend"), 20.0), ((trend == "range") & F.col("ranging"), 10.0), otherwise=-20.0)
        + ladder((held & F.col("__held"), 20.0), (held & ~F.col("__held"), -15.0), otherwise=0.0)
        - F.when(turned, 10.0).otherwise(0.0)
        + F.coalesce(F.col("swing_strength"), F.lit(0.0)) * 10
    )
    rows = rows.withColumn("structure_strength", F.when(F.col("__n") >= 10, clip(strength, 0.0, 100.0)).otherwise(0.0))
    return rows.drop("__leg", "__n", "__calm", "__since", "__way", "__price", "__held", "__took")


def structure(bars: DataFrame) -> DataFrame:
    return with_state(with_events(with_levels(with_swings(bars))))


def alignment(high: Column, low: Column) -> tuple[Column, Column]:
    """How a higher interval's trend and a lower one's agree, and the way to trade that goes with it; null where the higher one is unknown yet."""
    kind = ladder((high.isNull(), None), (high == "range", "range_dominant"), (high == low, "aligned"), otherwise="mixed")
    return kind, ladder((kind == "range_dominant", "range_mode"), (kind == "aligned", "trend_mode"), (kind == "mixed", "scalp_only"), otherwise=None)
