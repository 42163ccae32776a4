"""Candle engines: ribbon, momentum, MACD and RSI events, StochRSI timing and composite trend strength.

Each scans the averages it needs in one pass and classifies with columns.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ladder, last_rows, series
from .scan import Kernel, scan
from .smoothing import EPS, Atr, Average, Macd, Mean, Range
from .structure import with_pivots

RIBBON = (9, 12, 15, 18, 21, 25, 30, 35, 40, 50)
#: Fixed ribbon thresholds by interval: width, slope, pullback band.
RIBBON_FIXED = {"1m": (0.0008, 0.00025, 0.001), "5m": (0.0012, 0.00035, 0.002), "1h": (0.002, 0.001, 0.006)}
SLOPE_BARS = {"1m": 15, "5m": 10, "1h": 4}
ROC_LOOKBACKS = {"1m": (5, 20, 60), "5m": (3, 12, 36), "1h": (3, 6, 12)}


class Ribbon(Kernel):
    """Averages started by their first value, and the smoothed width of their spread; null until as many bars as the longest period."""

    reads = ("close",)
    makes = (("emas", "array<double>"), ("width_smooth", "double"), ("width_rate", "double"))

    def __init__(self, periods: tuple[int, ...] = RIBBON, smooth: int = 5):
        self.averages, self.width, self.bars = [Average(n, seeded=False) for n in periods], Average(smooth, seeded=False), 0
        self.longest, self.last = max(periods), None

    def step(self, close):
        values = [a.push(close) for a in self.averages]
        self.bars += 1
        if self.bars < self.longest:
            return None, None, None
        width = self.width.push((max(values) - min(values)) / (close + 1e-10))
        rate = 0.0 if self.last is None else (width - self.last) / (abs(self.last) + 1e-10)
        self.last = width
        return values, width, rate


def ribbon(bars: DataFrame, tf: str, atr_pct: str | None = None) -> DataFrame:
    """Stack score, direction, smoothed width and its rate, centre slope, state, strength and pullback of the ten averages."""
    rows = scan(bars, [Ribbon]).where("emas is not null")
    n, k = len(RIBBON), SLOPE_BARS.get(tf, 10)
    e = [F.col("emas")[i] for i in range(n)]
    up = sum((F.when(a > b, 1).otherwise(0) for a, b in zip(e, e[1:], strict=False)), F.lit(0)) / (n - 1)
    down = sum((F.when(a < b, 1).otherwise(0) for a, b in zip(e, e[1:], strict=False)), F.lit(0)) / (n - 1)
    ordered = F.array_sort("emas")
    share = F.col(atr_pct) if atr_pct else F.lit(None).cast("double")
    width, slope, band = RIBBON_FIXED.get(tf, (0.001, 0.0005, 0.003))
    rows = rows.withColumns(
        {"__u": up, "__d": down, "center": (ordered[n // 2 - 1] + ordered[n // 2]) / 2, "__wt": F.when(share > 0, 0.1 * share).otherwise(width), "__st": F.when(share > 0, 0.15 * share).otherwise(slope), "__pb": F.when(share > 0, 0.3 * share).otherwise(band)}
    )
    u, d = F.col("__u"), F.col("__d")
    bull, bear = (u >= 0.6) & (u > d), (d >= 0.6) & (d > u)
    before = F.lag("center", k + 1).over(series())
    rows = rows.withColumns({"ribbon_direction": ladder((bull, "BULL"), (bear, "BEAR"), otherwise="NEUTRAL"), "stack_score": F.greatest(u, d), "center_slope": F.coalesce((F.col("center") - before) / (F.abs(before) + 1e-10), F.lit(0.0))})
    rows = rows.withColumn("__ps", F.lag("center_slope").over(series()))
    s, c, w, r, wt, st = (F.col(x) for x in ("stack_score", "center_slope", "width_smooth", "width_rate", "__wt", "__st"))
    way = F.when(F.col("ribbon_direction") == "BULL", 1).otherwise(-1)
    chop = (s < 0.6) | (w < 0.7 * wt) & (F.abs(c) < 0.5 * st) | (F.col("ribbon_direction") == "NEUTRAL")
    healthy = (s >= 0.8) & (w >= wt) & (c * way >= st) & (r >= -0.15)
    # The last slope is this bar's own by then, so that only a flat centre tells of exhaustion.
    tired = (s >= 0.7) & (r <= -0.20) & (F.abs(c) < st)
    rows = rows.withColumn("ribbon_state", ladder((chop, "CHOP"), (healthy, "HEALTHY"), (tired, "EXHAUSTING"), otherwise="WEAKENING"))
    parts = 0.3 * clip((s - 0.5) / 0.5, 0, 1) + 0.25 * clip(w / (2 * wt + 1e-10), 0, 1) + 0.25 * clip(F.abs(c) / (2 * st + 1e-10), 0, 1) + 0.2 * clip((r + 0.15) / (0.3 + 1e-10), 0, 1)
    most = ladder((F.col("ribbon_state") == "CHOP", 35.0), (F.col("ribbon_state") == "EXHAUSTING", 60.0), otherwise=100.0)
    rows = rows.withColumns({"ribbon_strength": F.least(100 * parts, most), "ribbon_pullback": F.abs(F.col("close") - F.col("center")) <= F.col("__pb") * F.col("close")})
    return rows.drop("__u", "__d", "__wt", "__st", "__pb", "__ps")


class Momentum(Kernel):
    """ATR share of the close (the bar's own range before there is an average), rates of change, and the step of the smoothed fast one."""

    makes = (("roc_atr_pct", "double"), ("roc_fast", "double"), ("roc_mid", "double"), ("roc_slow", "double"), ("roc_accel", "double"))
    reads = ("high", "low", "close")

    def __init__(self, lookbacks: tuple[int, int, int], n: int = 14, smooth: int = 3):
        self.lookbacks, self.held = lookbacks, deque(maxlen=max(lookbacks) + 1)
        self.range, self.atr, self.smooth, self.last = Range(), Average(n, 1 / n), Average(smooth, seeded=False), 0.0

    def step(self, high, low, close):
        tr = self.range.push(high, low, close)
        atr = self.atr.push(tr)
        share = (tr if atr is None else atr) / (close + 1e-10)
        self.held.append(close)
        if len(self.held) < self.held.maxlen:
            return share, None, None, None, None
        rates = [(close - self.held[-1 - k]) / (self.held[-1 - k] + 1e-10) for k in self.lookbacks]
        smooth = self.smooth.push(rates[0])
        step, self.last = smooth - self.last, smooth
        return share, *rates, step


def momentum(bars: DataFrame, tf: str) -> DataFrame:
    """Rates of change over three lookbacks against the ATR share, with acceleration, state, score and blow-off."""
    lookbacks = ROC_LOOKBACKS.get(tf, (5, 20, 60))
    rows = scan(bars, [lambda: _momentum(lookbacks)]).where("roc_fast is not null")
    norm = lambda x: clip(F.col(x) / (F.col("roc_atr_pct") + 1e-10), -3.0, 3.0)
    rows = rows.withColumns({"roc_fast_norm": norm("roc_fast"), "roc_mid_norm": norm("roc_mid"), "roc_slow_norm": norm("roc_slow")})
    f, m, a = F.col("roc_fast_norm"), F.col("roc_mid_norm"), F.col("roc_accel")
    impulse = (f > 0.8) & (m > 0) & (a > 0) | (f < -0.8) & (m < 0) & (a < 0)
    fade = (F.abs(f) >= 0.8) & ((f > 0) & (a < 0) | (f < 0) & (a > 0)) | (F.abs(m) < 0.3) & (F.abs(f) > 0.3)
    state = ladder(((F.abs(f) < 0.3) & (F.abs(m) < 0.3), "NOISE"), (impulse, "IMPULSE"), (f * m < 0, "PULLBACK"), (fade, "FADE"), otherwise="NOISE")
    rows = rows.withColumns({"momentum_state": state, "blowoff": F.abs(f) > 1.5})
    one = F.lit(1.0)
    score = 100 * (0.5 * F.least(F.abs(f) / 0.8, one) + 0.3 * F.least(F.abs(m) / 0.8, one) + 0.2 * F.least(F.abs(a) / (F.abs("roc_fast") + 1e-10), one))
    return rows.withColumn("momentum_score", F.when(F.col("momentum_state") == "NOISE", F.least(score, F.lit(25.0))).otherwise(score))


def _momentum(lookbacks: tuple[int, int, int]) -> Kernel:
    return Momentum(lookbacks)


def entry_filter(rows: DataFrame, least: float = 50.0, pullbacks: bool = False) -> DataFrame:
    """Whether momentum allows an entry to either side (impulses that aren't blow-offs; pullbacks only if asked for), and the size multiplier."""
    f, m, a, state, score = (F.col(x) for x in ("roc_fast_norm", "roc_mid_norm", "roc_accel", "momentum_state", "momentum_score"))
    calm = ~F.col("blowoff")

    def side(way: int) -> Column:
        impulse = (state == "IMPULSE") & (f * way > 0) & (score >= least)
        back = (state == "PULLBACK") & (m * way > 0) & (score >= least * 0.7)
        return calm & (impulse | back if pullbacks else impulse)

    size = ladder((F.col("blowoff"), 0.3), (score >= 70, 1.0), (score >= 50, 0.8), (score >= 30, 0.5), otherwise=0.3)
    return rows.withColumns({"allows_long": side(1), "allows_short": side(-1), "size_multiplier": size})


def with_divergence(rows: DataFrame, n: int = 5) -> DataFrame:
    """roc_divergence: the close beyond the last swing known (n bars after its own) while roc_fast_norm stays within that swing's; BULLISH if both sides hold. Needs swing_high and swing_low of structure.with_pivots."""
    w = series()
    close, f = F.col("close"), F.col("roc_fast_norm")
    known = lambda c: F.struct(F.lag(c, n).over(w).alias("price"), F.lag("roc_fast_norm", n).over(w).alias("roc"))
    rows = rows.withColumns({"__h": known("swing_high"), "__l": known("swing_low")})
    last = lambda c: F.last(F.when(F.col(f"{c}.price").isNotNull(), F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"__h": last("__h"), "__l": last("__l")})
    bear = (close > F.col("__h.price")) & (f < F.col("__h.roc"))
    bull = (close < F.col("__l.price")) & (f > F.col("__l.roc"))
    return rows.withColumn("roc_divergence", ladder((bull, "BULLISH"), (bear, "BEARISH"), otherwise="NONE")).drop("__h", "__l")


def with_structure(rows: DataFrame, trend: str = "structure_trend") -> DataFrame:
    """structure_size: how far momentum and structure agree on a side (BULL long, BEAR short); 0 where they don't."""
    state, score, f, m = (F.col(x) for x in ("momentum_state", "momentum_score", "roc_fast_norm", "roc_mid_norm"))
    way = F.when(F.col(trend) == "BULL", 1).when(F.col(trend) == "BEAR", -1)
    size = ladder(((state == "IMPULSE") & (f * way > 0), F.least(F.lit(1.5), 1 + (score - 50) / 100)), ((state == "PULLBACK") & (m * way > 0), 0.8), otherwise=0.0)
    return rows.withColumn("structure_size", size)


def macd_events(bars: DataFrame, confirm: int = 2, chop: Column | None = None) -> DataFrame:
    """Histogram over ATR (within 3), its slope and acceleration, phase, and shift and weakening confirmed by ``confirm`` bars in a row. ``chop``: rows where events are suppressed."""
    rows = scan(bars, [Macd, Atr]).where("macd_hist is not null")
    w = series()
    rows = rows.withColumn("hist_norm", F.when(F.col("atr").isNotNull(), clip(F.col("macd_hist") / (F.col("atr") + EPS), -3.0, 3.0)).otherwise(F.col("macd_hist")))
    h, before = F.col("hist_norm"), F.lag("hist_norm").over(w)
    rows = rows.withColumns({"hist_slope": F.col("macd_hist") - F.lag("macd_hist").over(w), "__s": h - before, "__b": before})
    s, b = F.col("__s"), F.col("__b")
    shift = ladder(((b <= 0) & (h > 0) & (s > 0.05), "BULL_SHIFT"), ((b >= 0) & (h < 0) & (s < -0.05), "BEAR_SHIFT"), otherwise="NONE")
    weak = ladder(((h > 0) & (s < -0.05), "BULL_WEAKEN"), ((h < 0) & (s > 0.05), "BEAR_WEAKEN"), otherwise="NONE")
    rows = rows.withColumns({"shift_candidate": shift, "weaken_candidate": weak, "hist_accel": F.col("hist_slope") - F.lag("hist_slope").over(w)})

    def confirmed(name: str) -> Column:
        """Whether the last ``confirm`` rows all have the current candidate."""
        same = F.count(F.lit(1)).over(last_rows(confirm)) == confirm
        for k in range(1, confirm):
            same &= F.lag(name, k).over(w) == F.col(name)
        return same & (F.col(name) != "NONE")

    rows = rows.withColumn("macd_event", ladder((confirmed("shift_candidate"), F.col("shift_candidate")), (confirmed("weaken_candidate"), F.col("weaken_candidate")), otherwise="NONE"))
    if chop is not None:
        rows = rows.withColumn("macd_event", F.when(chop, "NONE").otherwise(F.col("macd_event")))
    size, pace = F.least(F.abs(h) / (0.04 + EPS), F.lit(2.0)) / 2, F.least(F.abs(s) / (0.1 + EPS), F.lit(2.0)) / 2
    sure = 100 * (0.6 * size + 0.4 * pace)
    sure = F.when(F.abs(h) < 0.02, F.least(sure, F.lit(50.0))).otherwise(sure)
    return rows.withColumns({"macd_phase": F.when(F.col("macd_hist") > 0, "BULL").otherwise("BEAR"), "event_confidence": F.when(F.col("macd_event") != "NONE", sure)}).drop("__s", "__b")


class FailureSwing:
    """A peak above ``high``, a fall below ``mid``, a lower peak, and a break below the fall's low by ``margin``."""

    def __init__(self, high: float = 60.0, mid: float = 45.0, margin: float = 1.0):
        self.high, self.mid, self.margin = high, mid, margin
        self.stage, self.peak, self.low = 0, 0.0, 0.0

    def push(self, x: float) -> bool:
        broke = False
        if self.stage == 0:
            if x >= self.high:
                self.stage, self.peak = 1, x
        elif self.stage == 1:
            if x < self.mid:
                self.stage, self.low = 2, x
            else:
                self.peak = max(self.peak, x)
        elif self.stage == 2:
            if x > self.mid and x >= self.low:
                self.stage = 3 if x < self.peak else 0
            else:
                self.low = min(self.low, x)
        else:
            broke = x < self.low - self.margin
            if broke or x > self.high:
                self.stage = 0
        return broke


class RsiTiming(Kernel):
    """RSI of the engines (50 where nothing moves, known from the bar that completes the means), regime, and failure swings, told once a bar."""

    reads = ("close",)
    makes = (("timing_rsi", "double"), ("rsi_regime", "string"), ("failure_swing", "string"))

    def __init__(self, n: int = 14):
        self.last, self.up, self.down = None, Average(n, 1 / n), Average(n, 1 / n)
        self.bear, self.bull = FailureSwing(), FailureSwing()

    def rsi(self, close: float) -> float | None:
        last, self.last = self.last, close
        if last is None:
            return None
        up, down = self.up.push(max(close - last, 0.0)), self.down.push(max(last - close, 0.0))
        if up is None or down is None:
            return None
        return 50.0 if up == 0 and down == 0 else 100 - 100 / (1 + up / (down + EPS))

    def step(self, close):
        rsi = self.rsi(close)
        if rsi is None:
            return None, "WARMUP", "NONE"
        bear, bull = self.bear.push(rsi), self.bull.push(100 - rsi)
        return rsi, "BULLISH" if rsi >= 55 else "BEARISH" if rsi <= 45 else "RANGE", "BULL" if bull else "BEAR" if bear else "NONE"


class StochTiming(Kernel):
    """Place of the RSI among its last values (0 to 1; fewer at the start), %K and %D, and zone."""

    reads = ("close",)
    makes = (("timing_k", "double"), ("timing_d", "double"), ("stoch_zone", "string"))

    def __init__(self, n: int = 14, span: int = 14, k: int = 3, d: int = 3):
        self.source, self.held, self.k, self.d = RsiTiming(n), deque(maxlen=span), Mean(k), Mean(d)

    def step(self, close):
        rsi = self.source.rsi(close)
        if rsi is None:
            return None, None, "WARMUP"
        self.held.append(rsi)
        low, high = min(self.held), max(self.held)
        k = self.k.push(0.5 if high - low < EPS else min(max((rsi - low) / (high - low + EPS), 0.0), 1.0))
        if k is None:
            return None, None, "WARMUP"
        return k, self.d.push(k), "OVERSOLD" if k <= 0.2 else "OVERBOUGHT" if k >= 0.8 else "NEUTRAL"


class Smooth(Kernel):
    """Average of a column over five values, started by the first."""

    reads = ("strength_raw",)
    makes = (("strength_smooth", "double"),)

    def __init__(self, n: int = 5):
        self.average = Average(n, seeded=False)

    def step(self, x):
        return (None if x is None else self.average.push(x),)


def trend_strength(rows: DataFrame, tf: str) -> DataFrame:
    """From slope_50, ribbon_width_rate, rv, oi_now, oi_prev, atr_pct, direction_bias, is_range and is_chop (each may be null): the weighted share of what is known, smoothed, capped and signed, with its bucket."""
    reference = {"1m": 0.003, "5m": 0.006, "1h": 0.02}.get(tf, 0.006)
    parts = [
        clip(F.abs("slope_50") / (0.2 * F.col("atr_pct") + EPS), 0.0, 1.0),
        clip((F.col("ribbon_width_rate") + 0.1) / (0.3 + EPS), 0.0, 1.0),
        clip((F.col("rv") - 0.8) / (1.2 + EPS), 0.0, 1.0),
        clip(F.abs((F.col("oi_now") - F.col("oi_prev")) / (F.col("oi_prev") + EPS)) / (reference + EPS), 0.0, 1.0),
    ]
    inputs = (F.col("slope_50"), F.col("ribbon_width_rate"), F.col("rv"), F.col("oi_now") * F.col("oi_prev"))
    weights = (0.35, 0.25, 0.2, 0.2)
    known = [F.when(x.isNotNull(), w).otherwise(0.0) for x, w in zip(inputs, weights, strict=True)]
    total = sum(known, F.lit(0.0))
    sums = sum((F.when(x.isNotNull(), w * p).otherwise(0.0) for x, w, p in zip(inputs, weights, parts, strict=True)), F.lit(0.0))
    rows = scan(rows.withColumn("strength_raw", F.when(total > 0, 100 * sums / total).otherwise(0.0)), [Smooth])
    none = F.lit(100.0)
    capped = F.least(F.col("strength_smooth"), F.when(F.col("is_range"), 50.0).otherwise(none), F.when(F.col("is_chop"), 50.0).otherwise(none), F.when(F.col("rv") < 0.3, 25.0).otherwise(none))
    rows = rows.withColumn("strength", capped)
    s = F.col("strength")
    return rows.withColumns({"strength_signed": s * F.coalesce("direction_bias", F.lit(0)), "strength_bucket": ladder((s <= 30, "WEAK"), (s <= 60, "EMERGING"), otherwise="STRONG")})


def divergences(bars: DataFrame, pivot: int = 5, apart: int = 3, factor: float = 0.15) -> DataFrame:
    """Pivots against the one before on the same side: price and RSI that disagree are regular or hidden divergences, if the pivots are ``apart`` bars or more and the prices differ enough against the ATR share; small ones need three points of RSI. With a strength of 0 to 100."""
    rows = scan(with_pivots(bars, pivot), [RsiTiming, Atr]).withColumn("__i", F.row_number().over(series()))
    found = None
    for side, way in (("high", 1), ("low", -1)):
        name = f"swing_{side}"
        own = rows.where(F.col(name).isNotNull() & F.col("timing_rsi").isNotNull())
        w = series()
        p, q = F.col(name), F.lag(name).over(w)
        r, s = F.col("timing_rsi"), F.lag("timing_rsi").over(w)
        own = own.withColumns({"__dp": (p - q) * way, "__dr": (r - s) * way, "__n": F.col("__i") - F.lag("__i").over(w), "__least": F.coalesce(factor * F.col("atr") / (F.col("close") + EPS), F.lit(0.001)) * p})
        dp, dr, least = F.abs("__dp"), F.abs("__dr"), F.col("__least")
        kind = ladder(((F.col("__dp") > 0) & (F.col("__dr") <= 0), "REG"), ((F.col("__dp") <= 0) & (F.col("__dr") > 0), "HID"), otherwise=None)
        fit = (F.col("__n") >= apart) & (dp >= least) & ((dp >= 2 * least) | (dr >= 3.0))
        strength = 100 * (0.5 * F.least(dp / (least + EPS), F.lit(3.0)) / 3 + 0.5 * F.least(dr / 10, F.lit(3.0)) / 3)
        own = own.withColumns({"divergence": F.concat(kind, F.lit("_BEAR" if way == 1 else "_BULL")), "divergence_strength": strength}).where(fit & F.col("divergence").isNotNull())
        own = own.select("symbol", "tf", "ts", "seq", p.alias("price"), "timing_rsi", "divergence", "divergence_strength")
        found = own if found is None else found.union(own)
    return found


def micro_timing(rows: DataFrame, confirm: int = 2, allowed: Column | None = None) -> DataFrame:
    """Ends of pullbacks: %K leaves its zone on the side of ``bias`` (1 or -1), or crosses %D within the outer thirty per cent, for ``confirm`` rows in a row; with confidence. Needs timing_k, timing_d and bias; ``allowed`` gates rows."""
    w = series()
    way = F.col("bias")
    # For shorts the range is turned round, so that one rule serves both sides.
    turn = lambda x: F.when(way == -1, 1 - x).otherwise(x)
    k, d = turn(F.col("timing_k")), turn(F.col("timing_d"))
    pk, pd = turn(F.lag("timing_k").over(w)), turn(F.lag("timing_d").over(w))
    leaves = (pk < 0.2) & (k > 0.2) & (k > pk)
    crosses = (k <= 0.3) & (d <= 0.3) & (pk <= pd) & (k > d)
    fit = (way != 0) & F.col("timing_d").isNotNull() & (leaves | crosses)
    fit = F.coalesce(fit if allowed is None else fit & allowed, F.lit(False))
    rows = rows.withColumns({"__c": F.when(fit, way).otherwise(0), "__k": k, "__d": d})
    held = F.count(F.lit(1)).over(last_rows(confirm)) == confirm
    for i in range(1, confirm):
        held &= F.lag("__c", i).over(w) == F.col("__c")
    event = F.when(held & (F.col("__c") == 1), "PULLBACK_DONE_UP").when(held & (F.col("__c") == -1), "PULLBACK_DONE_DOWN").otherwise("NONE")
    sure = 100 * F.least(clip((F.col("__k") - 0.2) / (0.3 + EPS), 0.0, 1.0) + F.when(F.col("__k") > F.col("__d"), 0.2).otherwise(0.0), F.lit(1.0))
    return rows.withColumns({"micro_timing": event, "micro_confidence": F.when(event != "NONE", sure)}).drop("__c", "__k", "__d")
