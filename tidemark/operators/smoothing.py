"""Kernels for exponential averages and what builds on them."""

from __future__ import annotations

import math
from collections import deque

from .scan import Kernel

EPS = 1e-12


class Average:
    """Exponential average with weight ``alpha``, started by the plain mean of the first n values (null before). Wilder's has alpha = 1 / n."""

    def __init__(self, n: int, alpha: float | None = None, seeded: bool = True):
        self.n, self.alpha = n, 2 / (n + 1) if alpha is None else alpha
        self.seen, self.total, self.value = 0, 0.0, None
        self.first = n if seeded else 1

    def push(self, x: float) -> float | None:
        if self.value is not None:
            self.value += self.alpha * (x - self.value)
        else:
            self.seen += 1
            self.total += x
            if self.seen == self.first:
                self.value = self.total / self.first
        return self.value


class Mean:
    """Mean of the last n values, null before there are n."""

    def __init__(self, n: int):
        self.held: deque = deque(maxlen=n)

    def push(self, x: float) -> float | None:
        self.held.append(x)
        return math.fsum(self.held) / len(self.held) if len(self.held) == self.held.maxlen else None


class Range:
    """Previous close and the true range of each bar."""

    def __init__(self):
        self.close: float | None = None

    def push(self, high: float, low: float, close: float) -> float:
        last, self.close = self.close, close
        return high - low if last is None else max(high - low, abs(high - last), abs(low - last))


def ema(*periods: int) -> type[Kernel]:
    """Columns ema_<n> of the close."""

    class Ema(Kernel):
        reads = ("close",)
        makes = tuple((f"ema_{n}", "double") for n in periods)

        def __init__(self):
            self.averages = [Average(n) for n in periods]

        def step(self, close):
            return tuple(a.push(close) for a in self.averages)

    return Ema


class Rsi(Kernel):
    """Wilder's RSI; the bar that completes the start means has none, and without losses it is 100."""

    reads = ("close",)
    makes = (("rsi", "double"),)

    def __init__(self, n: int = 14):
        self.last, self.up, self.down = None, Average(n, 1 / n), Average(n, 1 / n)

    def step(self, close):
        last, self.last = self.last, close
        if last is None:
            return (None,)
        ready = self.up.value is not None
        up, down = self.up.push(max(close - last, 0.0)), self.down.push(max(last - close, 0.0))
        if not ready:
            return (None,)
        return (100.0 if abs(down) <= 1e-9 else 100 - 100 / (1 + up / down),)


class StochRsi(Kernel):
    """Place of the RSI in its last values' range, in per cent (50 if flat), smoothed to %K and again to %D."""

    reads = ("close",)
    makes = (("stoch_k", "double"), ("stoch_d", "double"))

    def __init__(self, n: int = 14, span: int = 14, k: int = 3, d: int = 3):
        self.rsi, self.held, self.k, self.d = Rsi(n), deque(maxlen=span), Mean(k), Mean(d)

    def step(self, close):
        (rsi,) = self.rsi.step(close)
        if rsi is None:
            return None, None
        self.held.append(rsi)
        if len(self.held) < self.held.maxlen:
            return None, None
        low, high = min(self.held), max(self.held)
        k = self.k.push(50.0 if high == low else (rsi - low) / (high - low) * 100)
        return k, None if k is None else self.d.push(k)


class Macd(Kernel):
    reads = ("close",)
    makes = (("macd", "double"), ("macd_signal", "double"), ("macd_hist", "double"))

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = Average(fast), Average(slow), Average(signal)

    def step(self, close):
        fast, slow = self.fast.push(close), self.slow.push(close)
        if slow is None or fast is None:
            return None, None, None
        signal = self.signal.push(fast - slow)
        return fast - slow, signal, None if signal is None else fast - slow - signal


class Atr(Kernel):
    """Wilder's average true range over the bars from the second on."""

    reads = ("high", "low", "close")
    makes = (("atr", "double"),)

    def __init__(self, n: int = 14):
        self.range, self.mean, self.first = Range(), Average(n, 1 / n), True

    def step(self, high, low, close):
        tr, first, self.first = self.range.push(high, low, close), self.first, False
        return (None,) if first else (self.mean.push(tr),)


class Supertrend(Kernel):
    """Line and direction by bands around the middle price; starts upwards on the lower band, and holds a band until the close crosses it."""

    reads = ("high", "low", "close")
    makes = (("supertrend", "double"), ("uptrend", "boolean"))

    def __init__(self, n: int = 10, width: float = 3.0):
        self.range, self.mean, self.width = Range(), Mean(n), width
        self.first, self.line, self.up = True, None, True

    def step(self, high, low, close):
        tr, first, self.first = self.range.push(high, low, close), self.first, False
        atr = None if first else self.mean.push(tr)
        if atr is None:
            return None, None
        upper, lower = (high + low) / 2 + self.width * atr, (high + low) / 2 - self.width * atr
        if self.line is None:
            self.line = lower
        elif self.up:
            self.up = close >= self.line
            self.line = max(lower, self.line) if self.up else upper
        else:
            self.up = close > self.line
            self.line = lower if self.up else min(upper, self.line)
        return self.line, self.up


class AtrExpansion(Kernel):
    """Wilder's ATR from the first bar on, and its expansion over its own mean: with slope, spike of the true range, state and score."""

    reads = ("high", "low", "close")
    makes = (("atr", "double"), ("atr_pct", "double"), ("atr_exp", "double"), ("tr_spike", "double"), ("atr_exp_slope", "double"), ("vol_state", "string"), ("vol_score", "double"), ("shock", "boolean"))

    def __init__(self, n: int = 14, mean: int = 20, squeeze: float = 0.8, expansion: float = 1.2, extreme: float = 1.6, spike: float = 1.5, fade: float = -0.05):
        self.range, self.atr, self.tr_mean, self.atr_mean, self.last = Range(), Average(n, 1 / n), Mean(mean), Mean(mean), None
        self.squeeze, self.expansion, self.extreme, self.spike, self.fade = squeeze, expansion, extreme, spike, fade

    def step(self, high, low, close):
        tr = self.range.push(high, low, close)
        atr, tr_mean = self.atr.push(tr), self.tr_mean.push(tr)
        atr_mean = None if atr is None else self.atr_mean.push(atr)
        ratio = None if atr_mean is None else atr / (atr_mean + EPS)
        spike = None if tr_mean is None else tr / (tr_mean + EPS)
        slope = None if ratio is None or self.last is None else ratio - self.last
        self.last = ratio
        shock = spike is not None and spike >= self.spike
        state, score = ("WARMUP", None) if ratio is None else self.judged(ratio, slope, shock)
        return atr, None if atr is None else atr / (close + EPS), ratio, spike, slope, state, score, shock

    def judged(self, ratio: float, slope: float | None, shock: bool) -> tuple[str, float]:
        score = 100 * min(max((ratio - self.squeeze) / (self.extreme - self.squeeze + EPS), 0.0), 1.0)
        fading = ratio >= self.expansion and slope is not None and slope <= self.fade
        for state, holds, most in (("FADE_RISK", fading, 100.0), ("SQUEEZE", ratio < self.squeeze, 30.0), ("EXTREME", ratio >= self.extreme, 100.0), ("EXPANSION", ratio >= self.expansion, 85.0), ("NORMAL", True, 60.0)):
            if holds:
                score = min(min(score, most) + 5 * shock, 100.0)
                return state, max(score - 10, 0.0) if fading else score
        raise AssertionError


class BandwidthState(Kernel):
    """Bollinger bandwidth smoothed over three bars against its own mean over fifty."""

    reads = ("bandwidth",)
    makes = (("bw_smooth", "double"), ("bw_slope", "double"), ("bw_ratio", "double"), ("bw_state", "string"), ("bw_score", "double"))

    def __init__(self, smooth: int = 3, mean: int = 50, compress: float = 0.8, expand: float = 1.2, extreme: float = 1.6, fade: float = -0.02):
        self.smooth, self.mean, self.last = Average(smooth, seeded=False), Mean(mean), None
        self.compress, self.expand, self.extreme, self.fade = compress, expand, extreme, fade

    def step(self, bandwidth):
        if bandwidth is None:
            return None, None, None, "WARMUP", None
        value = self.smooth.push(bandwidth)
        slope = None if self.last is None else value - self.last
        self.last = value
        mean = self.mean.push(value)
        if mean is None:
            return value, slope, None, "WARMUP", None
        ratio = value / (mean + EPS)
        score = 100 * min(max((ratio - self.compress) / (self.extreme - self.compress + EPS), 0.0), 1.0)
        if ratio >= self.expand and slope is not None and slope <= self.fade:
            return value, slope, ratio, "FADE_RISK", max(score - 10, 0.0)
        for state, holds, most in (("COMPRESSED", ratio < self.compress, 30.0), ("EXTREME", ratio >= self.extreme, 100.0), ("EXPANDING", ratio >= self.expand, 85.0), ("NORMAL", True, 60.0)):
            if holds:
                return value, slope, ratio, state, min(score, most)
        raise AssertionError


class LockedBands(Kernel):
    """Bands around the middle price by Wilder's ATR; a band moves inwards only, unless the last close was beyond it. The direction turns when a close leaves the bands."""

    reads = ("high", "low", "close")
    makes = (("band_atr", "double"), ("upper_band", "double"), ("lower_band", "double"), ("direction", "string"))

    def __init__(self, n: int = 10, width: float = 3.0):
        self.range, self.atr, self.width = Range(), Average(n, 1 / n), width
        self.upper = self.lower = 0.0
        self.bars, self.direction = 0, "UP"

    def step(self, high, low, close):
        last = self.range.close
        atr = self.atr.push(self.range.push(high, low, close))
        self.bars += 1
        if atr is None:
            return None, None, None, None
        middle, reach = (high + low) / 2, self.width * atr
        start = self.bars <= 2
        if start or middle + reach < self.upper or last > self.upper:
            self.upper = middle + reach
        if start or middle - reach > self.lower or last < self.lower:
            self.lower = middle - reach
        if close > self.upper:
            self.direction = "UP"
        elif close < self.lower:
            self.direction = "DOWN"
        return atr, self.upper, self.lower, self.direction
