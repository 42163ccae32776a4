"""Exponential averages as compositions of affine maps, with one series dealt to many tasks.

A step of an average is the map y -> b * y + a * x with b = 1 - a. Over the rows
of a chunk the maps compose to y -> b^k * y + s, where s is the same average
started from nothing; it is a window's sum of the rows weighted by powers of b. The ends of the
chunks are a small table, one row for each chunk, in which the value that a chunk
starts from is found from those of the chunks before it; adding its share to s gives the average itself. Everything is
columns: nothing here leaves the JVM.

A chunk further back than the value's last bit weighs nothing: b^(length * lags) is
below 2^-70 then, and later chunks aren't looked at. Rows of a null symbol take no part.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ladder, last_rows, series, so_far
from ..sources.storage import stored
from .ordered import LENGTH, apart, numbered, whole

LEAST_BITS = 70


class Average(NamedTuple):
    """Average of ``x`` with weight ``alpha`` for the newest value, from row ``start`` of the series on, begun by the mean of its first ``n`` values (or its first, if not ``seeded``); null before."""

    x: Column
    n: int
    alpha: float
    start: int = 0
    seeded: bool = True

    @property
    def first(self) -> int:
        return self.start + self.n - 1 if self.seeded else self.start


def exponential(x: Column, n: int, start: int = 0, seeded: bool = True) -> Average:
    return Average(x, n, 2 / (n + 1), start, seeded)


def wilder(x: Column, n: int, start: int = 0) -> Average:
    return Average(x, n, 1 / n, start)


def with_averages(rows: DataFrame, averages: dict[str, Average], context: int = 0, length: int = LENGTH) -> DataFrame:
    """Rows of ``apart`` with a column for each average, right from ``pos`` -context on (earlier ones serve to find the values x only)."""
    local, tails = {}, {}
    k = F.col("pos") + context
    for name, a in averages.items():
        decay = 1 - a.alpha
        if a.first >= length - context:
            raise ValueError(f"{name} begins at row {a.first}; chunks of {length} rows are too short")
        if decay > 0 and -(length + context) * math.log2(decay) > 1000:
            raise ValueError(f"{name}: weights of {length} rows leave the range of doubles; take shorter chunks")
        x = a.x.cast("double")
        begin = F.avg(x).over(last_rows(a.n)) if a.seeded else x
        share = F.when((F.col("n") < a.first) | (k < 0), 0.0).when(F.col("n") == a.first, begin).otherwise(a.alpha * x)
        weighted = F.sum(share * F.pow(F.lit(decay), -k)).over(so_far()) * F.pow(F.lit(decay), k) if decay > 0 else share
        local[f"__{name}"] = weighted
        tails[name] = (decay, 1 if decay <= 0 else max(1, math.ceil(LEAST_BITS / (-length * math.log2(decay)))))
    begun = rows.withColumns(local)
    # the value right before the next chunk's first row that counts
    ends = begun.where(F.col("pos") == length - context - 1).select("symbol", F.col("series_tf").alias("__name"), (F.col("chunk") + 1).alias("__chunk"), *[F.col(f"__{n}").alias(f"__end_{n}") for n in averages])
    past = Window.partitionBy("symbol", "__name").orderBy("__chunk")
    started = {}
    for name, (decay, lags) in tails.items():
        started[f"__from_{name}"] = sum((F.coalesce(F.lag(f"__end_{name}", j).over(past), F.lit(0.0)) * decay ** (length * j) for j in range(1, lags)), F.coalesce(F.col(f"__end_{name}"), F.lit(0.0)))
    ends = ends.withColumns(started).select("symbol", F.concat_ws("#", "__name", "__chunk").alias("tf"), *started)
    joined = begun.join(ends, ["symbol", "tf"], "left")
    made = {}
    for name, (decay, _) in tails.items():
        carried = F.col(f"__{name}") + F.coalesce(F.col(f"__from_{name}"), F.lit(0.0)) * F.pow(F.lit(max(decay, 0.0)), k + 1)
        made[name] = F.when((F.col("n") >= averages[name].first) & (k >= 0), carried)
    return joined.withColumns(made).drop(*local, *started)


def _moves() -> tuple[Column, Column]:
    step = F.col("close") - F.lag("close").over(series())
    return F.greatest(step, F.lit(0.0)), F.greatest(-step, F.lit(0.0))


def _true_range() -> Column:
    last = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def with_ema(bars: DataFrame, *periods: int, before: int = 0, length: int = LENGTH) -> DataFrame:
    """Chunks with columns ema_<n> of the close."""
    rows = apart(numbered(bars), before, length)
    return with_averages(rows, {f"ema_{n}": exponential(F.col("close"), n) for n in periods}, before, length)


def with_rsi(bars: DataFrame, n: int = 14, before: int = 1, length: int = LENGTH) -> DataFrame:
    """Chunks with Wilder's ``rsi``: none at the bar that completes the first means, and 100 without losses."""
    up, down = _moves()
    rows = apart(numbered(bars), before + 1, length).withColumns({"__up": up, "__down": down})
    rows = with_averages(rows, {"__gain": wilder(F.col("__up"), n, 1), "__loss": wilder(F.col("__down"), n, 1)}, before, length)
    value = F.when(F.abs("__loss") <= 1e-9, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("__gain"), F.col("__loss"))))
    return rows.withColumn("rsi", F.when(F.col("n") > n, value)).drop("__up", "__down", "__gain", "__loss")


def with_stoch_rsi(bars: DataFrame, n: int = 14, span: int = 14, k: int = 3, d: int = 3, before: int = 1, length: int = LENGTH) -> DataFrame:
    """Chunks with ``stoch_k`` and ``stoch_d``: the RSI's place in its last values' range, in per cent (50 if flat to 1e-9), smoothed and smoothed again."""
    rows = with_rsi(bars, n, before + span + k + d - 3, length)

    def mean(x: Column, m: int) -> Column:
        return F.when(F.count(x).over(last_rows(m)) == m, F.avg(x).over(last_rows(m)))

    low, high = F.min("rsi").over(last_rows(span)), F.max("rsi").over(last_rows(span))
    place = F.when(high - low <= 1e-9, 50.0).otherwise((F.col("rsi") - low) / F.nullif(high - low, F.lit(0.0)) * 100)
    rows = rows.withColumn("__place", F.when(F.count("rsi").over(last_rows(span)) == span, place))
    rows = rows.withColumn("stoch_k", mean(F.col("__place"), k))
    return rows.withColumn("stoch_d", mean(F.col("stoch_k"), d)).drop("__place")


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, before: int = 0, length: int = LENGTH) -> DataFrame:
    """Chunks with ``macd``, ``macd_signal`` and ``macd_hist``; rows before there is a macd stay, as nulls."""
    rows = apart(numbered(bars), before, length)
    rows = with_averages(rows, {"__fast": exponential(F.col("close"), fast), "__slow": exponential(F.col("close"), slow)}, before, length)
    rows = stored(rows.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow"))  # else the averages run once more for the signal's
    rows = with_averages(rows, {"macd_signal": exponential(F.col("macd"), signal, slow - 1)}, before, length)
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def with_atr(bars: DataFrame, n: int = 14, before: int = 0, length: int = LENGTH) -> DataFrame:
    """Chunks with Wilder's ``atr`` over the bars from the second on."""
    rows = apart(numbered(bars), before + 1, length).withColumn("__range", _true_range())
    return with_averages(rows, {"atr": wilder(F.col("__range"), n, 1)}, before, length).drop("__range")


def atr_expansion(bars: DataFrame, n: int = 14, mean: int = 20, squeeze: float = 0.8, expansion: float = 1.2, extreme: float = 1.6, spike: float = 1.5, fade: float = -0.05, length: int = LENGTH) -> DataFrame:
    """Wilder's ATR from the first bar on against its own mean: atr, atr_pct, atr_exp (their ratio), tr_spike, atr_exp_slope, vol_state, vol_score and shock. WARMUP and no score while the mean isn't full."""
    eps = 1e-12
    rows = apart(numbered(bars), mean + 2, length).withColumn("__range", _true_range())
    rows = with_averages(rows, {"atr": wilder(F.col("__range"), n)}, mean + 1, length)
    full = lambda c: F.when(F.count(c).over(last_rows(mean)) == mean, F.avg(c).over(last_rows(mean)))
    rows = rows.withColumns({"atr_pct": F.col("atr") / (F.col("close") + eps), "atr_exp": F.col("atr") / (full("atr") + eps), "tr_spike": F.col("__range") / (full("__range") + eps)})
    rows = rows.withColumn("atr_exp_slope", F.col("atr_exp") - F.lag("atr_exp").over(series()))
    x, slope, shock = F.col("atr_exp"), F.col("atr_exp_slope"), F.coalesce(F.col("tr_spike") >= spike, F.lit(False))
    fading = F.coalesce((x >= expansion) & (slope <= fade), F.lit(False))
    state = ladder((x.isNull(), "WARMUP"), (fading, "FADE_RISK"), (x < squeeze, "SQUEEZE"), (x >= extreme, "EXTREME"), (x >= expansion, "EXPANSION"), otherwise="NORMAL")
    most = ladder((fading, 100.0), (x < squeeze, 30.0), (x >= extreme, 100.0), (x >= expansion, 85.0), otherwise=60.0)
    base = 100 * clip((x - squeeze) / (extreme - squeeze + eps), 0.0, 1.0)
    score = F.least(F.least(base, most) + F.when(shock, 5.0).otherwise(0.0), F.lit(100.0))
    made = {"vol_state": state, "vol_score": F.when(x.isNotNull(), F.when(fading, F.greatest(score - 10, F.lit(0.0))).otherwise(score)), "shock": shock}
    return whole(rows.withColumns(made).drop("__range"))


def ema(bars: DataFrame, *periods: int, length: int = LENGTH) -> DataFrame:
    return whole(with_ema(bars, *periods, length=length))


def rsi(bars: DataFrame, n: int = 14, length: int = LENGTH) -> DataFrame:
    return whole(with_rsi(bars, n, length=length))


def stoch_rsi(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    return whole(with_stoch_rsi(bars, length=length))


def macd(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    return whole(with_macd(bars, length=length))


def atr(bars: DataFrame, n: int = 14, length: int = LENGTH) -> DataFrame:
    return whole(with_atr(bars, n, length=length))
