"""Signals of bars from scanned averages: crossings, zones, bands and trend filters, as column expressions over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, last_rows, safe_divide, series, so_far
from . import smoothing as S
from .kernels import with_bollinger
from .scan import scan


def scanned(bars: DataFrame) -> DataFrame:
    """All scanned kernels at once: one shuffle and one pass."""
    return scan(bars, [S.ema(20, 50), S.Rsi, S.StochRsi, S.Macd, S.Atr, S.Supertrend])


def _crossed(x: Column, y: Column) -> tuple[Column, Column]:
    """Whether x rose above y, or fell below it, since the row before."""
    px, py = F.lag(x).over(series()), F.lag(y).over(series())
    known = px.isNotNull() & py.isNotNull()
    return known & (px <= py) & (x > y), known & (px >= py) & (x < y)


def moving_average_signal(rows: DataFrame) -> DataFrame:
    """ma_signal and ma_strength from a short and a long average (ema_20, ema_50)."""
    c, short, long = F.col("close"), F.col("ema_20"), F.col("ema_50")
    golden, death = _crossed(short, long)
    up, down = (c > short) & (c > long) & (short > long), (c <= short) & (c <= long) & (short <= long)
    ready = long.isNotNull()
    signal = ladder((~ready, "neutral"), (golden, "bullish"), (death, "bearish"), (up, "bullish"), (down, "bearish"), otherwise="neutral")
    strength = ladder((~ready, 50.0), (golden | death, 85.0), (up | down, 75.0), ((c > long) & (c <= short), 55.0), otherwise=50.0)
    return rows.withColumns({"ma_signal": signal, "ma_strength": strength, "ma_distance_pct": F.when(ready, safe_divide(c - short, short) * 100).otherwise(0.0)})


def rsi_signal(rows: DataFrame) -> DataFrame:
    r = F.col("rsi")
    before = F.coalesce(F.lag("rsi").over(series()), r)
    rising, falling = (r > before) & (r > 50), (r < before) & (r < 50)
    signal = ladder((r.isNull(), "neutral"), (r > 70, "bearish"), (r < 30, "bullish"), (r.between(45, 55), "neutral"), (rising, "bullish"), (falling, "bearish"), otherwise="neutral")
    strength = ladder((r.isNull(), 50.0), (r > 80, F.least(F.lit(85.0), r - 20)), (r > 70, 65.0), (r < 20, F.least(F.lit(85.0), 80 - r)), (r < 30, 65.0), (r.between(45, 55), 50.0), (rising | falling, 55.0), otherwise=50.0)
    return rows.withColumns({"rsi_signal": signal, "rsi_strength": strength})


def macd_signal(rows: DataFrame) -> DataFrame:
    h = F.col("macd_hist")
    step = h - F.coalesce(F.lag("macd_hist").over(series()), h)
    up, down = _crossed(F.col("macd"), F.col("macd_signal"))
    signal = ladder((h.isNull(), "neutral"), (up, "bullish"), (down, "bearish"), ((h > 0) & (step != 0), "bullish"), ((h < 0) & (step != 0), "bearish"), otherwise="neutral")
    strength = ladder((h.isNull(), 50.0), (up | down, 85.0), ((h > 0) & (step > 0) | (h < 0) & (step < 0), 70.0), ((h != 0) & (step != 0), 55.0), otherwise=50.0)
    return rows.withColumns({"macd_bias": signal, "macd_strength": strength})


def stoch_rsi_signal(rows: DataFrame) -> DataFrame:
    k, d = F.col("stoch_k"), F.col("stoch_d")
    up, down = _crossed(k, d)
    none = d.isNull()
    signal = ladder((none, "neutral"), (up & (k < 30), "bullish"), (down & (k > 70), "bearish"), (k > 80, "bearish"), (k < 20, "bullish"), (up, "bullish"), (down, "bearish"), otherwise="neutral")
    strength = ladder((none, 50.0), (up & (k < 30) | down & (k > 70), 85.0), ((k > 90) | (k < 10), 75.0), ((k > 80) | (k < 20), 65.0), (up | down, 60.0), otherwise=50.0)
    return rows.withColumns({"stoch_signal": signal, "stoch_strength": strength})


def atr_signal(rows: DataFrame) -> DataFrame:
    """atr as a share of the close (per cent), its ratio to the mean of the last 20 (fewer at the start), and strength; the signal is always neutral."""
    ratio = safe_divide(F.col("atr"), F.avg("atr").over(last_rows(20)), 1.0)
    out = rows.withColumns({"atr_ratio": F.when(F.col("atr").isNotNull(), ratio), "atr_close_pct": F.try_divide(F.col("atr"), F.col("close")) * 100})
    r = F.col("atr_ratio")
    return out.withColumn("atr_strength", ladder((r.isNull(), 50.0), (r > 1.5, 75.0), (r > 1.2, 60.0), (r < 0.6, 60.0), (r < 0.8, 55.0), otherwise=50.0))


def supertrend_signal(rows: DataFrame) -> DataFrame:
    """Flip or bars in a row (19 at most, one where the line begins) since the trend last changed."""
    up, w = F.col("uptrend"), series()
    before = F.lag("uptrend").over(w)
    flipped = before.isNotNull() & (before != up)
    out = rows.withColumns({"__flip": flipped, "__run": F.sum(F.when(flipped, 1).otherwise(0)).over(so_far())})
    runs = series(("symbol", "tf", "__run"))
    out = out.withColumn("trend_bars", F.when(up.isNotNull(), F.least(F.lit(19), F.sum(F.when(F.col("uptrend").isNotNull(), 1)).over(runs.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).cast("int"))
    strength = ladder((up.isNull(), 50.0), (F.col("__flip"), 85.0), otherwise=F.least(F.lit(75.0), 55.0 + F.col("trend_bars") * 2))
    return out.withColumns({"supertrend_signal": ladder((up.isNull(), "neutral"), (up, "bullish"), otherwise="bearish"), "supertrend_strength": strength}).drop("__flip", "__run")


def vwap_signal(rows: DataFrame) -> DataFrame:
    p = F.col("vwap_distance_pct")
    out = rows.withColumn("vwap_distance_pct", safe_divide(F.col("close") - F.col("vwap"), F.col("vwap")) * 100)
    signal = ladder((p > 0.5, "bullish"), (p < -0.5, "bearish"), otherwise="neutral")
    strength = ladder((F.abs(p) > 2, F.least(F.lit(80.0), 60 + F.abs(p) * 5)), (F.abs(p) > 0.5, 60.0), otherwise=50.0)
    return out.withColumns({"vwap_signal": signal, "vwap_strength": strength})


def bollinger_signal(bars: DataFrame) -> DataFrame:
    out = with_bollinger(bars)
    c, upper, lower, width = (F.col(x) for x in ("close", "bb_upper", "bb_lower", "bb_width"))
    ready = width.isNotNull()
    out = out.withColumns({"percent_b": F.when(ready, safe_divide(c - lower, upper - lower, 0.5) * 100), "bb_squeeze": F.when(ready, safe_divide(width, F.avg("bb_width").over(last_rows(20)), 1.0) < 0.7)})
    b = F.col("percent_b")
    signal = ladder((~ready, "neutral"), (c > upper, "bullish"), (c < lower, "bearish"), (b > 80, "bearish"), (b < 20, "bullish"), otherwise="neutral")
    base = ladder((~ready, 50.0), ((c > upper) | (c < lower), 70.0), ((b > 80) | (b < 20), 60.0), otherwise=50.0)
    return out.withColumns({"bb_signal": signal, "bb_strength": F.when(F.col("bb_squeeze"), F.least(base + 10, F.lit(90.0))).otherwise(base)})


#: Slope lookbacks and fixed thresholds by interval, where no ATR share is known.
EMA_LOOKBACK = {"15s": 20, "1m": 15, "5m": 10, "15m": 8, "1h": 4, "4h": 3}
EMA_SLOPE = {"15s": 0.0001, "1m": 0.0002, "5m": 0.0002, "15m": 0.0005, "1h": 0.001, "4h": 0.002}
EMA_WIDTH = {"15s": 0.0004, "1m": 0.0006, "5m": 0.001, "15m": 0.0015, "1h": 0.002, "4h": 0.004}
EMA_EXTENDED = {"15s": 0.001, "1m": 0.0015, "5m": 0.003, "15m": 0.005, "1h": 0.008, "4h": 0.015}


def ema_filter(bars: DataFrame, tf: str, atr_pct: str | None = None) -> DataFrame:
    """Averages over 9, 21 and 50 bars, slopes, ribbon width and extension, with bias, regime, alignment and strength.

    Thresholds follow the column ``atr_pct`` where it is positive, else the interval.
    """
    k = EMA_LOOKBACK.get(tf, 10)
    rows = scan(bars, [S.ema(9, 21, 50)]).where("ema_50 is not null")
    c, e9, e21, e50 = (F.col(x) for x in ("close", "ema_9", "ema_21", "ema_50"))
    slope = lambda e: F.coalesce((F.col(e) - F.first(e).over(last_rows(k + 1))) / F.nullif(F.first(e).over(last_rows(k + 1)), F.lit(0.0)), F.lit(0.0))
    share = F.col(atr_pct) if atr_pct else F.lit(None).cast("double")
    known = share > 0
    width_fixed = EMA_WIDTH.get(tf, 0.001)
    rows = rows.withColumns(
        {
            "slope_21": slope("ema_21"),
            "slope_50": slope("ema_50"),
            "ribbon_width": (F.greatest(e9, e21, e50) - F.least(e9, e21, e50)) / (c + 1e-10),
            "ext_21": F.abs(c - e21) / (c + 1e-10),
            "__s": F.when(known, 0.15 * share).otherwise(EMA_SLOPE.get(tf, 0.0002)),
            "__w": F.when(known, 0.1 * share).otherwise(width_fixed),
            "__x": F.when(known, 0.6 * share).otherwise(EMA_EXTENDED.get(tf, 0.003)),
            "__p": F.when(known, 0.25 * share).otherwise(max(0.0005, width_fixed * 0.5)),
            "alignment": ladder(((e9 > e21) & (e21 > e50), "STACKED_UP"), ((e9 < e21) & (e21 < e50), "STACKED_DOWN"), otherwise="MIXED"),
        }
    )
    s50, s, w = F.col("slope_50"), F.col("__s"), F.col("__w")
    votes = lambda *flags: sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    bulls = votes(c > e50, s50 > s, F.col("alignment") == "STACKED_UP")
    bears = votes(c < e50, s50 < -s, F.col("alignment") == "STACKED_DOWN")
    quiet = (F.abs(s50) < s * 0.5) & (F.col("ribbon_width") < w)
    rows = rows.withColumns(
        {
            "ema_bias": ladder(((c > e50) & (s50 > s * 0.5), "BULL"), ((c < e50) & (s50 < -s * 0.5), "BEAR"), otherwise="NEUTRAL"),
            "ema_regime": F.when(~quiet & ((bulls >= 2) | (bears >= 2)), "TREND").otherwise("RANGE"),
            "extended": F.col("ext_21") > F.col("__x"),
            "pullback": F.abs(c - e21) <= F.col("__p"),
        }
    )
    one = F.lit(1.0)
    strength = 100 * (
        0.35 * F.least(one, F.abs(s50) / (2 * s + 1e-10)) + 0.25 * F.least(one, F.col("ribbon_width") / (2 * w + 1e-10)) + 0.25 * F.when(F.col("alignment") == "MIXED", 0.4).otherwise(1.0) + 0.15 * F.when(F.col("ema_bias") == "NEUTRAL", 0.5).otherwise(1.0)
    )
    capped = F.when(F.col("ema_regime") == "RANGE", F.least(strength, F.lit(40.0))).otherwise(strength)
    return rows.withColumn("trend_strength", F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped))).drop("__s", "__w", "__x", "__p")


def supertrend_regime(bars: DataFrame, window: int = 20, hold: int = 3, near: float = 0.15) -> DataFrame:
    """Direction by locked bands, bars since the last flip, flip rate and mean distance over a window, with regime and strength (CHOP and 0 until the window is full)."""
    rows = scan(bars, [S.LockedBands]).where("band_atr is not null")
    c, w = F.col("close"), series()
    before = F.coalesce(F.lag("direction").over(w), F.lit("UP"))
    rows = rows.withColumn("flip", (before != F.col("direction")).cast("int"))
    rows = rows.withColumns({"__run": F.sum("flip").over(so_far()), "flip_rate": F.sum("flip").over(last_rows(window)) / window, "st_line": F.when(F.col("direction") == "UP", F.col("lower_band")).otherwise(F.col("upper_band")), "__n": F.row_number().over(w)})
    rows = rows.withColumn("hold_bars", F.count(F.lit(1)).over(series(("symbol", "tf", "__run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumns({"__pct": F.col("band_atr") / (c + 1e-10), "__ready": F.col("__n") >= window, "__d": F.when(F.col("__n") >= window, F.abs(c - F.col("st_line")) / (c + 1e-10))})
    rows = rows.withColumn("distance_avg", F.coalesce(F.avg("__d").over(last_rows(window)), F.lit(0.0)))
    rate, pct, far, held = F.col("flip_rate"), F.col("__pct"), F.col("distance_avg"), F.col("hold_bars")
    chop = (rate > 0.1) | (pct < 0.001) & (rate > 0.05) | (far < near * pct)
    trend = F.col("__ready") & ~chop & (rate < 0.05) & (held >= hold)
    one = F.lit(1.0)
    strength = 100 * (0.35 * F.least(one, held / (2.0 * hold)) + 0.35 * (1 - F.least(one, rate / 0.1)) + 0.3 * F.least(one, far / (2 * near * pct + 1e-10)))
    capped = ladder((~F.col("__ready"), 0.0), (trend, strength), otherwise=F.least(strength, F.lit(40.0)))
    return rows.withColumns({"st_regime": F.when(trend, "TREND").otherwise("CHOP"), "st_strength": capped}).drop("__run", "__n", "__pct", "__ready", "__d")


def permitted(rows: DataFrame) -> DataFrame:
    """trend_allowed, long_allowed and short_allowed by :func:`supertrend_regime`: no trend trades in chop, and in a trend only those of its direction. Flips are no entries."""
    trend, up = F.col("st_regime") == "TREND", F.col("direction") == "UP"
    return rows.withColumns({"trend_allowed": trend, "long_allowed": trend & up, "short_allowed": trend & ~up})


def bandwidth(bars: DataFrame) -> DataFrame:
    rows = with_bollinger(bars)
    return scan(rows.withColumn("bandwidth", (F.col("bb_upper") - F.col("bb_lower")) / (F.col("bb_mid") + 1e-12)), [S.BandwidthState])


def atr_expansion(bars: DataFrame) -> DataFrame:
    return scan(bars, [S.AtrExpansion])


def ema_mtf(high: DataFrame, low: DataFrame) -> DataFrame:
    """Pairs each bar of the lower interval with the last one of the higher that began before it ended, and says whether they agree. Both need symbol, ts, ema_bias and ema_regime."""
    both = low.select("symbol", "ts", F.lit(1).alias("__side"), F.col("ema_bias").alias("ltf_bias"), F.lit(None).cast("string").alias("h_bias"), F.lit(None).cast("string").alias("h_regime"))
    both = both.unionByName(high.select("symbol", "ts", F.lit(0).alias("__side"), F.lit(None).cast("string").alias("ltf_bias"), F.col("ema_bias").alias("h_bias"), F.col("ema_regime").alias("h_regime")))

    w = Window.partitionBy("symbol").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumns({"htf_bias": F.last("h_bias", ignorenulls=True).over(w), "htf_regime": F.last("h_regime", ignorenulls=True).over(w)}).where("__side = 1 and htf_bias is not null")
    state = ladder((F.col("htf_regime") == "RANGE", "RANGE_DOMINANT"), ((F.col("htf_bias") == F.col("ltf_bias")) & (F.col("htf_bias") != "NEUTRAL"), "ALIGNED"), otherwise="MIXED")
    return rows.select("symbol", "ts", "htf_bias", "ltf_bias", state.alias("mtf_alignment"))
