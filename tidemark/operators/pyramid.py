"""Windows of many lengths from one pre-aggregation of trades, and the flow signals made of them.

``steps`` brings trades down to one row for each step of time in which there were any.
All windows end with a step and are whole numbers of steps, so each is the sum of step rows: sums
are differences of two running sums from the chunk's start, and extremes, which differences can't give, are the
larger of two running extremes: that of the window's own block of its length up to the step, and that
of the block before from the window's start on. No step without trades is written out, and a symbol's
time is cut into chunks (``ordered.apart``, by step), each with the steps before it that its windows reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, place, safe_divide
from .ordered import apart

#: Chunks have so many times the steps of the longest window.
SPREAD = 4
_ADDED = ("buy", "sell", "notional", "trades")
_LEAST, _MOST = ("low", "begin"), ("high",)


def steps(trades: DataFrame, ms: int) -> DataFrame:
    """Per symbol and step ``n`` (its end is (n + 1) * ms): volume by side, notional, count, open, high, low, close, and the times of the first and last trade. Trades of one time count in the order of trade_id."""
    at, order = F.unix_millis("ts"), place(F.col("ts"), F.col("trade_id"))
    q, sold = F.col("quantity"), F.col("is_buyer_maker")
    return trades.groupBy("symbol", F.floor(at / ms).alias("n")).agg(
        F.sum(F.when(~sold, q).otherwise(0.0)).alias("buy"),
        F.sum(F.when(sold, q).otherwise(0.0)).alias("sell"),
        F.sum(F.col("price") * q).alias("notional"),
        F.count(F.lit(1)).alias("trades"),
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.min(at).alias("first_ms"),
        F.max(at).alias("last_ms"),
    )


def chunks(rows: DataFrame, reach: int) -> DataFrame:
    return apart(rows.withColumn("tf", F.lit("step")), reach, SPREAD * reach)


def _extremes(rows: DataFrame, k: int) -> DataFrame:
    """symbol, tf, n and the extremes of the last k steps."""
    values = rows.select("symbol", "tf", "n", F.col("n").alias("at"), *_LEAST, *_MOST)
    asked = rows.select("symbol", "tf", "n", (F.col("n") - (k - 1)).alias("at"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*_LEAST, *_MOST)])
    both = values.withColumn("__asks", F.lit(False)).unionByName(asked.withColumn("__asks", F.lit(True))).withColumn("__block", F.floor(F.col("at") / k))
    block = Window.partitionBy("symbol", "tf", "__block")
    up, down = (block.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("at"), F.desc("at")))
    made = {c: F.when(F.col("__asks"), f(c).over(down)).otherwise(f(c).over(up)) for cs, f in ((_LEAST, F.min), (_MOST, F.max)) for c in cs}
    found = both.withColumns({f"__{c}": x for c, x in made.items()})
    return found.groupBy("symbol", "tf", "n").agg(*[F.min(f"__{c}").alias(f"{c}_{k}") for c in _LEAST], *[F.max(f"__{c}").alias(f"{c}_{k}") for c in _MOST])


def windows(rows: DataFrame, lengths: tuple[int, ...], ms: int) -> DataFrame:
    """Chunks of steps with, for each length k in steps: buy_k, sell_k, notional_k, trades_k, open_k, low_k, high_k, span_k (milliseconds from its first trade to its last), coverage_k (the span's share of the length, at most 1) and complete_k (nine tenths or more)."""
    order = Window.partitionBy("symbol", "tf").orderBy("n")
    now = order.rangeBetween(Window.unboundedPreceding, 0)
    made = {}
    for k in lengths:
        past = order.rangeBetween(Window.unboundedPreceding, -k)
        made |= {f"{c}_{k}": F.sum(c).over(now) - F.coalesce(F.sum(c).over(past), F.lit(0)) for c in _ADDED}
    rows = rows.withColumn("begin", F.struct("first_ms", "open"))  # the least of a window is its first trade
    out = rows.withColumns(made).drop("begin")
    for k in lengths:
        out = out.join(_extremes(rows, k), ["symbol", "tf", "n"]).withColumn(f"open_{k}", F.col(f"begin_{k}.open"))
        span = F.col("last_ms") - F.col(f"begin_{k}.first_ms")
        out = out.withColumns({f"span_{k}": span, f"coverage_{k}": F.least(F.lit(1.0), span / (k * ms)), f"complete_{k}": span >= 0.9 * k * ms}).drop(f"begin_{k}")
    return out


def own(rows: DataFrame, ms: int) -> DataFrame:
    """The chunks' own rows, with the step's end as ``ts``."""
    return rows.where("pos >= 0").withColumn("ts", F.timestamp_millis((F.col("n") + 1) * ms)).drop("tf", "series_tf", "chunk", "pos")


def with_cvd(rows: DataFrame, reach: int, back: int = 9) -> DataFrame:
    """``chunks`` of the same ``reach`` with ``cvd``, the signed volume since the symbol's first trade, its change and the close's over ``lookback`` steps (as many as there are, up to ``back`` + 1 counting this one). An idle step has what the one before it had."""
    length = SPREAD * reach
    order = Window.partitionBy("symbol", "tf").orderBy("n")
    # A group reaches from one chunk's first row to the next one's, so what lies before a chunk's rows is the sum of the groups before its own.
    mine = rows.where("pos >= 0")
    parts = mine.select("symbol", F.floor((F.col("n") + reach) / length).alias("chunk"), (F.col("buy") - F.col("sell")).alias("d"), "close", "n")
    parts = parts.unionByName(mine.select("symbol", "chunk", F.lit(0.0).alias("d")), allowMissingColumns=True)  # each chunk has a group
    groups = parts.groupBy("symbol", "chunk").agg(F.sum("d").alias("d"), F.max_by("close", "n").alias("close"), F.min("n").alias("n"))
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    told = groups.select("symbol", "chunk", F.coalesce(F.sum("d").over(before), F.lit(0.0)).alias("__sum"), F.last("close", ignorenulls=True).over(before).alias("__close"), F.min("n").over(Window.partitionBy("symbol")).alias("__first"))
    running = F.sum(F.col("buy") - F.col("sell")).over(order.rangeBetween(Window.unboundedPreceding, 0))
    out = rows.join(told, ["symbol", "chunk"]).withColumn("cvd", F.col("__sum") + running)
    begun = F.col("n") - F.col("__first")
    then, first = order.rangeBetween(Window.unboundedPreceding, -back), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = lambda c, carried: F.when(begun >= back, F.coalesce(F.last(c).over(then), F.col(carried))).otherwise(F.first(c).over(first))
    made = {"lookback": F.least(F.lit(back + 1), begun + 1).cast("int"), "cvd_change": F.col("cvd") - past("cvd", "__sum"), "price_change": F.col("close") - past("close", "__close")}
    return out.withColumns(made).drop("__sum", "__close", "__first")


def direction(x: Column) -> Column:
    return F.when(x > 0, "bullish").when(x < 0, "bearish").otherwise("neutral")


def delta_signal(rows: DataFrame, k: int, least: int = 10) -> DataFrame:
    """From ``windows`` and ``with_cvd``: slope of the running delta, the sides of price and delta, divergence, who is aggressive in the last k steps, and the signal's side and strength. Null where the window has fewer than ``least`` trades."""
    ratio = safe_divide(F.col(f"buy_{k}") - F.col(f"sell_{k}"), F.col(f"buy_{k}") + F.col(f"sell_{k}"))
    price, delta = direction(F.col("price_change")), direction(F.col("cvd_change"))
    diverged = (price != "neutral") & (delta != "neutral") & (price != delta)
    size = F.abs(ratio) * 100
    strength = F.when(diverged, F.least(F.lit(90.0), 50 + size)).otherwise(F.least(F.lit(80.0), 40 + size))
    made = {
        "delta_ratio": ratio,
        "cvd_slope": F.col("cvd_change") / F.col("lookback"),
        "price_side": price,
        "cvd_side": delta,
        "is_divergent": diverged,
        "aggressor": ladder((ratio > 0.15, "buyers"), (ratio < -0.15, "sellers"), otherwise="balanced"),
        "delta_strength": strength,
    }
    enough = F.col(f"trades_{k}") >= least
    return rows.withColumns({c: F.when(enough, x) for c, x in made.items()})


def relative(rows: DataFrame, k: int, context: int) -> Column:
    """Volume of the last k steps over its usual: the context window's, brought to k steps; 1 where the context is empty."""
    total = lambda w: F.col(f"buy_{w}") + F.col(f"sell_{w}")
    usual = total(context) * k / context
    return F.when(usual > 0, total(k) / F.nullif(usual, F.lit(0.0))).otherwise(1.0)


def as_bars(rows: DataFrame, ms: int) -> DataFrame:
    """Steps as bars, which ``ordered`` and the operators on bars take."""
    return rows.select("symbol", F.lit("step").alias("tf"), F.timestamp_millis((F.col("n") + 1) * ms).alias("ts"), F.col("n").alias("seq"), "open", "high", "low", "close", (F.col("buy") + F.col("sell")).alias("volume"), "n")


def precise(rows: DataFrame, k: int, least: int = 20, coverage: float = 0.7) -> Column:
    """Whether the window's trades are many and spread enough to take their signed volume in the place of the candles'."""
    return (F.col(f"trades_{k}") >= least) & (F.col(f"coverage_{k}") >= coverage)


def exact_delta(rows: DataFrame, k: int) -> DataFrame:
    """Bars with a candle's delta and a window's columns: where :func:`precise` holds, the window's signed volume takes the place of the candles' in recent_delta, delta_pct, bias, strength and divergence; ``used_precise`` tells."""
    ratio = safe_divide(F.col(f"buy_{k}") - F.col(f"sell_{k}"), F.col(f"buy_{k}") + F.col(f"sell_{k}"))
    use = precise(rows, k)
    rows = rows.withColumns({"used_precise": use, "exact_ratio": F.when(use, ratio), "delta_pct": F.when(use, ratio * 100).otherwise(F.col("delta_pct")), "recent_delta": F.when(use, F.col(f"buy_{k}") - F.col(f"sell_{k}")).otherwise(F.col("recent_delta"))})
    d, size, change, delta = F.col("delta_pct"), F.abs("delta_pct"), F.col("price_change"), F.col("recent_delta")
    return rows.withColumns(
        {
            "aggression_bias": ladder((d > 30, "strong_buy"), (d > 10, "buy"), (d < -30, "strong_sell"), (d < -10, "sell"), otherwise="neutral"),
            "delta_strength": ladder((size > 30, F.least(F.lit(95.0), 70.0 + (size - 30) * 0.5)), (size > 10, 55.0 + (size - 10) * 0.75), otherwise=40.0 + size * 1.5),
            "delta_divergence": (change > 0) & (delta < 0) | (change < 0) & (delta > 0),
        }
    )


def volume_signal(rows: DataFrame, k: int, context: int, least: int = 10) -> DataFrame:
    """From a volume verdict and the windows: relative volume, side, strength (less in thin volume), and climax (none in thin volume). Null where the window has fewer than ``least`` trades."""
    bias, rv = F.col("aggression_bias"), relative(rows, k, context)
    climax = (F.col("accel_state") == "climax") | F.col("exhaustion_risk").isin("high", "extreme")
    made = {"volume_rv": rv, "volume_side": F.when(bias.endswith("buy"), "bullish").when(bias.endswith("sell"), "bearish").otherwise("neutral"), "volume_strength": F.col("volume_confidence") * F.least(rv, F.lit(1.0)), "is_climax": climax & (rv >= 1.0)}
    return rows.withColumns({c: F.when(F.col(f"trades_{k}") >= least, x) for c, x in made.items()})


def window_candles(rows: DataFrame, k: int, ms: int, least: int = 2) -> DataFrame:
    """The window of k steps after each step as a candle of its own, where it has ``least`` trades: neighbouring candles overlap."""
    candle = rows.where(F.col(f"trades_{k}") >= least).select("symbol", F.lit(f"window_{k}").alias("tf"), F.timestamp_millis((F.col("n") + 1) * ms).alias("ts"), F.col("n").alias("seq"), *[F.col(f"{c}_{k}").alias(c) for c in ("open", "high", "low")], "close", (F.col(f"buy_{k}") + F.col(f"sell_{k}")).alias("volume"), "pos")
    return candle.where("pos >= 0").drop("pos")
