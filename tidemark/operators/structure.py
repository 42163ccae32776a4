"""Market structure of bars: pivots, trend, breaks, ranges, gaps, breakouts and their outcome."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SERIES, ladder, lag, last_rows, series, so_far, true_range


def ahead(n: int):
    return series().rowsBetween(1, n)


def with_pivots(bars: DataFrame, n: int = 5) -> DataFrame:
    """swing_high and swing_low: prices of bars beyond the n on either side; null elsewhere and where a side isn't full. A pivot is known n bars later."""
    w, before = series(), last_rows(n, -1)
    full = (F.count(F.lit(1)).over(before) == n) & (F.count(F.lit(1)).over(ahead(n)) == n)
    high = full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(ahead(n)))
    low = full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(ahead(n)))
    return bars.withColumns({"swing_high": F.when(high, F.col("high")), "swing_low": F.when(low, F.col("low"))})


def with_trend(bars: DataFrame, n: int = 5) -> DataFrame:
    """At each bar, the trend by its last three confirmed highs and lows, and the last of each (confirmed n bars after the pivot)."""
    return trend_of(with_pivots(bars, n), n)


def trend_of(rows: DataFrame, n: int) -> DataFrame:
    """:func:`with_trend` on swing_high and swing_low, each known n bars after its bar."""
    rows = rows.withColumns({"__h": lag("swing_high", n), "__l": lag("swing_low", n)})
    earlier = series().rowsBetween(Window.unboundedPreceding, -1)
    for side in ("h", "l"):  # the pivot before each pivot, and the one before that, then the last three at every bar
        one, two = f"__{side}", f"__{side}2"
        rows = rows.withColumn(two, F.when(F.col(one).isNotNull(), F.last(one, ignorenulls=True).over(earlier)))
        three = F.last(two, ignorenulls=True).over(earlier)
        rows = rows.withColumn(f"__{side}s", F.when(F.col(one).isNotNull(), F.array_compact(F.array(three, two, one))))
        rows = rows.withColumn(f"__{side}s", F.coalesce(F.last(f"__{side}s", ignorenulls=True).over(so_far()), F.array().cast("array<double>"))).drop(two)
    step = lambda a, i: F.get(F.col(a), F.lit(i + 1)) - F.get(F.col(a), F.lit(i))
    count = lambda a, up: sum((F.when(F.coalesce((step(a, i) > 0) if up else (step(a, i) <= 0), F.lit(False)), 1).otherwise(0) for i in (0, 1)), F.lit(0))
    hh, lh, hl, ll = count("__hs", True), count("__hs", False), count("__ls", True), count("__ls", False)
    trend = ladder(((F.size("__hs") < 2) | (F.size("__ls") < 2), "unknown"), ((hh >= 1) & (hl >= 1) & (lh == 0), "uptrend"), ((lh >= 1) & (ll >= 1) & (hh == 0), "downtrend"), otherwise="range")
    last = lambda a: F.get(F.col(a), F.size(a) - 1)
    return rows.withColumns({"trend": trend, "last_high": last("__hs"), "last_low": last("__ls")}).drop("__h", "__l", "__hs", "__ls")


def with_breaks(rows: DataFrame) -> DataFrame:
    """structure_event: a break of the last confirmed high or low, with the trend a bos, against it a choch. Needs :func:`with_trend`."""
    up, down = F.col("high") > F.col("last_high"), F.col("low") < F.col("last_low")
    event = ladder(
        (up & (F.col("trend") == "uptrend"), "bos_bullish"), (up & (F.col("trend") == "downtrend"), "choch_bullish"), (down & (F.col("trend") == "downtrend"), "bos_bearish"), (down & (F.col("trend") == "uptrend"), "choch_bearish"), otherwise="none"
    )
    return rows.withColumn("structure_event", event)


def with_range(bars: DataFrame, n: int = 10, most_pct: float = 2.0) -> DataFrame:
    """in_range (the last n bars span less than most_pct), how tight against the n before, and the kind of range by where volume traded."""
    w = last_rows(n)
    rows = bars.withColumns({"__hi": F.max("high").over(w), "__lo": F.min("low").over(w), "__n": F.row_number().over(series()), "__old": F.max("high").over(last_rows(n, -n)) - F.min("low").over(last_rows(n, -n)), "__v": F.sum("volume").over(w)})
    span, mid = F.col("__hi") - F.col("__lo"), (F.col("__hi") + F.col("__lo")) / 2
    inside = (F.col("__n") >= n) & (F.try_divide(span, F.col("__lo")) * 100 < most_pct)
    # The middle differs from bar to bar, so that the volume beyond it comes from the window's own rows.
    held = F.collect_list(F.struct("close", "volume")).over(w)
    rows = rows.withColumns({"__mid": mid, "__held": held})
    beyond = lambda up: F.aggregate("__held", F.lit(0.0), lambda s, x: s + F.when((x["close"] > F.col("__mid")) if up else (x["close"] < F.col("__mid")), x["volume"]).otherwise(0.0))
    tight = F.when(F.col("__n") >= 2 * n, F.when(F.col("__old") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - span / F.col("__old")))).otherwise(0.0)).otherwise(0.5)
    rows = rows.withColumns({"in_range": inside, "range_tightness": F.when(inside, tight).otherwise(0.0), "__top": F.try_divide(beyond(True), F.col("__v")), "__bottom": F.try_divide(beyond(False), F.col("__v"))})
    kind = ladder((~F.col("in_range"), "neutral"), (F.col("range_tightness") > 0.7, "compression"), (F.col("__top") > 0.6, "distribution"), (F.col("__bottom") > 0.6, "accumulation"), otherwise="neutral")
    return rows.withColumn("range_type", kind).drop(*[c for c in rows.columns if c.startswith("__")])


def gaps(bars: DataFrame, least_pct: float = 0.1) -> DataFrame:
    """Fair-value gaps: bars that leave a gap to the bar two before; top, bottom, size, side, and whether a later bar trades in it."""
    high, low = lag("high", 2), lag("low", 2)
    # The bars after one are those before it in reversed order, whose extremes run along with the rows.
    later = Window.partitionBy(*SERIES).orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.withColumns({"__low_ahead": F.min("low").over(later), "__high_ahead": F.max("high").over(later)}).withColumns({"__h": high, "__l": low})
    bull, bear = F.col("low") > F.col("__h"), F.col("high") < F.col("__l")
    rows = rows.withColumns({"gap_side": ladder((bull, "bullish"), (bear, "bearish"), otherwise=None), "gap_top": F.when(bull, F.col("low")).when(bear, F.col("__l")), "gap_bottom": F.when(bull, F.col("__h")).when(bear, F.col("high"))})
    rows = rows.withColumn("gap_pct", F.try_divide(F.col("gap_top") - F.col("gap_bottom"), F.col("gap_bottom")) * 100).where(F.col("gap_side").isNotNull() & (F.col("gap_pct") >= least_pct))
    filled = F.when(F.col("gap_side") == "bullish", F.col("__low_ahead") <= F.col("gap_top")).otherwise(F.col("__high_ahead") >= F.col("gap_bottom"))
    return rows.withColumn("gap_filled", F.coalesce(filled, F.lit(False))).select("symbol", "tf", "ts", "seq", "gap_side", "gap_top", "gap_bottom", "gap_pct", "gap_filled")


def breakouts(bars: DataFrame, swing: int = 20, bars_ahead: int = 10, margin_pct: float = 0.15, atr_multiple: float = 0.25) -> DataFrame:
    """Bars that break the extreme of the ``swing`` bars before by enough, with the outcome over the following bars. An entry at price zero has no shares, and is unclear."""
    before = last_rows(swing, -1)
    rows = bars.withColumns({"tr": true_range()})
    rows = rows.withColumns(
        {
            "__top": F.when(F.count(F.lit(1)).over(before) == swing, F.max("high").over(before)),
            "__bottom": F.when(F.count(F.lit(1)).over(before) == swing, F.min("low").over(before)),
            "__atr_pct": F.try_divide(F.avg("tr").over(last_rows(14)), F.col("close")) * 100,
            "__max": F.max("high").over(ahead(bars_ahead)),
            "__min": F.min("low").over(ahead(bars_ahead)),
            "__end": F.lead("close", bars_ahead).over(series()),
            "__left": F.count(F.lit(1)).over(ahead(bars_ahead)),
        }
    )
    enough = lambda m: (m >= margin_pct) | (m >= F.col("__atr_pct") * atr_multiple)
    up_margin, down_margin = F.try_divide(F.col("high") - F.col("__top"), F.col("__top")) * 100, F.try_divide(F.col("__bottom") - F.col("low"), F.col("__bottom")) * 100
    up = (F.col("high") > F.col("__top")) & enough(up_margin)
    down = ~F.coalesce(up, F.lit(False)) & (F.col("low") < F.col("__bottom")) & enough(down_margin)
    rows = rows.withColumn("breakout", ladder((up, "upward"), (down, "downward"), otherwise=None)).where("breakout is not null")
    is_up = F.col("breakout") == "upward"
    entry, level = F.when(is_up, F.col("high")).otherwise(F.col("low")), F.when(is_up, F.col("__top")).otherwise(F.col("__bottom"))
    rows = rows.withColumns({"entry": entry, "level": level})
    e = F.col("entry")
    share = lambda up, down: F.try_divide(F.when(is_up, up).otherwise(down), e) * 100
    best, worst = share(F.col("__max") - e, e - F.col("__min")), share(F.col("__min") - e, e - F.col("__max"))
    back = F.when(is_up, F.col("__min") < F.col("level")).otherwise(F.col("__max") > F.col("level"))
    final = share(F.col("__end") - e, e - F.col("__end"))
    done = F.col("__left") == bars_ahead
    rows = rows.withColumns({"mfe_pct": F.when(done & best.isNotNull(), F.greatest(F.lit(0.0), best)), "mae_pct": F.when(done & worst.isNotNull(), F.least(F.lit(0.0), worst)), "final_pct": F.when(done, final)})
    outcome = ladder((~done, "pending"), ((F.col("mfe_pct") >= 1.0) & ~back, "true_breakout"), (back & (F.col("final_pct") < -0.5), "fake_breakout"), otherwise="unclear")
    return rows.withColumn("outcome", outcome).select("symbol", "tf", "ts", "seq", "breakout", "entry", "level", "mfe_pct", "mae_pct", "final_pct", "outcome")


def veto(breakout, delta_ratio, oi_score):
    """True where flow or open interest speaks against a breakout."""
    up = breakout == "upward"
    return F.when(up, (delta_ratio < -0.05) | (oi_score < -0.3)).otherwise((delta_ratio > 0.05) | (oi_score > 0.3))


def backtest(events: DataFrame, entered: str = "entered") -> DataFrame:
    """One row for each symbol: outcomes, precision, recall, false-positive rate, mean excursions, win rate and profit factor (infinite without losses)."""
    true, fake, went = F.col("outcome") == "true_breakout", F.col("outcome") == "fake_breakout", F.col(entered)
    n = lambda c: F.count(F.when(c, 1))
    settled = went & (true | fake)
    gain, loss = F.sum(F.when(settled & (F.col("final_pct") > 0), F.col("final_pct"))), -F.sum(F.when(settled & (F.col("final_pct") < 0), F.col("final_pct")))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return events.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("breakouts"),
        n(true).alias("true_breakouts"),
        n(fake).alias("fake_breakouts"),
        n(went).alias("entered"),
        share(n(true & went), n(went)).alias("precision"),
        share(n(true & went), n(true)).alias("recall"),
        share(n(fake & went), n(fake)).alias("false_positive_rate"),
        F.coalesce(F.avg(F.when(true, F.col("mfe_pct"))), F.lit(0.0)).alias("avg_mfe_true"),
        F.coalesce(F.avg(F.when(fake, F.col("mae_pct"))), F.lit(0.0)).alias("avg_mae_fake"),
        share(n(settled & (F.col("final_pct") > 0)), n(settled)).alias("win_rate"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).when(gain > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
    )


def acceptance(rows: DataFrame, bars_ahead: int = 3, share: float = 0.67, volume: float = 1.2) -> DataFrame:
    """Whether the bars after a break stay beyond it: ``share`` of the next closes, with their mean volume at ``volume`` times that of as many bars before. Null while the bars aren't there. Needs :func:`with_breaks`."""
    w = ahead(bars_ahead)
    up = F.col("structure_event").endswith("bullish")
    level = F.when(up, F.col("last_high")).otherwise(F.col("last_low"))
    rows = rows.withColumns({"__level": level, "__closes": F.collect_list("close").over(w), "__after": F.avg("volume").over(w), "__before": F.avg("volume").over(last_rows(bars_ahead, -1))})
    beyond = F.size(F.filter("__closes", lambda c: (c > F.col("__level")) == up)) / F.size("__closes")
    held = (beyond >= share) & (F.col("__after") >= volume * F.col("__before"))
    known = (F.col("structure_event") != "none") & (F.size("__closes") == bars_ahead)
    return rows.withColumns({"break_held": F.when(known, beyond), "break_accepted": F.when(known, held)}).drop("__level", "__closes", "__after", "__before")


def equal_levels(bars: DataFrame, side: str = "high", n: int = 5, within_pct: float = 0.1) -> DataFrame:
    """Pairs of a series' pivots within ``within_pct``, each with its mean price; pivots meet on neighbouring price bands. A price that is touched often gives every pair of its touches: :func:`levels` has a row for each price instead."""
    column = f"swing_{side}"
    pivots = with_pivots(bars, n).where(F.col(column).isNotNull()).select("symbol", "tf", "ts", F.col(column).alias("price"))
    # Two prices within the tolerance lie in the same band of that width (in logarithms) or in neighbouring ones.
    band = F.floor(F.ln("price") / F.lit(math.log1p(within_pct / 100))).cast("long")
    left = pivots.withColumn("band", band)
    right = left.select("symbol", "tf", F.col("ts").alias("other_ts"), F.col("price").alias("other"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    pairs = left.join(right, ["symbol", "tf", "band"]).where((F.col("ts") < F.col("other_ts")) & (F.abs(F.col("other") - F.col("price")) / F.col("price") * 100 < within_pct))
    return pairs.select("symbol", "tf", ((F.col("price") + F.col("other")) / 2).alias("level"), F.col("ts").alias("first_ts"), F.col("other_ts").alias("second_ts")).distinct()


def levels(bars: DataFrame, n: int = 5, within_pct: float = 0.1, part: str = "month") -> DataFrame:
    """Prices where liquidity rests, of both sides: those of pivots that a later pivot of their side comes within ``within_pct`` of (is_equal), and that of the latest pivot (is_latest); a side with a single pivot has none. Pivots at zero or below take no part.

    A pivot asks the price bands around its own for the largest and the least price of later pivots, so that rows grow with the pivots and not with their pairs. A band is cut by ``part`` of the time: within a part the extremes run along, those of later parts come from one row a part.
    """
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"swing_{x}").alias("price")) for x in ("high", "low")])
    pivots = with_pivots(bars, n).select(*SERIES, "ts", "seq", F.inline(sides)).where("price > 0")
    share = within_pct / 100
    band = F.floor(F.ln("price") / F.lit(math.log1p(share) / 2)).cast("long")
    own = pivots.select(*SERIES, "side", band.alias("band"), F.date_trunc(part, "ts").alias("part"), "ts", "seq", "price", F.lit(None).cast("double").alias("asked"))
    asks = own.select(*SERIES, "side", F.explode(F.sequence(F.col("band") - 3, F.col("band") + 3)).alias("band"), "part", "ts", "seq", F.lit(None).cast("double").alias("price"), F.col("price").alias("asked"))
    rows, place = own.unionByName(asks), (*SERIES, "side", "band")
    after = Window.partitionBy(*place).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*place, "part").agg(F.max("price").alias("top"), F.min("price").alias("bottom"))
    parts = parts.select(*place, "part", F.max("top").over(after).alias("top_after"), F.min("bottom").over(after).alias("bottom_after"))
    # From the latest on; of one moment the questions come first, so that no pivot finds itself.
    later = Window.partitionBy(*place, "part").orderBy(F.desc("ts"), F.desc("seq"), F.col("asked").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({"top": F.max("price").over(later), "bottom": F.min("price").over(later)}).where("asked is not null").join(parts, [*place, "part"])
    near = lambda x: F.coalesce(F.abs(F.col("asked") - x) / F.col("asked") < share, F.lit(False))
    equal = found.where(near(F.greatest("top", "top_after")) | near(F.least("bottom", "bottom_after"))).select(*SERIES, "side", F.col("asked").alias("level"), F.lit(True).alias("is_equal"), F.lit(False).alias("is_latest"))
    latest = pivots.groupBy(*SERIES, "side").agg(F.max_by("price", F.struct("ts", "seq")).alias("level"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*SERIES, "side", "level", F.lit(False).alias("is_equal"), F.lit(True).alias("is_latest"))
    return equal.union(latest).groupBy(*SERIES, "side", "level").agg(F.max("is_equal").alias("is_equal"), F.max("is_latest").alias("is_latest"))


def validated(events: DataFrame) -> DataFrame:
    """Breakouts with quality, confidence, action and levels, from delta_ratio, volume_score, oi_score, oi_pct, book_score, book_imbalance, rv and exhaustion_risk (unknown ones null). A veto has confidence 0."""
    way = F.when(F.col("breakout") == "upward", 1).otherwise(-1)
    x = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * way
    vetoed = F.coalesce(veto(F.col("breakout"), F.coalesce("delta_ratio", F.lit(0.0)), F.coalesce("oi_score", F.lit(0.0))), F.lit(False))
    flow, interest, depth = (x("delta_ratio") > 0.05) & (x("volume_score") > 0.2), (x("oi_pct") > 0.5) & (x("oi_score") > 0.2), (x("book_imbalance") > 0.1) | (x("book_score") > 0.2)
    aligned = flow.cast("int") + interest.cast("int") + depth.cast("int")
    rows = events.withColumns({"vetoed": vetoed, "aligned": aligned})
    n = F.col("aligned")
    quality = ladder((F.col("vetoed"), "retail"), (n >= 3, "institutional"), (n == 2, "mixed"), otherwise="retail")
    base = ladder((n >= 3, 85.0), (n == 2, 60.0), otherwise=35.0)
    extra = F.when(F.col("rv") > 2.0, 10.0).otherwise(0.0) + F.when(F.abs("delta_ratio") > 0.25, 10.0).otherwise(0.0) - F.when(F.col("exhaustion_risk").isin("high", "extreme"), 20.0).otherwise(0.0)
    rows = rows.withColumns({"breakout_quality": quality, "breakout_confidence": F.when(F.col("vetoed"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + extra)))})
    c = F.col("breakout_confidence")
    action = ladder((c >= 50, F.when(way == 1, "enter_long").otherwise("enter_short")), (c < 40, "avoid"), otherwise="wait")
    enters = c >= 50
    return rows.withColumns({"action": action, "stop": F.when(enters, F.col("level") * (1 - 0.005 * way)), "target": F.when(enters, F.col("entry") * (1 + 0.015 * way))})
