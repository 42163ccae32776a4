"""Open interest: regime, rate of change and high-edge signals over a series of (price, high, low, open_interest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ladder, lag, last_rows, series


def regime(price_pct: Column, oi_pct: Column, price_step: float = 0.5, oi_step: float = 1.0) -> tuple[Column, Column]:
    """The four-way regime of price and open interest, and its strength."""
    up, down, more, less = price_pct > price_step, price_pct < -price_step, oi_pct > oi_step, oi_pct < -oi_step
    p, o = F.abs(price_pct), F.abs(oi_pct)
    name = ladder((up & more, "new_longs"), (up & less, "short_covering"), (down & more, "new_shorts"), (down & less, "long_liquidation"), otherwise="neutral")
    strength = ladder(
        (up & more, F.least(F.lit(90.0), 50 + p * 5 + o * 3)), (up & less, F.least(F.lit(85.0), 50 + p * 3 + o * 3)), (down & more, F.least(F.lit(90.0), 50 + p * 3 + o * 5)), (down & less, F.least(F.lit(85.0), 50 + p * 3 + o * 3)), otherwise=40.0
    )
    return name, strength


def change_pct(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before * 100).otherwise(0.0)


def with_regime(rows: DataFrame, window: int = 20) -> DataFrame:
    """Regime by the changes from the first to the last row of a window."""
    first = lambda x: F.first(x).over(last_rows(window))
    out = rows.withColumns({"price_pct": change_pct(F.col("price"), first("price")), "oi_pct": change_pct(F.col("open_interest"), first("open_interest"))})
    name, strength = regime(F.col("price_pct"), F.col("oi_pct"))
    flow = ladder((F.col("oi_pct") > 0.1, "ENTERING"), (F.col("oi_pct") < -0.1, "LEAVING"), otherwise="FLAT")
    return out.withColumns({"oi_regime": name, "oi_strength": strength, "money_flow": flow})


def with_rate(rows: DataFrame, lookback: int = 20) -> DataFrame:
    """oi_step_pct; its size against the mean size over the window; and the acceleration of the last two steps over the three before."""
    step = change_pct(F.col("open_interest"), lag("open_interest"))
    out = rows.withColumns({"__n": F.row_number().over(series()), "oi_step_pct": F.coalesce(step, F.lit(0.0)), "__abs": F.when(lag("open_interest") > 0, F.abs(F.col("open_interest") - lag("open_interest")))})
    size = F.abs("oi_step_pct")
    mean = F.when(F.col("__n") >= lookback, F.avg(F.when(lag("open_interest") > 0, size)).over(last_rows(lookback - 1))).otherwise(F.when(size != 0, size).otherwise(1.0))
    recent, older = F.avg("__abs").over(last_rows(2)), F.avg("__abs").over(last_rows(3, -2))
    out = out.withColumns({"__mean": mean, "__recent": recent, "__older": older})
    vs = F.when(F.col("__mean") > 0, size / F.col("__mean")).otherwise(1.0)
    acceleration = F.when((F.col("__n") >= 6) & (F.col("__older") > 0), (F.col("__recent") - F.col("__older")) / F.col("__older")).otherwise(0.0)
    return out.withColumns({"oi_rate_vs_avg": F.when(F.col("__n") >= 2, vs).otherwise(1.0), "oi_acceleration": acceleration}).drop("__n", "__abs", "__mean", "__recent", "__older")


def with_edge(rows: DataFrame, lookback: int = 10, recent: int = 5) -> DataFrame:
    """oi_signal: compression, breakout_trap, expansion or exhaustion, in this order; none otherwise."""
    w = last_rows(lookback)
    enough = F.count(F.lit(1)).over(w) == lookback
    first_price, first_oi = lag("price", lookback - 1), lag("open_interest", lookback - 1)
    volatility = F.when(first_price > 0, (F.max("price").over(w) - F.min("price").over(w)) / first_price * 100).otherwise(0.0)
    out = rows.withColumns(
        {
            "__enough": enough,
            "__vol": volatility,
            "__oi": change_pct(F.col("open_interest"), first_oi),
            "__move": change_pct(F.col("price"), lag("price", 2)),
            "__recent_oi": change_pct(F.col("open_interest"), lag("open_interest", recent - 1)),
            "__high": F.max("high").over(last_rows(recent)),
            "__low": F.min("low").over(last_rows(recent)),
            "__top": F.max("high").over(last_rows(lookback - recent, -recent)),
            "__bottom": F.min("low").over(last_rows(lookback - recent, -recent)),
        }
    )
    broke = (F.col("__high") > F.col("__top") * 1.002) | (F.col("__low") < F.col("__bottom") * 0.998)
    signal = ladder(
        (~F.col("__enough"), "none"),
        ((F.col("__oi") > 3.0) & (F.col("__vol") < 2.0), "compression"),
        (broke & (F.col("__recent_oi") < -2.0), "breakout_trap"),
        ((F.col("__oi") > 5.0) & (F.abs("__move") > 1.0), "expansion"),
        (F.col("__oi") < -5.0, "exhaustion"),
        otherwise="none",
    )
    return out.withColumn("oi_signal", signal).drop(*[c for c in out.columns if c.startswith("__")])
