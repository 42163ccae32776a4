"""Analysis of signed-volume bars, sweeps with confirmation, volume agreement of two intervals, and paper trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, lag, last_rows, safe_divide, series, so_far
from .scan import Kernel, scan
from .structure import with_pivots


def delta_analysis(bars: DataFrame, recent: int = 5, lookback: int = 20) -> DataFrame:
    """From delta bars: the last bars' share of signed volume with bias, relative volume with level, acceleration, divergence and confidence."""
    w = last_rows(recent)
    rows = bars.withColumns(
        {
            "recent_delta": F.sum("delta").over(w),
            "__v": F.sum("volume").over(w),
            "__mean": F.avg("volume").over(last_rows(lookback)),
            "__change": F.when(F.count(F.lit(1)).over(w) == recent, F.col("close") - F.first("open").over(w)).otherwise(0.0),
            "__prev": lag("volume"),
        }
    )
    rows = rows.withColumns({"recent_ratio": F.when(F.col("__v") > 0, F.col("recent_delta") / (F.col("__v") + 1e-9)).otherwise(0.0), "rv": F.when(F.col("__mean") > 0, F.col("volume") / F.col("__mean")).otherwise(1.0)})
    r, rv = F.col("recent_ratio"), F.col("rv")
    pace = F.when(F.col("__prev") > 0, F.col("volume") / F.col("__prev")).otherwise(1.0)
    d = F.col("recent_delta")
    diverged = (F.col("__change") > 0) & (d < 0) | (F.col("__change") < 0) & (d > 0)
    return rows.withColumns(
        {
            "precise_bias": ladder((r > 0.30, "strong_buy"), (r > 0.15, "buy"), (r < -0.30, "strong_sell"), (r < -0.15, "sell"), otherwise="neutral"),
            "volume_level": ladder((rv < 0.3, "dead"), (rv < 0.7, "low"), (rv <= 1.5, "normal"), (rv <= 3.0, "high"), otherwise="extreme"),
            "volume_pace": ladder((pace > 1.5, "accelerating"), (pace < 0.7, "decelerating"), otherwise="steady"),
            "precise_divergence": diverged,
            "precise_confidence": F.least(F.lit(95.0), 50 + F.abs(r) * 100 + (rv - 1) * 10),
        }
    ).drop("__v", "__mean", "__change", "__prev")


def absorption(rows: DataFrame, atr_pct: Column) -> DataFrame:
    """Much volume, a small move against the ATR share and little move for the volume; the side that took it. Needs rv and delta_ratio."""
    move = F.when(F.col("open") > 0, F.abs(F.col("close") - F.col("open")) / F.col("open")).otherwise(0.0)
    rows = rows.withColumns({"__m": move, "__e": F.when(F.col("rv") > 0, move / (F.col("rv") + 1e-9)).otherwise(0.0), "__a": F.when(atr_pct > 0, move / atr_pct).otherwise(0.0)})
    found = (F.col("rv") >= 1.5) & (F.col("__a") <= 0.25) & (F.col("__e") <= 0.10)
    side = F.when(found & (F.col("delta_ratio") > 0.1) & (F.col("close") <= F.col("open")), "ask").when(found & (F.col("delta_ratio") < -0.1) & (F.col("close") >= F.col("open")), "bid")
    sure = F.when(found, F.least(F.lit(95.0), 50 + (F.col("rv") - 1.5) * 20 + (0.10 - F.col("__e")) * 200)).otherwise(0.0)
    return rows.withColumns({"absorbed": found, "absorbed_side": side, "absorption_confidence": sure}).drop("__m", "__e", "__a")


def volume_agreement(rows: DataFrame) -> DataFrame:
    """Whether the higher interval confirms the lower one's volume, from ltf_ratio and htf_ratio (volume to its recent mean)."""
    low, high = F.col("ltf_ratio"), F.col("htf_ratio")
    state = ladder(((low >= 1.5) & (high >= 1.5), "confirmed"), ((low >= 1.5) & (high <= 0.7), "stop_run"), ((low <= 0.7) & (high >= 1.5), "reaccumulation"), otherwise="unclear")
    rows = rows.withColumn("mtf_volume", state)
    s = F.col("mtf_volume")
    sure = ladder((s == "confirmed", F.least(F.lit(90.0), 60 + (low + high - 2) * 10)), (s == "stop_run", F.least(F.lit(85.0), 55 + F.abs(low - high) * 10)), (s == "reaccumulation", 65.0), otherwise=40.0)
    return rows.withColumns({"mtf_accepted": s.isin("confirmed", "reaccumulation"), "mtf_confidence": sure})


def recent_ratio(x: str, n: int = 20) -> Column:
    return safe_divide(F.col(x), F.avg(x).over(last_rows(n)), 1.0)


def sweeps(bars: DataFrame, n: int = 5, levels: int = 10, most: int = 3, usual: int = 20, least_rv: float = 1.2, flip: float = 0.1) -> DataFrame:
    """Levels run over and given back, on bars of signed volume (volume, delta_ratio).

    The last ``levels`` swings of either side that are known by a bar are its levels, the newest first. A
    high beyond one sweeps it upwards if one of the last ``most`` closes, the bar's own first, is below
    it; lows likewise, where no high does. The bar of that close confirms the sweep if its volume is ``least_rv`` times
    that of up to ``usual`` bars before it and its delta points the other way: those who followed are trapped then.
    sweep_side (up, down), swept_level, bars_to_close, post_sweep_rv, delta_flipped, trapped_side and sweep_confidence; nulls where there is none, and in the first two bars.
    """
    w = series()
    rows = with_pivots(bars, n)
    for side in ("high", "low"):
        known = F.lag(f"swing_{side}", n).over(w)
        rows = rows.withColumns({"__known": known, "__is": known.isNotNull()})
        own = Window.partitionBy("symbol", "tf", "__is").orderBy("ts", "seq").rowsBetween(1 - levels, 0)
        rows = rows.withColumn("__list", F.when(F.col("__is"), F.reverse(F.collect_list("__known").over(own))))
        rows = rows.withColumn(f"__{side}s", F.last("__list", ignorenulls=True).over(so_far()))
    rows = rows.drop("__known", "__is", "__list").withColumns({"__n": F.row_number().over(w), "__up": F.get(F.filter("__highs", lambda x: x < F.col("high")), F.lit(0)), "__down": F.get(F.filter("__lows", lambda x: x > F.col("low")), F.lit(0))})
    at = lambda c, i: F.lag(c, i - 1).over(w)

    def back(level: Column, way: int) -> Column:
        """Which of the last closes is first on the level's own side again."""
        found = None
        for i in range(1, most + 1):
            here = (F.col("__n") > i) & ((at("close", i) < level) if way > 0 else (at("close", i) > level))
            found = F.when(here, i) if found is None else found.when(here, i)
        return found

    rows = rows.withColumns({"__bu": back(F.col("__up"), 1), "__bd": back(F.col("__down"), -1)})
    up, down = F.col("__bu").isNotNull(), F.col("__bd").isNotNull()
    enough = F.col("__n") >= 3
    rows = rows.withColumns({"sweep_side": F.when(enough & up, "up").when(enough & down, "down"), "swept_level": F.when(enough & up, F.col("__up")).when(enough & down, F.col("__down")), "bars_to_close": F.when(enough, F.coalesce("__bu", "__bd"))})
    i, side = F.col("bars_to_close"), F.col("sweep_side")
    pick = lambda f: F.coalesce(*[F.when(i == k, f(k)) for k in range(1, most + 1)])
    before = pick(lambda k: F.avg("volume").over(w.rowsBetween(-(k + usual), -(k + 1))))
    rows = rows.withColumns({"__v": pick(lambda k: at("volume", k)), "__before": before, "__ratio": pick(lambda k: at("delta_ratio", k))})
    rv, ratio = F.when(F.col("__before") > 0, F.col("__v") / F.col("__before")).otherwise(0.0), F.col("__ratio")
    rows = rows.withColumns({"post_sweep_rv": F.when(side.isNotNull(), rv), "delta_flipped": F.when(side == "up", ratio < -flip).when(side == "down", ratio > flip)})
    sure = F.col("delta_flipped") & (F.col("post_sweep_rv") > least_rv)
    rows = rows.withColumns({"trapped_side": F.when(F.col("delta_flipped"), F.when(side == "up", "longs").otherwise("shorts")), "sweep_confirmed": F.when(side.isNotNull(), sure)})
    return rows.withColumn("sweep_confidence", F.when(F.col("sweep_confirmed"), F.least(F.lit(95.0), 60 + F.col("post_sweep_rv") * 10 + F.abs(ratio) * 50)).when(side.isNotNull(), 40.0).otherwise(0.0)).drop(*[c for c in rows.columns if c.startswith("__")])


class PaperTrades(Kernel):
    """One open trade a series. A signal opens a trade, moves the stop and target of one to the same side, or closes one to the other side; a price beyond the stop closes before one beyond the target. The trade that ends is told with its exit and result in per cent, less the fee."""

    reads = ("price", "signal", "stop", "target")
    makes = (("closed_side", "string"), ("entry_price", "double"), ("exit_price", "double"), ("exit_reason", "string"), ("pnl_pct", "double"))

    def __init__(self, fee: float = 0.04):
        self.fee, self.side, self.entry, self.stop, self.target = fee, None, None, None, None

    def step(self, price, signal, stop, target):
        ended = self._exit(price)
        if signal in ("long", "short"):
            if signal == self.side:
                self.stop, self.target = stop if stop is not None else self.stop, target if target is not None else self.target
            else:
                if self.side is not None:
                    ended = self._close(price, "signal_reversal")
                self.side, self.entry, self.stop, self.target = signal, price, stop, target
        return ended or (None,) * 5

    def _exit(self, price: float) -> tuple | None:
        if self.side is None:
            return None
        way = 1 if self.side == "long" else -1
        if self.stop is not None and (price - self.stop) * way <= 0:
            return self._close(self.stop, "stop_loss")
        if self.target is not None and (price - self.target) * way >= 0:
            return self._close(self.target, "take_profit")
        return None

    def _close(self, price: float, reason: str) -> tuple:
        way = 1 if self.side == "long" else -1
        out = self.side, self.entry, price, reason, (price - self.entry) / self.entry * 100 * way - self.fee
        self.side = None
        return out


def paper_trades(rows: DataFrame) -> DataFrame:
    """Closed trades of a series of price, signal, stop and target."""
    return scan(rows, [PaperTrades]).where("exit_reason is not null")


def trade_stats(trades: DataFrame) -> DataFrame:
    """By symbol: trades, winners, compounded result, mean win and loss, and exits by reason."""
    won = F.col("pnl_pct") > 0
    n = lambda c: F.count(F.when(c, 1))
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("closed"),
        n(won).alias("winners"),
        n(~won).alias("losers"),
        ((F.product(1 + F.col("pnl_pct") / 100) - 1) * 100).alias("compounded_pct"),
        F.coalesce(F.avg(F.when(won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(~won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_loss"),
        *[n(F.col("exit_reason") == x).alias(f"{x}s") for x in ("stop_loss", "take_profit", "signal_reversal")],
    )
