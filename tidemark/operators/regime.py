"""Regimes of the market state: the rules as a column, the transitions as a kernel for scans and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ladder
from .scan import Kernel

RISK_OFF = ("NO_TRADE", "LOW_VOLUME", "CHOPPY")


def candidate(min_rv: float = 0.5, min_confidence: float = 50.0) -> Column:
    """The regime that the current row calls for, from rv, delta_ratio, volume_side, is_climax, oi_direction, crowd, total_score, confidence, path, book_side_bias, divergence_side; the first rule that holds decides. Unknown inputs are null."""
    rv, score, sure = F.col("rv"), F.col("total_score"), F.col("confidence")
    rising = F.col("oi_direction") == "rising"
    bull, bear = F.col("volume_side") == "bullish", F.col("volume_side") == "bearish"
    shorts, longs = F.col("crowd").isin("heavily_short", "moderately_short"), F.col("crowd").isin("heavily_long", "moderately_long")
    return ladder(
        (rv < min_rv, "LOW_VOLUME"),
        (sure < min_confidence * 0.5, "NO_TRADE"),
        (rising & (F.abs("delta_ratio") < 0.1), "COMPRESSION"),
        (rising & shorts & bull, "SQUEEZE_SETUP_LONG"),
        (rising & longs & bear, "SQUEEZE_SETUP_SHORT"),
        (F.col("is_climax") & bull, "EXHAUSTION_LONG"),
        (F.col("is_climax") & bear, "EXHAUSTION_SHORT"),
        ((score >= 0.55) & (sure >= min_confidence) & rising & ~longs, "TREND_CONTINUATION_LONG"),
        ((score <= -0.55) & (sure >= min_confidence) & rising & ~shorts, "TREND_CONTINUATION_SHORT"),
        ((score >= 0.7) & (sure >= 70) & (rv >= 1.5) & (F.col("path") == "up"), "BREAKOUT_LONG"),
        ((score <= -0.7) & (sure >= 70) & (rv >= 1.5) & (F.col("path") == "down"), "BREAKOUT_SHORT"),
        (F.col("divergence_side") == "bullish", "ACCUMULATION"),
        (F.col("divergence_side") == "bearish", "DISTRIBUTION"),
        otherwise="NO_TRADE",
    )


#: Direction, kind and risk of the trade that a regime calls for; exhaustion is faded.
TRADES = {
    "SQUEEZE_SETUP_LONG": ("long", "squeeze", "high"),
    "SQUEEZE_SETUP_SHORT": ("short", "squeeze", "high"),
    "TREND_CONTINUATION_LONG": ("long", "trend", "medium"),
    "TREND_CONTINUATION_SHORT": ("short", "trend", "medium"),
    "BREAKOUT_LONG": ("long", "breakout", "medium"),
    "BREAKOUT_SHORT": ("short", "breakout", "medium"),
    "REVERSAL_LONG": ("long", "reversal", "high"),
    "REVERSAL_SHORT": ("short", "reversal", "high"),
    "EXHAUSTION_LONG": ("short", "reversal", "high"),
    "EXHAUSTION_SHORT": ("long", "reversal", "high"),
}


def with_trade(rows: DataFrame, stop: float = 1.5, target: float = 3.0, share: float = 0.01) -> DataFrame:
    """direction, kind and risk of the trade that ``regime`` calls for, its entry, stop_loss and take_profit, what confirms it, and warnings; null for a regime without one.

    Reads close, atr, rv, path, allows_long, allows_short, is_climax, crowd, is_extreme and spoof_side.
    An unknown input neither confirms nor warns; without a positive ``atr``, a share of the price stands for it.
    """
    look_up = lambda i: F.when(F.col("regime").isin(*TRADES), F.element_at(F.create_map(*[F.lit(x) for k, v in TRADES.items() for x in (k, v[i])]), F.col("regime")))
    rows = rows.withColumns({"direction": look_up(0), "kind": look_up(1), "risk": look_up(2)})
    traded, is_long = F.col("direction").isNotNull(), F.col("direction") == "long"
    side = F.when(is_long, 1.0).when(traded, -1.0)
    size = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("close") * share)
    confirms = lambda condition: F.when(traded, F.coalesce(condition, F.lit(False)))
    warnings = F.concat_ws(
        "; ",
        F.when(F.col("is_climax"), "volume climax"),
        F.when(F.col("is_extreme"), F.concat(F.lit("extreme funding: "), F.coalesce("crowd", F.lit("unknown")))),
        F.when(F.col("spoof_side").isNotNull(), F.concat(F.lit("spoof on side "), "spoof_side")),
    )
    return rows.withColumns(
        {
            "entry": F.when(traded, F.col("close")),
            "stop_loss": F.col("close") - side * stop * size,
            "take_profit": F.col("close") + side * target * size,
            "volume_confirms": confirms(F.col("rv") >= 1.2),
            "book_confirms": confirms(F.when(is_long, F.col("path") == "up").otherwise(F.col("path") == "down")),
            "oi_confirms": confirms(F.when(is_long, F.col("allows_long")).otherwise(F.col("allows_short"))),
            "warnings": F.when(traded, warnings),
        }
    )


class Transitions(Kernel):
    """The regime in force by event time (milliseconds): no change within the cooldown after one; a risk-off regime is taken at once; any other only after the present one (unless risk-off) has lasted, and after enough calls in a row."""

    reads = ("ms", "candidate")
    makes = (("regime", "string"), ("changed", "boolean"))

    def __init__(self, cooldown: int = 5_000, dwell: int = 15_000, confirm: int = 3):
        self.cooldown, self.dwell, self.confirm = cooldown, dwell, confirm
        self.regime, self.since, self.pending, self.calls = "NO_TRADE", None, None, 0

    def step(self, ms, candidate):
        moved = self._moves(ms, candidate)
        if moved:
            self.regime, self.since, self.pending, self.calls = candidate, ms, None, 0
        return self.regime, moved

    def _moves(self, ms: int, wanted: str | None) -> bool:
        waited = None if self.since is None else ms - self.since
        if wanted is None or waited is not None and waited < self.cooldown:
            return False
        if wanted == self.regime:
            self.pending, self.calls = None, 0
            return False
        if wanted in RISK_OFF:
            return True
        if self.regime not in RISK_OFF and waited is not None and waited < self.dwell:
            return False
        self.calls = self.calls + 1 if wanted == self.pending else 1
        self.pending = wanted
        return self.calls >= self.confirm
