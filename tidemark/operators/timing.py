"""Timing rules and VWAP interactions: conditions as columns, counters and latches as kernels."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ladder
from .scan import Kernel, scan


def _yes(c: Column) -> Column:
    """False where a condition is unknown."""
    return F.coalesce(c, F.lit(False))


class TimingRules(Kernel):
    """Which rule's conditions have held for enough bars: exhaustion first, then a breakout from an armed squeeze, then continuation outside the cooldown. A rule that fires leaves the counters of those after it as they are."""

    reads = ("__tired", "__bias", "__squeeze", "__ignites", "__gates", "__triggers")
    makes = (("timing_rule", "string"),)

    def __init__(self, confirm: int = 2, cooldown: int = 2):
        self.confirm, self.rest = confirm, cooldown
        self.tired = self.ignited = self.ready = self.cooling = 0
        self.armed = False

    def step(self, tired, bias, squeeze, ignites, gates, triggers):
        self.cooling = max(self.cooling - 1, 0)
        if bias:
            self.tired = self.tired + 1 if tired >= 2 else 0
            if self.tired >= self.confirm:
                self.cooling, self.ready = self.rest, 0
                return ("EXHAUSTION_WARNING",)
        self.armed = self.armed or squeeze
        self.ignited = self.ignited + 1 if self.armed and ignites else 0
        if self.ignited >= self.confirm:
            self.armed = False
            return ("BREAKOUT_WINDOW",)
        self.ready = self.ready + 1 if gates and not self.cooling and triggers >= 2 else 0
        return ("CONTINUATION_READY" if self.ready >= self.confirm else None,)


def timing(rows: DataFrame) -> DataFrame:
    """timing_state, direction, confidence and score from trend_ok, trend_bias, ribbon_width_rate, vwap_state, vwap_position, roc_fast_norm, roc_fast_norm_prev, acc_fast, atr_exp, atr_exp_slope, tr_spike, chop_value, chop_state, rsi_divergence, structure_pivot_type and macd_hist_slope; each may be null."""
    c = {x: F.col(x) for x in ("roc_fast_norm", "roc_fast_norm_prev", "acc_fast", "atr_exp", "tr_spike", "chop_value")}
    bias = F.coalesce("trend_bias", F.lit(0))
    roc, exp = c["roc_fast_norm"], c["atr_exp"]
    slowing = _yes((roc * bias > 0.3) & (c["acc_fast"] * bias < 0))
    hot = _yes(exp >= 1.2) | _yes(c["tr_spike"] >= 1.5)
    blowoff = hot & _yes(F.col("ribbon_width_rate") < 0)
    pair = F.concat_ws("@", "rsi_divergence", "structure_pivot_type")
    diverged = _yes(F.when(bias == 1, pair == "REG_BEAR@SWING_HIGH").when(bias == -1, pair == "REG_BULL@SWING_LOW"))
    tired = slowing.cast("int") + blowoff.cast("int") + diverged.cast("int")
    squeeze = _yes(exp < 0.8) & (_yes(F.col("chop_state") == "CHOP") | _yes(c["chop_value"] >= 61.8))
    ignites = (_yes(exp >= 1.2) | _yes(c["tr_spike"] >= 1.5)) & _yes(F.abs(roc) >= 0.8)
    trend = _yes(F.col("trend_ok")) & (bias != 0)
    held = _yes(F.col("vwap_state").isin("ACCEPT", "RECLAIM"))
    place = F.when(bias == 1, "ABOVE").when(bias == -1, "BELOW")
    aligned = F.col("vwap_position").isNull() | _yes(F.col("vwap_position") == place)
    restart = _yes((roc * bias > c["roc_fast_norm_prev"] * bias) & (roc * bias >= 0.3))
    support = _yes(exp >= 1.0) & _yes(F.coalesce("atr_exp_slope", F.lit(0.0)) >= 0)
    macd = _yes(F.col("macd_hist_slope") * bias > 0)
    triggers = restart.cast("int") + support.cast("int") + macd.cast("int")
    made = {"__tired": tired, "__bias": bias, "__squeeze": squeeze, "__ignites": ignites, "__gates": trend & held & aligned, "__triggers": triggers, "__restart": restart, "__support": support, "__macd": macd, "__trend": trend, "__exp": exp}
    out = scan(rows.withColumns(made), [TimingRules])
    rule, score = F.col("timing_rule"), lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    continues = F.least(F.lit(100.0), 50 + 15.0 * F.col("__triggers") + F.when(F.col("vwap_state") == "RECLAIM", 10.0).otherwise(0.0))
    exhausted = F.least(F.lit(100.0), 60 + 20.0 * (F.col("__tired") - 2) + F.when(F.col("__exp") >= 1.6, 10.0).otherwise(0.0))
    confidence = ladder((rule == "EXHAUSTION_WARNING", exhausted), (rule == "BREAKOUT_WINDOW", 95.0), (rule == "CONTINUATION_READY", continues), otherwise=None)
    direction = F.when(rule == "BREAKOUT_WINDOW", F.signum("roc_fast_norm").cast("int")).when(rule.isNotNull(), F.col("__bias")).otherwise(0)
    points = F.when(rule == "EXHAUSTION_WARNING", 0.0).when(rule == "BREAKOUT_WINDOW", 0.0).when(rule == "CONTINUATION_READY", 50 + score("__restart", 15.0) + score("__support", 15.0) + score("__macd", 10.0))
    state = F.coalesce("timing_rule", F.when(_yes(F.col("trend_ok")), "TRANSITION").otherwise("NO_TRADE"))
    out = out.withColumns({"timing_state": state, "timing_direction": direction, "timing_confidence": confidence, "timing_score": points})
    return out.drop(*made, "timing_rule")


class Interaction(Kernel):
    """Reclaims, losses, rejections and acceptances of a VWAP, in this order of precedence, by how long the close has held beyond it."""

    reads = ("__distance", "__touch", "__buffer", "__near", "__confirmed")
    makes = (("vwap_state", "string"), ("vwap_side", "int"), ("vwap_hold", "int"), ("vwap_crossings", "int"))

    def __init__(self, window: int = 20, choppy: int = 4):
        self.signs, self.choppy = deque(maxlen=window), choppy
        self.side = self.hold = 0
        self.crossing = {1: False, -1: False}  # upwards: a reclaim; downwards: a loss
        self.beyond = {1: 0, -1: 0}
        self.accepted = {1: 0, -1: 0}
        self.rejected, self.since_touch = 0, None

    def step(self, distance, touch, buffer, near, confirmed):
        if distance is None:
            return None, None, None, None
        sign = (distance > 0) - (distance < 0)
        self.signs.append(sign or (self.signs[-1] if self.signs else 0))
        crossings = sum(a != b for a, b in zip(list(self.signs)[1:], self.signs, strict=False))
        trending = crossings < self.choppy
        side = 0 if touch else sign
        self.since_touch = 0 if touch else None if self.since_touch is None else self.since_touch + 1
        state = self._crossed(1, side, distance, buffer, trending, confirmed) or self._crossed(-1, side, distance, buffer, trending, confirmed) or self._rejected(side, distance, touch, near, trending) or self._accepted(side, trending, confirmed) or "NEUTRAL"
        if side:
            self.hold = self.hold + 1 if side == self.side else 1
            self.side = side
        return state, side, self.hold, crossings

    def _crossed(self, way: int, side: int, distance: float, buffer: float, trending: bool, confirmed: bool) -> str | None:
        if self.side == -way and side == way:
            self.crossing[way], self.beyond[way] = True, 0
        if self.crossing[way] and distance * way >= buffer:
            self.beyond[way] += 1
        elif self.crossing[way] and distance * way <= -buffer:
            self.crossing[way], self.beyond[way] = False, 0
        if self.beyond[way] >= (2 if trending else 3) and (trending or confirmed):
            self.crossing[-way], self.beyond[-way] = False, 0
            self.rejected, self.accepted = 0, {1: 0, -1: 0}
            return "RECLAIM" if way == 1 else "LOSS"
        if not self.crossing[way]:
            self.beyond[way] = 0
        return None

    def _rejected(self, side: int, distance: float, touch: bool, near: float, trending: bool) -> str | None:
        if self.crossing[1] or self.crossing[-1]:
            self.rejected = 0
            return None
        recent = self.since_touch is not None and self.since_touch <= 3
        self.rejected = self.rejected + 1 if recent and side and distance * side >= near else 0
        if self.rejected >= (3 if trending else 2):
            self.accepted = {1: 0, -1: 0}
            return "REJECT"
        return None

    def _accepted(self, side: int, trending: bool, confirmed: bool) -> str | None:
        if self.crossing[1] or self.crossing[-1]:
            self.accepted = {1: 0, -1: 0}
            return None
        if self.rejected:
            return None
        if side:
            self.accepted = {side: self.accepted[side] + 1, -side: 0}
        need = 2 if trending else 3
        most = max(self.accepted.values())
        return "ACCEPT" if most >= need and (trending or confirmed and most > need) else None


#: Touch and reclaim distances by interval.
TOUCH = {"1m": 0.0001, "5m": 0.00015, "1h": 0.0003}
RECLAIM = {"1m": 0.0002, "5m": 0.00025, "1h": 0.0006}


def vwap_interaction(rows: DataFrame, tf: str, confirmed: Column | None = None) -> DataFrame:
    """Interaction state of bars with vwap, vwap_std and optionally atr_pct and rv."""
    distance = (F.col("close") - F.col("vwap")) / (F.col("vwap") + 1e-10)
    share = F.col("atr_pct") if "atr_pct" in rows.columns else F.lit(None).cast("double")
    near = TOUCH.get(tf, 0.00015)
    touch = (F.abs(distance) <= near) | _yes(F.abs((F.col("close") - F.col("vwap")) / (F.col("vwap_std") + 1e-10)) <= 0.15) | _yes(F.abs(distance) <= 0.05 * share)
    buffer = F.greatest(F.lit(RECLAIM.get(tf, 0.00025)), F.coalesce(0.1 * share, F.lit(0.0)))
    sure = _yes(F.col("rv") >= 1.2) if "rv" in rows.columns else F.lit(False)
    made = {"__distance": distance, "__touch": touch, "__buffer": buffer, "__near": F.lit(near), "__confirmed": sure if confirmed is None else sure | _yes(confirmed)}
    return scan(rows.withColumns(made), [Interaction]).drop(*made)
