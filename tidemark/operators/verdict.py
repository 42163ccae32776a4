"""Verdicts: what open interest, funding and market structure together tell a trader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SERIES, ladder, last_rows, series
from .open_interest import change_pct


def with_oi_signal(rows: DataFrame, window: int = 20, least_pct: float = 5.0) -> DataFrame:
    """oi_change_signal and its strength: open interest against the first row of the window, with the side of the price change. Rising interest confirms the price, falling interest only weakly."""
    first = lambda x: F.first(x).over(last_rows(window))
    rows = rows.withColumns({"oi_change_pct": change_pct(F.col("open_interest"), first("open_interest")), "price_change_pct": change_pct(F.col("price"), first("price"))})
    o, p = F.col("oi_change_pct"), F.col("price_change_pct")
    more, less = o > least_pct, o < -least_pct
    signal = F.when((more | less) & (p > 0), "bullish").when((more | less) & (p < 0), "bearish").otherwise("neutral")
    strength = ladder((more & (p != 0), F.least(F.lit(85.0), 60 + F.abs(o))), (less & (p != 0), 55.0), otherwise=50.0)
    return rows.withColumns({"oi_change_signal": signal, "oi_change_strength": strength})


def with_oi_verdict(rows: DataFrame) -> DataFrame:
    """money_entering and oi_verdict: the high-edge signal decides where there is one, else the regime. Needs with_regime and with_edge."""
    edge, regime = F.col("oi_signal"), F.col("oi_regime")
    side = F.when(F.col("price_pct") > 0.5, "bullish").otherwise("bearish")
    verdict = ladder(
        (edge == "compression", "neutral"),
        (edge.isin("breakout_trap", "exhaustion"), "caution"),
        (edge == "expansion", side),
        (regime == "new_longs", "bullish"),
        (regime == "new_shorts", "bearish"),
        (regime.isin("short_covering", "long_liquidation"), "caution"),
        otherwise="neutral",
    )
    return rows.withColumns({"money_entering": F.col("oi_pct") > 0.1, "oi_verdict": verdict})


def funding_warning(zone: Column) -> tuple[Column, Column]:
    """Warning and severity of a funding zone."""
    warning = ladder((zone == "extreme_positive", "squeeze_risk_down"), (zone == "high_positive", "dont_chase_longs"), (zone == "extreme_negative", "squeeze_risk_up"), (zone == "high_negative", "dont_chase_shorts"), otherwise="none")
    return warning, ladder((zone.startswith("extreme"), "extreme"), (zone.startswith("high"), "high"), otherwise="low")


def alignment(htf: Column, ltf: Column) -> Column:
    """How a lower timeframe's trend stands to a higher one's."""
    return ladder((htf == "range", "htf_range"), (htf == ltf, "full_align"), (ltf == "range", "partial_align"), otherwise="counter_trend")


def with_last_break(rows: DataFrame, settle: int = 3, share_pct: float = 0.5, fast: float = 0.33, most_seconds: float = 36_000) -> DataFrame:
    """The last break of structure at each bar: kind, seconds since, whether it was accepted (known ``settle`` bars later), and the momentum by how soon the price moved ``share_pct`` beyond its level. Needs structure.acceptance."""
    event = F.col("structure_event")
    level = F.when(event.endswith("bullish"), F.col("last_high")).otherwise(F.col("last_low"))
    rows = rows.withColumn("__leg", F.sum(F.when(event != "none", 1).otherwise(0)).over(series().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    leg = Window.partitionBy(*SERIES, "__leg").orderBy("ts", "seq")
    so_far = leg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__kind": F.first(F.when(event != "none", event)).over(so_far), "__level": F.first(level).over(so_far), "__at": F.first("ts").over(so_far), "__ok": F.first("break_accepted").over(so_far), "__i": F.row_number().over(leg)})
    began = F.col("__leg") > 0
    far = began & (F.abs(F.try_divide(F.col("close") - F.col("__level"), F.col("__level"))) * 100 >= share_pct)
    seconds = lambda t: (F.unix_millis(t) - F.unix_millis(F.col("__at"))) / 1000
    rows = rows.withColumn("__reached", F.min(F.when(far, F.col("ts"))).over(so_far))
    accepted = F.when(F.col("__i") > settle, F.col("__ok"))
    rows = rows.withColumns({"last_break": F.when(began, F.col("__kind")), "break_seconds": F.when(began, seconds(F.col("ts"))), "last_accepted": F.when(began, accepted), "__took": seconds(F.col("__reached"))})
    took, elapsed = F.col("__took"), F.col("break_seconds")
    momentum = ladder(
        (~began, "slow"),
        (~F.coalesce("last_accepted", F.lit(True)), "stalled"),
        (took < most_seconds * fast, "fast"),
        (took < most_seconds, "slow"),
        (took.isNotNull() | (elapsed > most_seconds), "stalled"),
        otherwise="slow",
    )
    rows = rows.withColumn("structural_momentum", momentum)
    # The last break of each kind, to tell whether a change of character has been answered.
    seen = series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda kind: F.max(F.when(event.startswith(kind), F.col("ts"))).over(seen)
    return rows.withColumns({"bos_at": of("bos"), "choch_at": of("choch")}).drop("__leg", "__kind", "__level", "__at", "__ok", "__i", "__reached", "__took")


def with_permission(rows: DataFrame) -> DataFrame:
    """structure_confidence (0 to 100) and allowed_side (long, short, both, or null for none). Needs trend, in_range, tf_alignment and :func:`with_last_break`."""
    trend, kind, accepted = F.col("trend"), F.col("last_break"), F.col("last_accepted")
    clear = ladder((trend.isin("uptrend", "downtrend"), 15), ((trend == "range") & F.col("in_range"), 10), otherwise=-20)
    event = F.when(kind.startswith("bos") & accepted, 20).when(kind.startswith("bos") & ~accepted, -15).when(kind.startswith("choch"), -10).otherwise(0)
    align = ladder((F.col("tf_alignment") == "full_align", 15), (F.col("tf_alignment") == "counter_trend", -20), (F.col("tf_alignment") == "partial_align", 5), otherwise=0)
    pace = ladder((F.col("structural_momentum") == "fast", 10), (F.col("structural_momentum") == "stalled", -15), otherwise=0)
    rows = rows.withColumn("structure_confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(50.0) + clear + event + align + pace)))
    answered = F.col("choch_at").isNull() | F.coalesce(F.col("bos_at") > F.col("choch_at"), F.lit(False))
    side = F.when(F.col("structure_confidence") < 40, F.lit(None)).when(F.col("in_range"), "both").when((trend == "uptrend") & answered, "long").when((trend == "downtrend") & answered, "short")
    return rows.withColumn("allowed_side", side)


def structure_score(rows: DataFrame) -> DataFrame:
    """structure_score, -1 to 1: half of the confidence towards the trend (0 without one), more for an accepted break, agreement with the higher interval and a fast follow-through, less for a rejected one, a change of character, disagreement or a stall. Needs :func:`with_permission`."""
    trend, kind, accepted = F.col("trend"), F.col("last_break"), F.col("last_accepted")
    base = ladder((trend == "uptrend", 0.5), (trend == "downtrend", -0.5), otherwise=0.0) * F.col("structure_confidence") / 100
    broke = kind.startswith("bos")
    event = ladder((broke & accepted, 1.3), (broke & ~accepted, 0.5), (kind.startswith("choch"), 0.6), otherwise=1.0)
    align = ladder((F.col("tf_alignment") == "full_align", 1.2), (F.col("tf_alignment") == "counter_trend", 0.4), otherwise=1.0)
    pace = ladder((F.col("structural_momentum") == "fast", 1.15), (F.col("structural_momentum") == "stalled", 0.7), otherwise=1.0)
    return rows.withColumn("structure_score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base * event * align * pace)))


def structure_veto(allowed: Column, side: Column, confidence: Column) -> Column:
    """Whether structure forbids a signal: no side allowed, the other side allowed, or a range without high confidence."""
    return F.when(allowed.isNull(), True).when(allowed == "both", confidence < 60).otherwise(allowed != side)


def with_volume_verdict(rows: DataFrame, ratio: Column | None = None) -> DataFrame:
    """Who began a move, who absorbed it, who is trapped, the volume's quality, confidence and verdict. From volume.with_candle_delta and volume.with_exhaustion, price_change over the same bars, and mtf_volume, mtf_accepted and mtf_confidence (null without a higher interval). ``ratio``: signed volume's share where it is known exactly; beyond a quarter it counts as institutional."""
    bias, risk, delta, change = F.col("aggression_bias"), F.col("exhaustion_risk"), F.col("recent_delta"), F.col("price_change")
    buys, sells, diverged = bias.endswith("buy"), bias.endswith("sell"), F.col("delta_divergence")
    run = F.coalesce(F.col("mtf_volume") == "stop_run", F.lit(False))
    accepted = F.coalesce(F.col("mtf_accepted"), F.lit(False))
    tired = risk.isin("high", "extreme")
    absorbed = ladder((diverged & (change > 0) & (delta < 0), "asks"), (diverged & (change < 0) & (delta > 0), "bids"), otherwise="none")
    trapped = ladder((run & (change > 0), "shorts"), (run, "longs"), (tired & buys, "late_longs"), (tired & sells, "late_shorts"), otherwise="none")
    exact = F.abs(ratio) > 0.25 if ratio is not None else F.lit(False)
    quality = ladder((accepted & (F.col("delta_strength") > 70), "institutional"), (run, "retail"), (exact, "institutional"), otherwise="mixed")
    base = (F.col("delta_strength") + F.col("exhaustion_confidence")) / 2
    sure = F.when(F.col("mtf_confidence").isNotNull(), (base + F.col("mtf_confidence")) / 2).otherwise(base)
    verdict = ladder((risk == "extreme", "caution"), (diverged & (delta > 0), "bullish"), (diverged, "bearish"), ((buys | sells) & (risk == "high"), "neutral"), (buys, "bullish"), (sells, "bearish"), otherwise="neutral")
    began = ladder((buys, "buyers"), (sells, "sellers"), otherwise="unclear")
    return rows.withColumns({"began_by": began, "absorbed_by": absorbed, "trapped": trapped, "volume_quality": quality, "volume_confidence": sure, "volume_verdict": verdict})


def funding_verdict(zone: Column, combo: Column, probability: Column) -> tuple[Column, Column, Column]:
    """Whether to chase, the verdict, and its confidence, from the funding zone and its combination with open interest (null: unknown)."""
    extreme = zone.startswith("extreme")
    verdict = ladder((combo == "crowded_longs_rising", "bearish"), (combo == "crowded_shorts_rising", "bullish"), ((combo == "capitulation") | extreme, "warning"), otherwise="neutral")
    sure = 50.0 + F.when(extreme, 20.0).otherwise(0.0) + F.when(zone.startswith("high"), 10.0).otherwise(0.0) + F.when(probability > 60, 10.0).otherwise(0.0)
    return ~(extreme | zone.startswith("high")), verdict, F.least(F.lit(90.0), sure)
