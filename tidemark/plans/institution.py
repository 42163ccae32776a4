"""Queries on structure with swing strength."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import institution as I
from . import oracle as Q
from .market import KEY, day, hour, rounded
from .momentum import recursion

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SEEN = f"({Q.W} ROWS UNBOUNDED PRECEDING)"
_NEXT = f"({Q.W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
_AROUND = f"({Q.W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_LEG = "PARTITION BY symbol, leg ORDER BY ts"
_HELD = lambda x: f"list_filter(list({x}) OVER {_SEEN}, lambda v: v IS NOT NULL)"


def _state(unit: str, s: str) -> str:
    """CTEs of the structure at each bar of a unit, in st{s}."""
    bars = Q.bars(unit).split("bars AS", 1)[1]
    return (
        f"b{s} AS{bars}, t{s} AS (SELECT *, CASE WHEN lag(close) OVER ({Q.W}) IS NULL THEN 0 ELSE greatest(high - low, abs(high - lag(close) OVER ({Q.W})), abs(low - lag(close) OVER ({Q.W}))) END AS tr FROM b{s})"
        + recursion(f"t{s}", "tr", 14, "1.0 / 14")
        + f""", a{s} AS (SELECT n.*, CASE WHEN n.close > 0 THEN coalesce(e.e, 0) / n.close * 100 ELSE 0 END AS ap FROM t{s}_n n LEFT JOIN t{s}_e e ON n.symbol = e.symbol AND n.i = e.i),
p{s} AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv, count(*) OVER {_AROUND} = 7 AS full7, max(high) OVER {_AROUND} AS mh, min(low) OVER {_AROUND} AS ml, lag(high) OVER ({Q.W}) AS ph, lead(high) OVER ({Q.W}) AS nh, lag(low) OVER ({Q.W}) AS pl, lead(low) OVER ({Q.W}) AS nl FROM a{s}),
s{s} AS (SELECT *, CASE WHEN full7 AND high = mh AND high > ph AND high > nh THEN high END AS sh, CASE WHEN full7 AND low = ml AND low < pl AND low < nl THEN low END AS sl FROM p{s}),
o{s} AS (SELECT *, last_value(sl IGNORE NULLS) OVER ({Q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ol, last_value(sh IGNORE NULLS) OVER {_SEEN} AS oh FROM s{s}),
g{s} AS (SELECT *, CASE WHEN sh IS NOT NULL THEN coalesce(CASE WHEN ap > 0 AND ol IS NOT NULL AND sh <> 0 THEN greatest(0, least(1, abs(sh - ol) / sh * 100 / ap)) END, 0.5) END AS hq, CASE WHEN sl IS NOT NULL THEN coalesce(CASE WHEN ap > 0 AND oh IS NOT NULL AND sl <> 0 THEN greatest(0, least(1, abs(sl - oh) / sl * 100 / ap)) END, 0.5) END AS lq FROM o{s}),
k{s} AS (SELECT *, lag(sh, 3) OVER ({Q.W}) AS kh, lag(sl, 3) OVER ({Q.W}) AS kl, lag(list_filter([hq, lq], lambda v: v IS NOT NULL), 3) OVER ({Q.W}) AS kq FROM g{s}),
l{s} AS (SELECT *, coalesce({_HELD('kh')}, []) AS hs, coalesce({_HELD('kl')}, []) AS ls, flatten({_HELD('kq')}) AS qs FROM k{s}),
c{s} AS (SELECT *, hs[-1] > hs[-2] AS h1, hs[-2] > hs[-3] AS h2, ls[-1] > ls[-2] AS l1, ls[-2] > ls[-3] AS l2 FROM l{s}),
d{s} AS (SELECT *, CASE WHEN len(hs) < 2 OR len(ls) < 2 THEN 'unknown' WHEN (h1 OR coalesce(h2, false)) AND (l1 OR coalesce(l2, false)) AND h1 AND coalesce(h2, true) THEN 'uptrend' WHEN (NOT h1 OR NOT coalesce(h2, true)) AND (NOT l1 OR NOT coalesce(l2, true)) AND NOT h1 AND NOT coalesce(h2, false) THEN 'downtrend' ELSE 'range' END AS trend,
  greatest(0.05, ap * 0.15) / 100 AS far, greatest(0.03, ap * 0.1) / 100 AS near, hs[-1] AS lh, ls[-1] AS ll, max(rv) OVER {_NEXT} >= 1.2 AS loud, max(close) OVER {_NEXT} AS mxc, min(close) OVER {_NEXT} AS mnc, count(*) OVER {_NEXT} = 3 AS full3 FROM c{s}),
e{s} AS (SELECT *, CASE WHEN trend = 'uptrend' AND close > lh * (1 + far) THEN 'bos_bullish' WHEN trend = 'downtrend' AND close < ll * (1 - far) THEN 'bos_bearish' WHEN trend = 'uptrend' AND close < ll * (1 - far) THEN 'choch_bearish' WHEN trend = 'downtrend' AND close > lh * (1 + far) THEN 'choch_bullish' ELSE 'none' END AS ev,
  coalesce(len(ls) >= 2 AND low < ll * (1 - near) AND close > ll, false) AS swl, coalesce(len(hs) >= 2 AND high > lh * (1 + near) AND close < lh, false) AS swh FROM d{s}),
f{s} AS (SELECT *, CASE WHEN full3 AND ev = 'bos_bullish' THEN mnc >= lh AND loud WHEN full3 AND ev = 'bos_bearish' THEN mxc <= ll AND loud END AS acc, sum(starts_with(ev, 'bos')::INT) OVER {_SEEN} AS leg, avg(ap) OVER {Q.rows(20)} AS calm, max(starts_with(ev, 'choch')::INT) OVER {Q.rows(5)} AS turned FROM e{s}),
h{s} AS (SELECT *, row_number() OVER ({_LEG}) - 1 AS since, first(ev) OVER ({_LEG}) AS way, first(close) OVER ({_LEG}) AS price, first(acc) OVER ({_LEG}) AS acc1 FROM f{s}),
m{s} AS (SELECT *, min(CASE WHEN leg > 0 AND since > 0 AND CASE WHEN way = 'bos_bullish' THEN high - price ELSE price - low END / nullif(price, 0) * 100 >= 0.5 * ap THEN since END) OVER ({_LEG} ROWS UNBOUNDED PRECEDING) AS took,
  (leg = 0 OR since >= 20) AND CASE WHEN i < 14 THEN true WHEN i < 20 THEN ap < 0 ELSE ap < calm END AND len(hs) > 0 AND len(ls) > 0 AS rng FROM h{s}),
st{s} AS (SELECT *, CASE WHEN leg = 0 OR since = 0 THEN 'slow' WHEN took <= 3 THEN 'fast' WHEN took <= 10 THEN 'slow' WHEN took IS NOT NULL OR since > 10 THEN 'stalled' ELSE 'slow' END AS mo,
  CASE WHEN i < 10 THEN 0 ELSE greatest(0, least(100, 50.0 + CASE WHEN trend IN ('uptrend', 'downtrend') THEN 20 WHEN trend = 'range' AND rng THEN 10 ELSE -20 END + CASE WHEN leg > 0 AND since >= 3 AND acc1 THEN 20 WHEN leg > 0 AND since >= 3 AND NOT acc1 THEN -15 ELSE 0 END - 10 * turned + coalesce(list_avg(qs[-5:]), 0) * 10)) END AS power FROM m{s})"""
    )


@query(f"WITH RECURSIVE {_state('hour', '1')} SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('ap', 'atr_pct')}, {Q.r('sh', 'swing_high')}, {Q.r('sl', 'swing_low')}, {Q.r('hq', 'high_strength')}, {Q.r('lq', 'low_strength')} FROM g1 WHERE sh IS NOT NULL OR sl IS NOT NULL")
def institutional_swings(spark, d):
    rows = I.with_swings(hour(spark, d)).where("swing_high is not null or swing_low is not null")
    return rounded(rows, *KEY, "atr_pct", "swing_high", "swing_low", "high_strength", "low_strength")


@query(
    f"""WITH RECURSIVE {_state('hour', '1')} SELECT symbol, ts::TIMESTAMPTZ AS ts, trend, ev AS structure_event, acc AS bos_accepted, swl AS swept_low, swh AS swept_high, swl AND coalesce(loud AND mxc > close, false) AS low_sweep_confirmed, swh AND coalesce(loud AND mnc < close, false) AS high_sweep_confirmed,
 rng AS ranging, {Q.r('CASE WHEN rng THEN list_max(hs[-5:]) END', 'range_top')}, {Q.r('CASE WHEN rng THEN list_min(ls[-5:]) END', 'range_bottom')}, mo AS structure_momentum, {Q.r('power::DOUBLE', 'structure_strength')} FROM st1"""
)
def institutional_structure(spark, d):
    return rounded(I.structure(hour(spark, d)), *KEY, "trend", "structure_event", "bos_accepted", "swept_low", "swept_high", "low_sweep_confirmed", "high_sweep_confirmed", "ranging", "range_top", "range_bottom", "structure_momentum", "structure_strength")


@query(
    f"""WITH RECURSIVE {_state('hour', '1')}, {_state('day', '2')},
j AS (SELECT l.symbol, l.ts, l.trend AS lt, h.trend AS ht FROM st1 l ASOF LEFT JOIN st2 h ON l.symbol = h.symbol AND l.ts >= h.ts + INTERVAL 1 DAY),
k AS (SELECT *, CASE WHEN ht IS NULL THEN NULL WHEN ht = 'range' THEN 'range_dominant' WHEN ht = lt THEN 'aligned' ELSE 'mixed' END AS al FROM j)
SELECT symbol, ts::TIMESTAMPTZ AS ts, lt AS trend, ht AS htf_trend, al AS structure_alignment, CASE al WHEN 'range_dominant' THEN 'range_mode' WHEN 'aligned' THEN 'trend_mode' WHEN 'mixed' THEN 'scalp_only' END AS trading_mode FROM k"""
)
def institutional_alignment(spark, d):
    """Hourly structure against that of the last day that has ended."""
    low = I.structure(hour(spark, d)).select("symbol", "ts", "seq", "trend")
    high = I.structure(day(spark, d)).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("trend").alias("htf_trend"))
    kind, mode = I.alignment(F.col("htf_trend"), F.col("trend"))
    return A.asof(low, high, "htf_trend").select(*KEY, "trend", "htf_trend", kind.alias("structure_alignment"), mode.alias("trading_mode"))
