"""Queries on the candle engines; averages and latches are recursive SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import engines as N
from ..operators import kernels as K
from ..operators import momentum as M
from ..functions.scalars import bias_way, series
from ..operators import timing as T
from ..operators import vwap as W
from ..operators.scan import scan
from . import market, momentum
from . import oracle as Q
from .flow import _PIVOTS
from .live import _vwap
from .market import KEY, hour, rounded
from .momentum import _MACD, _REC, _TR, filtered, recursion

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ribbon_sql() -> str:
    """All averages in one recursion from the first bar, and the smoothed width in another from the bar of the longest period on."""
    periods, longest = N.RIBBON, max(N.RIBBON)
    es = [f"e{p}" for p in periods]
    step = ", ".join(f"p.e{p} + 2.0 / {p + 1} * (n.close - p.e{p})" for p in periods)
    pairs = list(zip(es, es[1:], strict=False))
    share = lambda op: "(" + " + ".join(f"({a} {op} {b})::INT" for a, b in pairs) + f") / {len(pairs)}.0"
    half, wt, st, pb = len(es) // 2, *N.RIBBON_FIXED["1h"]
    k = N.SLOPE_BARS["1h"] + 1
    clip = lambda x: f"greatest(0, least(1, {x}))"
    return (
        _REC("hour")
        + f""", b AS (SELECT *, row_number() OVER ({Q.W}) AS i FROM bars),
e AS (SELECT symbol, i, {', '.join(f'close AS {x}' for x in es)} FROM b WHERE i = 1 UNION ALL SELECT n.symbol, n.i, {step} FROM e p JOIN b n ON n.symbol = p.symbol AND n.i = p.i + 1),
w AS (SELECT e.*, b.ts, b.close, (greatest({', '.join(es)}) - least({', '.join(es)})) / (b.close + 1e-10) AS wd, list_sort([{', '.join(es)}]) AS o FROM e JOIN b USING (symbol, i) WHERE i >= {longest}),
s AS (SELECT symbol, i, wd AS ws FROM w WHERE i = {longest} UNION ALL SELECT w.symbol, w.i, s.ws + 2.0 / 6 * (w.wd - s.ws) FROM s JOIN w ON w.symbol = s.symbol AND w.i = s.i + 1),
x AS (SELECT w.*, s.ws, {share('>')} AS u, {share('<')} AS d, (o[{half}] + o[{half + 1}]) / 2 AS ce FROM w JOIN s USING (symbol, i)),
y AS (SELECT *, coalesce((ws - lag(ws) OVER ({Q.W})) / (abs(lag(ws) OVER ({Q.W})) + 1e-10), 0) AS wr, greatest(u, d) AS sc, CASE WHEN u >= 0.6 AND u > d THEN 'BULL' WHEN d >= 0.6 AND d > u THEN 'BEAR' ELSE 'NEUTRAL' END AS di, coalesce((ce - lag(ce, {k}) OVER ({Q.W})) / (abs(lag(ce, {k}) OVER ({Q.W})) + 1e-10), 0) AS sl FROM x),
z AS (SELECT *, CASE WHEN sc < 0.6 OR (ws < 0.7 * {wt} AND abs(sl) < 0.5 * {st}) OR di = 'NEUTRAL' THEN 'CHOP' WHEN sc >= 0.8 AND ws >= {wt} AND sl * CASE WHEN di = 'BULL' THEN 1 ELSE -1 END >= {st} AND wr >= -0.15 THEN 'HEALTHY' WHEN sc >= 0.7 AND wr <= -0.2 AND abs(sl) < {st} THEN 'EXHAUSTING' ELSE 'WEAKENING' END AS state FROM y)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('sc', 'stack_score')}, di AS ribbon_direction, {Q.r('ws', 'width_smooth')}, {Q.r('wr', 'width_rate')}, {Q.r('ce', 'center')}, {Q.r('sl', 'center_slope')}, state AS ribbon_state,
 {Q.r(f"least(100 * (0.3 * {clip('(sc - 0.5) / 0.5')} + 0.25 * {clip(f'ws / (2 * {wt} + 1e-10)')} + 0.25 * {clip(f'abs(sl) / (2 * {st} + 1e-10)')} + 0.2 * {clip('(wr + 0.15) / (0.3 + 1e-10)')}), CASE state WHEN 'CHOP' THEN 35 WHEN 'EXHAUSTING' THEN 60 ELSE 100 END)", 'ribbon_strength')},
 abs(close - ce) <= {pb} * close AS ribbon_pullback FROM z"""
    )


ORACLES["ema_ribbon"] = _ribbon_sql()
ORACLES["roc_momentum"] = (
    _REC("hour")
    + _TR
    + recursion("tr", "tr", 14, "1.0 / 14")
    + f""", a AS (SELECT n.symbol, n.ts, n.i, n.close, coalesce(e.e, n.tr) / (n.close + 1e-10) AS ap, lag(n.close, 3) OVER (PARTITION BY n.symbol ORDER BY n.ts) AS c3, lag(n.close, 6) OVER (PARTITION BY n.symbol ORDER BY n.ts) AS c6, lag(n.close, 12) OVER (PARTITION BY n.symbol ORDER BY n.ts) AS c12 FROM tr_n n LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i),
b AS (SELECT *, (close - c3) / (c3 + 1e-10) AS rf, (close - c6) / (c6 + 1e-10) AS rm FROM a WHERE c12 IS NOT NULL),
sm AS (SELECT symbol, i, rf AS s FROM b WHERE i = 13 UNION ALL SELECT b.symbol, b.i, sm.s + 0.5 * (b.rf - sm.s) FROM sm JOIN b ON b.symbol = sm.symbol AND b.i = sm.i + 1),
c AS (SELECT b.*, greatest(-3, least(3, rf / (ap + 1e-10))) AS f, greatest(-3, least(3, rm / (ap + 1e-10))) AS m, s - coalesce(lag(s) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0) AS ac FROM b JOIN sm USING (symbol, i)),
d AS (SELECT *, CASE WHEN abs(f) < 0.3 AND abs(m) < 0.3 THEN 'NOISE' WHEN (f > 0.8 AND m > 0 AND ac > 0) OR (f < -0.8 AND m < 0 AND ac < 0) THEN 'IMPULSE' WHEN f * m < 0 THEN 'PULLBACK' WHEN (abs(f) >= 0.8 AND ((f > 0 AND ac < 0) OR (f < 0 AND ac > 0))) OR (abs(m) < 0.3 AND abs(f) > 0.3) THEN 'FADE' ELSE 'NOISE' END AS st,
  100 * (0.5 * least(abs(f) / 0.8, 1) + 0.3 * least(abs(m) / 0.8, 1) + 0.2 * least(abs(ac) / (abs(rf) + 1e-10), 1)) AS raw FROM c),
e AS (SELECT *, CASE WHEN st = 'NOISE' THEN least(raw, 25) ELSE raw END AS sc, abs(f) > 1.5 AS bl FROM d)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('rf', 'roc_fast')}, {Q.r('f', 'roc_fast_norm')}, {Q.r('m', 'roc_mid_norm')}, {Q.r('ac', 'roc_accel')}, st AS momentum_state, {Q.r('sc', 'momentum_score')}, bl AS blowoff, NOT bl AND st = 'IMPULSE' AND f > 0 AND sc >= 50 AS allows_long, NOT bl AND st = 'IMPULSE' AND f < 0 AND sc >= 50 AS allows_short,
 {Q.r('CASE WHEN bl THEN 0.3 WHEN sc >= 70 THEN 1.0 WHEN sc >= 50 THEN 0.8 WHEN sc >= 30 THEN 0.5 ELSE 0.3 END::DOUBLE', 'size_multiplier')} FROM e"""
)


@query
def ema_ribbon(spark, d):
    return rounded(N.ribbon(hour(spark, d), "1h"), *KEY, "stack_score", "ribbon_direction", "width_smooth", "width_rate", "center", "center_slope", "ribbon_state", "ribbon_strength", "ribbon_pullback")


@query
def roc_momentum(spark, d):
    rows = N.entry_filter(N.momentum(hour(spark, d), "1h"))
    return rounded(rows, *KEY, "roc_fast", "roc_fast_norm", "roc_mid_norm", "roc_accel", "momentum_state", "momentum_score", "blowoff", "allows_long", "allows_short", "size_multiplier")


_EVENTS = (
    _MACD
    + _TR
    + recursion("tr", "tr", 14, "1.0 / 14", 2)
    + f""", ma AS (SELECT m.symbol, m.ts, m.hist, CASE WHEN e.e IS NOT NULL THEN greatest(-3, least(3, m.hist / (e.e + 1e-12))) ELSE m.hist END AS h FROM mc m JOIN tr_n n USING (symbol, ts) LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i WHERE m.hist IS NOT NULL),
mb AS (SELECT *, lag(h) OVER ({Q.W}) AS b, h - lag(h) OVER ({Q.W}) AS s, hist - lag(hist) OVER ({Q.W}) AS sl FROM ma),
md AS (SELECT *, sl - lag(sl) OVER ({Q.W}) AS ac, CASE WHEN b <= 0 AND h > 0 AND s > 0.05 THEN 'BULL_SHIFT' WHEN b >= 0 AND h < 0 AND s < -0.05 THEN 'BEAR_SHIFT' WHEN h > 0 AND s < -0.05 THEN 'BULL_WEAKEN' WHEN h < 0 AND s > 0.05 THEN 'BEAR_WEAKEN' ELSE 'NONE' END AS ev FROM mb),
me AS (SELECT *, 100 * (0.6 * least(abs(h) / (0.04 + 1e-12), 2) / 2 + 0.4 * least(abs(s) / (0.1 + 1e-12), 2) / 2) AS sure FROM md)"""
)
ORACLES["macd_events"] = (
    _REC("hour")
    + _EVENTS
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('h', 'hist_norm')}, {Q.r('sl', 'hist_slope')}, {Q.r('ac', 'hist_accel')}, CASE WHEN hist > 0 THEN 'BULL' ELSE 'BEAR' END AS macd_phase, ev AS macd_event, {Q.r("CASE WHEN ev <> 'NONE' THEN CASE WHEN abs(h) < 0.02 THEN least(sure, 50) ELSE sure END END", 'event_confidence')} FROM me"""
)


@query
def macd_events(spark, d):
    return rounded(N.macd_events(hour(spark, d), confirm=1), *KEY, "hist_norm", "hist_slope", "hist_accel", "macd_phase", "macd_event", "event_confidence")


def timing_rsi(source: str) -> str:
    """CTEs that give ``<source>_r``: the engines' RSI of a source with symbol, ts and close."""
    x, before = source, f"lag(close) OVER ({Q.W})"
    return (
        f""", {x}_g AS (SELECT symbol, ts, greatest(close - {before}, 0) AS u, greatest({before} - close, 0) AS l FROM {x}), {x}_u AS (SELECT symbol, ts, u FROM {x}_g), {x}_d AS (SELECT symbol, ts, l FROM {x}_g)"""
        + recursion(f"{x}_u", "u", 14, "1.0 / 14", 2)
        + recursion(f"{x}_d", "l", 14, "1.0 / 14", 2)
        + f", {x}_r AS (SELECT n.symbol, n.ts, n.i, CASE WHEN a.e = 0 AND b.e = 0 THEN 50 ELSE 100 - 100 / (1 + a.e / (b.e + 1e-12)) END AS rsi FROM {x}_u_n n LEFT JOIN {x}_u_e a ON n.symbol = a.symbol AND n.i = a.i LEFT JOIN {x}_d_e b ON n.symbol = b.symbol AND n.i = b.i)"
    )


def timing_stoch(source: str) -> str:
    """CTEs that give ``<source>_z``: %K and %D of ``<source>_r`` with their zone."""
    x, three = source, Q.rows(3)
    return f""", {x}_lo AS (SELECT symbol, ts, rsi, min(rsi) OVER {Q.rows(14)} AS lo, max(rsi) OVER {Q.rows(14)} AS hi FROM {x}_r WHERE rsi IS NOT NULL),
{x}_p AS (SELECT symbol, ts, CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (rsi - lo) / (hi - lo + 1e-12))) END AS p FROM {x}_lo),
{x}_k AS (SELECT symbol, ts, CASE WHEN count(p) OVER {three} = 3 THEN avg(p) OVER {three} END AS k FROM {x}_p),
{x}_z AS (SELECT *, CASE WHEN count(k) OVER {three} = 3 THEN avg(k) OVER {three} END AS d, CASE WHEN k IS NULL THEN 'WARMUP' WHEN k <= 0.2 THEN 'OVERSOLD' WHEN k >= 0.8 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS zone FROM {x}_k)"""


#: The stages of a failure swing, for the RSI and for what it lacks to 100.
_FAILURES = """, fx AS (SELECT symbol, i, side, CASE side WHEN 'BEAR' THEN rsi ELSE 100 - rsi END AS x FROM bars_r, (VALUES ('BEAR'), ('BULL')) AS sides(side) WHERE rsi IS NOT NULL),
fs AS (SELECT symbol, side, min(i) - 1 AS i, 0 AS stage, 0::DOUBLE AS peak, 0::DOUBLE AS low, false AS broke FROM fx GROUP BY ALL
  UNION ALL SELECT n.symbol, n.side, n.i,
    CASE p.stage WHEN 0 THEN CASE WHEN x >= 60 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN x < 45 THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN x > 45 AND x >= low THEN CASE WHEN x < peak THEN 3 ELSE 0 END ELSE 2 END ELSE CASE WHEN x < low - 1 OR x > 60 THEN 0 ELSE 3 END END,
    CASE WHEN p.stage = 0 AND x >= 60 THEN x WHEN p.stage = 1 AND x >= 45 THEN greatest(peak, x) ELSE peak END,
    CASE WHEN p.stage = 1 AND x < 45 THEN x WHEN p.stage = 2 AND NOT (x > 45 AND x >= low) THEN least(low, x) ELSE low END,
    p.stage = 3 AND x < low - 1
  FROM fs p JOIN fx n ON n.symbol = p.symbol AND n.side = p.side AND n.i = p.i + 1),
ff AS (SELECT symbol, i, bool_or(broke) FILTER (side = 'BULL') AS bull, bool_or(broke) FILTER (side = 'BEAR') AS bear FROM fs GROUP BY ALL)"""
ORACLES["rsi_timing"] = (
    _REC("hour")
    + timing_rsi("bars")
    + timing_stoch("bars")
    + _FAILURES
    + f""" SELECT r.symbol, r.ts::TIMESTAMPTZ AS ts, {Q.r('rsi', 'timing_rsi')}, CASE WHEN rsi IS NULL THEN 'WARMUP' WHEN rsi >= 55 THEN 'BULLISH' WHEN rsi <= 45 THEN 'BEARISH' ELSE 'RANGE' END AS rsi_regime, CASE WHEN rsi IS NULL THEN 'NONE' WHEN bull THEN 'BULL' WHEN bear THEN 'BEAR' ELSE 'NONE' END AS failure_swing,
 {Q.r('k', 'timing_k')}, {Q.r('d', 'timing_d')}, coalesce(zone, 'WARMUP') AS stoch_zone FROM bars_r r LEFT JOIN bars_z z ON r.symbol = z.symbol AND r.ts = z.ts LEFT JOIN ff ON r.symbol = ff.symbol AND r.i = ff.i"""
)
_PAIR = "PARTITION BY symbol, side ORDER BY ts"
ORACLES["rsi_divergences"] = (
    _REC("hour")
    + _PIVOTS
    + timing_rsi("bars")
    + _TR
    + recursion("tr", "tr", 14, "1.0 / 14", 2)
    + f""", dp AS (SELECT symbol, ts, 'BEAR' AS side, sh AS p FROM s WHERE sh IS NOT NULL UNION ALL SELECT symbol, ts, 'BULL', sl FROM s WHERE sl IS NOT NULL),
dr AS (SELECT dp.symbol, dp.ts, side, p, r.rsi, r.i, coalesce(0.15 * e.e / (n.close + 1e-12), 0.001) * p AS least_, CASE side WHEN 'BEAR' THEN 1 ELSE -1 END AS way FROM dp JOIN bars_r r USING (symbol, ts) JOIN tr_n n USING (symbol, ts) LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i WHERE r.rsi IS NOT NULL),
dd AS (SELECT *, (p - lag(p) OVER ({_PAIR})) * way AS a, (rsi - lag(rsi) OVER ({_PAIR})) * way AS b, i - lag(i) OVER ({_PAIR}) AS n FROM dr),
dk AS (SELECT *, CASE WHEN a > 0 AND b <= 0 THEN 'REG_' || side WHEN a <= 0 AND b > 0 THEN 'HID_' || side END AS kind FROM dd)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('p', 'price')}, {Q.r('rsi', 'timing_rsi')}, kind AS divergence, {Q.r('100 * (0.5 * least(abs(a) / (least_ + 1e-12), 3) / 3 + 0.5 * least(abs(b) / 10, 3) / 3)', 'divergence_strength')}
FROM dk WHERE kind IS NOT NULL AND n >= 3 AND abs(a) >= least_ AND (abs(a) >= 2 * least_ OR abs(b) >= 3)"""
)
_TURNED = lambda x: f"CASE WHEN way = -1 THEN 1 - {x} ELSE {x} END"
ORACLES["stoch_micro_timing"] = (
    _REC("hour")
    + filtered("bars", "1h")
    + ", fb AS (SELECT symbol, ts, c AS close FROM bars_f)"
    + timing_rsi("fb")
    + timing_stoch("fb")
    + f""", mj AS (SELECT symbol, ts, CASE f.bias WHEN 'BULL' THEN 1 WHEN 'BEAR' THEN -1 ELSE 0 END AS way, k, d, coalesce(zone, 'WARMUP') AS zone FROM bars_f f LEFT JOIN fb_z USING (symbol, ts)),
ml AS (SELECT *, lag(k) OVER ({Q.W}) AS k0, lag(d) OVER ({Q.W}) AS d0 FROM mj), mt AS (SELECT *, {_TURNED('k')} AS tk, {_TURNED('d')} AS td, {_TURNED('k0')} AS tk0, {_TURNED('d0')} AS td0 FROM ml),
mf AS (SELECT *, coalesce(way <> 0 AND d IS NOT NULL AND ((tk0 < 0.2 AND tk > 0.2 AND tk > tk0) OR (tk <= 0.3 AND td <= 0.3 AND tk0 <= td0 AND tk > td)), false) AS fit FROM mt)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('k', 'timing_k')}, {Q.r('d', 'timing_d')}, zone AS stoch_zone, CASE WHEN NOT fit THEN 'NONE' WHEN way = 1 THEN 'PULLBACK_DONE_UP' ELSE 'PULLBACK_DONE_DOWN' END AS micro_timing,
 {Q.r('CASE WHEN fit THEN 100 * least(greatest(0, least(1, (tk - 0.2) / (0.3 + 1e-12))) + CASE WHEN tk > td THEN 0.2 ELSE 0 END, 1) END', 'micro_confidence')} FROM mf"""
)
ORACLES["trend_strength"] = (
    _REC("hour")
    + filtered("bars", "1h")
    + f""", sv AS (SELECT f.*, b.volume, (b.high - b.low) / nullif(b.close, 0) AS ap FROM bars_f f JOIN bars b USING (symbol, ts)),
sw AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv FROM sv),
sx AS (SELECT *, 100 * (0.35 * greatest(0, least(1, abs(s50) / (0.2 * ap + 1e-12))) + 0.2 * greatest(0, least(1, (rv - 0.8) / (1.2 + 1e-12)))) / 0.55 AS raw FROM sw)"""
    + recursion("sx", "raw", 1, "2.0 / 6")
    + f""", sy AS (SELECT n.*, e.e AS sm FROM sx_n n JOIN sx_e e ON n.symbol = e.symbol AND n.i = e.i), sz AS (SELECT *, least(sm, CASE WHEN regime = 'RANGE' THEN 50 ELSE 100 END, CASE WHEN rv < 0.3 THEN 25 ELSE 100 END) AS st FROM sy)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('raw', 'strength_raw')}, {Q.r('st', 'strength')}, {Q.r("st * CASE bias WHEN 'BULL' THEN 1 WHEN 'BEAR' THEN -1 ELSE 0 END", 'strength_signed')}, CASE WHEN st <= 30 THEN 'WEAK' WHEN st <= 60 THEN 'EMERGING' ELSE 'STRONG' END AS strength_bucket FROM sz"""
)


@query
def rsi_timing(spark, d):
    return rounded(scan(hour(spark, d), [N.RsiTiming, N.StochTiming]), *KEY, "timing_rsi", "rsi_regime", "failure_swing", "timing_k", "timing_d", "stoch_zone")


@query
def trend_strength(spark, d):
    rows = K.with_relative_volume(M.ema_filter(hour(spark, d), "1h"))
    none = F.lit(None).cast("double")
    bias = bias_way(F.col("ema_bias"))
    rows = rows.withColumns({"ribbon_width_rate": none, "oi_now": none, "oi_prev": none, "atr_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "direction_bias": bias, "is_range": F.col("ema_regime") == "RANGE", "is_chop": F.lit(False)})
    return rounded(N.trend_strength(rows, "1h"), *KEY, "strength_raw", "strength", "strength_signed", "strength_bucket")


def interaction(source: str, share: str = "NULL::DOUBLE") -> str:
    """CTEs that give ``vz``, the interaction state of rows with a (distance to the VWAP), close, vwap, sd and rv, and the ATR's ``share`` of the close; counters of one row come from the last one's, reclaims before losses before rejections before acceptances."""
    crossed = lambda a, b, way: f"CASE WHEN c{a} AND a * {way} >= far THEN true WHEN c{a} AND a * {way} <= -far THEN false ELSE c{a} END AS c{b}, CASE WHEN c{a} AND a * {way} >= far THEN b{a} + 1 WHEN c{a} AND a * {way} <= -far THEN 0 ELSE b{a} END AS b{b}"
    return f""", va AS (SELECT symbol, ts, a, row_number() OVER ({Q.W}) AS i, abs(a) <= 0.0003 OR coalesce(abs((close - vwap) / (sd + 1e-10)) <= 0.15, false) OR coalesce(abs(a) <= 0.05 * {share}, false) AS touch, greatest(0.0006, coalesce(0.1 * {share}, 0)) AS far, coalesce(rv >= 1.2, false) AS sure, CASE WHEN sign(a) <> 0 THEN sign(a)::INT END AS sg FROM {source} WHERE a IS NOT NULL),
vb AS (SELECT *, CASE WHEN touch THEN 0 ELSE sign(a)::INT END AS side, coalesce(last_value(sg IGNORE NULLS) OVER ({Q.W} ROWS UNBOUNDED PRECEDING), 0) AS sgn, i - max(CASE WHEN touch THEN i END) OVER ({Q.W} ROWS UNBOUNDED PRECEDING) <= 3 AS recent FROM va),
vc AS (SELECT *, (sgn <> coalesce(lag(sgn) OVER ({Q.W}), sgn))::INT AS ch FROM vb), vd AS (SELECT *, sum(ch) OVER {Q.rows(19)} AS n, sum(ch) OVER {Q.rows(19)} < 4 AS calm FROM vc), ve AS (SELECT *, calm OR sure AS ok, CASE WHEN calm THEN 2 ELSE 3 END AS need, CASE WHEN calm THEN 3 ELSE 2 END AS rneed FROM vd),
vm AS (SELECT symbol, 0::BIGINT AS i, 0 AS last, 0 AS hold, false AS cu, false AS cd, 0 AS bu, 0 AS bd, 0 AS au, 0 AS ad, 0 AS rej, 'NEUTRAL' AS state FROM (SELECT DISTINCT symbol FROM ve)
  UNION ALL SELECT symbol, i, CASE WHEN side <> 0 THEN side ELSE last END, CASE WHEN side = 0 THEN hold WHEN side = last THEN hold + 1 ELSE 1 END, cu, cd, bu, bd, au, ad, rej, CASE WHEN fu THEN 'RECLAIM' WHEN fd THEN 'LOSS' WHEN fr THEN 'REJECT' WHEN NOT (cu OR cd) AND rej = 0 AND greatest(au, ad) >= need AND (calm OR (sure AND greatest(au, ad) > need)) THEN 'ACCEPT' ELSE 'NEUTRAL' END
  FROM (SELECT * REPLACE (CASE WHEN fu OR fd THEN au WHEN fr OR cu OR cd THEN 0 WHEN rej > 0 OR side = 0 THEN au WHEN side = 1 THEN au + 1 ELSE 0 END AS au, CASE WHEN fu OR fd THEN ad WHEN fr OR cu OR cd THEN 0 WHEN rej > 0 OR side = 0 THEN ad WHEN side = -1 THEN ad + 1 ELSE 0 END AS ad)
  FROM (SELECT *, NOT (fu OR fd OR cu OR cd) AND rej >= rneed AS fr
  FROM (SELECT * REPLACE (CASE WHEN fu OR fd OR cu OR cd THEN 0 WHEN coalesce(recent, false) AND side <> 0 AND a * side >= 0.0003 THEN rej + 1 ELSE 0 END AS rej, CASE WHEN fu OR fd THEN 0 ELSE au END AS au, CASE WHEN fu OR fd THEN 0 ELSE ad END AS ad, cu AND NOT fd AS cu, CASE WHEN fd THEN 0 ELSE bu END AS bu)
  FROM (SELECT symbol, i, a, far, side, calm, sure, need, rneed, recent, last, hold, rej, au, ad, fu, cu, bu, cd, CASE WHEN NOT fu AND NOT fd AND NOT cd THEN 0 ELSE bd END AS bd, fd
  FROM (SELECT *, NOT fu AND bd >= need AND ok AS fd
  FROM (SELECT * EXCLUDE (cd1, bd1), {crossed('d1', 'd', -1)}
  FROM (SELECT *, CASE WHEN fu THEN false ELSE cd0 OR (last = 1 AND side = -1) END AS cd1, CASE WHEN fu OR (last = 1 AND side = -1) THEN 0 ELSE bd0 END AS bd1
  FROM (SELECT * REPLACE (CASE WHEN NOT fu AND NOT cu THEN 0 ELSE bu END AS bu)
  FROM (SELECT *, bu >= need AND ok AS fu
  FROM (SELECT * EXCLUDE (cu1, bu1), {crossed('u1', 'u', 1)}
  FROM (SELECT n.symbol, n.i, n.a, n.far, n.side, n.calm, n.sure, n.ok, n.need, n.rneed, n.recent, p.last, p.hold, p.rej, p.au, p.ad, p.cd AS cd0, p.bd AS bd0, p.cu OR (p.last = -1 AND n.side = 1) AS cu1, CASE WHEN p.last = -1 AND n.side = 1 THEN 0 ELSE p.bu END AS bu1 FROM vm p JOIN ve n ON n.symbol = p.symbol AND n.i = p.i + 1)
  ))))))))))),
vz AS (SELECT ve.symbol, ve.ts, m.state, ve.side, m.hold, ve.n::INT AS n FROM ve JOIN vm m ON ve.symbol = m.symbol AND ve.i = m.i)"""


ORACLES["vwap_state_machine"] = (
    _REC("hour")
    + _vwap("ts::DATE")
    + f", yr AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv FROM y)"
    + interaction("yr")
    + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('vwap', 'vwap')}, state AS vwap_state, side AS vwap_side, hold AS vwap_hold, z.n AS vwap_crossings FROM yr LEFT JOIN vz z USING (symbol, ts)"
)


@query
def vwap_state_machine(spark, d):
    rows = T.vwap_interaction(W.session(K.with_relative_volume(hour(spark, d))), "1h")
    return rounded(rows, *KEY, "vwap", "vwap_state", "vwap_side", "vwap_hold", "vwap_crossings")


_unrounded = lambda sql: re.sub(r"round\((.*?), 6\) \+ 0 AS", r"(\1) AS", sql)
_JOINED = lambda t: f"JOIN {t} ON {t}.symbol = b.symbol AND {t}.ts = b.ts::TIMESTAMPTZ"
_AGO = lambda k: f"lag(close, {k}) OVER ({Q.W})"
_INPUTS = (
    _REC("hour")
    + f""", rb AS ({_unrounded(ORACLES['ema_ribbon'])}), ax AS ({_unrounded(momentum.ORACLES['atr_expansion'])}), cp AS ({_unrounded(market.ORACLES['choppiness_14'])}),
rv AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv FROM bars),
b1 AS (SELECT b.*, ax.atr / (b.close + 1e-12) AS ap, ax.atr_exp AS ex, ax.tr_spike AS sp, ax.atr_exp_slope AS es, cp.chop, cp.chop_state, rb.width_rate AS wr, rb.ribbon_state <> 'CHOP' AS trend_ok, CASE rb.ribbon_direction WHEN 'BULL' THEN 1 WHEN 'BEAR' THEN -1 ELSE 0 END AS bias FROM rv b {_JOINED('rb')} {_JOINED('ax')} {_JOINED('cp')})"""
    + _vwap("ts::DATE", "b1")
    + interaction("y", "ap")
    + f""", tm AS (SELECT symbol, ts, close, greatest(high - low, abs(high - {_AGO(1)}), abs(low - {_AGO(1)})) AS tr, {_AGO(3)} AS c3, {_AGO(12)} AS c12 FROM y)"""
    + recursion("tm", "tr", 14, "1.0 / 14")
    + """, mo AS (SELECT n.symbol, n.ts, n.close, (n.close - c3) / (c3 + 1e-10) AS rf, coalesce(e.e, n.tr) / (n.close + 1e-10) AS share FROM tm_n n LEFT JOIN tm_e e ON n.symbol = e.symbol AND n.i = e.i WHERE c12 IS NOT NULL)"""
    + recursion("mo", "rf", 1, "0.5")
    + f", mp AS (SELECT n.*, greatest(-3, least(3, n.rf / (n.share + 1e-10))) AS roc, e.e - coalesce(lag(e.e) OVER w, 0) AS acc FROM mo_n n JOIN mo_e e ON n.symbol = e.symbol AND n.i = e.i WINDOW w AS (PARTITION BY n.symbol ORDER BY n.ts))"
    + _MACD.replace("FROM bars", "FROM mp")
    + f""", ti AS (SELECT y.symbol, y.ts, bias, trend_ok, wr, ex, sp, es, chop, chop_state, roc, acc, vz.state AS vs, CASE WHEN abs(y.a) <= 0.0001 THEN 'AT' WHEN y.a > 0 THEN 'ABOVE' WHEN y.a <= 0 THEN 'BELOW' END AS place, lag(roc) OVER w AS roc0, hist - lag(hist) OVER w AS hs
  FROM mc JOIN mp USING (symbol, ts) JOIN y USING (symbol, ts) LEFT JOIN vz USING (symbol, ts) WHERE hist IS NOT NULL WINDOW w AS (PARTITION BY y.symbol ORDER BY y.ts)),
tj AS (SELECT *, row_number() OVER ({Q.W}) AS i, coalesce(ex >= 1.2, false) OR coalesce(sp >= 1.5, false) AS hot, coalesce(roc * bias > roc0 * bias AND roc * bias >= 0.3, false) AS restart, coalesce(ex >= 1 AND coalesce(es, 0) >= 0, false) AS support, coalesce(hs * bias > 0, false) AS md,
  trend_ok AND bias <> 0 AND coalesce(vs IN ('ACCEPT', 'RECLAIM'), false) AND (place IS NULL OR coalesce(place = CASE bias WHEN 1 THEN 'ABOVE' WHEN -1 THEN 'BELOW' END, false)) AS gates FROM ti),
tk AS (SELECT *, coalesce(roc * bias > 0.3 AND acc * bias < 0, false)::INT + (hot AND coalesce(wr < 0, false))::INT AS tired, coalesce(ex < 0.8, false) AND (coalesce(chop_state = 'CHOP', false) OR coalesce(chop >= 61.8, false)) AS squeeze, hot AND abs(roc) >= 0.8 AS ignites, restart::INT + support::INT + md::INT AS triggers FROM tj),
tl AS (SELECT symbol, 0::BIGINT AS i, 0 AS nt, 0 AS ni, 0 AS nr, 0 AS cool, false AS armed, NULL::VARCHAR AS rule FROM (SELECT DISTINCT symbol FROM tk)
  UNION ALL SELECT symbol, i, nt, CASE WHEN exh THEN ni ELSE gi END, CASE WHEN exh THEN 0 WHEN gi >= 2 THEN nr ELSE gr END, CASE WHEN exh THEN 2 ELSE cool END, CASE WHEN exh THEN armed ELSE ga AND gi < 2 END, CASE WHEN exh THEN 'EXHAUSTION_WARNING' WHEN gi >= 2 THEN 'BREAKOUT_WINDOW' WHEN gr >= 2 THEN 'CONTINUATION_READY' END
  FROM (SELECT *, bias <> 0 AND nt >= 2 AS exh, CASE WHEN ga AND ignites THEN ni + 1 ELSE 0 END AS gi, CASE WHEN gates AND cool = 0 AND triggers >= 2 THEN nr + 1 ELSE 0 END AS gr
  FROM (SELECT n.*, CASE WHEN n.bias = 0 THEN p.nt WHEN n.tired >= 2 THEN p.nt + 1 ELSE 0 END AS nt, p.ni, p.nr, greatest(p.cool - 1, 0) AS cool, p.armed, p.armed OR n.squeeze AS ga FROM tl p JOIN tk n ON n.symbol = p.symbol AND n.i = p.i + 1)))"""
)
ORACLES["timing_rules"] = (
    _INPUTS
    + f""" SELECT k.symbol, k.ts::TIMESTAMPTZ AS ts, coalesce(rule, CASE WHEN trend_ok THEN 'TRANSITION' ELSE 'NO_TRADE' END) AS timing_state, CASE WHEN rule = 'BREAKOUT_WINDOW' THEN sign(roc)::INT WHEN rule IS NOT NULL THEN bias ELSE 0 END AS timing_direction,
 {Q.r("CASE rule WHEN 'EXHAUSTION_WARNING' THEN least(100, 60 + 20 * (tired - 2) + CASE WHEN ex >= 1.6 THEN 10 ELSE 0 END) WHEN 'BREAKOUT_WINDOW' THEN 95 WHEN 'CONTINUATION_READY' THEN least(100, 50 + 15 * triggers + CASE WHEN vs = 'RECLAIM' THEN 10 ELSE 0 END) END::DOUBLE", 'timing_confidence')},
 {Q.r("CASE rule WHEN 'EXHAUSTION_WARNING' THEN 0 WHEN 'BREAKOUT_WINDOW' THEN 0 WHEN 'CONTINUATION_READY' THEN 50 + 15 * restart::INT + 15 * support::INT + 10 * md::INT END::DOUBLE", 'timing_score')} FROM tk k JOIN tl l ON k.symbol = l.symbol AND k.i = l.i"""
)


@query
def timing_rules(spark, d):
    """All inputs from the same hourly bars: four scans over one partitioning."""
    rows = N.ribbon(M.atr_expansion(K.with_choppiness(K.with_relative_volume(hour(spark, d)))), "1h")
    rows = N.macd_events(N.momentum(T.vwap_interaction(W.session(rows), "1h"), "1h"))
    w = series()
    rows = rows.withColumns(
        {
            "trend_ok": F.col("ribbon_state") != "CHOP",
            "trend_bias": F.when(F.col("ribbon_direction") == "BULL", 1).when(F.col("ribbon_direction") == "BEAR", -1).otherwise(0),
            "ribbon_width_rate": F.col("width_rate"),
            "roc_fast_norm_prev": F.lag("roc_fast_norm").over(w),
            "acc_fast": F.col("roc_accel"),
            "chop_value": F.col("chop"),
            "rsi_divergence": F.lit(None).cast("string"),
            "structure_pivot_type": F.lit(None).cast("string"),
            "macd_hist_slope": F.col("hist_slope"),
        }
    )
    return rounded(T.timing(rows), *KEY, "timing_state", "timing_direction", "timing_confidence", "timing_score")


@query
def rsi_divergences(spark, d):
    return rounded(N.divergences(hour(spark, d)), *KEY, "price", "timing_rsi", "divergence", "divergence_strength")


@query
def stoch_micro_timing(spark, d):
    rows = scan(M.ema_filter(hour(spark, d), "1h"), [N.StochTiming])
    bias = bias_way(F.col("ema_bias"))
    return rounded(N.micro_timing(rows.withColumn("bias", bias), confirm=1), *KEY, "timing_k", "timing_d", "stoch_zone", "micro_timing", "micro_confidence")
