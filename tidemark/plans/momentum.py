"""Queries on scanned averages; their SQL runs the recursions row by row."""

from __future__ import annotations

from ..operators import kernels as K
from ..operators import momentum as M
from ..operators import recurrence as R
from ..operators import smoothing as S
from ..operators.ordered import whole
from ..operators.scan import scan
from . import oracle as Q
from .market import KEY, hour, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def recursion(source: str, x: str, n: int, alpha: str, first: int = 1) -> str:
    """CTEs that give ``e``, the average of column x with weight alpha, started by the mean of n values from row ``first`` on."""
    return f""", {source}_n AS (SELECT *, row_number() OVER ({Q.W}) AS i FROM {source}),
{source}_e AS (SELECT symbol, {n + first - 1}::BIGINT AS i, avg({x}) AS e FROM {source}_n WHERE i BETWEEN {first} AND {n + first - 1} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT n.symbol, n.i, p.e + {alpha} * (n.{x} - p.e) FROM {source}_e p JOIN {source}_n n ON n.symbol = p.symbol AND n.i = p.i + 1)"""


_REC = lambda unit: Q.bars(unit).replace("WITH bars", "WITH RECURSIVE bars", 1)


@query(_REC("hour") + recursion("bars", "close", 12, "2.0 / 13") + f" SELECT n.symbol, n.ts::TIMESTAMPTZ AS ts, {Q.r('e', 'ema_12')} FROM bars_n n LEFT JOIN bars_e e ON n.symbol = e.symbol AND n.i = e.i")
def ema_12(spark, d):
    return rounded(R.ema(hour(spark, d), 12), *KEY, "ema_12")


_TR = f", tr AS (SELECT symbol, ts, close, greatest(high - low, abs(high - lag(close) OVER ({Q.W})), abs(low - lag(close) OVER ({Q.W}))) AS tr FROM bars)"


@query(_REC("hour") + _TR + recursion("tr", "tr", 14, "1.0 / 14", 2) + f" SELECT n.symbol, n.ts::TIMESTAMPTZ AS ts, {Q.r('e', 'atr')} FROM tr_n n LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i")
def atr_wilder_14(spark, d):
    return rounded(R.atr(hour(spark, d)), *KEY, "atr")


_MOVES = f", g AS (SELECT symbol, ts, greatest(close - lag(close) OVER ({Q.W}), 0) AS u, greatest(lag(close) OVER ({Q.W}) - close, 0) AS l FROM bars)"
_RSI = (
    _MOVES
    + ", gain AS (SELECT symbol, ts, u FROM g), loss AS (SELECT symbol, ts, l FROM g)"
    + recursion("gain", "u", 14, "1.0 / 14", 2)
    + recursion("loss", "l", 14, "1.0 / 14", 2)
    + ", rsi AS (SELECT n.symbol, n.ts, n.i, CASE WHEN n.i <= 15 THEN NULL WHEN abs(b.e) <= 1e-9 THEN 100 ELSE 100 - 100 / (1 + a.e / b.e) END AS rsi FROM gain_n n LEFT JOIN gain_e a ON n.symbol = a.symbol AND n.i = a.i LEFT JOIN loss_e b ON n.symbol = b.symbol AND n.i = b.i)"
)
_RSI_SIGNAL = f"""SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('rsi', 'rsi')},
 CASE WHEN rsi IS NULL THEN 'neutral' WHEN rsi > 70 THEN 'bearish' WHEN rsi < 30 THEN 'bullish' WHEN rsi BETWEEN 45 AND 55 THEN 'neutral' WHEN rsi > p AND rsi > 50 THEN 'bullish' WHEN rsi < p AND rsi < 50 THEN 'bearish' ELSE 'neutral' END AS rsi_signal,
 {Q.r("CASE WHEN rsi IS NULL THEN 50 WHEN rsi > 80 THEN least(85, 60 + rsi - 80) WHEN rsi > 70 THEN 65 WHEN rsi < 20 THEN least(85, 60 + 20 - rsi) WHEN rsi < 30 THEN 65 WHEN rsi BETWEEN 45 AND 55 THEN 50 WHEN (rsi > p AND rsi > 50) OR (rsi < p AND rsi < 50) THEN 55 ELSE 50 END", 'rsi_strength')}
 FROM (SELECT *, coalesce(lag(rsi) OVER ({Q.W}), rsi) AS p FROM rsi)"""


@query(_REC("hour") + _RSI + _RSI_SIGNAL)
def rsi_14(spark, d):
    return rounded(whole(M.rsi_signal(R.with_rsi(hour(spark, d), before=1))), *KEY, "rsi", "rsi_signal", "rsi_strength")


_STOCH = f""", sr AS (SELECT *, min(rsi) OVER {Q.rows(14)} AS lo, max(rsi) OVER {Q.rows(14)} AS hi, count(rsi) OVER {Q.rows(14)} AS c FROM rsi),
sk0 AS (SELECT symbol, ts, CASE WHEN c = 14 THEN CASE WHEN hi = lo THEN 50 ELSE (rsi - lo) / (hi - lo) * 100 END END AS s FROM sr),
sk AS (SELECT symbol, ts, CASE WHEN count(s) OVER {Q.rows(3)} = 3 THEN avg(s) OVER {Q.rows(3)} END AS k FROM sk0),
sd AS (SELECT symbol, ts, k, CASE WHEN count(k) OVER {Q.rows(3)} = 3 THEN avg(k) OVER {Q.rows(3)} END AS d FROM sk)"""


@query(_REC("hour") + _RSI + _STOCH + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('k', 'stoch_k')}, {Q.r('d', 'stoch_d')} FROM sd")
def stoch_rsi(spark, d):
    return rounded(R.stoch_rsi(hour(spark, d)), *KEY, "stoch_k", "stoch_d")


_MACD = (
    ", fa AS (SELECT symbol, ts, close FROM bars), sl AS (SELECT symbol, ts, close FROM bars)"
    + recursion("fa", "close", 12, "2.0 / 13")
    + recursion("sl", "close", 26, "2.0 / 27")
    + ", ml AS (SELECT n.symbol, n.ts, a.e - b.e AS m FROM fa_n n JOIN fa_e a ON n.symbol = a.symbol AND n.i = a.i JOIN sl_e b ON n.symbol = b.symbol AND n.i = b.i)"
    + recursion("ml", "m", 9, "2.0 / 10")
    + ", mc AS (SELECT n.symbol, n.ts, n.m AS macd, e.e AS sig, n.m - e.e AS hist FROM ml_n n LEFT JOIN ml_e e ON n.symbol = e.symbol AND n.i = e.i)"
)


@query(_REC("hour") + _MACD + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('macd', 'macd')}, {Q.r('sig', 'macd_signal')}, {Q.r('hist', 'macd_hist')} FROM mc")
def macd_hist(spark, d):
    return rounded(R.macd(hour(spark, d)).where("macd is not null"), *KEY, "macd", "macd_signal", "macd_hist")


@query(
    _REC("hour")
    + _MACD
    + f""", s AS (SELECT *, lag(macd) OVER ({Q.W}) AS pm, lag(sig) OVER ({Q.W}) AS ps, hist - coalesce(lag(hist) OVER ({Q.W}), hist) AS st FROM mc),
t AS (SELECT *, coalesce(pm <= ps AND macd > sig, false) AS up, coalesce(pm >= ps AND macd < sig, false) AS dn FROM s)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN hist IS NULL THEN 'neutral' WHEN up THEN 'bullish' WHEN dn THEN 'bearish' WHEN hist > 0 AND st <> 0 THEN 'bullish' WHEN hist < 0 AND st <> 0 THEN 'bearish' ELSE 'neutral' END AS macd_bias,
 CASE WHEN hist IS NULL THEN 50.0 WHEN up OR dn THEN 85 WHEN (hist > 0 AND st > 0) OR (hist < 0 AND st < 0) THEN 70 WHEN hist <> 0 AND st <> 0 THEN 55 ELSE 50 END::DOUBLE AS macd_strength FROM t"""
)
def macd_histogram_signal(spark, d):
    return whole(M.macd_signal(R.with_macd(hour(spark, d), before=1))).where("macd is not null").select(*KEY, "macd_bias", "macd_strength")


@query(
    _REC("hour")
    + _TR
    + recursion("tr", "tr", 14, "1.0 / 14", 2)
    + f""", a AS (SELECT n.symbol, n.ts, n.close, e.e AS atr FROM tr_n n LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i),
b AS (SELECT *, CASE WHEN atr IS NOT NULL THEN CASE WHEN abs(avg(atr) OVER {Q.rows(20)}) > 1e-9 THEN atr / avg(atr) OVER {Q.rows(20)} ELSE 1 END END AS q FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('q', 'atr_ratio')}, {Q.r('atr / nullif(close, 0) * 100', 'atr_close_pct')}, CASE WHEN q IS NULL THEN 50.0 WHEN q > 1.5 THEN 75 WHEN q > 1.2 THEN 60 WHEN q < 0.6 THEN 60 WHEN q < 0.8 THEN 55 ELSE 50 END::DOUBLE AS atr_strength FROM b"""
)
def atr_analysis(spark, d):
    return rounded(whole(M.atr_signal(R.with_atr(hour(spark, d), before=19))), *KEY, "atr_ratio", "atr_close_pct", "atr_strength")


_CROSS = ", ea AS (SELECT symbol, ts, close FROM bars), eb AS (SELECT symbol, ts, close FROM bars)" + recursion("ea", "close", 20, "2.0 / 21") + recursion("eb", "close", 50, "2.0 / 51")


@query(
    _REC("hour")
    + _CROSS
    + f""", m AS (SELECT n.symbol, n.ts, n.close AS c, a.e AS s, b.e AS l FROM ea_n n LEFT JOIN ea_e a ON n.symbol = a.symbol AND n.i = a.i LEFT JOIN eb_e b ON n.symbol = b.symbol AND n.i = b.i),
x AS (SELECT *, coalesce(lag(s) OVER ({Q.W}) <= lag(l) OVER ({Q.W}) AND s > l, false) AS g, coalesce(lag(s) OVER ({Q.W}) >= lag(l) OVER ({Q.W}) AND s < l, false) AS dd FROM m)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN l IS NULL THEN 'neutral' WHEN g THEN 'bullish' WHEN dd THEN 'bearish' WHEN c > s AND c > l AND s > l THEN 'bullish' WHEN c <= s AND c <= l AND s <= l THEN 'bearish' ELSE 'neutral' END AS ma_signal,
 CASE WHEN l IS NULL THEN 50.0 WHEN g OR dd THEN 85 WHEN (c > s AND c > l AND s > l) OR (c <= s AND c <= l AND s <= l) THEN 75 WHEN c > l AND c <= s THEN 55 ELSE 50 END::DOUBLE AS ma_strength, {Q.r('CASE WHEN l IS NULL OR abs(s) <= 1e-9 THEN 0 ELSE (c - s) / s * 100 END', 'ma_distance_pct')} FROM x"""
)
def moving_averages(spark, d):
    return rounded(whole(M.moving_average_signal(R.with_ema(hour(spark, d), 20, 50, before=1))), *KEY, "ma_signal", "ma_strength", "ma_distance_pct")


@query(
    Q.bars("hour")
    + f""", m AS (SELECT symbol, ts, close AS c, CASE WHEN count(*) OVER {Q.rows(20)} = 20 THEN avg(close) OVER {Q.rows(20)} END AS mid, CASE WHEN count(*) OVER {Q.rows(20)} = 20 THEN stddev_pop(close) OVER {Q.rows(20)} END AS sd FROM bars),
w AS (SELECT *, mid + 2 * sd AS u, mid - 2 * sd AS lo, ((mid + 2 * sd) - (mid - 2 * sd)) / nullif(mid, 0) * 100 AS bw FROM m),
q AS (SELECT *, CASE WHEN bw IS NOT NULL THEN CASE WHEN abs(u - lo) > 1e-9 THEN (c - lo) / (u - lo) ELSE 0.5 END * 100 END AS b, CASE WHEN bw IS NOT NULL THEN CASE WHEN abs(avg(bw) OVER {Q.rows(20)}) > 1e-9 THEN bw / avg(bw) OVER {Q.rows(20)} ELSE 1 END < 0.7 END AS sq FROM w),
z AS (SELECT *, CASE WHEN bw IS NULL THEN 50.0 WHEN c > u OR c < lo THEN 70 WHEN b > 80 OR b < 20 THEN 60 ELSE 50 END AS st FROM q)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('b', 'percent_b')}, sq AS bb_squeeze, CASE WHEN bw IS NULL THEN 'neutral' WHEN c > u THEN 'bullish' WHEN c < lo THEN 'bearish' WHEN b > 80 THEN 'bearish' WHEN b < 20 THEN 'bullish' ELSE 'neutral' END AS bb_signal, (CASE WHEN sq THEN least(st + 10, 90) ELSE st END)::DOUBLE AS bb_strength FROM z"""
)
def bollinger_analysis(spark, d):
    return rounded(M.bollinger_signal(hour(spark, d)), *KEY, "percent_b", "bb_squeeze", "bb_signal", "bb_strength")


@query(
    Q.bars("hour")
    + f""", c AS (SELECT symbol, ts, close, sum((high + low + close) / 3 * volume) OVER ({Q.W} ROWS UNBOUNDED PRECEDING) AS pv, sum(volume) OVER ({Q.W} ROWS UNBOUNDED PRECEDING) AS v, (high + low + close) / 3 AS tp FROM bars),
v AS (SELECT *, CASE WHEN abs(v) > 1e-9 THEN pv / v ELSE tp END AS vw FROM c), p AS (SELECT *, CASE WHEN abs(vw) > 1e-9 THEN (close - vw) / vw * 100 ELSE 0 END AS p FROM v)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('p', 'vwap_distance_pct')}, CASE WHEN p > 0.5 THEN 'bullish' WHEN p < -0.5 THEN 'bearish' ELSE 'neutral' END AS vwap_signal, {Q.r('CASE WHEN abs(p) > 2 THEN least(80, 60 + abs(p) * 5) WHEN abs(p) > 0.5 THEN 60 ELSE 50 END', 'vwap_strength')} FROM p"""
)
def vwap_analysis(spark, d):
    return rounded(M.vwap_signal(K.with_vwap(hour(spark, d))), *KEY, "vwap_distance_pct", "vwap_signal", "vwap_strength")


_STOCH_CROSS = f""", x AS (SELECT *, coalesce(lag(k) OVER ({Q.W}) <= lag(d) OVER ({Q.W}) AND k > d, false) AS up, coalesce(lag(k) OVER ({Q.W}) >= lag(d) OVER ({Q.W}) AND k < d, false) AS dn FROM sd)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN d IS NULL THEN 'neutral' WHEN up AND k < 30 THEN 'bullish' WHEN dn AND k > 70 THEN 'bearish' WHEN k > 80 THEN 'bearish' WHEN k < 20 THEN 'bullish' WHEN up THEN 'bullish' WHEN dn THEN 'bearish' ELSE 'neutral' END AS stoch_signal,
 CASE WHEN d IS NULL THEN 50 WHEN (up AND k < 30) OR (dn AND k > 70) THEN 85 WHEN k > 90 OR k < 10 THEN 75 WHEN k > 80 OR k < 20 THEN 65 WHEN up OR dn THEN 60 ELSE 50 END::DOUBLE AS stoch_strength FROM x"""


@query(_REC("hour") + _RSI + _STOCH + _STOCH_CROSS)
def stoch_rsi_signal(spark, d):
    return whole(M.stoch_rsi_signal(R.with_stoch_rsi(hour(spark, d), before=1))).select(*KEY, "stoch_signal", "stoch_strength")


#: The line from the eleventh bar on; a band holds until the close crosses it.
_SUPER = _TR.replace("SELECT symbol, ts, close,", "SELECT symbol, ts, close, high, low, row_number() OVER (" + Q.W + ") AS i,") + f""", sa AS (SELECT *, avg(tr) OVER {Q.rows(10)} AS a FROM tr WHERE i >= 2), sb AS (SELECT *, (high + low) / 2 + 3 * a AS u, (high + low) / 2 - 3 * a AS l FROM sa WHERE i >= 11),
st AS (SELECT symbol, i, l AS line, true AS up FROM sb WHERE i = 11
  UNION ALL SELECT symbol, i, CASE WHEN now THEN CASE WHEN up THEN greatest(l, line) ELSE l END WHEN up THEN u ELSE least(u, line) END, now
  FROM (SELECT n.symbol, n.i, n.u, n.l, p.line, p.up, CASE WHEN p.up THEN n.close >= p.line ELSE n.close > p.line END AS now FROM st p JOIN sb n ON n.symbol = p.symbol AND n.i = p.i + 1)),
sf AS (SELECT t.symbol, t.ts, s.line, s.up, coalesce(lag(s.up) OVER w <> s.up, false) AS flip FROM tr t LEFT JOIN st s USING (symbol, i) WINDOW w AS (PARTITION BY t.symbol ORDER BY t.ts)),
sr AS (SELECT *, sum(flip::INT) OVER ({Q.W}) AS run FROM sf), su AS (SELECT *, CASE WHEN up IS NOT NULL THEN least(19, count(up) OVER (PARTITION BY symbol, run ORDER BY ts))::INT END AS n FROM sr),
sv AS (SELECT *, CASE WHEN up THEN 'bullish' WHEN NOT up THEN 'bearish' ELSE 'neutral' END AS supertrend_signal, CASE WHEN up IS NULL THEN 50 WHEN flip THEN 85 ELSE least(75, 55 + 2 * n) END::DOUBLE AS supertrend_strength FROM su)"""


@query(_REC("hour") + _SUPER + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('line', 'supertrend')}, up AS uptrend, n AS trend_bars, supertrend_signal, supertrend_strength FROM sv")
def supertrend_10_3(spark, d):
    return rounded(M.supertrend_signal(scan(hour(spark, d), [S.Supertrend])), *KEY, "supertrend", "uptrend", "trend_bars", "supertrend_signal", "supertrend_strength")


_LOCKED = _TR.replace("SELECT symbol, ts, close,", "SELECT symbol, ts, close, high, low,") + recursion("tr", "tr", 10, "1.0 / 10") + f""", lb AS (SELECT n.*, e.e AS a, (high + low) / 2 + 3 * e.e AS u, (high + low) / 2 - 3 * e.e AS l, lag(close) OVER w AS c0 FROM tr_n n LEFT JOIN tr_e e ON n.symbol = e.symbol AND n.i = e.i WINDOW w AS (PARTITION BY n.symbol ORDER BY n.ts)),
lr AS (SELECT symbol, i, 0::DOUBLE AS ub, 0::DOUBLE AS lo, 'UP' AS way FROM lb WHERE i = 9
  UNION ALL SELECT symbol, i, ub, lo, CASE WHEN close > ub THEN 'UP' WHEN close < lo THEN 'DOWN' ELSE way END
  FROM (SELECT n.symbol, n.i, n.close, p.way, CASE WHEN n.u < p.ub OR n.c0 > p.ub THEN n.u ELSE p.ub END AS ub, CASE WHEN n.l > p.lo OR n.c0 < p.lo THEN n.l ELSE p.lo END AS lo FROM lr p JOIN lb n ON n.symbol = p.symbol AND n.i = p.i + 1)),
lf AS (SELECT lb.*, lr.ub, lr.lo, lr.way, (coalesce(lag(lr.way) OVER w, 'UP') <> lr.way)::INT AS flip, row_number() OVER w >= 20 AS ready FROM lb JOIN lr USING (symbol, i) WHERE i >= 10 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
lg AS (SELECT *, sum(flip) OVER ({Q.W}) AS run, sum(flip) OVER {Q.rows(20)} / 20.0::DOUBLE AS rate, a / (close + 1e-10) AS pct, CASE WHEN ready THEN abs(close - CASE WHEN way = 'UP' THEN lo ELSE ub END) / (close + 1e-10) END AS dist FROM lf),
lh AS (SELECT *, count(*) OVER (PARTITION BY symbol, run ORDER BY ts) AS held, coalesce(avg(dist) OVER {Q.rows(20)}, 0) AS far FROM lg),
lt AS (SELECT *, ready AND NOT (rate > 0.1 OR (pct < 0.001 AND rate > 0.05) OR far < 0.15 * pct) AND rate < 0.05 AND held >= 3 AS trend, 100 * (0.35 * least(1, held / 6.0) + 0.35 * (1 - least(1, rate / 0.1)) + 0.3 * least(1, far / (0.3 * pct + 1e-10))) AS sc FROM lh)"""


@query(
    _REC("hour")
    + _LOCKED
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('ub', 'upper_band')}, {Q.r('lo', 'lower_band')}, way AS direction, held AS hold_bars, {Q.r('rate', 'flip_rate')}, CASE WHEN trend THEN 'TREND' ELSE 'CHOP' END AS st_regime,
 {Q.r('CASE WHEN NOT ready THEN 0 WHEN trend THEN sc ELSE least(sc, 40) END', 'st_strength')} FROM lt"""
)
def supertrend_regime(spark, d):
    return rounded(M.supertrend_regime(hour(spark, d)), *KEY, "upper_band", "lower_band", "direction", "hold_bars", "flip_rate", "st_regime", "st_strength")


@query(_REC("hour") + _LOCKED + " SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN trend THEN 'TREND' ELSE 'CHOP' END AS st_regime, trend AS trend_allowed, trend AND way = 'UP' AS long_allowed, trend AND way = 'DOWN' AS short_allowed FROM lt")
def supertrend_permission(spark, d):
    return M.permitted(M.supertrend_regime(hour(spark, d))).select(*KEY, "st_regime", "trend_allowed", "long_allowed", "short_allowed")


def expansion(source: str = "bars") -> str:
    """CTEs that give ``xs``, the expansion of a source's ATR with state and score."""
    w = Q.W
    return f""", tx AS (SELECT symbol, ts, close, greatest(high - low, abs(high - lag(close) OVER ({w})), abs(low - lag(close) OVER ({w}))) AS tr FROM {source})""" + recursion("tx", "tr", 14, "1.0 / 14") + f""",
xa AS (SELECT n.*, e.e AS atr FROM tx_n n LEFT JOIN tx_e e ON n.symbol = e.symbol AND n.i = e.i),
xb AS (SELECT *, atr / (CASE WHEN count(atr) OVER {Q.rows(20)} = 20 THEN avg(atr) OVER {Q.rows(20)} END + 1e-12) AS x, tr / (CASE WHEN count(*) OVER {Q.rows(20)} = 20 THEN avg(tr) OVER {Q.rows(20)} END + 1e-12) AS spike FROM xa),
xc AS (SELECT *, x - lag(x) OVER ({w}) AS slope, coalesce(spike >= 1.5, false) AS shock FROM xb), xd AS (SELECT *, coalesce(x >= 1.2 AND slope <= -0.05, false) AS fading, 100 * greatest(0, least(1, (x - 0.8) / (0.8 + 1e-12))) AS base FROM xc),
xe AS (SELECT *, CASE WHEN x IS NULL THEN 'WARMUP' WHEN fading THEN 'FADE_RISK' WHEN x < 0.8 THEN 'SQUEEZE' WHEN x >= 1.6 THEN 'EXTREME' WHEN x >= 1.2 THEN 'EXPANSION' ELSE 'NORMAL' END AS state, least(100, least(base, CASE WHEN fading THEN 100 WHEN x < 0.8 THEN 30 WHEN x >= 1.6 THEN 100 WHEN x >= 1.2 THEN 85 ELSE 60 END) + CASE WHEN shock THEN 5 ELSE 0 END) AS sc FROM xd),
xs AS (SELECT *, CASE WHEN x IS NOT NULL THEN CASE WHEN fading THEN greatest(0, sc - 10) ELSE sc END END AS score FROM xe)"""


@query(_REC("hour") + expansion() + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('atr', 'atr')}, {Q.r('x', 'atr_exp')}, {Q.r('spike', 'tr_spike')}, {Q.r('slope', 'atr_exp_slope')}, state AS vol_state, {Q.r('score', 'vol_score')}, shock FROM xs")
def atr_expansion(spark, d):
    return rounded(R.atr_expansion(hour(spark, d)), *KEY, "atr", "atr_exp", "tr_spike", "atr_exp_slope", "vol_state", "vol_score", "shock")


@query(
    _REC("hour")
    + f", bm AS (SELECT symbol, ts, CASE WHEN count(*) OVER {Q.rows(20)} = 20 THEN avg(close) OVER {Q.rows(20)} END AS m, stddev_pop(close) OVER {Q.rows(20)} AS sd FROM bars), bw AS (SELECT symbol, ts, 4 * sd / (m + 1e-12) AS b FROM bm WHERE m IS NOT NULL)"
    + recursion("bw", "b", 1, "0.5")
    + f""", bs AS (SELECT n.*, e.e AS s, e.e - lag(e.e) OVER w AS sl FROM bw_n n JOIN bw_e e ON n.symbol = e.symbol AND n.i = e.i WINDOW w AS (PARTITION BY n.symbol ORDER BY n.ts)),
bx AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(50)} = 50 THEN s / (avg(s) OVER {Q.rows(50)} + 1e-12) END AS x FROM bs),
bz AS (SELECT *, coalesce(x >= 1.2 AND sl <= -0.02, false) AS fading, 100 * greatest(0, least(1, (x - 0.8) / (0.8 + 1e-12))) AS sc FROM bx)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('b', 'bandwidth')}, {Q.r('s', 'bw_smooth')}, {Q.r('x', 'bw_ratio')}, CASE WHEN x IS NULL THEN 'WARMUP' WHEN fading THEN 'FADE_RISK' WHEN x < 0.8 THEN 'COMPRESSED' WHEN x >= 1.6 THEN 'EXTREME' WHEN x >= 1.2 THEN 'EXPANDING' ELSE 'NORMAL' END AS bw_state,
 {Q.r('CASE WHEN x IS NOT NULL THEN CASE WHEN fading THEN greatest(sc - 10, 0) WHEN x < 0.8 THEN least(sc, 30) WHEN x >= 1.6 THEN sc WHEN x >= 1.2 THEN least(sc, 85) ELSE least(sc, 60) END END', 'bw_score')} FROM bars LEFT JOIN bz USING (symbol, ts)"""
)
def bb_bandwidth(spark, d):
    return rounded(M.bandwidth(hour(spark, d)), *KEY, "bandwidth", "bw_smooth", "bw_ratio", "bw_state", "bw_score")


def filtered(source: str, tf: str) -> str:
    """CTEs that give ``<source>_f``, the bars of ``source`` with averages over 9, 21 and 50 bars, slope, width, alignment, bias, regime and strength."""
    b, k = source, M.EMA_LOOKBACK[tf] + 1
    first = f"first(e50) OVER {Q.rows(k)}"
    one = lambda n: f", {b}{n} AS (SELECT symbol, ts, close FROM {b})" + recursion(f"{b}{n}", "close", n, f"2.0 / {n + 1}")
    s, w = M.EMA_SLOPE[tf], M.EMA_WIDTH[tf]
    return (
        one(9)
        + one(21)
        + one(50)
        + f""", {b}_m AS (SELECT n.symbol, n.ts, n.close AS c, x.e AS e9, y.e AS e21, z.e AS e50 FROM {b}50_n n JOIN {b}50_e z USING (symbol, i) JOIN {b}21_e y USING (symbol, i) JOIN {b}9_e x USING (symbol, i)),
{b}_s AS (SELECT *, coalesce((e50 - {first}) / nullif({first}, 0), 0) AS s50, (greatest(e9, e21, e50) - least(e9, e21, e50)) / (c + 1e-10) AS rw, CASE WHEN e9 > e21 AND e21 > e50 THEN 'STACKED_UP' WHEN e9 < e21 AND e21 < e50 THEN 'STACKED_DOWN' ELSE 'MIXED' END AS al FROM {b}_m),
{b}_b AS (SELECT *, CASE WHEN c > e50 AND s50 > {s} * 0.5 THEN 'BULL' WHEN c < e50 AND s50 < -{s} * 0.5 THEN 'BEAR' ELSE 'NEUTRAL' END AS bias, CASE WHEN NOT (abs(s50) < {s} * 0.5 AND rw < {w}) AND ((c > e50)::INT + (s50 > {s})::INT + (al = 'STACKED_UP')::INT >= 2 OR (c < e50)::INT + (s50 < -{s})::INT + (al = 'STACKED_DOWN')::INT >= 2) THEN 'TREND' ELSE 'RANGE' END AS regime FROM {b}_s),
{b}_f AS (SELECT *, greatest(0, least(CASE WHEN regime = 'RANGE' THEN 40 ELSE 100 END, 100 * (0.35 * least(1, abs(s50) / (2 * {s} + 1e-10)) + 0.25 * least(1, rw / (2 * {w} + 1e-10)) + 0.25 * CASE WHEN al = 'MIXED' THEN 0.4 ELSE 1 END + 0.15 * CASE WHEN bias = 'NEUTRAL' THEN 0.5 ELSE 1 END))) AS ts_ FROM {b}_b)"""
    )


@query(_REC("hour") + filtered("bars", "1h") + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('e9', 'ema_9')}, {Q.r('e21', 'ema_21')}, {Q.r('e50', 'ema_50')}, {Q.r('s50', 'slope_50')}, {Q.r('rw', 'ribbon_width')}, al AS alignment, bias AS ema_bias, regime AS ema_regime, {Q.r('ts_', 'trend_strength')} FROM bars_f")
def ema_filter(spark, d):
    return rounded(M.ema_filter(hour(spark, d), "1h"), *KEY, "ema_9", "ema_21", "ema_50", "slope_50", "ribbon_width", "alignment", "ema_bias", "ema_regime", "trend_strength")


@query(
    _REC("hour")
    + ", high AS (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY ALL)"
    + filtered("bars", "1h")
    + filtered("high", "4h")
    + """ SELECT l.symbol, l.ts::TIMESTAMPTZ AS ts, h.bias AS htf_bias, l.bias AS ltf_bias, CASE WHEN h.regime = 'RANGE' THEN 'RANGE_DOMINANT' WHEN h.bias = l.bias AND h.bias <> 'NEUTRAL' THEN 'ALIGNED' ELSE 'MIXED' END AS mtf_alignment
FROM bars_f l ASOF JOIN high_f h ON l.symbol = h.symbol AND l.ts >= h.ts"""
)
def mtf_alignment(spark, d):
    from ..operators import bars as B
    from ..sources import market as T

    quarter = B.ohlcv(T.event_ticks(spark, d), "4h")
    return M.ema_mtf(M.ema_filter(quarter, "4h"), M.ema_filter(hour(spark, d), "1h"))
