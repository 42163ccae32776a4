"""Queries over bars, trades and open interest, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import kernels as K
from ..operators import open_interest as O
from ..operators import volume as V
from ..sources import market as S
from . import oracle as Q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, scaled: bool = False) -> DataFrame:
    """The named columns, doubles to six places (and no negative zero). ``scaled``: millionths to the nearest whole, as round(x, 6) in the SQL takes them, so that a half that is stored a trifle short still goes up."""
    kinds = dict(df.dtypes)
    six = (lambda c: F.when(F.abs(F.col(c)) < 1e300, F.round(F.col(c) * 1e6) / 1e6).otherwise(F.col(c))) if scaled else (lambda c: F.round(c, 6))
    return df.select(*[(six(c) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns])


def day(spark: SparkSession, d: str) -> DataFrame:
    return B.ohlcv(S.event_ticks(spark, d), "1d")


def hour(spark: SparkSession, d: str) -> DataFrame:
    return B.ohlcv(S.event_ticks(spark, d), "1h")


OHLC = ("open", "high", "low", "close", "volume")
KEY = ("symbol", "ts")
_BARS = f"SELECT symbol, ts::TIMESTAMPTZ AS ts, {', '.join(Q.r(c, c) for c in OHLC)}, trades FROM bars"


@query(Q.bars("day") + _BARS)
def bars_ohlcv_day(spark, d):
    return rounded(day(spark, d), *KEY, *OHLC, "trades")


@query(Q.bars("hour") + _BARS)
def bars_ohlcv_hour(spark, d):
    return rounded(hour(spark, d), *KEY, *OHLC, "trades")


def _full(x: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {Q.rows(n)} = {n} THEN {x} END"


@query(
    Q.bars("hour")
    + f"""SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r(_full(f'avg(close) OVER {Q.rows(20)}', 20), 'sma')}, {Q.r(f'avg(close) OVER {Q.rows(20)}', 'average_last')},
  {Q.r(_full(f'stddev_pop(close) OVER {Q.rows(20)}', 20), 'rolling_std')}, {Q.r(f'sum(close) OVER {Q.rows(20)}', 'sum_last')} FROM bars"""
)
def rolling_moments(spark, d):
    return rounded(K.with_moments(hour(spark, d)), *KEY, "sma", "average_last", "rolling_std", "sum_last")


@query(
    Q.bars("hour")
    + f""", m AS (SELECT symbol, ts, {_full(f'avg(close) OVER {Q.rows(20)}', 20)} AS mid, {_full(f'stddev_pop(close) OVER {Q.rows(20)}', 20)} AS sd FROM bars)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('mid', 'bb_mid')}, {Q.r('mid + 2 * sd', 'bb_upper')}, {Q.r('mid - 2 * sd', 'bb_lower')}, {Q.r('((mid + 2 * sd) - (mid - 2 * sd)) / nullif(mid, 0) * 100', 'bb_width')} FROM m"""
)
def bollinger_bands(spark, d):
    return rounded(K.with_bollinger(hour(spark, d)), *KEY, "bb_mid", "bb_upper", "bb_lower", "bb_width")


_SO_FAR = f"({Q.W} ROWS UNBOUNDED PRECEDING)"


@query(
    Q.bars("hour")
    + f""", c AS (SELECT symbol, ts, (high + low + close) / 3 AS tp, sum((high + low + close) / 3 * volume) OVER {_SO_FAR} AS pv, sum(volume) OVER {_SO_FAR} AS v FROM bars)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('CASE WHEN abs(v) > 1e-9 THEN pv / v ELSE tp END', 'vwap')} FROM c"""
)
def vwap_cumulative(spark, d):
    return rounded(K.with_vwap(hour(spark, d)), *KEY, "vwap")


_TR = f"greatest(high - low, abs(high - lag(close) OVER ({Q.W})), abs(low - lag(close) OVER ({Q.W})))"


@query(
    Q.bars("hour")
    + f""", t AS (SELECT *, {_TR} AS tr FROM bars)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('tr', 'tr')}, {Q.r(_full(f'avg(tr) OVER {Q.rows(14)}', 14), 'atr_sma')}, {Q.r(_full(f'sum(tr) OVER {Q.rows(14)}', 14), 'tr_sum')} FROM t"""
)
def true_range_atr(spark, d):
    return rounded(K.with_true_range(hour(spark, d)), *KEY, "tr", "atr_sma", "tr_sum")


@query(
    Q.bars("hour")
    + f""", m AS (SELECT *, count(*) OVER {Q.rows(20)} AS n, avg(volume) OVER {Q.rows(20)} AS a, avg(volume) OVER {Q.rows(19, -1)} AS p FROM bars)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('CASE WHEN n = 20 AND a > 0 THEN volume / a ELSE 1 END', 'rv')}, {Q.r('CASE WHEN n < 20 THEN 1 WHEN abs(p) > 1e-9 THEN volume / p ELSE 1 END', 'rv_prior')},
  {Q.r('CASE WHEN n = 20 THEN a ELSE 0 END', 'sma_volume_or_zero')} FROM m"""
)
def relative_volume(spark, d):
    return rounded(K.with_relative_volume(hour(spark, d)), *KEY, "rv", "rv_prior", "sma_volume_or_zero")


_CHOP = f""", t AS (SELECT *, {_TR} AS tr FROM bars), s AS (SELECT *, count(*) OVER {Q.rows(14)} AS n, sum(tr) OVER {Q.rows(14)} / greatest(max(high) OVER {Q.rows(14)} - min(low) OVER {Q.rows(14)}, 1e-12) AS q FROM t),
c AS (SELECT *, CASE WHEN n = 14 THEN greatest(0, least(100, CASE WHEN q > 0 THEN 100 * log10(q) / log10(14) ELSE 50 END)) END AS chop FROM s)"""
_CHOP_STATE = "CASE WHEN chop >= 61.8 THEN 'CHOP' WHEN chop <= 38.2 THEN 'TREND' WHEN chop IS NOT NULL THEN 'TRANSITION' END AS chop_state"


@query(Q.bars("hour") + _CHOP + f"SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('chop', 'chop')}, {Q.r(f'chop - lag(chop, 3) OVER ({Q.W})', 'chop_slope')}, {_CHOP_STATE} FROM c")
def choppiness_14(spark, d):
    return rounded(K.with_choppiness(hour(spark, d)), *KEY, "chop", "chop_slope", "chop_state")


@query(
    Q.bars("day")
    + _CHOP
    + f""", m AS (SELECT *, {_full(f'avg(close) OVER {Q.rows(20)}', 20)} AS mid, {_full(f'stddev_pop(close) OVER {Q.rows(20)}', 20)} AS sd FROM c)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('close', 'close')}, {Q.r('mid', 'sma')}, {Q.r('mid + 2 * sd', 'bb_upper')}, {Q.r('mid - 2 * sd', 'bb_lower')}, {Q.r('chop', 'chop')}, {_CHOP_STATE} FROM m"""
)
def daily_trend_report(spark, d):
    """Per symbol and day: close, moving average, bands, choppiness and its label."""
    return rounded(K.with_choppiness(K.with_bollinger(K.with_moments(day(spark, d)))), *KEY, "close", "sma", "bb_upper", "bb_lower", "chop", "chop_state")


def _roc(k: int) -> str:
    p = f"lag(close, {k}) OVER ({Q.W})"
    return f"{Q.r(f'CASE WHEN {p} > 0 THEN (close - {p}) / {p} * 100 END', f'roc_{k}')}, {Q.r(f'CASE WHEN {p} > 0 AND close > 0 THEN ln(close / {p}) END', f'log_return_{k}')}"


@query(Q.bars("hour") + f"SELECT symbol, ts::TIMESTAMPTZ AS ts, {', '.join(_roc(k) for k in (5, 10, 20))} FROM bars")
def roc_multi(spark, d):
    return rounded(K.with_roc(hour(spark, d)), *KEY, *[f"{x}_{k}" for k in (5, 10, 20) for x in ("roc", "log_return")])


@query(
    Q.bars("hour")
    + f""", a AS (SELECT *, count(*) OVER {Q.rows(20)} = 20 AS ok, avg(volume) OVER {Q.rows(20)} AS mean, coalesce(close - lag(close) OVER ({Q.W}), 0) AS dp, coalesce(volume - lag(volume) OVER ({Q.W}), 0) AS dv FROM bars),
b AS (SELECT *, CASE WHEN abs(mean) > 1e-9 THEN volume / mean ELSE 1 END AS q, dp <> 0 AND dv > 0 AS conf FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('CASE WHEN ok THEN q ELSE volume END', 'volume_ratio')}, CASE WHEN ok AND q > 1.5 THEN CASE WHEN dp > 0 THEN 'bullish' ELSE 'bearish' END ELSE 'neutral' END AS volume_signal,
  {Q.r("CASE WHEN NOT ok THEN 50 WHEN q > 2 AND conf THEN least(90, 50 + (q - 1) * 20) WHEN q > 2 THEN greatest(60, least(90, 50 + (q - 1) * 20) - 15) WHEN q > 1.5 AND conf THEN 70 WHEN q > 1.5 THEN 55 WHEN q < 0.5 THEN 30 ELSE 50 END::DOUBLE", 'volume_strength')} FROM b"""
)
def volume_analysis(spark, d):
    return rounded(V.analyzed(hour(spark, d)), *KEY, "volume_ratio", "volume_signal", "volume_strength")


@query(
    Q.bars("hour")
    + f""", a AS (SELECT *, row_number() OVER ({Q.W}) AS i, avg(volume) OVER {Q.rows(20, -1)} AS av, max(high) OVER {Q.rows(20)} AS hi, min(low) OVER {Q.rows(20)} AS lo, max(high) OVER {Q.rows(10, -2)} AS sh, min(low) OVER {Q.rows(10, -2)} AS sl, lag(close) OVER ({Q.W}) AS pc FROM bars),
b AS (SELECT *, CASE WHEN av > 0 THEN volume / av ELSE 1 END AS rv, CASE WHEN i >= 20 AND hi <> lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END AS pct FROM a),
c AS (SELECT *, CASE WHEN rv > 3 THEN 'extreme' WHEN rv > 1.5 THEN 'high' WHEN rv > 0.7 THEN 'normal' WHEN rv > 0.3 THEN 'low' ELSE 'dead' END AS ctx, CASE WHEN pct > 80 THEN 'range_high' WHEN pct < 20 THEN 'range_low' ELSE 'mid_range' END AS loc,
  CASE WHEN i >= 3 AND rv > 1.5 AND CASE WHEN pc > 0 THEN abs((close - pc) / pc * 100) ELSE 0 END / rv < 0.3 THEN CASE WHEN close >= pc THEN 'bid_absorption' ELSE 'ask_absorption' END ELSE 'none' END AS ab,
  CASE WHEN i >= 12 AND high > sh AND close < sh THEN 'high' WHEN i >= 12 AND low < sl AND close > sl THEN 'low' ELSE 'none' END AS sw FROM b),
e AS (SELECT *, rv > 1.5 AND ab = 'none' AND loc <> 'mid_range' AS mv FROM c)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('rv', 'relative_volume')}, ctx AS volume_context, {Q.r('pct', 'range_percentile')}, loc AS volume_location, ab AS absorption, sw AS sweep,
  {Q.r("CASE sw WHEN 'high' THEN sh WHEN 'low' THEN sl ELSE 0 END", 'sweep_level')}, mv AS move_is_real,
  {Q.r("greatest(0, least(100, 50 + CASE ctx WHEN 'extreme' THEN 20 WHEN 'high' THEN 10 WHEN 'low' THEN -15 WHEN 'dead' THEN -25 ELSE 0 END + CASE WHEN loc = 'mid_range' THEN -10 ELSE 10 END + CASE WHEN ab <> 'none' THEN -5 ELSE 0 END + CASE WHEN sw <> 'none' AND rv > 1.5 THEN 15 WHEN sw <> 'none' THEN -5 ELSE 0 END))::DOUBLE", 'move_confidence')},
  CASE WHEN ab = 'bid_absorption' THEN 'bullish' WHEN ab <> 'none' THEN 'bearish' WHEN sw <> 'none' AND rv > 1.5 THEN CASE WHEN sw = 'low' THEN 'bullish' ELSE 'bearish' END WHEN mv THEN CASE WHEN close > pc THEN 'bullish' ELSE 'bearish' END WHEN rv <= 1.5 THEN 'suspicious' ELSE 'neutral' END AS move_signal FROM e"""
)
def volume_real_move(spark, d):
    return rounded(V.real_move(hour(spark, d)), *KEY, "relative_volume", "volume_context", "range_percentile", "volume_location", "absorption", "sweep", "sweep_level", "move_is_real", "move_confidence", "move_signal")


@query(
    Q.bars("hour")
    + f""", a AS (SELECT *, CASE WHEN high - low > 0 THEN volume * (2 * (close - low) / (high - low) - 1) ELSE 0 END AS cd FROM bars),
b AS (SELECT *, sum(cd) OVER {Q.rows(5)} AS rd, sum(volume) OVER {Q.rows(5)} AS v5, sum(cd) OVER {_SO_FAR} AS cum, close - first(close) OVER {Q.rows(5)} AS dp FROM a),
c AS (SELECT *, CASE WHEN abs(v5) > 1e-9 THEN rd / v5 ELSE 0 END * 100 AS dpct FROM b)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('cd', 'candle_delta')}, {Q.r('rd', 'recent_delta')}, {Q.r('cum', 'cumulative_delta')}, {Q.r('dpct', 'delta_pct')},
  CASE WHEN dpct > 30 THEN 'strong_buy' WHEN dpct > 10 THEN 'buy' WHEN dpct < -30 THEN 'strong_sell' WHEN dpct < -10 THEN 'sell' ELSE 'neutral' END AS aggression_bias,
  {Q.r("CASE WHEN abs(dpct) > 30 THEN least(95, 70 + (abs(dpct) - 30) * 0.5) WHEN abs(dpct) > 10 THEN 55 + (abs(dpct) - 10) * 0.75 ELSE 40 + abs(dpct) * 1.5 END", 'delta_strength')},
  (dp > 0 AND rd < 0) OR (dp < 0 AND rd > 0) AS delta_divergence FROM c"""
)
def volume_candle_delta(spark, d):
    return rounded(V.with_candle_delta(hour(spark, d)), *KEY, "candle_delta", "recent_delta", "cumulative_delta", "delta_pct", "aggression_bias", "delta_strength", "delta_divergence")


_STEPS = ", ".join(f"lag(volume, {k}) OVER ({Q.W}) AS v{k}" for k in range(1, 10))
_RATIO = [f"CASE WHEN {'v' + str(k + 1)} IS NULL THEN NULL WHEN v{k + 1} > 0 THEN {'volume' if k == 0 else 'v' + str(k)} / v{k + 1} ELSE 1 END" for k in range(9)]


@query(
    Q.bars("hour")
    + f""", a AS (SELECT *, row_number() OVER ({Q.W}) AS n, avg(volume) OVER {Q.rows(10)} AS mean, {_STEPS} FROM bars),
b AS (SELECT *, list_filter([{', '.join(_RATIO)}], lambda x: x IS NOT NULL) AS rs, CASE WHEN abs(mean) > 1e-9 THEN volume / mean ELSE 1 END AS va FROM a),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, len(rs) + 1), lambda i: rs[i] BETWEEN 0.9 AND 1.1)) - 1, len(rs)) AS k FROM b)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('coalesce(rs[1], 1)', 'volume_accel')}, {Q.r('coalesce(rs[1] - rs[2], 0)', 'accel_momentum')}, {Q.r('va', 'volume_vs_avg')},
  CASE WHEN n < 3 THEN 'steady' WHEN va >= 3 THEN 'climax' WHEN coalesce(rs[1], 1) >= 1.5 THEN 'accelerating' WHEN coalesce(rs[1], 1) <= 0.7 THEN 'decelerating' ELSE 'steady' END AS accel_state,
  (k - coalesce(list_max(list_filter(range(1, k + 1), lambda i: rs[i] < 0.9)), 0))::INT AS bars_rising, (k - coalesce(list_max(list_filter(range(1, k + 1), lambda i: rs[i] > 1.1)), 0))::INT AS bars_falling FROM c"""
)
def volume_acceleration(spark, d):
    return rounded(V.with_acceleration(hour(spark, d)), *KEY, "volume_accel", "accel_momentum", "volume_vs_avg", "accel_state", "bars_rising", "bars_falling")


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({Q.W})"


@query(
    Q.bars("hour")
    + f""", z AS (SELECT *, abs(close - open) AS body FROM bars),
a AS (SELECT *, row_number() OVER ({Q.W}) AS n, avg(volume) OVER {Q.rows(5, -5)} AS a5, avg(volume) OVER {_SO_FAR} AS aall, max(volume) OVER {Q.rows(5)} AS mx, ({_lag('body', 4)} + {_lag('body', 3)}) / 2 AS eb, (body + {_lag('body', 1)}) / 2 AS lb,
  ({_lag('volume', 4)} + {_lag('volume', 3)}) / 2 AS ev, (volume + {_lag('volume', 1)} + {_lag('volume', 2)}) / 3 AS lv, {_lag('close', 4)} - {_lag('close', 5)} AS push, close - {_lag('close', 4)} AS prog FROM z),
b AS (SELECT *, mx > CASE WHEN n >= 10 THEN a5 ELSE aall END * 1.5 AS spike FROM a),
c AS (SELECT *, coalesce(lb < eb * 0.5 AND spike, false) AS f1, coalesce(lv < ev * 0.7, false) AS f2, coalesce(CASE WHEN push > 0 THEN prog < push * 0.3 WHEN push < 0 THEN prog > push * 0.3 ELSE false END AND spike, false) AS f3 FROM b),
e AS (SELECT *, CASE WHEN n >= 6 THEN f1::INT + f2::INT + f3::INT ELSE 0 END AS k FROM c)
SELECT symbol, ts::TIMESTAMPTZ AS ts, k AS exhaustion_signs, CASE WHEN n < 6 THEN 'low' WHEN k >= 4 OR (k >= 3 AND spike) THEN 'extreme' WHEN k >= 3 OR (k >= 2 AND spike) THEN 'high' WHEN k >= 2 THEN 'medium' ELSE 'low' END AS exhaustion_risk,
  {Q.r("CASE WHEN n >= 6 THEN least(95, 30 + 20 * f1::INT + 15 * f2::INT + 20 * f3::INT) ELSE 30 END::DOUBLE", 'exhaustion_confidence')} FROM e"""
)
def volume_exhaustion(spark, d):
    return rounded(V.with_exhaustion(hour(spark, d)), *KEY, "exhaustion_signs", "exhaustion_risk", "exhaustion_confidence")


@query(
    Q.OI
    + f""", a AS (SELECT *, first(price) OVER {Q.rows(20)} AS p0, first(open_interest) OVER {Q.rows(20)} AS o0 FROM oi),
b AS (SELECT *, CASE WHEN p0 > 0 THEN (price - p0) / p0 * 100 ELSE 0 END AS p, CASE WHEN o0 > 0 THEN (open_interest - o0) / o0 * 100 ELSE 0 END AS o FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('p', 'price_pct')}, {Q.r('o', 'oi_pct')}, CASE WHEN p > 0.5 AND o > 1 THEN 'new_longs' WHEN p > 0.5 AND o < -1 THEN 'short_covering' WHEN p < -0.5 AND o > 1 THEN 'new_shorts' WHEN p < -0.5 AND o < -1 THEN 'long_liquidation' ELSE 'neutral' END AS oi_regime,
  {Q.r("CASE WHEN p > 0.5 AND o > 1 THEN least(90, 50 + abs(p) * 5 + abs(o) * 3) WHEN p > 0.5 AND o < -1 THEN least(85, 50 + abs(p) * 3 + abs(o) * 3) WHEN p < -0.5 AND o > 1 THEN least(90, 50 + abs(p) * 3 + abs(o) * 5) WHEN p < -0.5 AND o < -1 THEN least(85, 50 + abs(p) * 3 + abs(o) * 3) ELSE 40 END", 'oi_strength')},
  CASE WHEN o > 0.1 THEN 'ENTERING' WHEN o < -0.1 THEN 'LEAVING' ELSE 'FLAT' END AS money_flow FROM b"""
)
def oi_regime(spark, d):
    return rounded(O.with_regime(S.open_interest(spark, d)), *KEY, "price_pct", "oi_pct", "oi_regime", "oi_strength", "money_flow")


@query(
    Q.OI
    + f""", a AS (SELECT *, row_number() OVER ({Q.W}) AS n, lag(open_interest) OVER ({Q.W}) AS l FROM oi),
b AS (SELECT *, coalesce(CASE WHEN l > 0 THEN (open_interest - l) / l * 100 ELSE 0 END, 0) AS s, CASE WHEN l > 0 THEN abs(open_interest - l) END AS d FROM a),
c AS (SELECT *, CASE WHEN n >= 20 THEN avg(CASE WHEN l > 0 THEN abs(s) END) OVER {Q.rows(19)} WHEN s <> 0 THEN abs(s) ELSE 1 END AS m, avg(d) OVER {Q.rows(2)} AS r2, avg(d) OVER {Q.rows(3, -2)} AS r3 FROM b)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('s', 'oi_step_pct')}, {Q.r('CASE WHEN n >= 2 AND m > 0 THEN abs(s) / m ELSE 1 END', 'oi_rate_vs_avg')}, {Q.r('CASE WHEN n >= 6 AND r3 > 0 THEN (r2 - r3) / r3 ELSE 0 END', 'oi_acceleration')} FROM c"""
)
def oi_rate(spark, d):
    return rounded(O.with_rate(S.open_interest(spark, d)), *KEY, "oi_step_pct", "oi_rate_vs_avg", "oi_acceleration")


def _pct(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN ({now} - {before}) / {before} * 100 ELSE 0 END"


@query(
    Q.OI
    + f""", a AS (SELECT *, count(*) OVER {Q.rows(10)} AS n, {_lag('price', 9)} AS p9, {_lag('open_interest', 9)} AS o9, {_lag('price', 2)} AS p2, {_lag('open_interest', 4)} AS o4, max(price) OVER {Q.rows(10)} - min(price) OVER {Q.rows(10)} AS rng,
  max(high) OVER {Q.rows(5)} AS h5, min(low) OVER {Q.rows(5)} AS l5, max(high) OVER {Q.rows(5, -5)} AS ht, min(low) OVER {Q.rows(5, -5)} AS lt FROM oi),
b AS (SELECT *, CASE WHEN p9 > 0 THEN rng / p9 * 100 ELSE 0 END AS vol, {_pct('open_interest', 'o9')} AS oc, {_pct('price', 'p2')} AS mv, {_pct('open_interest', 'o4')} AS ro FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN n < 10 THEN 'none' WHEN oc > 3 AND vol < 2 THEN 'compression' WHEN (h5 > ht * 1.002 OR l5 < lt * 0.998) AND ro < -2 THEN 'breakout_trap' WHEN oc > 5 AND abs(mv) > 1 THEN 'expansion' WHEN oc < -5 THEN 'exhaustion' ELSE 'none' END AS oi_signal FROM b"""
)
def oi_edge(spark, d):
    return O.with_edge(S.open_interest(spark, d)).select(*KEY, "oi_signal")


@query(
    Q.TRADES
    + """, k AS (SELECT *, date_trunc('day', ts) AS start FROM trades WHERE price * quantity >= 50),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, start ORDER BY quantity) AS pl, floor(count(*) OVER (PARTITION BY symbol, start) * 0.2)::BIGINT + 1 AS c FROM k),
q AS (SELECT *, max(CASE WHEN pl = c THEN quantity END) OVER (PARTITION BY symbol, start) AS least_q FROM p)
SELECT symbol, start::TIMESTAMPTZ AS ts, count(*) AS trades, round(sum(quantity), 6) + 0 AS volume FROM q WHERE quantity >= least_q GROUP BY ALL"""
)
def noise_filter(spark, d):
    kept = B.without_noise(S.trades(spark, d), "1d").groupBy("symbol", F.col("start").alias("ts")).agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("volume"))
    return rounded(kept)


@query(
    Q.TRADES
    + """, k AS (SELECT *, date_trunc('day', ts) AS start FROM trades),
m AS (SELECT symbol, start, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS b, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS s, count(*) AS n FROM k GROUP BY ALL),
g AS (SELECT symbol, unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM k GROUP BY symbol),
f AS (SELECT g.symbol, g.start AS ts, coalesce(open, 0) AS open, coalesce(high, 0) AS high, coalesce(low, 0) AS low, coalesce(close, 0) AS close, coalesce(b, 0) AS buy_volume, coalesce(s, 0) AS sell_volume, coalesce(n, 0) AS trades FROM g LEFT JOIN m USING (symbol, start))
SELECT symbol, ts::TIMESTAMPTZ AS ts, round(open, 6) + 0 AS open, round(high, 6) + 0 AS high, round(low, 6) + 0 AS low, round(close, 6) + 0 AS close, round(buy_volume, 6) + 0 AS buy_volume, round(sell_volume, 6) + 0 AS sell_volume, round(buy_volume - sell_volume, 6) + 0 AS delta,
  round(CASE WHEN abs(buy_volume + sell_volume) > 1e-9 THEN (buy_volume - sell_volume) / (buy_volume + sell_volume) ELSE 0 END, 6) + 0 AS delta_ratio, trades, round(sum(buy_volume - sell_volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0 AS cvd FROM f"""
)
def precise_delta_bars(spark, d):
    return rounded(B.delta_bars(S.trades(spark, d), "1d", filtered=False), *KEY, "open", "high", "low", "close", "buy_volume", "sell_volume", "delta", "delta_ratio", "trades", "cvd")


@query(
    Q.TRADES
    + """, p AS (SELECT *, floor((row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) - 1) / greatest(1, floor(count(*) OVER (PARTITION BY symbol) / 20)))::BIGINT AS bar FROM trades)
SELECT symbol, bar, round(first(price ORDER BY ts, trade_id), 6) + 0 AS open, round(max(price), 6) + 0 AS high, round(min(price), 6) + 0 AS low, round(last(price ORDER BY ts, trade_id), 6) + 0 AS close, round(sum(quantity), 6) + 0 AS volume, count(*) AS trades FROM p GROUP BY ALL"""
)
def count_bars(spark, d):
    return rounded(B.count_bars(S.trades(spark, d)))
