"""Queries on signed-volume bars, volume agreement and paper trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import lag
from ..operators import asof as A
from ..operators import bars as B
from ..operators import kernels as K
from ..operators import precise as P
from ..sources import market as T
from . import oracle as Q
from .market import KEY, ORACLES as _MARKET, hour, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_BARS = _MARKET["precise_delta_bars"].rpartition("SELECT symbol, ts::TIMESTAMPTZ")[0]


@query(
    _BARS.rstrip()
    + f""", x AS (SELECT symbol, ts, open, close, buy_volume AS b, sell_volume AS s, buy_volume + sell_volume AS v FROM f),
y AS (SELECT *, sum(b - s) OVER {Q.rows(5)} AS rd, sum(v) OVER {Q.rows(5)} AS v5, avg(v) OVER {Q.rows(20)} AS m, lag(v) OVER ({Q.W}) AS pv, CASE WHEN count(*) OVER {Q.rows(5)} = 5 THEN close - first(open) OVER {Q.rows(5)} ELSE 0 END AS ch FROM x),
z AS (SELECT *, CASE WHEN v5 > 0 THEN rd / (v5 + 1e-9) ELSE 0 END AS rr, CASE WHEN m > 0 THEN v / m ELSE 1 END AS rv, CASE WHEN pv > 0 THEN v / pv ELSE 1 END AS pa FROM y)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('rd', 'recent_delta')}, {Q.r('rr', 'recent_ratio')}, {Q.r('rv', 'rv')}, CASE WHEN rr > 0.3 THEN 'strong_buy' WHEN rr > 0.15 THEN 'buy' WHEN rr < -0.3 THEN 'strong_sell' WHEN rr < -0.15 THEN 'sell' ELSE 'neutral' END AS precise_bias,
 CASE WHEN rv < 0.3 THEN 'dead' WHEN rv < 0.7 THEN 'low' WHEN rv <= 1.5 THEN 'normal' WHEN rv <= 3 THEN 'high' ELSE 'extreme' END AS volume_level, CASE WHEN pa > 1.5 THEN 'accelerating' WHEN pa < 0.7 THEN 'decelerating' ELSE 'steady' END AS volume_pace,
 (ch > 0 AND rd < 0) OR (ch < 0 AND rd > 0) AS precise_divergence, {Q.r('least(95, 50 + abs(rr) * 100 + (rv - 1) * 10)', 'precise_confidence')},
 rv >= 1.5 AND CASE WHEN open > 0 THEN abs(close - open) / open ELSE 0 END / 2.0 <= 0.25 AND CASE WHEN rv > 0 THEN CASE WHEN open > 0 THEN abs(close - open) / open ELSE 0 END / (rv + 1e-9) ELSE 0 END <= 0.1 AS absorbed FROM z"""
)
def precise_delta_analysis(spark, d):
    rows = P.absorption(P.delta_analysis(B.delta_bars(T.trades(spark, d), "1d", filtered=False)), F.lit(2.0))
    return rounded(rows, *KEY, "recent_delta", "recent_ratio", "rv", "precise_bias", "volume_level", "volume_pace", "precise_divergence", "precise_confidence", "absorbed")


_HOURS = Q.bars("hour") + ", hb AS (SELECT * FROM bars), db AS (SELECT event_type AS symbol, date_trunc('day', ts) AS ts, sum(value) AS volume FROM events GROUP BY ALL)"
_OF = lambda t, n: f"(SELECT symbol, ts, CASE WHEN abs(avg(volume) OVER {Q.rows(20)}) > 1e-9 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS {n} FROM {t})"


@query(
    _HOURS
    + f""", j AS (SELECT h.symbol, h.ts, l, hi FROM {_OF('hb', 'l')} h ASOF JOIN {_OF('db', 'hi')} g ON h.symbol = g.symbol AND h.ts >= g.ts),
k AS (SELECT *, CASE WHEN l >= 1.5 AND hi >= 1.5 THEN 'confirmed' WHEN l >= 1.5 AND hi <= 0.7 THEN 'stop_run' WHEN l <= 0.7 AND hi >= 1.5 THEN 'reaccumulation' ELSE 'unclear' END AS st FROM j)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('l', 'ltf_ratio')}, {Q.r('hi', 'htf_ratio')}, st AS mtf_volume, st IN ('confirmed', 'reaccumulation') AS mtf_accepted,
 {Q.r("CASE st WHEN 'confirmed' THEN least(90, 60 + (l + hi - 2) * 10) WHEN 'stop_run' THEN least(85, 55 + abs(l - hi) * 10) WHEN 'reaccumulation' THEN 65 ELSE 40 END", 'mtf_confidence')} FROM k"""
)
def volume_mtf_agreement(spark, d):
    low = hour(spark, d).withColumn("ltf_ratio", P.recent_ratio("volume"))
    high = B.ohlcv(T.event_ticks(spark, d), "1d").withColumn("htf_ratio", P.recent_ratio("volume"))
    rows = A.asof(low.select("symbol", "ts", "seq", "ltf_ratio"), high.select("symbol", "ts", "htf_ratio"), "htf_ratio")
    return rounded(P.volume_agreement(rows), *KEY, "ltf_ratio", "htf_ratio", "mtf_volume", "mtf_accepted", "mtf_confidence")


def _pivot(side: str) -> str:
    """A bar beyond the five on either side, as the bar five later knows it."""
    best, worse = ("max", ">") if side == "high" else ("min", "<")
    beyond = " AND ".join(f"count(*) OVER {w} = 5 AND {side} {worse} {best}({side}) OVER {w}" for w in (Q.rows(5, -1), f"({Q.W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"))
    return f"CASE WHEN {beyond} THEN {side} END AS p_{side}"


def _levels(side: str) -> str:
    """The last ten known pivots at each bar, the newest first."""
    return f"(SELECT symbol, ts, list_reverse(list(k) OVER ({Q.W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS {side}s FROM (SELECT symbol, ts, lag(p_{side}, 5) OVER ({Q.W}) AS k FROM pv) WHERE k IS NOT NULL)"


def _closes(level: str, sign: str) -> str:
    return "CASE " + " ".join(f"WHEN i > {k} AND {'close' if k == 1 else f'lag(close, {k - 1}) OVER ({Q.W})'} {sign} {level} THEN {k}" for k in (1, 2, 3)) + " END"


def _picked(x: str) -> str:
    return "CASE b " + " ".join(f"WHEN {k} THEN {x.format(k=k, at=k - 1, a=k + 20, z=k + 1)}" for k in (1, 2, 3)) + " END"


_SWEEPS = (
    _BARS.rstrip()
    + f""", sb AS (SELECT symbol, ts, high, low, close, buy_volume + sell_volume AS v, CASE WHEN abs(buy_volume + sell_volume) > 1e-9 THEN (buy_volume - sell_volume) / (buy_volume + sell_volume) ELSE 0 END AS dr, row_number() OVER ({Q.W}) AS i FROM f),
pv AS (SELECT *, {_pivot('high')}, {_pivot('low')} FROM sb),
lv AS (SELECT p.*, list_filter(h.highs, lambda x: x < p.high)[1] AS up, list_filter(l.lows, lambda x: x > p.low)[1] AS dn FROM pv p ASOF LEFT JOIN {_levels('high')} h ON p.symbol = h.symbol AND p.ts >= h.ts ASOF LEFT JOIN {_levels('low')} l ON p.symbol = l.symbol AND p.ts >= l.ts),
bk AS (SELECT *, {_closes('up', '<')} AS bu, {_closes('dn', '>')} AS bd FROM lv),
sd AS (SELECT *, CASE WHEN i < 3 THEN NULL WHEN bu IS NOT NULL THEN 'up' WHEN bd IS NOT NULL THEN 'down' END AS side, CASE WHEN i >= 3 THEN coalesce(bu, bd) END AS b FROM bk),
pk AS (SELECT *, {_picked(f'lag(v, {{at}}) OVER ({Q.W})')} AS pvol, {_picked(f'avg(v) OVER ({Q.W} ROWS BETWEEN {{a}} PRECEDING AND {{z}} PRECEDING)')} AS mean, {_picked(f'lag(dr, {{at}}) OVER ({Q.W})')} AS pr FROM sd),
fl AS (SELECT *, CASE WHEN side IS NOT NULL THEN CASE WHEN mean > 0 THEN pvol / mean ELSE 0 END END AS prv, CASE side WHEN 'up' THEN pr < -0.1 WHEN 'down' THEN pr > 0.1 END AS flipped FROM pk)"""
)


@query(
    _SWEEPS
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, side AS sweep_side, {Q.r("CASE side WHEN 'up' THEN up WHEN 'down' THEN dn END", 'swept_level')}, b AS bars_to_close, {Q.r('prv', 'post_sweep_rv')}, flipped AS delta_flipped, CASE WHEN flipped THEN CASE side WHEN 'up' THEN 'longs' ELSE 'shorts' END END AS trapped_side,
 flipped AND prv > 1.2 AS sweep_confirmed, {Q.r('CASE WHEN flipped AND prv > 1.2 THEN least(95, 60 + prv * 10 + abs(pr) * 50) WHEN side IS NOT NULL THEN 40 ELSE 0 END', 'sweep_confidence')} FROM fl WHERE side IS NOT NULL"""
)
def sweep_confirmation(spark, d):
    """Sweeps of swing levels on daily bars of signed volume, and whether volume and delta confirm them."""
    rows = P.sweeps(B.delta_bars(T.trades(spark, d), "1d", filtered=False)).where("sweep_side is not null")
    return rounded(rows, *KEY, "sweep_side", "swept_level", "bars_to_close", "post_sweep_rv", "delta_flipped", "trapped_side", "sweep_confirmed", "sweep_confidence")


@query()
def trade_tracker_stats(spark, d):
    """A long where the close rises through its average, a short where it falls through, stopped and targeted at one and two per cent."""
    rows = K.with_moments(hour(spark, d))
    above, before = F.col("close") > F.col("sma"), lag("close") > lag("sma")
    rows = rows.withColumn("signal", F.when(above & ~before, "long").when(~above & before, "short"))
    way = F.when(F.col("signal") == "long", 1).otherwise(-1)
    rows = rows.withColumns({"price": F.col("close"), "stop": F.col("close") * (1 - 0.01 * way), "target": F.col("close") * (1 + 0.02 * way)})
    return rounded(P.trade_stats(P.paper_trades(rows.select("symbol", "tf", "ts", "seq", "price", "signal", "stop", "target"))))
