"""Queries on tickers, taker volume, accounts, and the verdicts on open interest, funding and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from ..operators import asof as A
from ..operators import bars as B
from ..operators import open_interest as O
from ..operators import score as C
from ..operators import structure as T
from ..operators import verdict as X
from ..sources import market as S
from . import flow
from . import oracle as Q
from .flow import _FUND, _PIVOTS, _SEEN, _ahead
from .market import KEY, _pct, hour, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    f"""WITH l AS (SELECT event_type AS symbol, max(ts) AS till FROM events GROUP BY ALL),
d AS (SELECT event_type AS symbol, ts, event_id, value FROM events JOIN l ON event_type = symbol WHERE ts > till - INTERVAL 24 HOUR)
SELECT symbol, {Q.r('last(value ORDER BY ts, event_id) - first(value ORDER BY ts, event_id)', 'price_change')}, {Q.r('(last(value ORDER BY ts, event_id) - first(value ORDER BY ts, event_id)) / nullif(first(value ORDER BY ts, event_id), 0) * 100', 'price_change_pct')}, {Q.r('avg(value)', 'weighted_avg_price')},
 {Q.r('last(value ORDER BY ts, event_id)', 'last_price')}, {Q.r('max(value)', 'high_price')}, {Q.r('min(value)', 'low_price')}, {Q.r('first(value ORDER BY ts, event_id)', 'open_price')}, count(*) AS trades FROM d GROUP BY symbol"""
)
def ticker_24h(spark, d):
    """Each symbol's last 24 hours of ticks, each of quantity one."""
    ticks = S.event_ticks(spark, d)
    till = ticks.groupBy("symbol").agg(F.max("ts").alias("till"))
    order = F.struct("ts", "seq")
    rows = ticks.join(till, "symbol").where(F.col("ts") > F.col("till") - F.expr("INTERVAL 24 HOURS")).groupBy("symbol").agg(
        F.min_by("price", order).alias("open_price"), F.max_by("price", order).alias("last_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.avg("price").alias("weighted_avg_price"), F.count("*").alias("trades")
    )
    change = F.col("last_price") - F.col("open_price")
    return rounded(rows.withColumns({"price_change": change, "price_change_pct": F.try_divide(change, F.col("open_price")) * 100}), "symbol", "price_change", "price_change_pct", "weighted_avg_price", "last_price", "high_price", "low_price", "open_price", "trades")


@query(
    f"""WITH v AS (SELECT l_returnflag AS symbol, date_trunc('week', l_shipdate) AS ts, coalesce(sum(l_quantity) FILTER (l_linestatus <> 'F'), 0) AS b, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS s FROM lineitem GROUP BY ALL)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('b', 'buy_volume')}, {Q.r('s', 'sell_volume')}, {Q.r('CASE WHEN abs(s) > 1e-9 THEN b / s ELSE 0 END', 'buy_sell_ratio')} FROM v"""
)
def taker_volume(spark, d):
    """Volume by the taker's side and week; the ratio is 0 where nothing was sold."""
    rows = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("ts"))
    side = lambda sold: F.coalesce(F.sum(F.when((F.col("l_linestatus") == "F") == F.lit(sold), F.col("l_quantity"))), F.lit(0.0))
    rows = rows.agg(side(False).alias("buy_volume"), side(True).alias("sell_volume"))
    return rounded(rows.withColumn("buy_sell_ratio", safe_divide(F.col("buy_volume"), F.col("sell_volume"))), "symbol", "ts", "buy_volume", "sell_volume", "buy_sell_ratio")


@query(
    f"""WITH v AS (SELECT c_mktsegment AS symbol, count(*) FILTER (c_acctbal >= 0)::DOUBLE AS l, count(*) FILTER (c_acctbal < 0)::DOUBLE AS s FROM customer GROUP BY ALL)
SELECT symbol, {Q.r('l / (l + s)', 'long_account')}, {Q.r('s / (l + s)', 'short_account')}, {Q.r('CASE WHEN s > 0 THEN l / s ELSE 0 END', 'long_short_ratio')} FROM v"""
)
def long_short_ratio(spark, d):
    """Customers as accounts: long with a balance of zero or more, short below."""
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    rows = S.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("symbol")).agg(n(F.col("c_acctbal") >= 0).alias("long"), n(F.col("c_acctbal") < 0).alias("short"))
    every = F.col("long") + F.col("short")
    return rounded(rows.withColumns({"long_account": safe_divide(F.col("long"), every), "short_account": safe_divide(F.col("short"), every), "long_short_ratio": safe_divide(F.col("long"), F.col("short"))}), "symbol", "long_account", "short_account", "long_short_ratio")


@query(Q.OI + f" SELECT symbol, max(ts)::TIMESTAMPTZ AS ts, {Q.r('last(open_interest ORDER BY ts)', 'open_interest')}, {Q.r('last(open_interest * price ORDER BY ts)', 'open_interest_value')} FROM oi GROUP BY symbol")
def open_interest_value(spark, d):
    """Each symbol's latest open interest, and its value at that day's mean price."""
    rows = S.open_interest(spark, d).groupBy("symbol").agg(F.max_by(F.struct("ts", "open_interest", (F.col("open_interest") * F.col("price")).alias("open_interest_value")), "ts").alias("x"))
    return rounded(rows.select("symbol", "x.*"), "symbol", "ts", "open_interest", "open_interest_value")


@query(
    Q.OI
    + f""", a AS (SELECT *, first(price) OVER {Q.rows(20)} AS p0, first(open_interest) OVER {Q.rows(20)} AS o0 FROM oi), b AS (SELECT *, {_pct('price', 'p0')} AS p, {_pct('open_interest', 'o0')} AS o FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('o', 'oi_change_pct')}, CASE WHEN abs(o) > 5 AND p > 0 THEN 'bullish' WHEN abs(o) > 5 AND p < 0 THEN 'bearish' ELSE 'neutral' END AS oi_change_signal, {Q.r('CASE WHEN o > 5 AND p <> 0 THEN least(85, 60 + abs(o)) WHEN o < -5 AND p <> 0 THEN 55 ELSE 50 END', 'oi_change_strength')} FROM b"""
)
def oi_change_signal(spark, d):
    return rounded(X.with_oi_signal(S.open_interest(spark, d)), *KEY, "oi_change_pct", "oi_change_signal", "oi_change_strength")


@query(
    Q.OI
    + f""", a AS (SELECT *, first(price) OVER {Q.rows(20)} AS p0, first(open_interest) OVER {Q.rows(20)} AS o0, count(*) OVER {Q.rows(10)} AS n, lag(price, 9) OVER ({Q.W}) AS p9, lag(open_interest, 9) OVER ({Q.W}) AS o9, lag(price, 2) OVER ({Q.W}) AS p2, lag(open_interest, 4) OVER ({Q.W}) AS o4, max(price) OVER {Q.rows(10)} - min(price) OVER {Q.rows(10)} AS rng,
  max(high) OVER {Q.rows(5)} AS h5, min(low) OVER {Q.rows(5)} AS l5, max(high) OVER {Q.rows(5, -5)} AS ht, min(low) OVER {Q.rows(5, -5)} AS lt FROM oi),
b AS (SELECT *, {_pct('price', 'p0')} AS p, {_pct('open_interest', 'o0')} AS o, CASE WHEN p9 > 0 THEN rng / p9 * 100 ELSE 0 END AS vol, {_pct('open_interest', 'o9')} AS oc, {_pct('price', 'p2')} AS mv, {_pct('open_interest', 'o4')} AS ro FROM a),
c AS (SELECT *, CASE WHEN n < 10 THEN 'none' WHEN oc > 3 AND vol < 2 THEN 'compression' WHEN (h5 > ht * 1.002 OR l5 < lt * 0.998) AND ro < -2 THEN 'breakout_trap' WHEN oc > 5 AND abs(mv) > 1 THEN 'expansion' WHEN oc < -5 THEN 'exhaustion' ELSE 'none' END AS e FROM b)
SELECT symbol, ts::TIMESTAMPTZ AS ts, o > 0.1 AS money_entering, CASE WHEN e = 'compression' THEN 'neutral' WHEN e IN ('breakout_trap', 'exhaustion') THEN 'caution' WHEN e = 'expansion' THEN CASE WHEN p > 0.5 THEN 'bullish' ELSE 'bearish' END
  WHEN p > 0.5 AND o > 1 THEN 'bullish' WHEN p < -0.5 AND o > 1 THEN 'bearish' WHEN abs(p) > 0.5 AND o < -1 THEN 'caution' ELSE 'neutral' END AS oi_verdict FROM c"""
)
def oi_verdict(spark, d):
    return X.with_oi_verdict(O.with_edge(O.with_regime(S.open_interest(spark, d)))).select(*KEY, "money_entering", "oi_verdict")


@query(
    _FUND
    + """ SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE zone WHEN 'extreme_positive' THEN 'squeeze_risk_down' WHEN 'high_positive' THEN 'dont_chase_longs' WHEN 'extreme_negative' THEN 'squeeze_risk_up' WHEN 'high_negative' THEN 'dont_chase_shorts' ELSE 'none' END AS funding_warning,
 CASE WHEN starts_with(zone, 'extreme') THEN 'extreme' WHEN starts_with(zone, 'high') THEN 'high' ELSE 'low' END AS funding_severity FROM z"""
)
def funding_warning(spark, d):
    warning, severity = X.funding_warning(F.col("funding_zone"))
    return C.with_funding_zone(S.funding(spark, d)).select(*KEY, warning.alias("funding_warning"), severity.alias("funding_severity"))


_STATE = f""", c AS (SELECT *, lag(sh, 5) OVER ({Q.W}) AS h, lag(sl, 5) OVER ({Q.W}) AS l FROM s),
a AS (SELECT *, list_filter(list(h) OVER {_SEEN}, lambda x: x IS NOT NULL) AS hs, list_filter(list(l) OVER {_SEEN}, lambda x: x IS NOT NULL) AS ls FROM c),
b AS (SELECT *, hs[-1] > hs[-2] AS h1, hs[-2] > hs[-3] AS h2, ls[-1] > ls[-2] AS l1, ls[-2] > ls[-3] AS l2 FROM a),
e AS (SELECT *, CASE WHEN coalesce(len(hs), 0) < 2 OR coalesce(len(ls), 0) < 2 THEN 'unknown' WHEN (h1 OR coalesce(h2, false)) AND (l1 OR coalesce(l2, false)) AND NOT (NOT h1 OR NOT coalesce(h2, true)) THEN 'uptrend'
  WHEN (NOT h1 OR NOT coalesce(h2, true)) AND (NOT l1 OR NOT coalesce(l2, true)) AND NOT (h1 OR coalesce(h2, false)) THEN 'downtrend' ELSE 'range' END AS trend FROM b),
f AS (SELECT e.symbol, e.ts, e.trend, e.hs[-1] AS lh, e.ls[-1] AS ll, x.close, x.volume, x.high, x.low, CASE WHEN e.high > hs[-1] AND trend = 'uptrend' THEN 'bos_bullish' WHEN e.high > hs[-1] AND trend = 'downtrend' THEN 'choch_bullish' WHEN e.low < ls[-1] AND trend = 'downtrend' THEN 'bos_bearish' WHEN e.low < ls[-1] AND trend = 'uptrend' THEN 'choch_bearish' ELSE 'none' END AS ev FROM e JOIN bars x USING (symbol, ts)),
g AS (SELECT *, CASE WHEN ends_with(ev, 'bullish') THEN lh ELSE ll END AS lv, list(close) OVER {_ahead(3)} AS nx, avg(volume) OVER {_ahead(3)} AS av, avg(volume) OVER {Q.rows(3, -1)} AS bv FROM f),
k AS (SELECT *, CASE WHEN ev <> 'none' AND len(nx) = 3 THEN len(list_filter(nx, lambda y: (y > lv) = ends_with(ev, 'bullish'))) / 3.0 END AS held FROM g),
m AS (SELECT *, CASE WHEN held IS NOT NULL THEN held >= 0.67 AND av >= 1.2 * bv END AS okay, sum((ev <> 'none')::INT) OVER {_SEEN} AS leg FROM k)"""


@query(Q.bars("hour") + _PIVOTS + _STATE + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, ev AS structure_event, {Q.r('held', 'break_held')}, okay AS break_accepted FROM m WHERE ev <> 'none'")
def break_acceptance(spark, d):
    rows = T.acceptance(T.with_breaks(T.with_trend(hour(spark, d)))).where("structure_event <> 'none'")
    return rounded(rows, *KEY, "structure_event", "break_held", "break_accepted")


_LEG = "PARTITION BY symbol, leg ORDER BY ts"


@query(
    Q.bars("hour")
    + _PIVOTS
    + _STATE
    + f""", n AS (SELECT *, first(ev) OVER ({_LEG}) AS kind, first(lv) OVER ({_LEG}) AS level, first(ts) OVER ({_LEG}) AS began, first(okay) OVER ({_LEG}) AS ok1, row_number() OVER ({_LEG}) AS i,
  row_number() OVER ({Q.W}) AS nb, max(high) OVER {Q.rows(10)} AS hi, min(low) OVER {Q.rows(10)} AS lo, max(CASE WHEN starts_with(ev, 'bos') THEN ts END) OVER {_SEEN} AS bos_at, max(CASE WHEN starts_with(ev, 'choch') THEN ts END) OVER {_SEEN} AS choch_at FROM m),
o AS (SELECT *, min(CASE WHEN leg > 0 AND abs((close - level) / nullif(level, 0)) * 100 >= 0.5 THEN ts END) OVER ({_LEG}) AS reached, CASE WHEN i > 3 AND leg > 0 THEN ok1 END AS acc, nb >= 10 AND (hi - lo) / nullif(lo, 0) * 100 < 2 AS rng FROM n),
pp AS (SELECT *, epoch_ms(reached) / 1000.0 - epoch_ms(began) / 1000.0 AS took, epoch_ms(ts) / 1000.0 - epoch_ms(began) / 1000.0 AS el FROM o),
q AS (SELECT *, CASE WHEN leg = 0 THEN 'slow' WHEN NOT coalesce(acc, true) THEN 'stalled' WHEN took < 36000 * 0.33 THEN 'fast' WHEN took < 36000 THEN 'slow' WHEN took IS NOT NULL OR el > 36000 THEN 'stalled' ELSE 'slow' END AS mo FROM pp),
t AS (SELECT *, greatest(0, least(100, 50.0 + CASE WHEN trend IN ('uptrend', 'downtrend') THEN 15 WHEN trend = 'range' AND rng THEN 10 ELSE -20 END + CASE WHEN leg > 0 AND starts_with(kind, 'bos') AND acc THEN 20 WHEN leg > 0 AND starts_with(kind, 'bos') AND NOT acc THEN -15 WHEN leg > 0 AND starts_with(kind, 'choch') THEN -10 ELSE 0 END + CASE mo WHEN 'fast' THEN 10 WHEN 'stalled' THEN -15 ELSE 0 END)) AS cf FROM q),
u AS (SELECT *, choch_at IS NULL OR coalesce(bos_at > choch_at, false) AS an FROM t),
y AS (SELECT *, CASE WHEN cf < 40 THEN NULL WHEN rng THEN 'both' WHEN trend = 'uptrend' AND an THEN 'long' WHEN trend = 'downtrend' AND an THEN 'short' END AS side FROM u)
SELECT symbol, ts::TIMESTAMPTZ AS ts, trend, mo AS structural_momentum, {Q.r('cf', 'structure_confidence')}, side AS allowed_side, CASE WHEN side IS NULL THEN true WHEN side = 'both' THEN cf < 60 ELSE side <> 'long' END AS long_vetoed FROM y"""
)
def structure_permission(spark, d):
    """Hourly structure by itself (no higher timeframe): its confidence, the side it allows, and whether it forbids a long with the same confidence."""
    rows = T.with_range(T.acceptance(T.with_breaks(T.with_trend(hour(spark, d)))), most_pct=2.0)
    rows = X.with_permission(X.with_last_break(rows).withColumn("tf_alignment", F.lit("htf_range")))
    rows = rows.withColumn("long_vetoed", X.structure_veto(F.col("allowed_side"), F.lit("long"), F.col("structure_confidence")))
    return rounded(rows, *KEY, "trend", "structural_momentum", "structure_confidence", "allowed_side", "long_vetoed")


_HIGHER = f", ht AS ({flow.ORACLES['trend_hh_hl'].replace(Q.bars('hour'), Q.bars('hour').replace("date_trunc('hour', ts)", 'time_bucket(INTERVAL 4 HOUR, ts)'))})"
_ALIGNED = "CASE WHEN htf IS NULL OR htf = 'range' THEN 'htf_range' WHEN htf = trend THEN 'full_align' WHEN trend = 'range' THEN 'partial_align' ELSE 'counter_trend' END"
_TWO = (
    ORACLES["structure_permission"]
    .rpartition("SELECT symbol, ts::TIMESTAMPTZ AS ts, trend, mo")[0]
    .replace(" AS el FROM o)", f" AS el, htf, {_ALIGNED} AS al FROM (SELECT o.*, ht.trend AS htf FROM o ASOF LEFT JOIN ht ON o.symbol = ht.symbol AND o.ts + INTERVAL 1 HOUR >= ht.ts::TIMESTAMP + INTERVAL 4 HOUR))")
    .replace("WHEN 'stalled' THEN -15 ELSE 0 END)) AS cf", "WHEN 'stalled' THEN -15 ELSE 0 END + CASE al WHEN 'full_align' THEN 15 WHEN 'counter_trend' THEN -20 WHEN 'partial_align' THEN 5 ELSE 0 END)) AS cf")
    .replace(", n AS (SELECT *, first(ev)", _HIGHER + ", n AS (SELECT *, first(ev)", 1)
)


@query(
    _TWO
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, trend, htf AS htf_trend, al AS tf_alignment, {Q.r('cf', 'structure_confidence')}, side AS allowed_side, {Q.r("greatest(-1, least(1, CASE trend WHEN 'uptrend' THEN 0.5 WHEN 'downtrend' THEN -0.5 ELSE 0 END * cf / 100 * CASE WHEN leg > 0 AND starts_with(kind, 'bos') AND acc THEN 1.3 WHEN leg > 0 AND starts_with(kind, 'bos') AND NOT acc THEN 0.5 WHEN leg > 0 AND starts_with(kind, 'choch') THEN 0.6 ELSE 1 END * CASE al WHEN 'full_align' THEN 1.2 WHEN 'counter_trend' THEN 0.4 ELSE 1 END * CASE mo WHEN 'fast' THEN 1.15 WHEN 'stalled' THEN 0.7 ELSE 1 END))", 'structure_score')} FROM y"""
)
def structure_signal(spark, d):
    """Structure of two intervals from one stream of trades: hourly bars, with the trend of the last four-hour bar that has closed."""
    ticks = S.event_ticks(spark, d)
    rows = T.with_range(T.acceptance(T.with_breaks(T.with_trend(B.ohlcv(ticks, "1h")))), most_pct=2.0)
    high = T.with_trend(B.ohlcv(ticks, "4h")).select("symbol", (F.col("ts") + F.expr("interval 4 hours")).alias("ts"), F.col("trend").alias("htf_trend"))
    closed = rows.withColumns({"__ts": F.col("ts"), "ts": F.col("ts") + F.expr("interval 1 hour")})
    joined = A.asof(closed, high, "htf_trend").withColumn("ts", F.col("__ts")).drop("__ts")
    joined = joined.withColumn("tf_alignment", F.coalesce(X.alignment(F.col("htf_trend"), F.col("trend")), F.lit("htf_range")))
    joined = joined.withColumn("tf_alignment", F.when(F.col("htf_trend").isNull(), "htf_range").otherwise(F.col("tf_alignment")))
    scored = X.structure_score(X.with_permission(X.with_last_break(joined)))
    return rounded(scored, *KEY, "trend", "htf_trend", "tf_alignment", "structure_confidence", "allowed_side", "structure_score")
