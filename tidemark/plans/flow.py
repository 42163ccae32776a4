"""Queries on structure, order books, funding, scores and the choice of instruments."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import book as K
from ..operators import score as C
from ..operators import select as P
from ..operators import structure as T
from ..operators import volume as V
from ..functions.scalars import higher_interval, history_limit
from ..operators.kernels import with_relative_volume
from ..sources import market as S
from . import market
from . import oracle as Q
from .market import KEY, _TR, hour, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _ahead(n: int) -> str:
    return f"({Q.W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


_PIVOTS = f""", p AS (SELECT *, count(*) OVER {Q.rows(5, -1)} = 5 AND count(*) OVER {_ahead(5)} = 5 AS ok, max(high) OVER {Q.rows(5, -1)} AS hb, max(high) OVER {_ahead(5)} AS ha, min(low) OVER {Q.rows(5, -1)} AS lb, min(low) OVER {_ahead(5)} AS la FROM bars),
s AS (SELECT symbol, ts, high, low, CASE WHEN ok AND high > hb AND high > ha THEN high END AS sh, CASE WHEN ok AND low < lb AND low < la THEN low END AS sl FROM p)"""


@query(Q.bars("hour") + _PIVOTS + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('sh', 'swing_high')}, {Q.r('sl', 'swing_low')} FROM s WHERE sh IS NOT NULL OR sl IS NOT NULL")
def swings_pivot5(spark, d):
    return rounded(T.with_pivots(hour(spark, d)).where("swing_high is not null or swing_low is not null"), *KEY, "swing_high", "swing_low")


_SEEN = f"({Q.W} ROWS UNBOUNDED PRECEDING)"


@query(
    Q.bars("hour")
    + _PIVOTS
    + f""", c AS (SELECT *, lag(sh, 5) OVER ({Q.W}) AS h, lag(sl, 5) OVER ({Q.W}) AS l FROM s),
a AS (SELECT *, list_filter(list(h) OVER {_SEEN}, lambda x: x IS NOT NULL) AS hs, list_filter(list(l) OVER {_SEEN}, lambda x: x IS NOT NULL) AS ls FROM c),
b AS (SELECT *, hs[-1] > hs[-2] AS h1, hs[-2] > hs[-3] AS h2, ls[-1] > ls[-2] AS l1, ls[-2] > ls[-3] AS l2 FROM a),
e AS (SELECT *, CASE WHEN coalesce(len(hs), 0) < 2 OR coalesce(len(ls), 0) < 2 THEN 'unknown' WHEN (h1 OR coalesce(h2, false)) AND (l1 OR coalesce(l2, false)) AND NOT (NOT h1 OR NOT coalesce(h2, true)) THEN 'uptrend'
  WHEN (NOT h1 OR NOT coalesce(h2, true)) AND (NOT l1 OR NOT coalesce(l2, true)) AND NOT (h1 OR coalesce(h2, false)) THEN 'downtrend' ELSE 'range' END AS trend FROM b)
SELECT symbol, ts::TIMESTAMPTZ AS ts, trend, {Q.r('hs[-1]', 'last_high')}, {Q.r('ls[-1]', 'last_low')}, CASE WHEN high > hs[-1] AND trend = 'uptrend' THEN 'bos_bullish' WHEN high > hs[-1] AND trend = 'downtrend' THEN 'choch_bullish' WHEN low < ls[-1] AND trend = 'downtrend' THEN 'bos_bearish' WHEN low < ls[-1] AND trend = 'uptrend' THEN 'choch_bearish' ELSE 'none' END AS structure_event FROM e"""
)
def trend_hh_hl(spark, d):
    return rounded(T.with_breaks(T.with_trend(hour(spark, d))), *KEY, "trend", "last_high", "last_low", "structure_event")


@query(
    Q.bars("hour")
    + f""", a AS (SELECT *, lag(high, 2) OVER ({Q.W}) AS h2, lag(low, 2) OVER ({Q.W}) AS l2, min(low) OVER ({Q.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS la, max(high) OVER ({Q.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ha FROM bars),
b AS (SELECT *, low > h2 AS bull, CASE WHEN low > h2 THEN low WHEN high < l2 THEN l2 END AS t, CASE WHEN low > h2 THEN h2 WHEN high < l2 THEN high END AS bo FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN bull THEN 'bullish' ELSE 'bearish' END AS gap_side, {Q.r('t', 'gap_top')}, {Q.r('bo', 'gap_bottom')}, {Q.r('(t - bo) / nullif(bo, 0) * 100', 'gap_pct')}, coalesce(CASE WHEN bull THEN la <= t ELSE ha >= bo END, false) AS gap_filled FROM b WHERE t IS NOT NULL AND (t - bo) / nullif(bo, 0) * 100 >= 0.1"""
)
def fvg(spark, d):
    return rounded(T.gaps(hour(spark, d)), *KEY, "gap_side", "gap_top", "gap_bottom", "gap_pct", "gap_filled")


@query(
    Q.OI.replace("oi AS", "bars AS")
    + f""", a AS (SELECT *, row_number() OVER ({Q.W}) AS n, max(price) OVER {Q.rows(10)} AS hi, min(price) OVER {Q.rows(10)} AS lo, max(price) OVER {Q.rows(10, -10)} - min(price) OVER {Q.rows(10, -10)} AS old, list(price) OVER {Q.rows(10)} AS ps, list(open_interest) OVER {Q.rows(10)} AS vs, sum(open_interest) OVER {Q.rows(10)} AS v FROM bars),
b AS (SELECT *, n >= 10 AND (hi - lo) / nullif(lo, 0) * 100 < 60 AS ok, CASE WHEN n >= 20 THEN CASE WHEN old > 0 THEN greatest(0, least(1, 1 - (hi - lo) / old)) ELSE 0 END ELSE 0.5 END AS t,
  coalesce(list_sum(list_filter(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN ps[i] > (hi + lo) / 2 THEN vs[i] END), lambda x: x IS NOT NULL)), 0) / nullif(v, 0) AS up, coalesce(list_sum(list_filter(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN ps[i] < (hi + lo) / 2 THEN vs[i] END), lambda x: x IS NOT NULL)), 0) / nullif(v, 0) AS dn FROM a)
SELECT symbol, ts::TIMESTAMPTZ AS ts, ok AS in_range, {Q.r('CASE WHEN ok THEN t ELSE 0 END', 'range_tightness')}, CASE WHEN NOT ok THEN 'neutral' WHEN t > 0.7 THEN 'compression' WHEN up > 0.6 THEN 'distribution' WHEN dn > 0.6 THEN 'accumulation' ELSE 'neutral' END AS range_type FROM b"""
)
def range_structure(spark, d):
    """On daily mean order prices, whose spans are wide."""
    rows = S.open_interest(spark, d).select("symbol", "tf", "ts", "seq", F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), F.col("open_interest").alias("volume"))
    return rounded(T.with_range(rows, most_pct=60.0), *KEY, "in_range", "range_tightness", "range_type")


_BREAK = f""", t AS (SELECT *, {_TR} AS tr FROM bars),
a AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(20, -1)} = 20 THEN max(high) OVER {Q.rows(20, -1)} END AS top, CASE WHEN count(*) OVER {Q.rows(20, -1)} = 20 THEN min(low) OVER {Q.rows(20, -1)} END AS bot, avg(tr) OVER {Q.rows(14)} / nullif(close, 0) * 100 AS ap,
  max(high) OVER {_ahead(10)} AS mx, min(low) OVER {_ahead(10)} AS mn, lead(close, 10) OVER ({Q.W}) AS fin, count(*) OVER {_ahead(10)} = 10 AS done FROM t),
b AS (SELECT *, coalesce(high > top AND ((high - top) / nullif(top, 0) * 100 >= 0.15 OR (high - top) / nullif(top, 0) * 100 >= ap * 0.25), false) AS up, coalesce(low < bot AND ((bot - low) / nullif(bot, 0) * 100 >= 0.15 OR (bot - low) / nullif(bot, 0) * 100 >= ap * 0.25), false) AS dn FROM a),
c AS (SELECT *, CASE WHEN up THEN high ELSE low END AS e, CASE WHEN up THEN top ELSE bot END AS lv FROM b WHERE up OR dn),
f AS (SELECT *, CASE WHEN done AND e <> 0 THEN greatest(0, CASE WHEN up THEN mx - e ELSE e - mn END / e * 100) END AS mfe, CASE WHEN done AND e <> 0 THEN least(0, CASE WHEN up THEN mn - e ELSE e - mx END / e * 100) END AS mae, CASE WHEN done AND e <> 0 THEN CASE WHEN up THEN fin - e ELSE e - fin END / e * 100 END AS fr, CASE WHEN up THEN mn < lv ELSE mx > lv END AS bk FROM c),
o AS (SELECT *, CASE WHEN NOT done THEN 'pending' WHEN mfe >= 1 AND NOT bk THEN 'true_breakout' WHEN bk AND fr < -0.5 THEN 'fake_breakout' ELSE 'unclear' END AS oc FROM f)"""


@query(Q.bars("hour") + _BREAK + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN up THEN 'upward' ELSE 'downward' END AS breakout, {Q.r('e', 'entry')}, {Q.r('lv', 'level')}, {Q.r('mfe', 'mfe_pct')}, {Q.r('mae', 'mae_pct')}, {Q.r('fr', 'final_pct')}, oc AS outcome FROM o")
def breakout_outcome(spark, d):
    return rounded(T.breakouts(hour(spark, d)), *KEY, "breakout", "entry", "level", "mfe_pct", "mae_pct", "final_pct", "outcome")


@query(
    Q.bars("hour")
    + _BREAK
    + f""", w AS (SELECT *, up AS went FROM o)
SELECT symbol, count(*) AS breakouts, count(*) FILTER (oc = 'true_breakout') AS true_breakouts, count(*) FILTER (oc = 'fake_breakout') AS fake_breakouts, count(*) FILTER (went) AS entered,
 {Q.r("coalesce(count(*) FILTER (oc = 'true_breakout' AND went)::DOUBLE / nullif(count(*) FILTER (went), 0), 0)", 'precision')}, {Q.r("coalesce(count(*) FILTER (oc = 'true_breakout' AND went)::DOUBLE / nullif(count(*) FILTER (oc = 'true_breakout'), 0), 0)", 'recall')},
 {Q.r("coalesce(count(*) FILTER (oc = 'fake_breakout' AND went)::DOUBLE / nullif(count(*) FILTER (oc = 'fake_breakout'), 0), 0)", 'false_positive_rate')}, {Q.r("coalesce(avg(mfe) FILTER (oc = 'true_breakout'), 0)", 'avg_mfe_true')}, {Q.r("coalesce(avg(mae) FILTER (oc = 'fake_breakout'), 0)", 'avg_mae_fake')},
 {Q.r("coalesce(count(*) FILTER (went AND oc IN ('true_breakout', 'fake_breakout') AND fr > 0)::DOUBLE / nullif(count(*) FILTER (went AND oc IN ('true_breakout', 'fake_breakout')), 0), 0)", 'win_rate')} FROM w GROUP BY symbol"""
)
def breakout_backtest(spark, d):
    """As if every upward breakout had been entered."""
    rows = T.backtest(T.breakouts(hour(spark, d)).withColumn("entered", F.col("breakout") == "upward"))
    return rounded(rows, "symbol", "breakouts", "true_breakouts", "fake_breakouts", "entered", "precision", "recall", "false_positive_rate", "avg_mfe_true", "avg_mae_fake", "win_rate")


_BOOK = """WITH l AS (SELECT l_orderkey AS book_id, l_linenumber % 2 = 1 AS bid, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS qty FROM lineitem),
b AS (SELECT book_id, list({'price': price, 'qty': qty} ORDER BY price DESC, qty DESC) FILTER (bid) AS bids, list({'price': price, 'qty': qty} ORDER BY price, qty) FILTER (NOT bid) AS asks FROM l GROUP BY book_id),
m AS (SELECT *, (bids[1].price + asks[1].price) / 2 AS mid FROM b WHERE len(bids) > 0 AND len(asks) > 0)"""
_SUM = lambda side, e, n=10: f"coalesce(list_sum(list_transform({side}[1:{n}], lambda x: {e})), 0)"


@query(
    _BOOK
    + f""", d AS (SELECT *, {_SUM('bids', 'x.qty')} AS bd, {_SUM('asks', 'x.qty')} AS ad, {_SUM('bids', 'x.price * x.qty')} AS bv, {_SUM('asks', 'x.price * x.qty')} AS av FROM m),
i AS (SELECT *, CASE WHEN abs(bd + ad) > 1e-9 THEN (bd - ad) / (bd + ad) ELSE 0 END AS im, (CASE WHEN ad = 0 THEN 99 ELSE bd / ad END + CASE WHEN av > 0 THEN bv / av WHEN ad = 0 THEN 99 ELSE bd / ad END) / 2 AS rt FROM d)
SELECT book_id, {Q.r('mid', 'mid')}, {Q.r('(asks[1].price - bids[1].price) / mid * 100', 'spread_pct')}, {Q.r('bd', 'bid_depth')}, {Q.r('ad', 'ask_depth')}, {Q.r('im * 100', 'imbalance_pct')}, CASE WHEN im > 0.1 THEN 'bullish' WHEN im < -0.1 THEN 'bearish' ELSE 'neutral' END AS book_signal,
 {Q.r('CASE WHEN abs(im) > 0.3 THEN least(80, 50 + abs(im) * 100) WHEN abs(im) > 0.1 THEN 60 ELSE 50 END', 'book_strength')}, {Q.r('rt', 'book_ratio')}, CASE WHEN rt >= 2 THEN 'bid_heavy' WHEN rt <= 0.5 THEN 'ask_heavy' ELSE 'balanced' END AS book_side FROM i"""
)
def book_depth_imbalance(spark, d):
    rows = K.ratio_signal(K.depth_signal(K.with_snapshot(S.book(spark, d))), F.lit(True))
    return rounded(rows, "book_id", "mid", "spread_pct", "bid_depth", "ask_depth", "imbalance_pct", "book_signal", "book_strength", "book_ratio", "book_side")


@query(
    _BOOK
    + " SELECT book_id, "
    + ", ".join(f"round(coalesce(list_sum(list_transform(list_filter({side}, lambda x: abs(x.price - mid) <= mid * {bps} / 10000), lambda x: x.qty)), 0), 6) + 0 AS {side[:3]}_{bps}bps" for side in ("bids", "asks") for bps in (500, 2500))
    + " FROM m"
)
def book_depth_bps(spark, d):
    """Quantity on either side of the book within 5 and 25 per cent of the middle, in basis points."""
    rows = K.with_snapshot(S.book(spark, d))
    return rounded(rows.select("book_id", *[K.depth_within(side, bps).alias(f"{side[:3]}_{bps}bps") for side in ("bids", "asks") for bps in (500, 2500)]))


_WEIGH = "x.price * x.qty / (1 + abs(x.price - mid) / mid * 10000 / 100)"


@query(
    _BOOK
    + f""", w AS (SELECT *, list_transform(bids[1:50], lambda x: {_WEIGH}) AS wb, list_transform(asks[1:50], lambda x: {_WEIGH}) AS wa FROM m),
e AS (SELECT *, list_sort(list_concat(wb, wa))[floor((len(wb) + len(wa)) / 2)::INT + 1] AS md, least(15, len(wa), len(wb)) AS k FROM w)
SELECT book_id, {Q.r('md', 'median_level')}, {Q.r('asks[list_position(list_transform(wa, lambda x: x >= md * 2), true)].price', 'thick_above')}, {Q.r('bids[list_position(list_transform(wb, lambda x: x >= md * 2), true)].price', 'thick_below')},
 {Q.r('coalesce(list_sum(wa[1:k]) / nullif(list_sum(wb[1:k]), 0), 1)', 'resistance_ratio')}, CASE WHEN list_sum(wa[1:k]) / nullif(list_sum(wb[1:k]), 0) < 0.7 THEN 'up' WHEN list_sum(wa[1:k]) / nullif(list_sum(wb[1:k]), 0) > 1 / 0.7 THEN 'down' ELSE 'balanced' END AS path FROM e"""
)
def liquidity_ladder(spark, d):
    return rounded(K.path(K.with_ladder(K.with_snapshot(S.book(spark, d)))), "book_id", "median_level", "thick_above", "thick_below", "resistance_ratio", "path")


_FUND = """WITH f AS (SELECT event_type AS symbol, ts, event_id AS seq, (value - 100) / 1e5 AS rate FROM events),
h AS (SELECT *, list(rate) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past, rate * 100 AS p FROM f),
q AS (SELECT *, CASE WHEN coalesce(len(past), 0) >= 10 THEN len(list_filter(past, lambda x: x < rate)) / len(past) * 100 WHEN p > 0.1 THEN 95 + least(4, (p - 0.1) * 20) WHEN p > 0.05 THEN 75 + (p - 0.05) / 0.05 * 20 WHEN p > 0.01 THEN 50 + (p - 0.01) / 0.04 * 25 WHEN p > -0.01 THEN 50 WHEN p > -0.05 THEN 25 + (p + 0.05) / 0.06 * 25 WHEN p > -0.1 THEN 5 + (p + 0.1) / 0.05 * 20 ELSE greatest(1, 5 - (-0.1 - p) * 20) END AS pc FROM h),
z AS (SELECT *, CASE WHEN pc >= 95 THEN 'extreme_positive' WHEN pc >= 75 THEN 'high_positive' WHEN pc >= 50 AND p > 0.01 THEN 'normal_positive' WHEN pc <= 5 THEN 'extreme_negative' WHEN pc <= 25 THEN 'high_negative' WHEN pc < 50 AND p < -0.01 THEN 'normal_negative' ELSE 'neutral' END AS zone FROM q)"""


@query(
    _FUND
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('pc', 'funding_percentile')}, zone AS funding_zone, CASE zone WHEN 'extreme_positive' THEN 'heavily_long' WHEN 'high_positive' THEN 'moderately_long' WHEN 'extreme_negative' THEN 'heavily_short' WHEN 'high_negative' THEN 'moderately_short' ELSE 'balanced' END AS crowd,
 CASE WHEN p > 0.1 THEN 'bearish' WHEN p > 0.03 THEN 'neutral' WHEN p < -0.1 THEN 'bullish' ELSE 'neutral' END AS funding_signal, {Q.r('CASE WHEN abs(p) > 0.1 THEN least(80, 50 + abs(p) * 100) WHEN abs(p) > 0.03 THEN 55 ELSE 50 END', 'funding_strength')} FROM z"""
)
def funding_percentile(spark, d):
    signal, strength = C.funding_signal(F.col("funding_rate"))
    rows = C.with_funding_zone(S.funding(spark, d)).withColumns({"funding_signal": signal, "funding_strength": strength})
    return rounded(rows, *KEY, "funding_percentile", "funding_zone", "crowd", "funding_signal", "funding_strength")


@query(
    """WITH oi AS (SELECT o_orderstatus AS symbol, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
t AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)
SELECT CASE t.symbol WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END AS symbol, t.ts::TIMESTAMPTZ AS ts, round(t.volume, 6) + 0 AS volume, round(oi.v, 6) + 0 AS open_interest
FROM t ASOF LEFT JOIN oi ON CASE t.symbol WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END = oi.symbol AND t.ts >= oi.ts"""
)
def asof_price_oi(spark, d):
    """Daily traded volume with the open interest last known that day."""
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    symbol = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("P")
    traded = S.table(spark, d, "lineitem").groupBy(symbol.alias("symbol"), day.alias("ts")).agg(F.sum("l_quantity").alias("volume"))
    return rounded(A.asof(traded, S.open_interest(spark, d).select("symbol", "ts", "open_interest"), "open_interest"), "symbol", "ts", "volume", "open_interest")


_PAIRS = """WITH t AS (SELECT p_brand AS symbol, sum(l_extendedprice) AS qv, max(l_extendedprice / nullif(l_quantity, 0)) AS high, min(l_extendedprice / nullif(l_quantity, 0)) AS low, last(l_extendedprice / nullif(l_quantity, 0) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS last, first(l_extendedprice / nullif(l_quantity, 0) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS first
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT p_brand AS symbol, avg(p_retailprice) AS mid, avg(p_size) AS size, count(*) AS n FROM part GROUP BY ALL),
k AS (SELECT symbol, mid * (1 - size / 1e6) AS bid, mid * (1 + size / 1e6) AS ask, n * 1.0::DOUBLE AS bid_qty, size::DOUBLE AS ask_qty FROM b),
c AS (SELECT *, (ask - bid) / ((ask + bid) / 2) * 100 AS sp FROM t JOIN k USING (symbol) WHERE qv >= (SELECT quantile_cont(qv, 0.7) FROM t WHERE qv > 0)),
s AS (SELECT *, cume_dist() OVER (ORDER BY qv) AS vs, cume_dist() OVER (ORDER BY sp) AS ss, cume_dist() OVER (ORDER BY bid_qty + ask_qty) AS ds, CASE WHEN last > 0 THEN (high - low) / last ELSE 0 END AS rg, abs((last - first) / nullif(first, 0) * 100) AS ch FROM c WHERE sp <= 0.03),
e AS (SELECT *, pow(vs, 0.8) AS pa, greatest(0, least(1, 0.7 * (1 - ss) + 0.3 * ds)) AS li, greatest(0, least(1, CASE WHEN rg BETWEEN 0.02 AND 0.08 THEN 1 - abs(rg - 0.04) / 0.04 * 0.3 WHEN rg < 0.02 THEN rg / 0.02 * 0.5 ELSE 0.7 * exp((0.08 - rg) * 20) END)) AS vo,
  CASE WHEN ch > 10 AND vs < 0.4 THEN 0.3 WHEN ch > 15 THEN 0.5 WHEN ch < 2 THEN 0.85 WHEN ch < 5 THEN 1 ELSE 0.9 - (ch - 5) / 100 END AS cl FROM s)"""


@query(_PAIRS + f" SELECT symbol, {Q.r('0.35 * pa + 0.25 * li + 0.2 * vo + 0.1 * cl + 0.1 * 0.5', 'tradability')}, pa >= 0.6 AND li >= 0.6 AND sp <= 0.03 AS trade_allowed FROM e ORDER BY 0.35 * pa + 0.25 * li + 0.2 * vo + 0.1 * cl DESC, symbol LIMIT 10")
def pair_selection_topk(spark, d):
    """Part brands as instruments, with quotes around their mean price."""
    price = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    parts = S.table(spark, d, "part")
    lines = S.table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    tickers = lines.groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("l_extendedprice").alias("quote_volume"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("last"), F.min_by(price, order).alias("first"))
    tickers = tickers.withColumn("change_pct", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100)
    middle, half = F.col("middle"), F.col("size") / 1e6
    books = parts.groupBy(F.col("p_brand").alias("symbol")).agg(F.avg("p_retailprice").alias("middle"), F.avg("p_size").alias("size"), F.count("*").cast("double").alias("bid_qty"))
    books = books.select("symbol", (middle * (1 - half)).alias("bid"), (middle * (1 + half)).alias("ask"), "bid_qty", F.col("size").alias("ask_qty"))
    symbols = tickers.select("symbol", F.lit("TRADING").alias("status"), F.lit("PERPETUAL").alias("contract_type"), F.lit("USDT").alias("quote_asset"))
    return rounded(P.best(tickers, books, symbols), "symbol", "tradability", "trade_allowed")


@query(
    Q.bars("hour")
    + _PIVOTS
    + f""", v AS (SELECT symbol, ts, sh FROM s WHERE sh IS NOT NULL)
SELECT DISTINCT a.symbol, {Q.r('(a.sh + b.sh) / 2', 'level')}, a.ts::TIMESTAMPTZ AS first_ts, b.ts::TIMESTAMPTZ AS second_ts FROM v a JOIN v b ON a.symbol = b.symbol AND a.ts < b.ts AND abs(b.sh - a.sh) / a.sh * 100 < 0.1"""
)
def liquidity_levels(spark, d):
    return rounded(T.equal_levels(hour(spark, d)), "symbol", "level", "first_ts", "second_ts")


@query(
    Q.bars("hour")
    + _PIVOTS
    + f""", v AS (SELECT symbol, ts, 'high' AS side, sh AS p FROM s WHERE sh > 0 UNION ALL SELECT symbol, ts, 'low', sl FROM s WHERE sl > 0),
l AS (SELECT symbol, side, p, EXISTS (SELECT 1 FROM v b WHERE b.symbol = a.symbol AND b.side = a.side AND b.ts > a.ts AND abs(a.p - b.p) / a.p < 0.1 / 100) AS eq, ts = max(ts) OVER (PARTITION BY symbol, side) AND count(*) OVER (PARTITION BY symbol, side) > 1 AS la FROM v a)
SELECT symbol, side, {Q.r('p', 'level')}, bool_or(eq) AS is_equal, bool_or(la) AS is_latest FROM l WHERE eq OR la GROUP BY symbol, side, p"""
)
def resting_levels(spark, d):
    """Equal highs and lows and the latest of each side, a row for each price."""
    return rounded(T.levels(hour(spark, d)), "symbol", "side", "level", "is_equal", "is_latest")


@query(
    Q.bars("hour")
    + f" SELECT symbol, '4h' AS higher_tf, count(*) AS bars, {Q.r('sum(volume)', 'volume')}, CASE WHEN count(*) < 2 THEN count(*) ELSE greatest(2, least(30, count(*))) END AS history_limit FROM bars GROUP BY symbol"
)
def history_limits(spark, d):
    """Instruments with the interval above theirs and how many bars back an analysis of thirty can look."""
    rows = hour(spark, d).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))
    return rounded(rows.withColumns({"higher_tf": higher_interval(F.col("tf")), "history_limit": history_limit(F.lit(30), F.col("bars"))}), "symbol", "higher_tf", "bars", "volume", "history_limit")


_WALLS = lambda side: f"len(list_filter({side}_before[1:10], lambda x: x.qty >= list_avg(list_transform({side}_before[1:10], lambda z: z.qty)) * 3 AND len(list_filter({side}[1:10], lambda y: abs(y.price - x.price) <= x.price * 0.001 AND y.qty >= x.qty * 0.5)) = 0))"
_BY_TIME = "PARTITION BY month ORDER BY ts, book_id"


@query(
    _BOOK.replace("FROM lineitem)", ", l_shipdate AS shipped FROM lineitem)").replace("SELECT book_id, list(", "SELECT book_id, min(shipped) AS ts, list(", 1)
    + f""", d AS (SELECT *, strftime(ts, '%Y-%m') AS month, {_SUM('bids', 'x.qty')} AS bd, {_SUM('asks', 'x.qty')} AS ad FROM m),
i AS (SELECT *, CASE WHEN abs(bd + ad) > 1e-9 THEN (bd - ad) / (bd + ad) ELSE 0 END AS im FROM d),
c AS (SELECT *, lag(im) OVER ({_BY_TIME}) AS im0, lag(bids) OVER ({_BY_TIME}) AS bids_before, lag(asks) OVER ({_BY_TIME}) AS asks_before, lag(mid) OVER ({_BY_TIME}) AS mid0, lag(bd) OVER ({_BY_TIME}) AS bd0, lag(ad) OVER ({_BY_TIME}) AS ad0 FROM i),
w AS (SELECT *, {_WALLS('bids')}::INT AS bw, {_WALLS('asks')}::INT AS aw, (mid - mid0) / nullif(mid0, 0) * 10000 AS mv FROM c)
SELECT book_id, {Q.r('im - im0', 'imbalance_change')}, {Q.r('bd - bd0', 'bid_depth_change')}, {Q.r('CASE WHEN ad0 > 0 THEN (ad - ad0) / ad0 * 100 END', 'ask_depth_change_pct')}, {Q.r('mv', 'moved_bps')}, bw AS bid_walls, aw AS ask_walls,
 CASE WHEN bw > 0 AND mv >= 2 THEN 'bid_spoof' WHEN aw > 0 AND mv <= -2 THEN 'ask_spoof' ELSE 'none' END AS spoof FROM w"""
)
def spoof_bands(spark, d):
    """Books in order of time as one series for each month."""
    books = K.with_snapshot(S.book(spark, d)).withColumn("symbol", F.date_format("ts", "yyyy-MM"))
    rows = K.spoofs(K.with_changes(books))
    return rounded(rows.select("book_id", "imbalance_change", "bid_depth_change", "ask_depth_change_pct", "moved_bps", F.size("bid_walls").alias("bid_walls"), F.size("ask_walls").alias("ask_walls"), "spoof"))


_CROWD = "zone IN ('extreme_positive', 'high_positive')", "zone IN ('extreme_negative', 'high_negative')"


@query(
    _FUND
    + f""", o AS (SELECT *, (p - lag(p) OVER (PARTITION BY symbol ORDER BY ts, seq)) * 100 AS oi FROM z),
c AS (SELECT *, CASE WHEN {_CROWD[0]} AND oi > 0.3 THEN 'crowded_longs_rising' WHEN {_CROWD[1]} AND oi > 0.3 THEN 'crowded_shorts_rising' WHEN starts_with(zone, 'extreme') AND oi < -0.3 THEN 'capitulation' WHEN starts_with(zone, 'extreme') THEN 'extreme_exhaustion'
  WHEN NOT {_CROWD[0]} AND NOT {_CROWD[1]} AND oi > 0.3 THEN 'healthy_trend' ELSE 'no_edge' END AS combo FROM o)
SELECT symbol, ts::TIMESTAMPTZ AS ts, combo AS funding_combo, CASE combo WHEN 'crowded_longs_rising' THEN CASE WHEN starts_with(zone, 'extreme') THEN 75.0 ELSE 65 END WHEN 'crowded_shorts_rising' THEN CASE WHEN starts_with(zone, 'extreme') THEN 75.0 ELSE 65 END WHEN 'capitulation' THEN 80 WHEN 'extreme_exhaustion' THEN 70 WHEN 'healthy_trend' THEN 60 ELSE 50 END::DOUBLE AS combo_probability FROM c"""
)
def funding_oi_combo(spark, d):
    """With the change of the rate itself, a hundredfold, in the place of open interest."""
    rows = C.with_funding_zone(S.funding(spark, d))
    p = F.col("funding_rate") * 100
    rows = rows.withColumn("oi_pct", (p - F.lag(p).over(Window.partitionBy("symbol").orderBy("ts", "seq"))) * 100)
    name, sure = C.funding_combo(F.col("funding_zone"), F.col("oi_pct"))
    return rows.select(*KEY, name.alias("funding_combo"), sure.alias("combo_probability"))


_unrounded = lambda name: re.sub(r"round\((.*?), 6\) \+ 0 AS", r"(\1) AS", market.ORACLES[name])


@query(
    Q.bars("hour")
    + _BREAK
    + f""", cd AS ({_unrounded('volume_candle_delta')}), ex AS ({_unrounded('volume_exhaustion')}),
rv AS (SELECT symbol, ts, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv FROM bars),
ki AS (SELECT o.*, rv.rv, ex.exhaustion_risk AS risk, cd.delta_pct / 100 AS dr, CASE WHEN up THEN 1 ELSE -1 END AS way FROM o JOIN cd ON cd.symbol = o.symbol AND cd.ts = o.ts::TIMESTAMPTZ JOIN ex ON ex.symbol = o.symbol AND ex.ts = o.ts::TIMESTAMPTZ JOIN rv ON rv.symbol = o.symbol AND rv.ts = o.ts),
ks AS (SELECT *, greatest(-1, least(1, dr / 0.25)) * greatest(0, least(1, (rv - 1) / 1.5)) AS vs FROM ki),
kv AS (SELECT *, dr * way < -0.05 OR vs / 2 * way < -0.3 AS veto, (dr * way > 0.05 AND vs * way > 0.2)::INT + (dr * way > 0.1)::INT AS n FROM ks),
kc AS (SELECT *, CASE WHEN veto THEN 0 ELSE greatest(0, least(100, CASE n WHEN 2 THEN 60 ELSE 35 END + CASE WHEN rv > 2 THEN 10 ELSE 0 END + CASE WHEN abs(dr) > 0.25 THEN 10 ELSE 0 END - CASE WHEN risk IN ('high', 'extreme') THEN 20 ELSE 0 END)) END::DOUBLE AS c FROM kv)
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE WHEN up THEN 'upward' ELSE 'downward' END AS breakout, veto AS vetoed, n AS aligned, CASE WHEN NOT veto AND n = 2 THEN 'mixed' ELSE 'retail' END AS breakout_quality, c AS breakout_confidence,
 CASE WHEN c >= 50 AND up THEN 'enter_long' WHEN c >= 50 THEN 'enter_short' WHEN c < 40 THEN 'avoid' ELSE 'wait' END AS action, {Q.r('CASE WHEN c >= 50 THEN lv * (1 - 0.005 * way) END', 'stop')}, {Q.r('CASE WHEN c >= 50 THEN e * (1 + 0.015 * way) END', 'target')} FROM kc"""
)
def breakout_validation(spark, d):
    bars = V.with_exhaustion(V.with_candle_delta(with_relative_volume(hour(spark, d))))
    known = bars.select("symbol", "tf", "ts", "seq", "rv", "exhaustion_risk", (F.col("delta_pct") / 100).alias("delta_ratio"), C.volume_score(F.col("delta_pct") / 100, F.col("rv")).alias("volume_score"))
    none = F.lit(None).cast("double")
    events = T.breakouts(hour(spark, d)).join(known, ["symbol", "tf", "ts", "seq"]).withColumns({"oi_score": F.col("volume_score") / 2, "oi_pct": none, "book_score": none, "book_imbalance": F.col("delta_ratio")})
    return rounded(T.validated(events), *KEY, "breakout", "vetoed", "aligned", "breakout_quality", "breakout_confidence", "action", "stop", "target")
