"""Queries on what books, volume, funding and rates of change tell together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import last_rows
from ..operators import asof as A
from ..operators import bars as B
from ..operators import book as K
from ..operators import engines as N
from ..operators import precise as P
from ..operators import score as C
from ..operators import structure as T
from ..operators import verdict as X
from ..operators import volume as V
from ..sources import market as S
from . import engines, flow, market, precise
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


def _within(sql: str, final: str = "SELECT symbol, ts::TIMESTAMPTZ") -> str:
    """The CTEs of another query's SQL."""
    return sql.rpartition(final)[0].rstrip()


_SOLD = lambda own, now, gone: f"list_transform(coalesce(prev, []), lambda p: len(list_filter(p.{own}, lambda x: x.qty >= 3 * usual AND len(list_filter({now}[1:10], lambda y: abs(y.price - x.price) < x.price * 0.001 AND y.qty >= x.qty * 0.5)) = 0 AND {gone})))"
_BOOKS = "PARTITION BY month ORDER BY ts, book_id"


@query(
    _within(flow.ORACLES["spoof_bands"], "SELECT book_id").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", v AS (SELECT *, {flow._SUM('bids', 'x.price * x.qty')} AS bv, {flow._SUM('asks', 'x.price * x.qty')} AS av, {flow._SUM('bids', 'x.qty', 20)} + {flow._SUM('asks', 'x.qty', 20)} AS vol, list_transform(bids[1:50], lambda x: {flow._WEIGH}) AS wb, list_transform(asks[1:50], lambda x: {flow._WEIGH}) AS wa,
  list_avg(list_transform(list_concat(bids[1:20], asks[1:20]), lambda x: x.qty)) AS usual, list({{'b': bids[1:10], 'a': asks[1:10], 'm': mid}}) OVER ({_BOOKS} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER ({_BOOKS}) AS i FROM w),
z AS (SELECT *, coalesce(list_sum(wa[1:least(15, len(wa), len(wb))]) / nullif(list_sum(wb[1:least(15, len(wa), len(wb))]), 0), 1) AS rr, vol / nullif(avg(vol) OVER ({_BOOKS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS vr, coalesce(mv / 100, 0) AS pc, (CASE WHEN ad = 0 THEN 99 ELSE bd / ad END + CASE WHEN av > 0 THEN bv / av WHEN ad = 0 THEN 99 ELSE bd / ad END) / 2 AS rt, CASE WHEN ad > 0 THEN bd / ad ELSE 1 END AS dr,
  {_SOLD('b', 'bids', 'p.m < x.price * 1.01 AND (p.m - mid) / p.m * 10000 > 2')} AS pb, {_SOLD('a', 'asks', 'p.m > x.price * 0.99 AND (mid - p.m) / p.m * 10000 > 2')} AS pa FROM v),
pm AS (SELECT month, i, CASE WHEN rr < 0.7 THEN 'up' WHEN rr > 1 / 0.7 THEN 'down' ELSE 'unclear' END AS path FROM z WHERE i = 1 UNION ALL
  SELECT z.month, z.i, CASE WHEN rr < CASE WHEN p.path = 'down' THEN 0.595 ELSE 0.7 END THEN 'up' WHEN rr > CASE WHEN p.path = 'up' THEN 1 / 0.7 / 0.85 ELSE 1 / 0.7 END THEN 'down' ELSE 'unclear' END FROM pm p JOIN z ON z.month = p.month AND z.i = p.i + 1),
y AS (SELECT z.*, pm.path, coalesce(list_sum(pb), 0)::INT + coalesce(list_sum(pa), 0)::INT AS pulls, coalesce(list_max(list_filter(range(1, len(pb) + 1), lambda j: pb[j] > 0)), 0) AS lb, coalesce(list_max(list_filter(range(1, len(pa) + 1), lambda j: pa[j] > 0)), 0) AS la, coalesce(vr, 1) AS q FROM z JOIN pm USING (month, i)),
x AS (SELECT *, CASE WHEN q > 0 THEN abs(pc) / q ELSE 1 END AS eff, coalesce(vr > 1.2, false) AS vok, CASE WHEN rt >= 2 THEN 'bid_heavy' WHEN rt <= 0.5 THEN 'ask_heavy' ELSE 'balanced' END AS side, coalesce(len(prev), 0) >= 3 AS known, CASE WHEN rt >= 3 THEN least(85, 50 + (rt - 1) * 10) WHEN rt >= 2 THEN 60 + (rt - 2) * 10 WHEN rt <= 1 / 3.0 THEN least(85, 50 + (1 / rt - 1) * 10) WHEN rt <= 0.5 THEN 60 + (1 / rt - 2) * 10 ELSE 40 END AS rs FROM y),
u AS (SELECT *, CASE WHEN q > 1.5 AND abs(pc) < 0.3 AND eff < 0.3 THEN CASE WHEN dr > 1.5 AND pc <= 0 THEN 'bid' WHEN dr < 0.67 AND pc >= 0 THEN 'ask' ELSE 'none' END ELSE 'none' END AS ab, CASE WHEN NOT known OR pulls < 2 THEN 'none' WHEN la >= lb THEN 'ask_spoof' ELSE 'bid_spoof' END AS sp, side <> 'balanced' AND NOT vok AS bait FROM x),
n AS (SELECT *, least(90, 50 + (CASE WHEN ab = 'bid' THEN dr ELSE 1 / nullif(dr, 0) END - 1) * 20 + (1 - eff) * 30) AS abs_, CASE WHEN sp <> 'none' THEN 65 ELSE 0 END AS sc FROM u),
o AS (SELECT *, CASE WHEN ab = 'bid' THEN abs_ ELSE 0 END + CASE WHEN side = 'bid_heavy' AND vok THEN rs ELSE 0 END + CASE WHEN sp = 'ask_spoof' THEN sc ELSE 0 END + CASE WHEN path = 'up' THEN 55 ELSE 0 END AS up, CASE WHEN ab = 'ask' THEN abs_ ELSE 0 END + CASE WHEN side = 'ask_heavy' AND vok THEN rs ELSE 0 END + CASE WHEN sp = 'bid_spoof' THEN sc ELSE 0 END + CASE WHEN path = 'down' THEN 55 ELSE 0 END AS dn,
  (ab = 'bid')::INT + (side = 'bid_heavy' AND vok)::INT + (sp = 'ask_spoof')::INT + (path = 'up')::INT AS nu, (ab = 'ask')::INT + (side = 'ask_heavy' AND vok)::INT + (sp = 'bid_spoof')::INT + (path = 'down')::INT AS nd FROM n),
r AS (SELECT *, CASE WHEN bait AND sp <> 'none' THEN 'trap' WHEN up > dn * 1.3 THEN 'bullish' WHEN dn > up * 1.3 THEN 'bearish' ELSE 'neutral' END AS vd FROM o)
SELECT book_id, path, sp AS spoof, CASE WHEN known THEN pulls ELSE 0 END AS times_pulled, ab AS absorbed, bait AS book_bait, vd AS book_verdict, {Q.r("CASE WHEN vd = 'trap' THEN greatest(60, sc) WHEN nu + nd = 0 THEN 40 WHEN vd = 'bullish' THEN least(85, up / nu) WHEN vd = 'bearish' THEN least(85, dn / nd) ELSE 50 END::DOUBLE", 'book_confidence')},
 CASE WHEN path <> 'unclear' THEN path WHEN vd = 'bullish' THEN 'up_by_flow' WHEN vd = 'bearish' THEN 'down_by_flow' ELSE 'unclear' END AS forced_way FROM r"""
)
def book_verdict(spark, d):
    """Books in order of time as one series for each month; a book's quantities stand for the volume traded at it."""
    w = Window.partitionBy("symbol").orderBy("ts", "book_id")
    rows = K.with_snapshot(S.book(spark, d)).withColumn("symbol", F.date_format("ts", "yyyy-MM")).withColumn("volume", F.col("bid_depth_20") + F.col("ask_depth_20"))
    before = F.lag("mid").over(w)
    rows = rows.withColumns({"volume_ratio": F.try_divide(F.col("volume"), F.avg("volume").over(w.rowsBetween(-20, -1))), "price_pct": F.try_divide(F.col("mid") - before, before) * 100})
    side, strength = K.absorption(F.col("volume_ratio"), F.col("price_pct"))
    rows = K.with_path_memory(K.with_ladder(K.pulled_walls(rows))).withColumns({"absorbed": side, "absorbed_strength": strength})
    rows = K.vote(K.ratio_signal(rows, F.coalesce(F.col("volume_ratio") > 1.2, F.lit(False))))
    return rounded(rows, "book_id", "path", "spoof", "times_pulled", "absorbed", "book_bait", "book_verdict", "book_confidence", "forced_way")


@query(
    f"""WITH d AS ({_within(market.ORACLES['volume_candle_delta'])} SELECT symbol, ts, dp, rd, dpct, abs(dpct) AS sz, (dp > 0 AND rd < 0) OR (dp < 0 AND rd > 0) AS dv FROM c),
x AS ({_within(market.ORACLES['volume_exhaustion'])} SELECT symbol, ts, CASE WHEN n < 6 THEN 'low' WHEN k >= 4 OR (k >= 3 AND spike) THEN 'extreme' WHEN k >= 3 OR (k >= 2 AND spike) THEN 'high' WHEN k >= 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN n >= 6 THEN least(95, 30 + 20 * f1::INT + 15 * f2::INT + 20 * f3::INT) ELSE 30 END AS ec FROM e),
m AS ({_within(precise.ORACLES['volume_mtf_agreement'])} SELECT symbol, ts, st, CASE st WHEN 'confirmed' THEN least(90, 60 + (l + hi - 2) * 10) WHEN 'stop_run' THEN least(85, 55 + abs(l - hi) * 10) WHEN 'reaccumulation' THEN 65 ELSE 40 END AS mc FROM k),
j AS (SELECT *, CASE WHEN dpct > 10 THEN 1 WHEN dpct < -10 THEN -1 ELSE 0 END AS b, CASE WHEN sz > 30 THEN least(95, 70 + (sz - 30) * 0.5) WHEN sz > 10 THEN 55 + (sz - 10) * 0.75 ELSE 40 + sz * 1.5 END AS ds FROM d JOIN x USING (symbol, ts) LEFT JOIN m USING (symbol, ts))
SELECT symbol, ts::TIMESTAMPTZ AS ts, CASE b WHEN 1 THEN 'buyers' WHEN -1 THEN 'sellers' ELSE 'unclear' END AS began_by, CASE WHEN dv AND dp > 0 THEN 'asks' WHEN dv THEN 'bids' ELSE 'none' END AS absorbed_by,
 CASE WHEN st = 'stop_run' AND dp > 0 THEN 'shorts' WHEN st = 'stop_run' THEN 'longs' WHEN risk IN ('high', 'extreme') AND b = 1 THEN 'late_longs' WHEN risk IN ('high', 'extreme') AND b = -1 THEN 'late_shorts' ELSE 'none' END AS trapped,
 CASE WHEN st IN ('confirmed', 'reaccumulation') AND ds > 70 THEN 'institutional' WHEN st = 'stop_run' THEN 'retail' ELSE 'mixed' END AS volume_quality, {Q.r('CASE WHEN mc IS NULL THEN (ds + ec) / 2 ELSE ((ds + ec) / 2 + mc) / 2 END', 'volume_confidence')},
 CASE WHEN risk = 'extreme' THEN 'caution' WHEN dv AND rd > 0 THEN 'bullish' WHEN dv THEN 'bearish' WHEN b <> 0 AND risk = 'high' THEN 'neutral' WHEN b = 1 THEN 'bullish' WHEN b = -1 THEN 'bearish' ELSE 'neutral' END AS volume_verdict FROM j"""
)
def volume_verdict(spark, d):
    """Hourly bars, with the day as the higher interval."""
    low = V.with_exhaustion(V.with_candle_delta(hour(spark, d))).withColumns({"price_change": F.col("close") - F.first("close").over(last_rows(5)), "ltf_ratio": P.recent_ratio("volume")})
    high = B.ohlcv(S.event_ticks(spark, d), "1d").withColumn("htf_ratio", P.recent_ratio("volume"))
    rows = P.volume_agreement(A.asof(low, high.select("symbol", "ts", "htf_ratio"), "htf_ratio"))
    return rounded(X.with_volume_verdict(rows), *KEY, "began_by", "absorbed_by", "trapped", "volume_quality", "volume_confidence", "volume_verdict")


@query(
    _within(flow.ORACLES["funding_oi_combo"])
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, NOT (starts_with(zone, 'extreme') OR starts_with(zone, 'high')) AS may_chase, CASE WHEN combo = 'crowded_longs_rising' THEN 'bearish' WHEN combo = 'crowded_shorts_rising' THEN 'bullish' WHEN combo = 'capitulation' OR starts_with(zone, 'extreme') THEN 'warning' ELSE 'neutral' END AS funding_verdict,
 least(90, 50 + CASE WHEN starts_with(zone, 'extreme') THEN 20 WHEN starts_with(zone, 'high') THEN 10 ELSE 0 END + CASE WHEN combo IN ('crowded_longs_rising', 'crowded_shorts_rising', 'capitulation', 'extreme_exhaustion') THEN 10 ELSE 0 END)::DOUBLE AS funding_confidence FROM c"""
)
def funding_verdict(spark, d):
    """With the change of the rate itself, a hundredfold, in the place of open interest."""
    rows = C.with_funding_zone(S.funding(spark, d))
    p = F.col("funding_rate") * 100
    rows = rows.withColumn("oi_pct", (p - F.lag(p).over(Window.partitionBy("symbol").orderBy("ts", "seq"))) * 100)
    chase, verdict, sure = X.funding_verdict(F.col("funding_zone"), *C.funding_combo(F.col("funding_zone"), F.col("oi_pct")))
    return rows.select(*KEY, chase.alias("may_chase"), verdict.alias("funding_verdict"), sure.alias("funding_confidence"))


@query(
    _within(engines.ORACLES["roc_momentum"])
    + flow._PIVOTS
    + f""", q AS (SELECT e.symbol, e.ts, e.close, e.f, lag(s.sh, 5) OVER w AS h, lag(s.sl, 5) OVER w AS l, lag(e.f, 5) OVER w AS fr FROM e JOIN s USING (symbol, ts) WINDOW w AS (PARTITION BY e.symbol ORDER BY e.ts)),
u AS (SELECT *, last_value(CASE WHEN h IS NOT NULL THEN {{'p': h, 'r': fr}} END IGNORE NULLS) OVER ({Q.W} ROWS UNBOUNDED PRECEDING) AS hs, last_value(CASE WHEN l IS NOT NULL THEN {{'p': l, 'r': fr}} END IGNORE NULLS) OVER ({Q.W} ROWS UNBOUNDED PRECEDING) AS ls FROM q)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('f', 'roc_fast_norm')}, CASE WHEN close < ls.p AND f > ls.r THEN 'BULLISH' WHEN close > hs.p AND f < hs.r THEN 'BEARISH' ELSE 'NONE' END AS roc_divergence FROM u"""
)
def roc_divergence(spark, d):
    return rounded(N.with_divergence(N.momentum(T.with_pivots(hour(spark, d)), "1h")), *KEY, "roc_fast_norm", "roc_divergence")
