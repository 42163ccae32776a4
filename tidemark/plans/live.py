"""Queries on session VWAP, sliding windows, the unified score and regimes, and streams replayed over stored tables."""

from __future__ import annotations

import re
from itertools import pairwise

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import momentum as M
from ..operators import regime as R
from ..operators import score as C
from ..operators import smoothing as S
from ..operators import structure as G
from ..operators import volume as V
from ..operators import vwap as W
from ..operators import windows as N
from ..operators.kernels import with_relative_volume, with_true_range
from ..operators.scan import scan
from ..sources import market as T
from ..sources.storage import shared_dir, stored
from ..streaming import ordered as Z
from ..streaming import state as X
from . import flow, momentum
from . import oracle as Q
from .market import _TR, KEY, hour, rounded
from .momentum import _REC, _RSI

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _vwap(part: str, source: str = "bars") -> str:
    w = f"(PARTITION BY symbol, {part} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f""", t AS (SELECT *, (high + low + close) / 3 AS p, CASE WHEN volume > 0 THEN volume END AS v FROM {source}),
s AS (SELECT *, sum(v) OVER {w} AS sv, sum(p * v) OVER {w} AS pv, sum(p * p * v) OVER {w} AS ppv, count(v) OVER {w} AS n FROM t),
x AS (SELECT *, pv / (sv + 1e-10) AS vwap FROM s), y AS (SELECT *, CASE WHEN n >= 30 AND sqrt(greatest(0, ppv / sv - vwap * vwap)) > 1e-10 THEN sqrt(greatest(0, ppv / sv - vwap * vwap)) END AS sd, (close - vwap) / (vwap + 1e-10) AS a FROM x)"""


_VWAP_OUT = f"symbol, ts::TIMESTAMPTZ AS ts, {Q.r('vwap', 'vwap')}, {Q.r('sd', 'vwap_std')}, {Q.r('a', 'vwap_distance')}, CASE WHEN vwap IS NULL THEN NULL WHEN abs(a) <= 0.0001 THEN 'AT' WHEN a > 0 THEN 'ABOVE' ELSE 'BELOW' END AS vwap_position"
_VWAP_COLUMNS = (*KEY, "vwap", "vwap_std", "vwap_distance", "vwap_position")


@query(Q.bars("hour") + _vwap("ts::DATE") + f" SELECT {_VWAP_OUT} FROM y")
def vwap_session(spark, d):
    return rounded(W.session(hour(spark, d)), *_VWAP_COLUMNS)


@query(Q.bars("hour") + _vwap("isoyear(ts), week(ts)") + f" SELECT {_VWAP_OUT} FROM y")
def vwap_weekly(spark, d):
    return rounded(W.weekly(hour(spark, d)), *_VWAP_COLUMNS)


@query(
    Q.bars("hour")
    + ", an AS (SELECT symbol, last(ts ORDER BY high, ts) AS anchor_at FROM bars GROUP BY symbol), ab AS (SELECT bars.*, anchor_at FROM bars JOIN an USING (symbol) WHERE ts >= anchor_at)"
    + _vwap("anchor_at", "ab")
    + f" SELECT {_VWAP_OUT} FROM y"
)
def vwap_anchored(spark, d):
    """Anchored at each symbol's highest bar."""
    bars = hour(spark, d)
    anchors = bars.groupBy("symbol", "tf").agg(F.max_by("ts", F.struct("high", "ts")).alias("anchor_time")).withColumn("anchor_id", F.lit("high"))
    return rounded(W.anchored(bars, anchors), *_VWAP_COLUMNS)


_EVENTS = flow.ORACLES["trend_hh_hl"]


@query(
    f"WITH te AS ({_EVENTS}), " + Q.bars("hour").removeprefix("WITH ") + """, an AS (SELECT te.symbol, structure_event || '@' || round(close * 100)::BIGINT AS anchor_id, min(bars.ts) AS anchor_time, bool_or(structure_event LIKE 'choch%') AS turn FROM te JOIN bars ON te.symbol = bars.symbol AND te.ts = bars.ts::TIMESTAMPTZ WHERE structure_event <> 'none' GROUP BY ALL),
lf AS (SELECT *, lead(anchor_time, 3) OVER (PARTITION BY symbol ORDER BY anchor_time, anchor_id) AS pruned_at, (SELECT min(b.anchor_time) FROM an b WHERE b.symbol = an.symbol AND b.anchor_time > an.anchor_time AND b.turn) AS turned_at FROM an),
ab AS (SELECT bars.*, anchor_id, anchor_time FROM bars JOIN lf USING (symbol) WHERE bars.ts >= anchor_time AND (pruned_at IS NULL OR bars.ts < pruned_at) AND (turned_at IS NULL OR bars.ts < turned_at))"""
    + _vwap("anchor_id", "ab")
    + f" SELECT anchor_id, {_VWAP_OUT} FROM y"
)
def vwap_structure_anchors(spark, d):
    """Anchored at the last three breaks of structure; a change of character takes out the anchors before it."""
    bars = hour(spark, d)
    anchors = stored(W.structure_anchors(G.with_breaks(G.with_trend(bars))))
    later = Window.partitionBy("symbol", "tf").orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    once = anchors.groupBy("symbol", "tf", "anchor_id").agg(F.min("anchor_time").alias("anchor_time"))
    marks = once.select("symbol", "tf", "anchor_id", F.unix_micros("anchor_time").alias("ts"), F.when(F.col("anchor_id").startswith("choch"), F.unix_micros("anchor_time")).alias("turn"))
    ends = marks.withColumn("end", F.min("turn").over(later)).where("end is not null").select("symbol", "tf", "anchor_id", F.timestamp_micros("end").alias("ts"))
    return rounded(W.lived(bars, anchors, 3, ends), "anchor_id", *_VWAP_COLUMNS)


@query(
    Q.bars("hour")
    + f""", r14 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({Q.W})), abs(low - lag(close) OVER ({Q.W}))) AS tr FROM bars), rs AS (SELECT *, CASE WHEN count(*) OVER {Q.rows(14)} = 14 THEN avg(tr) OVER {Q.rows(14)} END / nullif(close, 0) AS share FROM r14)"""
    + _vwap("ts::DATE", "rs")
    + f""", bd AS (SELECT *, coalesce(sd, CASE WHEN share > 0 THEN 0.5 * share * close END) AS b1, coalesce(2 * sd, CASE WHEN share > 0 THEN share * close END) AS b2 FROM y)
SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('share', 'atr_share')}, {Q.r('vwap - b1', 'band_1_low')}, {Q.r('vwap + b1', 'band_1_high')}, {Q.r('vwap - b2', 'band_2_low')}, {Q.r('vwap + b2', 'band_2_high')}, CASE WHEN sd IS NOT NULL THEN 'STD' WHEN share > 0 THEN 'ATR_FALLBACK' ELSE 'NONE' END AS band_method FROM bd"""
)
def vwap_bands(spark, d):
    """Bands of the session's VWAP: by its deviation, or by the ATR's share of the close where a day has too few bars for one."""
    rows = with_true_range(hour(spark, d)).withColumn("atr_share", F.try_divide(F.col("atr_sma"), F.col("close")))
    return rounded(W.with_bands(W.session(rows), "atr_share"), *KEY, "atr_share", "band_1_low", "band_1_high", "band_2_low", "band_2_high", "band_method")


def _events_as_trades(spark, d):
    return T.event_ticks(spark, d).select("symbol", "ts", "seq", F.col("seq").alias("trade_id"), "price", F.lit(1.0).alias("quantity"), (F.col("seq") % 2 == 0).alias("is_buyer_maker"))


def _slide(s: int) -> str:
    w = f"(PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW)"
    b, q = f"sum((event_id % 2 <> 0)::INT) OVER {w}", f"count(*) OVER {w}"
    return f"{Q.r(f'{b}::DOUBLE', f'buy_{s}')}, {Q.r(f'(2.0 * {b} - {q}) / {q}', f'delta_ratio_{s}')}, {Q.r(f'sum(value) OVER {w} / {q}', f'vwap_{s}')}, {q} AS count_{s}"


@query(f"SELECT event_type AS symbol, ts::TIMESTAMPTZ AS ts, event_id AS seq, {_slide(900)}, {_slide(3600)} FROM events")
def sliding_windows(spark, d):
    rows = N.sliding(_events_as_trades(spark, d), (900, 3600))
    return rounded(rows, "symbol", "ts", "seq", *[f"{c}_{s}" for s in (900, 3600) for c in ("buy", "delta_ratio", "vwap", "count")])


@query("SELECT event_type AS symbol, ts::TIMESTAMPTZ AS ts, event_id AS trade_id, round(sum(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE, 6) + 0 AS cvd FROM events")
def cvd(spark, d):
    """Each event twice: the second is passed over."""
    rows = _events_as_trades(spark, d)
    return rounded(N.once(rows.union(rows.withColumn("seq", F.col("seq") + 1_000_000_000))), "symbol", "ts", "trade_id", "cvd")


def _state(spark, d):
    """Hourly market state from bars: flow, volume, price against the average, and the scores."""
    bars = V.with_candle_delta(V.with_acceleration(with_relative_volume(hour(spark, d))))
    bars = bars.withColumns({"delta_ratio": F.col("delta_pct") / 100, "volume_score": C.volume_score(F.col("delta_pct") / 100, F.col("rv"))})
    return C.with_unified_score(bars.withColumns({"book_score": F.lit(None).cast("double"), "oi_score": F.col("volume_score") / 2, "funding_score": F.lit(0.1)}))


_SCORE = (
    Q.bars("hour")
    + f""", a AS (SELECT *, CASE WHEN high - low > 0 THEN volume * (2 * (close - low) / (high - low) - 1) ELSE 0 END AS cd, CASE WHEN count(*) OVER {Q.rows(20)} = 20 AND avg(volume) OVER {Q.rows(20)} > 0 THEN volume / avg(volume) OVER {Q.rows(20)} ELSE 1 END AS rv FROM bars),
b AS (SELECT *, CASE WHEN abs(sum(volume) OVER {Q.rows(5)}) > 1e-9 THEN sum(cd) OVER {Q.rows(5)} / sum(volume) OVER {Q.rows(5)} ELSE 0 END AS dr FROM a),
c AS (SELECT *, greatest(-1, least(1, dr / 0.25)) * greatest(0, least(1, (rv - 1) / 1.5)) AS vs, CASE WHEN rv < 1 THEN greatest(0.3, least(1, 0.3 + 0.7 * rv)) ELSE 1 END AS k FROM b),
e AS (SELECT *, (0.35 * vs + k * (0.25 * vs / 2 + 0.10 * 0.1)) / (0.35 + k * 0.65) AS t0 FROM c),
g AS (SELECT *, CASE WHEN rv < 0.3 THEN greatest(-0.2475, least(0.2475, t0)) ELSE t0 END AS t FROM e)"""
)


@query(
    _SCORE
    + f""" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('vs', 'volume_score')}, {Q.r('t', 'total_score')}, {Q.r('least(100, 100 * abs(t) / 0.85)', 'confidence')}, CASE WHEN abs(t) < 0.25 THEN 'neutral' WHEN t > 0 THEN 'long' ELSE 'short' END AS bias, CASE WHEN abs(t) >= 0.75 THEN 'strong' WHEN abs(t) >= 0.55 THEN 'moderate' ELSE 'weak' END AS score_strength,
 CASE WHEN rv < 0.7 AND abs(t) > 0.25 THEN 'low_volume' END AS score_warning FROM g"""
)
def unified_score(spark, d):
    return rounded(_state(spark, d), *KEY, "volume_score", "total_score", "confidence", "bias", "score_strength", "score_warning")


_unrounded = lambda name: re.sub(r"round\((.*?), 6\) \+ 0 AS", r"(\1) AS", momentum.ORACLES[name])


@query(
    f"""WITH ma AS ({_unrounded('moving_averages')}), rs AS ({_unrounded('rsi_14')}), mc AS ({_unrounded('macd_histogram_signal')}), sk AS ({_unrounded('stoch_rsi_signal')}), su AS ({_unrounded('supertrend_10_3')}),
v AS (SELECT symbol, ts, ma_signal AS s, ma_strength AS x FROM ma UNION ALL SELECT symbol, ts, rsi_signal, rsi_strength FROM rs UNION ALL SELECT symbol, ts, coalesce(macd_bias, 'neutral'), coalesce(macd_strength, 50) FROM ma LEFT JOIN mc USING (symbol, ts)
  UNION ALL SELECT symbol, ts, stoch_signal, stoch_strength FROM sk UNION ALL SELECT symbol, ts, supertrend_signal, supertrend_strength FROM su),
b AS (SELECT symbol, ts, count(*) FILTER (s = 'bullish') AS bullish, count(*) FILTER (s = 'bearish') AS bearish, count(*) FILTER (s = 'neutral') AS neutral, avg(x) AS m, avg(x * CASE s WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END) AS b FROM v GROUP BY ALL)
SELECT symbol, ts, bullish, bearish, neutral, {Q.r('m', 'mean_strength')}, {Q.r('b', 'balance')}, CASE WHEN b > 20 THEN 'strong_bullish' WHEN b > 5 THEN 'bullish' WHEN b < -20 THEN 'strong_bearish' WHEN b < -5 THEN 'bearish' ELSE 'neutral' END AS vote FROM b"""
)
def summary_vote(spark, d):
    """All oscillators' votes by symbol and hour, from one scan."""
    rows = M.scanned(hour(spark, d))
    for f in (M.moving_average_signal, M.rsi_signal, M.macd_signal, M.stoch_rsi_signal, M.supertrend_signal):
        rows = f(rows)
    votes = F.array(*[F.struct(F.col(s).alias("signal"), F.col(x).alias("strength")) for s, x in (("ma_signal", "ma_strength"), ("rsi_signal", "rsi_strength"), ("macd_bias", "macd_strength"), ("stoch_signal", "stoch_strength"), ("supertrend_signal", "supertrend_strength"))])
    return rounded(C.summary_vote(rows.select("symbol", "ts", F.inline(votes))))


# Bars are an hour apart, so neither the cooldown nor the time in a regime holds a change back: a regime is in force from its third call in a row on, a risk-off one at once.
_WANTED = (
    _SCORE
    + f""", h AS (SELECT *, least(100, 100 * abs(t) / 0.85) AS sure, row_number() OVER ({Q.W}) >= 3 AND CASE WHEN abs(avg(volume) OVER {Q.rows(10)}) > 1e-9 THEN volume / avg(volume) OVER {Q.rows(10)} ELSE 1 END >= 3 AS climax,
 sum(cd) OVER {Q.rows(5)} AS rd, close - first(close) OVER {Q.rows(5)} AS move FROM g),
k AS (SELECT *, CASE WHEN rv < 0.5 THEN 'LOW_VOLUME' WHEN sure < 0.5 THEN 'NO_TRADE' WHEN climax AND dr > 0.1 THEN 'EXHAUSTION_LONG' WHEN climax AND dr < -0.1 THEN 'EXHAUSTION_SHORT'
 WHEN move < 0 AND rd > 0 THEN 'ACCUMULATION' WHEN move > 0 AND rd < 0 THEN 'DISTRIBUTION' ELSE 'NO_TRADE' END AS wanted FROM h)"""
)


def _called(spark, d):
    """The market state with the regime that each hour calls for."""
    rows = _state(spark, d).withColumns(
        {
            "volume_side": F.when(F.col("delta_ratio") > 0.1, "bullish").when(F.col("delta_ratio") < -0.1, "bearish").otherwise("neutral"),
            "is_climax": F.col("accel_state") == "climax",
            "oi_direction": F.lit(None).cast("string"),
            "crowd": F.lit("balanced"),
            "path": F.lit(None).cast("string"),
            "divergence_side": F.when(F.col("delta_divergence"), F.when(F.col("recent_delta") > 0, "bullish").otherwise("bearish")),
        }
    )
    return rows.withColumn("candidate", R.candidate(min_confidence=1.0))


@query(
    _WANTED
    + f""", l AS (SELECT *, lag(wanted) OVER ({Q.W}) AS before FROM k), m AS (SELECT *, sum(CASE WHEN wanted = before THEN 0 ELSE 1 END) OVER ({Q.W}) AS run FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS calls FROM m),
o AS (SELECT *, coalesce(last_value(CASE WHEN wanted IN ('NO_TRADE', 'LOW_VOLUME', 'CHOPPY') OR calls >= 3 THEN wanted END IGNORE NULLS) OVER ({Q.W}), 'NO_TRADE') AS regime FROM n)
SELECT symbol, ts::TIMESTAMPTZ AS ts, wanted AS candidate, regime, regime <> coalesce(lag(regime) OVER ({Q.W}), 'NO_TRADE') AS changed FROM o"""
)
def regime_machine(spark, d):
    rows = _called(spark, d).withColumn("ms", F.unix_millis("ts"))
    return scan(rows.select(*KEY, "tf", "seq", "ms", "candidate"), [R.Transitions]).select(*KEY, "candidate", "regime", "changed")


@query(
    _WANTED
    + f""", u AS (SELECT *, {_TR} AS tr FROM k),
v AS (SELECT *, coalesce(nullif(CASE WHEN count(tr) OVER {Q.rows(14)} = 14 THEN avg(tr) OVER {Q.rows(14)} END, 0), close * 0.01) AS atr, CASE wanted WHEN 'EXHAUSTION_LONG' THEN -1 WHEN 'EXHAUSTION_SHORT' THEN 1 END AS side FROM u)
SELECT symbol, ts::TIMESTAMPTZ AS ts, wanted AS candidate, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, 'reversal' AS kind, 'high' AS risk, {Q.r('close', 'entry')}, {Q.r('close - side * 1.5 * atr', 'stop_loss')}, {Q.r('close + side * 3 * atr', 'take_profit')},
 rv >= 1.2 AS volume_confirms, false AS book_confirms, false AS oi_confirms, 'volume climax' AS warnings FROM v WHERE side IS NOT NULL"""
)
def trade_plan(spark, d):
    """The trade that each hour's candidate calls for."""
    rows = with_true_range(_called(spark, d)).withColumns({"regime": F.col("candidate"), "atr": F.col("atr_sma"), **{c: F.lit(None).cast("boolean") for c in ("allows_long", "allows_short", "is_extreme")}, "spoof_side": F.lit(None).cast("string")})
    planned = R.with_trade(rows).where("direction is not null")
    return rounded(planned, *KEY, "candidate", "direction", "kind", "risk", "entry", "stop_loss", "take_profit", "volume_confirms", "book_confirms", "oi_confirms", "warnings")


#: Counted rows of a piece of a replay.
PIECE = 200_000


def replayed(spark, rows, plan, close_ms: int | None = None, counted: Column | None = None):
    """Run a streaming plan over a stored table to its end; the sink is a table in the shared folder. ``close_ms``: a closing row so long after the last lets the watermark pass all others. ``counted``: the stream gets the rows in order of time, in pieces of about ``PIECE`` rows for which this holds, so that its state is that of a piece and of the watermark's delay."""
    folder = shared_dir(spark)
    source = f"{folder}/in"
    rows.write.parquet(source)
    whole = spark.read.schema(rows.schema).parquet(source)
    cuts = _cuts(whole, counted) if counted is not None else []
    if cuts:
        source = f"{folder}/pieces"
        ranged = stored(whole.repartitionByRange("ts"))

    def run():
        stream = plan(spark.readStream.schema(rows.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return stream.schema

    for begin, end in pairwise([None, *cuts, None]) if cuts else ():
        piece = F.lit(True) if begin is None else F.col("ts") >= F.timestamp_micros(F.lit(begin))
        ranged.where(piece if end is None else piece & (F.col("ts") < F.timestamp_micros(F.lit(end)))).write.mode("append").parquet(source)
        run()
    if close_ms is not None:
        Z.closing_row(whole, close_ms).write.mode("append").parquet(source)
    return spark.read.schema(run()).parquet(f"{folder}/out")


def _cuts(rows, counted) -> list[int]:
    """The times (in microseconds) at which pieces begin, but for the first."""
    rows = rows.where(counted)
    n = -(-rows.count() // PIECE)
    if n < 2:
        return []
    return sorted(set(rows.agg(F.percentile_approx(F.unix_micros("ts"), [i / n for i in range(1, n)])).first()[0]))


@query(_REC("hour") + _RSI + f" SELECT symbol, ts::TIMESTAMPTZ AS ts, {Q.r('rsi', 'rsi')} FROM rsi")
def rsi_stream(spark, d):
    """The RSI kernel in a stream over hourly bars, in whatever order their files are read."""
    bars = hour(spark, d)
    return rounded(replayed(spark, bars, lambda s: Z.in_order(s, S.Rsi, "1 day", ("symbol", "tf"), ("ts", "seq")), 172_800_000, F.lit(True)), *KEY, "rsi")


@query("SELECT event_type AS symbol, ts::TIMESTAMPTZ AS ts, event_id AS trade_id FROM events")
def stream_dedupe(spark, d):
    """Each event twice; the second is passed over."""
    rows = _events_as_trades(spark, d)
    return replayed(spark, rows.union(rows), X.deduplicated).select("symbol", "ts", "trade_id")


@query(
    """WITH w AS (SELECT event_type AS symbol, event_id % 2 = 0 AS sold, date_trunc('hour', ts) + to_hours(unnest(range(1, 7))) AS e FROM events)
SELECT symbol, e::TIMESTAMPTZ AS ts, sum(CASE WHEN sold THEN -1 ELSE 1 END)::DOUBLE AS delta, count(*)::DOUBLE AS volume, count(*) AS trades FROM w GROUP BY ALL"""
)
def stream_sliding_delta(spark, d):
    """Signed volume of six hours, every hour; the last windows are closed by a row beyond them."""
    rows = replayed(spark, _events_as_trades(spark, d), lambda s: X.sliding_delta(s, "6 hours", "1 hour", "1 hour"), 8 * 3_600_000)
    return rows.where(F.col("symbol") != Z.CLOSING)


@query(Q.TRADES + ", k AS (SELECT symbol, ts, price, quantity, trade_id FROM trades), s AS (SELECT symbol, min(epoch_ms(ts)) AS a, max(epoch_ms(ts)) AS b FROM k GROUP BY symbol), p AS (SELECT k.*, floor((epoch_ms(ts) - a) / ((b - a) / 20.0))::BIGINT AS bar FROM k JOIN s USING (symbol)) SELECT symbol, bar, round(first(price ORDER BY ts, trade_id), 6) + 0 AS open, round(max(price), 6) + 0 AS high, round(min(price), 6) + 0 AS low, round(last(price ORDER BY ts, trade_id), 6) + 0 AS close, round(sum(quantity), 6) + 0 AS volume FROM p WHERE bar < 20 GROUP BY ALL")
def carried_bars(spark, d):
    return rounded(B.carried_bars(T.trades(spark, d)))
