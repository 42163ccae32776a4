"""Candle engines and timing rules on small series."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import engines, momentum, score, select, timing
from tidemark.operators import regime as R
from tidemark.operators.scan import scan
from test_kernels import frame, noise, values

INPUTS = "trend_ok boolean, trend_bias int, ribbon_width_rate double, vwap_state string, vwap_position string, roc_fast_norm double, roc_fast_norm_prev double, acc_fast double, atr_exp double, atr_exp_slope double, tr_spike double, chop_value double, chop_state string, rsi_divergence string, structure_pivot_type string, macd_hist_slope double"
NAMES = [x.split()[0] for x in INPUTS.split(", ")]
CONTINUATION = dict(trend_ok=True, trend_bias=1, vwap_state="ACCEPT", vwap_position="ABOVE", roc_fast_norm=0.6, roc_fast_norm_prev=0.4, atr_exp=1.1, atr_exp_slope=0.01, macd_hist_slope=0.1)
EXHAUSTION = dict(trend_ok=True, trend_bias=1, roc_fast_norm=0.9, acc_fast=-0.1, atr_exp=1.7, ribbon_width_rate=-0.2)
SQUEEZE, IGNITION = dict(atr_exp=0.7, chop_state="CHOP"), dict(atr_exp=1.3, roc_fast_norm=-0.9)


def decided(spark, *steps):
    rows = [("x", "1h", i, *[s.get(n) for n in NAMES]) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, f"symbol string, tf string, seq long, {INPUTS}").withColumn("ts", F.timestamp_seconds("seq"))
    return [(r.timing_state, r.timing_direction) for r in timing.timing(df).orderBy("seq").collect()]


def test_continuation_needs_two_bars(spark):
    assert decided(spark, CONTINUATION, CONTINUATION) == [("TRANSITION", 0), ("CONTINUATION_READY", 1)]


def test_exhaustion_goes_first_and_cools_down(spark):
    got = decided(spark, EXHAUSTION, EXHAUSTION, CONTINUATION, CONTINUATION, CONTINUATION)
    assert [s for s, _ in got] == ["TRANSITION", "EXHAUSTION_WARNING", "TRANSITION", "TRANSITION", "CONTINUATION_READY"]


def test_breakout_needs_a_squeeze_before(spark):
    assert [s for s, _ in decided(spark, IGNITION, IGNITION, {})] == ["NO_TRADE"] * 3
    assert decided(spark, SQUEEZE, IGNITION, IGNITION, IGNITION)[1:] == [("NO_TRADE", 0), ("BREAKOUT_WINDOW", -1), ("NO_TRADE", 0)]


def test_ribbon_of_a_trend_is_stacked(spark):
    rising = values(engines.ribbon(frame(spark, [100 * 1.005**i for i in range(120)]), "1h"), "ribbon_direction")
    falling = values(engines.ribbon(frame(spark, [100 * 0.995**i for i in range(120)]), "1h"), "ribbon_direction")
    assert set(rising[-20:]) == {"BULL"} and set(falling[-20:]) == {"BEAR"} and len(rising) == 71
    assert values(engines.ribbon(frame(spark, [100.0] * 80), "1h"), "ribbon_state")[-1] == "CHOP"


def test_momentum_of_a_flat_series_is_noise(spark):
    assert set(values(engines.momentum(frame(spark, [100.0] * 60), "1h"), "momentum_state")) == {"NOISE"}
    rows = engines.entry_filter(engines.momentum(frame(spark, noise(80)), "1h"))
    assert rows.where("allows_long and allows_short").count() == 0


def test_rsi_timing_regimes_and_flat_series(spark):
    assert set(values(scan(frame(spark, [5.0] * 30), [engines.RsiTiming]), "timing_rsi")[14:]) == {50.0}
    rising = values(scan(frame(spark, [float(i) for i in range(30)]), [engines.RsiTiming]), "rsi_regime")
    assert rising[:14] == ["WARMUP"] * 14 and set(rising[14:]) == {"BULLISH"}


def test_failure_swing():
    swing = engines.FailureSwing()
    assert [swing.push(x) for x in (50, 62, 65, 44, 40, 50, 47, 38.5)] == [False] * 7 + [True]


def test_vwap_reclaim_then_acceptance():
    machine = timing.Interaction()
    states = [machine.step(x, abs(x) < 1e-4, 2e-4, 1e-4, True)[0] for x in (-0.01, -0.01, 0.01, 0.01, 0.01)]
    assert states[1] == "ACCEPT" and states[3] == "RECLAIM"


def test_macd_events_are_confirmed_by_rows_in_a_row(spark):
    rng = random.Random(4)
    df = frame(spark, [100 + 10 * rng.random() for _ in range(120)])
    one = engines.macd_events(df, confirm=1)
    assert one.where("macd_event <> shift_candidate and shift_candidate <> 'NONE'").count() == 0 and one.where("macd_event <> 'NONE'").count() > 0
    assert engines.macd_events(df, confirm=1, chop=F.lit(True)).where("macd_event <> 'NONE'").count() == 0


def test_unified_score_of_a_strong_long(spark):
    df = spark.range(1).select(score.volume_score(F.lit(0.3), F.lit(3.0)).alias("volume_score"), score.book_score(F.lit(0.5), *[F.lit(False)] * 4).alias("book_score"), score.oi_score(F.lit(1.5), F.lit(2.0)).alias("oi_score"), F.lit(0.0).alias("funding_score"), F.lit(3.0).alias("rv"))
    row = score.with_unified_score(df).first()
    assert row.bias == "long" and row.total_score == pytest.approx(0.9)


def test_eligibility_and_filters(spark):
    symbols = spark.createDataFrame([("AUSDT", "TRADING", "PERPETUAL", "USDT"), ("XUPUSDT", "TRADING", "PERPETUAL", "USDT"), ("B", "BREAK", "PERPETUAL", "USDT")], "symbol string, status string, contract_type string, quote_asset string")
    assert [r.symbol for r in select.eligible(symbols).collect()] == ["AUSDT"]
    tickers = spark.createDataFrame([(f"S{i}", float(i)) for i in range(1, 11)], "symbol string, quote_volume double")
    books = spark.createDataFrame([("S10", 100.0, 100.01), ("S9", 100.0, 101.0)], "symbol string, bid double, ask double")
    got = {r.symbol: r.filter_result for r in select.with_liquidity(tickers, books).collect()}
    assert got["S10"] == "passed" and got["S9"] == "spread" and got["S8"] == "book" and got["S7"] == "volume"


def test_ema_filter_of_trends(spark):
    up = momentum.ema_filter(frame(spark, [100 * 1.004**i for i in range(90)]), "1h").orderBy(F.desc("ts")).first()
    assert (up.alignment, up.ema_bias, up.ema_regime) == ("STACKED_UP", "BULL", "TREND")


def test_paper_trades(spark):
    from tidemark.operators.precise import PaperTrades

    book = PaperTrades()
    steps = [(100.0, "long", 99.0, 102.0), (100.5, "long", 99.5, None), (99.4, None, None, None), (100.0, "short", 101.0, 98.0), (97.0, None, None, None), (100.0, "long", None, None), (101.0, "short", None, None)]
    got = [book.step(*s) for s in steps]
    assert got[2][:4] == ("long", 100.0, 99.5, "stop_loss") and got[2][4] == pytest.approx(-0.54)
    assert got[4][:4] == ("short", 100.0, 98.0, "take_profit") and got[6][:4] == ("long", 100.0, 101.0, "signal_reversal")


def test_trade_of_each_regime(spark):
    """Ten regimes are traded, exhaustion is faded; null inputs neither confirm nor warn, and without a true range a hundredth of the price stands for it."""
    both = lambda name, long, short: [(f"{name}_LONG", long), (f"{name}_SHORT", short)]
    expected = dict(both("SQUEEZE_SETUP", ("long", "squeeze", "high"), ("short", "squeeze", "high")) + both("TREND_CONTINUATION", ("long", "trend", "medium"), ("short", "trend", "medium")))
    expected |= dict(both("BREAKOUT", ("long", "breakout", "medium"), ("short", "breakout", "medium")) + both("REVERSAL", ("long", "reversal", "high"), ("short", "reversal", "high")) + both("EXHAUSTION", ("short", "reversal", "high"), ("long", "reversal", "high")))
    inputs = [(200.0, 4.0, 1.2, "up", True, False, True, "heavily_long", True, "bid"), (200.0, None, None, None, None, None, None, None, None, None), (200.0, 0.0, 1.1, "down", False, True, False, "balanced", False, None)]
    rows = [(r, *i) for r in [*expected, "NO_TRADE", "COMPRESSION", None] for i in inputs]
    made = R.with_trade(spark.createDataFrame(rows, "regime string, close double, atr double, rv double, path string, allows_long boolean, allows_short boolean, is_climax boolean, crowd string, is_extreme boolean, spoof_side string")).collect()
    assert len(made) == len(rows)
    for r in made:
        if r.regime not in expected:
            assert [r[c] for c in ("direction", "kind", "risk", "entry", "stop_loss", "take_profit", "volume_confirms", "book_confirms", "oi_confirms", "warnings")] == [None] * 10
            continue
        assert (r.direction, r.kind, r.risk) == expected[r.regime]
        side, size = (1 if r.direction == "long" else -1), r.atr or 2.0
        assert (r.entry, r.stop_loss, r.take_profit) == (200.0, 200.0 - side * 1.5 * size, 200.0 + side * 3 * size)
        assert r.volume_confirms == (r.rv is not None and r.rv >= 1.2)
        assert r.book_confirms == (r.path == ("up" if side > 0 else "down"))
        assert r.oi_confirms == bool(r.allows_long if side > 0 else r.allows_short)
        assert r.warnings == ("volume climax; extreme funding: heavily_long; spoof on side bid" if r.is_climax else "")
