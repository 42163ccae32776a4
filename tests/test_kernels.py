"""Kernels and operators against closed forms and step-by-step versions."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions.scalars import INTERVAL_MS, clip, interval_ms, normalized_symbol, place, safe_divide
from tidemark.operators import asof, bars, kernels, regime, smoothing, structure, vwap, windows
from tidemark.operators.scan import scan
from tidemark.plans.market import rounded
from tidemark.streaming.state import stream_scan


def frame(spark, closes, symbol="x", volume=1000.0, spread=1.0):
    rows = [(symbol, "1h", i, i, c - 0.1, c + spread, c - spread, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, tf string, s long, seq long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("s") * 3600))


def values(df, column):
    return [r[column] for r in df.orderBy("symbol", "ts").collect()]


def noise(n, seed=42):
    rng = random.Random(seed)
    return [100 + 0.3 * i + rng.uniform(-0.5, 0.5) for i in range(n)]


def test_sma_and_ema_of_a_rising_series(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert values(df.withColumn("m", kernels.sma(F.col("close"), 3)), "m") == [None, None, 2, 3, 4]
    assert values(scan(df, [smoothing.ema(3)]), "ema_3") == [None, None, 2, 3, 4]


def test_vwap_of_closed_form_and_without_volume(spark):
    rows = [("x", "1h", i, float(p), float(v)) for i, (p, v) in enumerate([(100, 100), (110, 200), (105, 150)])]
    df = spark.createDataFrame(rows, "symbol string, tf string, seq long, close double, volume double").selectExpr("*", "close as high", "close as low", "timestamp_seconds(seq) as ts")
    assert values(kernels.with_vwap(df), "vwap")[-1] == pytest.approx(47750 / 450)
    some = df.withColumn("volume", F.when(F.col("seq") == 1, 0.0).when(F.col("seq") == 2, 50.0).otherwise(F.col("volume")))
    assert values(vwap.session(some), "vwap")[-1] == pytest.approx(15250 / 150)


def test_true_range_sees_gaps(spark):
    rows = [("x", "1h", 0, 110.0, 90.0, 105.0), ("x", "1h", 1, 85.0, 75.0, 82.0)]
    df = spark.createDataFrame(rows, "symbol string, tf string, seq long, high double, low double, close double").withColumn("ts", F.timestamp_seconds("seq"))
    assert values(kernels.with_true_range(df), "tr") == [20, 30]


def test_rsi_is_hundred_without_losses_and_null_at_first(spark):
    got = values(scan(frame(spark, [float(i) for i in range(1, 61)]), [smoothing.Rsi]), "rsi")
    assert got[:15] == [None] * 15 and set(got[15:]) == {100.0}


def test_series_are_independent_and_batches_do_not_matter(spark):
    a, b = frame(spark, noise(300), "a"), frame(spark, noise(250, 7), "b")
    kinds = [smoothing.ema(9), smoothing.Rsi, smoothing.Macd, smoothing.StochRsi, smoothing.Supertrend, smoothing.AtrExpansion]
    both = {(r.symbol, r.seq): r for r in scan(a.union(b), kinds).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        alone = scan(a, kinds).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(both["a", r.seq] == r for r in alone) and len(both) == 550


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark, noise(120)).select("symbol", "tf", "ts", "seq", "high", "low", "close")
    for part in range(3):
        df.where(F.floor(F.col("seq") / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_scan(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), smoothing.Atr)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")), "atr") == values(scan(df, [smoothing.Atr]), "atr")


def test_regime_waits_for_confirmations_and_leaves_at_once(spark):
    calls = [(0, "BREAKOUT_LONG"), (1, "BREAKOUT_LONG"), (2, "BREAKOUT_LONG"), (3, "NO_TRADE"), (8, "CHOPPY"), (14, "BREAKOUT_SHORT"), (15, "BREAKOUT_SHORT"), (16, "BREAKOUT_SHORT")]
    machine = regime.Transitions()
    got = [machine.step(s * 1000, c)[0] for s, c in calls]
    assert got == ["NO_TRADE", "NO_TRADE", "BREAKOUT_LONG", "BREAKOUT_LONG", "CHOPPY", "CHOPPY", "CHOPPY", "BREAKOUT_SHORT"]


def test_pivots_and_gaps(spark):
    shape = [10, 11, 12, 13, 14, 20, 14, 13, 12, 11, 10, 9, 8]
    got = values(structure.with_pivots(frame(spark, [float(x) for x in shape])), "swing_high")
    assert [i for i, x in enumerate(got) if x is not None] == [5]
    gaps = structure.gaps(frame(spark, [100.0, 101.0, 110.0, 111.0, 103.0])).collect()
    assert (gaps[0].gap_side, gaps[0].gap_bottom, gaps[0].gap_top, gaps[0].gap_filled) == ("bullish", 101.0, 109.0, True)


def test_asof_nearest_takes_the_earlier_of_two_as_near(spark):
    left = spark.createDataFrame([("x", 10), ("x", 14), ("y", 1)], "symbol string, s long").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("x", 8, 1.0), ("x", 12, 2.0), ("x", 13, 3.0)], "symbol string, s long, v double").select("symbol", F.timestamp_seconds("s").alias("ts"), "v")
    near = {(r.symbol, r.s): r.v for r in asof.asof(left, right, "v", nearest=True).collect()}
    last = {(r.symbol, r.s): r.v for r in asof.asof(left, right, "v").collect()}
    assert near == {("x", 10): 1.0, ("x", 14): 3.0, ("y", 1): None} and last == {("x", 10): 1.0, ("x", 14): 3.0, ("y", 1): None}


def test_sliding_windows_hold_trades_of_the_same_time(spark):
    rows = [("x", 0, 1, 10.0, 1.0, False), ("x", 4, 2, 20.0, 2.0, True), ("x", 9, 3, 30.0, 1.0, False)]
    df = spark.createDataFrame(rows, "symbol string, s long, trade_id long, price double, quantity double, is_buyer_maker boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.buy_5, r.sell_5, r.count_5) for r in windows.sliding(df, (5,)).orderBy("s").collect()]
    assert got == [(1, 0, 1), (1, 2, 2), (1, 2, 2)]


def test_sliding_windows_end_with_the_microsecond_and_keep_every_digit(spark):
    rows = [("x", 0, 1, 1e15, 1.0, False), ("x", 10_000_000, 2, 0.1, 1.0, False), ("x", 10_000_400, 3, 0.3, 1.0, True), ("x", 15_000_100, 4, 0.2, 1.0, True)]
    df = spark.createDataFrame(rows, "symbol string, us long, trade_id long, price double, quantity double, is_buyer_maker boolean").withColumn("ts", F.timestamp_micros("us"))
    got = [(r.count_5, r.vwap_5) for r in windows.sliding(df, (5,)).orderBy("us").collect()]
    assert got == [(1, 1e15), (1, 0.1), (2, 0.2), (2, 0.25)]


def test_rounding_of_halves_stored_a_trifle_short(spark):
    df = spark.createDataFrame([((0.94621 + 3) / 4,), (-1.5e-6,), (1e305,), (float("nan"),), (None,)], "x double")
    got = [r.x for r in rounded(df, scaled=True).collect()]
    assert (0.94621 + 3) / 4 < 0.9865525 and got[:3] == [0.986553, -2e-6, 1e305] and math.isnan(got[3]) and got[4] is None


def test_count_bars_take_the_rest_in_the_last(spark):
    df = spark.range(45).selectExpr("'x' as symbol", "timestamp_seconds(id) as ts", "id as trade_id", "cast(id as double) as price", "1.0D as quantity")
    got = bars.count_bars(df).orderBy("bar").collect()
    assert len(got) == 23 and [r.trades for r in got[:2]] == [2, 2] and got[-1].trades == 1


def test_count_and_carried_bars_sort_no_rows_to_aggregate(spark):
    rows = [(None if i % 4 == 0 else "x", i, i % 9) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, s long, trade_id long").select("symbol", F.timestamp_seconds("s").alias("ts"), "trade_id", F.col("s").cast("double").alias("price"), F.lit(1.0).alias("quantity"))
    for made in (bars.count_bars(df, 5), bars.carried_bars(df, 5)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
    counted = bars.count_bars(df, 5)
    assert [(r.symbol, r.bar, r.open, r.close, r.trades) for r in counted.where("symbol is null").orderBy("bar").collect()][:2] == [(None, 0, 0.0, 12.0, 4), (None, 1, 16.0, 28.0, 4)]


def test_places_are_in_order(spark):
    keys = [(None, 5), (-7, 2**62), (0, -(2**62) + 1), (0, None), (10**16, -1), (10**16, 3)]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i long, us long, n long").withColumn("p", place(F.timestamp_micros("us"), F.col("n")))
    assert [r.i for r in df.orderBy("p").collect()] == [0, 1, 3, 2, 4, 5]


def test_scalars(spark):
    row = spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0), 7.0).alias("a"), clip(F.lit(9.0), -1.0, 1.0).alias("b"), interval_ms(F.lit("1d")).alias("c"), interval_ms(F.lit("?")).alias("d"), normalized_symbol(F.lit("btc/us-d_t")).alias("e")).first()
    assert tuple(row) == (7.0, 1.0, INTERVAL_MS["1d"], 60_000, "BTCUSDT")


def test_average_equals_its_definition():
    xs = noise(50)
    average, want = smoothing.Average(10), None
    for i, x in enumerate(xs):
        got = average.push(x)
        want = None if i < 9 else sum(xs[:10]) / 10 if i == 9 else want + 2 / 11 * (x - want)
        assert got is None and want is None or math.isclose(got, want, rel_tol=1e-12)
