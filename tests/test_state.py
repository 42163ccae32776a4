"""Windows, joined components, latches and ordered streams against plain loops."""

import datetime
import random
import tempfile
import time
import uuid

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F
from tidemark.operators import components as J
from tidemark.operators import precise, pyramid
from tidemark.operators import smoothing as S
from tidemark.operators.scan import scan
from tidemark.plans import live, registry
from tidemark.streaming import ordered as Z

BEGIN = datetime.datetime(2024, 1, 1)
MS = 1000


def at(ms):
    return BEGIN + datetime.timedelta(milliseconds=ms)


@pytest.fixture(scope="module")
def trades(spark):
    """Busy, idle and sparse times of two symbols; the second has one trade."""
    rng, rows, t = random.Random(2), [], 0
    for i in range(600):
        t += rng.choice([5, 40, 300, 900, 2500, 2500]) if i % 97 else 60_000
        rows.append(("a", at(t), i, rng.choice([10.0, 11.5, 9.0, 14.0]), float(rng.randint(1, 5)), rng.random() < 0.5))
    rows.append(("b", at(123_456), 0, 7.0, 2.0, False))
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean").repartition(5).cache()


def ms_of(ts):
    return int((ts - BEGIN) / datetime.timedelta(milliseconds=1))


def test_windows_of_all_lengths(trades):
    rows, df = trades
    lengths = (3, 7, 20)
    got = pyramid.own(pyramid.with_cvd(pyramid.windows(pyramid.chunks(pyramid.steps(df, MS), 20), lengths, MS), 20), MS).collect()
    base = int(BEGIN.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    own = {s: [r for r in rows if r[0] == s] for s in "ab"}
    steps = {(r[0], ms_of(r[1]) // MS) for r in rows}
    assert {(r.symbol, r.n - base // MS) for r in got} == steps and len(got) == len(steps)
    for r in got:
        n = r.n - base // MS
        seen = [x for x in own[r.symbol] if ms_of(x[1]) // MS <= n]
        for k in lengths:
            win = [x for x in seen if ms_of(x[1]) // MS > n - k]
            buy = sum(x[4] for x in win if not x[5])
            assert r[f"trades_{k}"] == len(win) and abs(r[f"buy_{k}"] - buy) < 1e-9 and abs(r[f"notional_{k}"] - sum(x[3] * x[4] for x in win)) < 1e-6
            assert (r[f"low_{k}"], r[f"high_{k}"]) == (min(x[3] for x in win), max(x[3] for x in win))
            span = ms_of(win[-1][1]) - ms_of(win[0][1])
            assert r[f"span_{k}"] == span and r[f"complete_{k}"] == (span >= 0.9 * k * MS) and abs(r[f"coverage_{k}"] - min(1, span / (k * MS))) < 1e-12
        signed = lambda xs: sum(-x[4] if x[5] else x[4] for x in xs)
        first = ms_of(own[r.symbol][0][1]) // MS
        past = [x for x in seen if ms_of(x[1]) // MS <= max(n - 9, first)]
        assert abs(r.cvd - signed(seen)) < 1e-9 and abs(r.cvd_change - (signed(seen) - signed(past))) < 1e-9
        assert r.lookback == min(10, n - first + 1) and abs(r.price_change - (seen[-1][3] - past[-1][3])) < 1e-9


def test_asof_of_several_streams_over_buckets(spark):
    rng = random.Random(3)
    grid = sorted({(rng.choice("ab"), rng.randrange(0, 100_000, 50)) for _ in range(300)})
    streams = {name: [(rng.choice("ab"), rng.randrange(0, 100_000, 50), i, float(i)) for i in range(n)] for name, n in (("x", 200), ("y", 5), ("z", 0))}
    frame = lambda rows: spark.createDataFrame([(s, at(t), q, v) for s, t, q, v in rows], "symbol string, ts timestamp, seq long, v double")
    asks = {"now": J.Ask("x"), "then": J.Ask("x", 7000), "before": J.Ask("x", 7000, strict=True), "slow": J.Ask("y"), "none": J.Ask("z")}
    df = spark.createDataFrame([(s, at(t)) for s, t in grid], "symbol string, ts timestamp")
    got = {(r.symbol, ms_of(r.ts)): r for r in J.asof_all(df, {k: frame(v) for k, v in streams.items()}, asks, 9000).collect()}
    assert len(got) == len(grid)
    for symbol, t in grid:
        for name, a in asks.items():
            said = [(u, q, v) for s, u, q, v in streams[a.stream] if s == symbol and (u < t - a.back or u == t - a.back and not a.strict)]
            value = got[symbol, t][name]
            assert (value.v if value else None) == (max(said)[2] if said else None)


def test_open_interest_change(spark):
    prints = spark.createDataFrame([("a", at(t), 0, v) for t, v in ((0, 100.0), (1000, 110.0), (5000, 121.0), (6000, 60.5))], "symbol string, ts timestamp, seq long, open_interest double")
    grid = spark.createDataFrame([("a", at(t)) for t in (0, 500, 1000, 4000, 5500, 6500, 20000)], "symbol string, ts timestamp")
    rows = J.asof_all(grid, {"oi": J.oi_prints(prints)}, {"oi": J.Ask("oi"), "oi_then": J.Ask("oi", 2000, strict=True)}, 3000).withColumn("change", J.oi_change())
    got = {ms_of(r.ts): r.change and round(r.change, 6) for r in rows.collect()}
    assert got == {0: None, 500: None, 1000: 10.0, 4000: 10.0, 5500: 10.0, 6500: -50.0, 20000: -50.0}


def test_warmup_stays_once_it_is_over(spark):
    rows = spark.createDataFrame([("a", at(t), t, n, b) for t, n, b in ((0, 50, 50), (10, 5, 50), (20, 50, 50), (30, 0, 0))] + [("b", at(40), 40, None, None)], "symbol string, ts timestamp, elapsed long, trades int, books int")
    got = J.with_warmup(rows, F.col("elapsed"), F.col("trades"), F.col("books"), 10, 20, 30).collect()
    assert {(r.symbol, r.elapsed): r.warm for r in got} == {("a", 0): False, ("a", 10): False, ("a", 20): True, ("a", 30): True, ("b", 40): False}


def test_data_quality_and_action(spark):
    made = spark.range(1).select(J.data_quality(F.lit(0.5), F.lit(True), F.lit(2), F.lit(0)).alias("q"), *[J.action(F.lit(x)).alias(f"a{i}") for i, x in enumerate((0.55, -0.55, 0.24, 0.3, -0.3))]).first()
    assert tuple(made) == (0.75, "LONG", "SHORT", "NO TRADE", "WEAK LONG", "WEAK SHORT")


def test_a_sweep_is_confirmed_by_volume_and_delta(spark):
    """A pivot high at 20 is run over by bar 14 and given back by its own close, with volume and selling; a low one likewise without."""
    highs = [10, 11, 12, 13, 14, 20, 14, 13, 12, 11, 10, 11, 12, 13, 21, 12]
    rows = []
    for i, h in enumerate(highs):
        closes, volume, ratio = (15.0, 40.0, -0.5) if i == 14 else (h - 1.0, 10.0, 0.0)
        rows.append(("a", "1d", at(i), 0, float(h), h - 2.0 if i != 14 else 12.0, closes, volume, ratio))
    bars = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, seq long, high double, low double, close double, volume double, delta_ratio double")
    got = [r for r in precise.sweeps(bars).collect() if r.sweep_side]
    assert [(ms_of(r.ts), r.sweep_side, r.swept_level, r.bars_to_close, r.post_sweep_rv, r.delta_flipped, r.trapped_side, r.sweep_confirmed, r.sweep_confidence) for r in got] == [(14, "up", 20.0, 1, 4.0, True, "longs", True, 95.0)]
    assert precise.sweeps(bars.where("false")).count() == 0


def batches(spark, pieces, plan):
    """A stream that gets the pieces one after the other, each as a micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    query = None
    for i, piece in enumerate(pieces):
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if query is None:
            stream = plan(spark.readStream.schema(piece.schema).parquet(f"{folder}/in"))
            query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
        query.processAllAvailable()
        time.sleep(0.1)
    query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_a_stream_out_of_order_equals_the_batch(spark):
    rng = random.Random(7)
    rows = [("ab"[i % 2], "1h", at(i * 1000), i, 50 + rng.random()) for i in range(120)]
    schema = "symbol string, tf string, ts timestamp, seq long, close double"
    bars = spark.createDataFrame(rows, schema)
    arrived = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 8))  # up to eight seconds late
    pieces = [spark.createDataFrame(arrived[i : i + 30], schema) for i in range(0, 120, 30)]
    pieces.append(Z.closing_row(bars, 60_000))
    got = batches(spark, pieces, lambda s: Z.in_order(s, S.Rsi, "10 seconds", ("symbol", "tf"), ("ts", "seq")))
    want = {(r.symbol, r.ts): r.rsi for r in scan(bars, [S.Rsi]).collect()}
    found = {(r.symbol, r.ts): r.rsi for r in got.collect()}
    assert found == want


def test_rows_later_than_the_watermark_are_dropped(spark):
    schema = "symbol string, tf string, ts timestamp, seq long, close double"
    one = [("a", "1h", at(i * 1000), i, 50.0 + i) for i in range(0, 40)]
    late = [("a", "1h", at(5500), 999, 1.0), ("a", "1h", at(45_000), 45, 95.0)]
    pieces = [spark.createDataFrame(one, schema), spark.createDataFrame(late, schema), Z.closing_row(spark.createDataFrame(late, schema), 60_000)]
    got = batches(spark, pieces, lambda s: Z.in_order(s, S.Rsi, "10 seconds", ("symbol", "tf"), ("ts", "seq")))
    assert sorted(r.seq for r in got.collect()) == [*range(40), 45]


def test_components_of_events_within_a_millisecond(spark, tmp_path):
    """Where several events share a millisecond, the one of the largest id counts, also as the first price of all."""
    step = datetime.timedelta(microseconds=1)
    times = [BEGIN + k * datetime.timedelta(minutes=10) + n * step for k in range(40) for n in (0, 300, 600)]
    rows = [(1000 - i, t, i, "a", float(i * i % 97), f'{{"k": {i % 100}}}') for i, t in enumerate(times)]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
        con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("components_stream", "market_state"):
        assert difference(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], str(tmp_path)) == ""


def test_the_state_of_components_grows_with_half_hours_alone(spark, tmp_path, monkeypatch):
    """A hundred times the events in the same half-hours: the stream's state stays as it is."""
    size = {}
    for n in (4, 400):
        monkeypatch.setattr(live, "shared_dir", lambda _, n=n: f"file://{tmp_path}/{n}/{uuid.uuid4().hex}")
        rows = [(i, BEGIN + i // n * datetime.timedelta(minutes=30) + i % n * datetime.timedelta(seconds=4), "ab"[i % 2], i * 37 % 101 + 0.5, f'{{"k": {i % 100}}}') for i in range(20 * n)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/{n}/events.parquet")
        assert registry.queries()["components_stream"](spark, f"{tmp_path}/{n}").count() == 40
        size[n] = sum(f.stat().st_size for f in tmp_path.glob(f"{n}/**/*.delta"))
    assert 0 < size[400] < 1.5 * size[4]


def test_step_ends_are_the_first_and_last_known_values(spark):
    """Two rows a kind and step, the value of the largest seq in its millisecond; a step's last millisecond belongs to it, to its last microsecond."""
    us = lambda x: BEGIN + datetime.timedelta(microseconds=x)
    rows = [("a", us(0), 1, 1.0), ("a", us(10), 2, 2.0), ("a", us(1000), 9, 3.0), ("a", us(1001), 8, 4.0), ("a", us(1002), 10, None), ("a", us(5000), 3, 5.0), ("a", us(9000), 4, None), ("a", us(10_999), 5, 6.0), ("a", us(11_000), 6, None), ("b", us(1000), 7, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, value double").select("*", F.lit(0).alias("side"), F.lit("price").alias("kind"), F.lit(False).alias("asks"), F.unix_millis("ts").alias("ms"))
    got = batches(spark, [df, Z.closing_row(df, 60_000)], lambda s: Z.step_ends(s, "10 seconds", 10))
    assert sorted((r.symbol, ms_of(r.ts), r.value) for r in got.collect()) == [("a", 0, 2.0), ("a", 1, 3.0), ("a", 10, 6.0), ("a", 11, None), ("b", 1, 7.0)]


def test_components_of_unknown_values(spark, tmp_path):
    """Prices and books that are null, some alone in their millisecond or half-hour, and hours without any open interest."""
    rng, t, rows = random.Random(9), 0, []
    for i in range(500):
        t += rng.choice([0, 0, 300, 1000, 1000, 40_000_000, 900_000_000, 3_000_000_000])
        rows.append((i * 7919 % 500, BEGIN + datetime.timedelta(microseconds=t), i, "ab"[i > 1 and rng.random() < 0.4], 5.0 if i < 2 else rng.choice([None, 3.0, float(i)]), rng.choice([None, "{}", f'{{"k": {i % 100}}}'])))
    rows[1] = (*rows[1][:3], "b", *rows[1][4:])
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert difference(registry.queries()["components_stream"](spark, str(tmp_path)), registry.oracle_sql()["components_stream"], str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["components_stream", "rsi_stream"])
def test_a_replay_in_pieces_equals_the_sql(spark, monkeypatch, name):
    monkeypatch.setattr(live, "PIECE", 400)
    d = "/root/testdata/sf0.001"
    assert difference(registry.queries()[name](spark, d), registry.oracle_sql()[name], d) == ""


def test_a_series_longer_than_a_slice_keeps_its_order(spark):
    rng = random.Random(8)
    rows = [("a", "1h", at(i), None if i == 5 else i, 50 + rng.random()) for i in range(Z.SLICE + 500)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "symbol string, tf string, ts timestamp, seq long, close double")
    got = {(r.ts, r.seq): r.rsi for r in batches(spark, [df, Z.closing_row(df, 60_000)], lambda s: Z.in_order(s, S.Rsi, "10 seconds", ("symbol", "tf"), ("ts", "seq"))).collect()}
    assert got == {(r.ts, r.seq): r.rsi for r in scan(df, [S.Rsi]).collect()} and len(got) == len(rows)
