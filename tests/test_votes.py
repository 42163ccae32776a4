"""Path memory, pulled walls and structure against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tidemark.operators import book as K
from tidemark.operators import institution as I

START = datetime(2024, 1, 1)


def _paths(ratios):
    """Row by row, with the last path in mind."""
    out, last = [], None
    for r in ratios:
        up, down = 0.7, 1 / 0.7
        if last == "down":
            up *= 0.85
        elif last == "up":
            down /= 0.85
        last = "up" if r < up else "down" if r > down else "unclear"
        out.append(last)
    return out


def test_path_memory(spark):
    rng = random.Random(7)
    values = (0.4, 0.65, 1.0, 1.5, 2.5)  # one of each band
    series = {s: [rng.choice(values) for _ in range(60)] for s in "abc"} | {"alternating": [0.65, 1.5] * 20, "after_up": [0.4] + [1.5, 0.65] * 20, "single": [1.5]}
    rows = [(s, START + timedelta(minutes=i), i, r) for s, rs in series.items() for i, r in enumerate(rs)]
    made = K.with_path_memory(spark.createDataFrame(rows, "symbol string, ts timestamp, book_id int, resistance_ratio double"))
    got = {s: [] for s in series}
    for row in made.orderBy("symbol", "ts").collect():
        got[row.symbol].append(row.path)
    assert got == {s: _paths(rs) for s, rs in series.items()}


def test_path_memory_of_nothing(spark):
    none = spark.createDataFrame([], "symbol string, ts timestamp, book_id int, resistance_ratio double")
    assert K.with_path_memory(none).count() == 0


def _book(i, bids, asks):
    level = lambda x: {"price": float(x[0]), "qty": float(x[1])}
    return ("s", START + timedelta(seconds=i), i, [level(x) for x in bids], [level(x) for x in asks])


_SCHEMA = "symbol string, ts timestamp, book_id int, bids array<struct<price double, qty double>>, asks array<struct<price double, qty double>>"


def test_pulled_walls(spark):
    wall = [(100, 50), (99, 1)]
    books = [_book(i, wall, [(101, 1), (102, 1)]) for i in range(4)] + [_book(4, [(98, 1), (97, 1)], [(99, 1), (100, 1)])]
    made = {r.book_id: r for r in K.pulled_walls(K.with_snapshot(spark.createDataFrame(books, _SCHEMA))).collect()}
    assert [made[i].spoof for i in range(4)] == ["none"] * 4
    assert (made[4].spoof, made[4].times_pulled, made[4].spoof_confidence) == ("bid_spoof", 4, 65.0)


def test_a_wall_pulled_once_needs_open_interest(spark):
    plain = [_book(i, [(100, 1), (99, 1)], [(101, 1), (102, 1)]) for i in range(3)]
    books = plain + [_book(3, [(100, 50), (99, 1)], [(101, 1), (102, 1)]), _book(4, [(98, 1), (97, 1)], [(99, 1), (100, 1)])]
    rows = K.with_snapshot(spark.createDataFrame(books, _SCHEMA))
    last = lambda df: df.where("book_id = 4").select("spoof", "spoof_confidence").first()
    assert tuple(last(K.pulled_walls(rows))) == ("none", 0.0)
    assert tuple(last(K.pulled_walls(rows, F.lit(True)))) == ("bid_spoof", 70.0)


def _bars(spark, rows):
    return spark.createDataFrame([("s", "1h", START + timedelta(hours=i), i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, tf string, ts timestamp, seq int, open double, high double, low double, close double, volume double")


def test_a_sweep_is_confirmed_by_volume_and_a_turn(spark):
    shape = [10, 9, 8, 7, 8, 9, 10, 9, 8, 6, 8, 9, 10, 10]
    rows = [(x, x + 0.5, x - 0.5, x, 1) for x in shape] + [(10, 10.5, 5.0, 8, 1), (8, 9.5, 7.5, 9, 9)] + [(9, 9.5, 8.5, 9, 1)] * 8
    made = I.structure(_bars(spark, rows)).orderBy("ts").collect()
    assert [i for i, r in enumerate(made) if r.swing_low is not None] == [3, 9, 14]
    assert [i for i, r in enumerate(made) if r.swept_low] == [14]
    # Fewer than twenty bars have no relative volume, so that nothing confirms.
    assert not made[14].low_sweep_confirmed
    late = I.structure(_bars(spark, [(9, 9.5, 8.5, 9, 1)] * 10 + rows)).orderBy("ts").collect()
    assert [(i, r.low_sweep_confirmed) for i, r in enumerate(late) if r.swept_low] == [(24, True)]


def test_structure_of_few_flat_and_zero_bars(spark):
    assert I.structure(_bars(spark, [(0, 0, 0, 0, 0)] * 3)).where("trend = 'unknown' and structure_strength = 0").count() == 3
    flat = I.structure(_bars(spark, [(1, 1, 1, 1, 1)] * 30))
    assert flat.where("swing_high is not null or swept_low or swept_high or structure_event <> 'none'").count() == 0
    assert I.structure(_bars(spark, [(1, 1, 1, 1, 1)]).where("false")).count() == 0


def test_a_swing_at_price_zero_has_the_middle_strength(spark):
    shape = [5, 6, 7, 8, 7, 6, 5, 6, 7, 8, 7, 6, 5, 6, 7, 8, 6, 4, 0, 4, 6, 7, 8]
    made = I.with_swings(_bars(spark, [(x, x + 0.5, x, x, 1) for x in shape])).where("swing_low is not null").orderBy("ts").collect()
    assert [(r.swing_low, r.atr_pct > 0, r.low_strength == 0.5) for r in made][-1] == (0.0, False, True)
    # The close decides atr_pct, the low the share: a low of zero under a close above it.
    rows = [(x, x + 0.5, x, max(x, 1), 1) for x in shape]
    last = I.with_swings(_bars(spark, rows)).where("swing_low = 0").first()
    assert last.atr_pct > 0 and last.low_strength == 0.5


def test_levels_of_many_equal_pivots_are_few(spark):
    """A price touched 300 times is one level, and prices within the share are found on either side of a band's border and of a month's."""
    import datetime as dt

    from pyspark.sql import functions as F
    from tidemark.operators import structure as T

    def brute(prices):
        equal = {p for i, p in enumerate(prices) if any(abs(p - q) / p < 0.001 for q in prices[i + 1 :])}
        return {(p, p in equal, p == prices[-1]) for p in equal | {prices[-1]}}

    prices = [100.0] * 300 + [round(50 * 1.0004**i, 6) for i in range(60)] + [200.0, 100.05, 300.0, 200.19, 200.21]
    start, rows = dt.datetime(2024, 1, 1), []
    for i, p in enumerate(prices):  # every fifth bar is a high above its neighbours
        rows += [("a", "1h", start + dt.timedelta(hours=5 * i + k), 0, p if k == 2 else 1.0) for k in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, seq int, high double").withColumn("low", F.lit(-1.0)).withColumn("close", F.col("high"))
    got = {(r.level, r.is_equal, r.is_latest) for r in T.levels(bars, n=2).collect() if r.side == "high"}
    assert got == brute(prices)
    assert T.levels(bars.where("false")).count() == 0


def test_small_helpers_at_their_edges(spark):
    from pyspark.sql import functions as F
    from tidemark.functions.scalars import bias_way, higher_interval, history_limit

    df = spark.createDataFrame([("bull", "1h", 5, 3), ("BEAR", "1M", 0, 100), (None, None, None, 1), ("x", "7m", 1, 50)], "bias string, tf string, wanted int, there int")
    got = [tuple(r) for r in df.select(bias_way(F.col("bias")), higher_interval(F.col("tf")), history_limit(F.col("wanted"), F.col("there"))).collect()]
    assert got == [(1, "4h", 3), (-1, None, 30), (0, None, 1), (0, None, 2)]
