"""Anchors with a life against a plain loop."""

import datetime
import random

from tidemark.operators import vwap

BEGIN = datetime.datetime(2024, 1, 1)


def test_each_bar_meets_the_anchors_that_live(spark):
    rng = random.Random(6)
    at = lambda i: BEGIN + datetime.timedelta(hours=i)
    bars = [("ab"[i % 2], "1h", at(i // 2), 0, 10.0 + rng.random(), 9.0, 9.5, float(rng.randint(0, 5))) for i in range(80)]
    anchors = [("a", "1h", f"x{k}", at(t)) for k, t in enumerate((2, 5, 5, 9, 20, 30))] + [("a", "1h", "x0", at(33)), ("b", "1h", "y", at(39))]
    removed = [("a", "1h", "x4", at(25)), ("a", "1h", "gone", at(1))]
    df = spark.createDataFrame(bars, "symbol string, tf string, ts timestamp, seq long, high double, low double, close double, volume double")
    an = spark.createDataFrame(anchors, "symbol string, tf string, anchor_id string, anchor_time timestamp")
    rm = spark.createDataFrame(removed, "symbol string, tf string, anchor_id string, ts timestamp")
    for most, age in ((3, None), (2, 4), (1, None)):
        want = {}
        for s in "ab":
            own = sorted({(min(t for a, _, j, t in anchors if (a, j) == (s, i)), i) for a, _, i, _ in anchors if a == s})
            out = {i: t for a, _, i, t in removed if a == s}
            for _, _, ts, _, h, lo, c, v in (b for b in bars if b[0] == s):
                for t, i in [x for x in own if x[0] <= ts][-most:]:
                    if i in out and ts >= out[i]:
                        continue
                    rows = [b for b in bars if b[0] == s and t <= b[2] <= ts]
                    if age is not None and len(rows) > age:
                        continue
                    weight = sum(b[7] for b in rows)
                    want[s, ts, i] = sum((b[4] + b[5] + b[6]) / 3 * b[7] for b in rows) / (weight + 1e-10) if weight else None
        got = {(r.symbol, r.ts, r.anchor_id): r.vwap for r in vwap.lived(df, an, most, rm, age).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert vwap.lived(df.where("false"), an).count() == 0 and vwap.lived(df, an.where("false")).count() == 0
