"""Order books: snapshots, imbalance, liquidity ladders and vanished walls, on arrays of levels (bids and asks, best first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder, safe_divide


def depth(side: str, n: int) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda s, x: s + x["qty"])


def value(side: str, n: int) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda s, x: s + x["price"] * x["qty"])


def with_snapshot(books: DataFrame) -> DataFrame:
    """Middle, spread and depth of books that have both sides."""
    bid, ask = F.col("bids")[0]["price"], F.col("asks")[0]["price"]
    rows = books.where("size(bids) > 0 and size(asks) > 0").withColumn("mid", (bid + ask) / 2).withColumn("spread", ask - bid)
    return rows.withColumns(
        {"spread_pct": F.try_divide(F.col("spread"), F.col("mid")) * 100, "bid_depth": depth("bids", 10), "ask_depth": depth("asks", 10), "bid_depth_20": depth("bids", 20), "ask_depth_20": depth("asks", 20), "bid_value": value("bids", 10), "ask_value": value("asks", 10)}
    )


def imbalance(n: int = 10) -> Column:
    """(bids - asks) / (bids + asks) of the first n levels."""
    b, a = depth("bids", n), depth("asks", n)
    return safe_divide(b - a, b + a)


def depth_within(side: str, bps: float) -> Column:
    """Quantity within so many basis points of the middle."""
    return F.aggregate(F.filter(side, lambda x: F.abs(x["price"] - F.col("mid")) <= F.col("mid") * bps / 10_000), F.lit(0.0), lambda s, x: s + x["qty"])


def depth_signal(rows: DataFrame) -> DataFrame:
    """book_signal and book_strength by the imbalance of depth."""
    i = safe_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth"))
    size = F.abs(i)
    signal = ladder((i > 0.1, "bullish"), (i < -0.1, "bearish"), otherwise="neutral")
    return rows.withColumns({"imbalance_pct": i * 100, "book_signal": signal, "book_strength": ladder((size > 0.3, F.least(F.lit(80.0), 50 + size * 100)), (size > 0.1, 60.0), otherwise=50.0)})


def ratio_signal(rows: DataFrame, confirmed: Column) -> DataFrame:
    """Bid or ask heavy by the mean of depth and value ratios; bait without volume confirmation."""
    ratio = F.when(F.col("ask_depth") == 0, 99.0).otherwise(F.try_divide(F.col("bid_depth"), F.col("ask_depth")))
    by_value = F.when(F.col("ask_value") > 0, F.try_divide(F.col("bid_value"), F.col("ask_value"))).otherwise(ratio)
    rows = rows.withColumn("book_ratio", (ratio + by_value) / 2)
    r = F.col("book_ratio")
    back = F.try_divide(F.lit(1.0), r)
    side = ladder((r >= 2.0, "bid_heavy"), (r <= 0.5, "ask_heavy"), otherwise="balanced")
    strength = ladder((r >= 3.0, F.least(F.lit(85.0), 50 + (r - 1) * 10)), (r >= 2.0, 60 + (r - 2) * 10), (r <= 1 / 3.0, F.least(F.lit(85.0), 50 + (back - 1) * 10)), (r <= 0.5, 60 + (back - 2) * 10), otherwise=40.0)
    bait = (side != "balanced") & ~confirmed
    return rows.withColumns({"book_side": side, "book_bait": bait, "ratio_strength": F.when(bait, F.greatest(F.lit(30.0), strength - 20)).otherwise(strength)})


def with_ladder(rows: DataFrame, levels: int = 50, summed: int = 15) -> DataFrame:
    """Levels' value by their distance from the middle; the upper median; nearest thick levels; and the ratio of resistance above to that below."""
    weigh = lambda x: x["price"] * x["qty"] / (1 + F.abs(x["price"] - F.col("mid")) / F.col("mid") * 10_000 / 100)
    rows = rows.withColumns({"__b": F.transform(F.slice("bids", 1, levels), weigh), "__a": F.transform(F.slice("asks", 1, levels), weigh)})
    every = F.array_sort(F.concat("__b", "__a"))
    rows = rows.withColumn("median_level", F.get(every, F.floor(F.size(every) / 2).cast("int")))
    thick = lambda side, weights: F.get(F.filter(F.arrays_zip(F.col(side).alias("level"), F.col(weights).alias("weight")), lambda x: x["weight"] >= F.col("median_level") * 2), F.lit(0))["level"]["price"]
    n = F.least(F.lit(summed), F.size("__a"), F.size("__b"))
    total = lambda w: F.aggregate(F.slice(w, F.lit(1), n), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumns({"thick_above": thick("asks", "__a"), "thick_below": thick("bids", "__b"), "resistance_ratio": F.coalesce(F.try_divide(total("__a"), total("__b")), F.lit(1.0))}).drop("__a", "__b")


def path(rows: DataFrame) -> DataFrame:
    """The easier way without memory of the last one: up where little stands above, down where little stands below."""
    r = F.col("resistance_ratio")
    return rows.withColumn("path", ladder((r < 0.7, "up"), (r > 1 / 0.7, "down"), otherwise="balanced"))


def vanished_walls(rows: DataFrame, before: str = "bids_before", now: str = "bids", wall: float = 3.0, tolerance: float = 0.001, left: float = 0.5) -> DataFrame:
    """Levels of an earlier book that were walls and aren't there any more: no level within the tolerance keeps half of the size."""
    sizes = F.transform(F.slice(before, 1, 10), lambda x: x["qty"])
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(sizes), F.lit(1))
    gone = F.filter(
        F.slice(before, 1, 10), lambda x: (x["qty"] >= mean * wall) & ~F.exists(F.slice(now, 1, 10), lambda y: (F.abs(y["price"] - x["price"]) <= x["price"] * tolerance) & (y["qty"] >= x["qty"] * left))
    )
    return rows.withColumn("vanished_walls", gone)


def with_changes(rows: DataFrame, key: str = "symbol", order: tuple[str, ...] = ("ts", "book_id")) -> DataFrame:
    """Change of imbalance and of each side's depth (absolute and per cent) against the book before, and that book's bids and asks. Needs :func:`with_snapshot`."""
    w = Window.partitionBy(key).orderBy(*order)
    i = safe_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth"))
    rows = rows.withColumn("imbalance", i)
    made = {"imbalance_change": F.col("imbalance") - F.lag("imbalance").over(w), "bids_before": F.lag("bids").over(w), "asks_before": F.lag("asks").over(w), "mid_before": F.lag("mid").over(w)}
    for side in ("bid_depth", "ask_depth"):
        before = F.lag(side).over(w)
        made |= {f"{side}_change": F.col(side) - before, f"{side}_change_pct": F.when(before > 0, (F.col(side) - before) / before * 100)}
    return rows.withColumns(made)


def spoofs(rows: DataFrame, snap_bps: float = 2.0) -> DataFrame:
    """Walls of the book before that are gone, where the price has snapped away by ``snap_bps`` since: from bid walls upwards moves tell nothing, so bids count on rises and asks on falls. Needs :func:`with_changes`."""
    rows = vanished_walls(rows, "bids_before", "bids").withColumnRenamed("vanished_walls", "bid_walls")
    rows = vanished_walls(rows, "asks_before", "asks").withColumnRenamed("vanished_walls", "ask_walls")
    moved = F.try_divide(F.col("mid") - F.col("mid_before"), F.col("mid_before")) * 10_000
    kind = ladder(((F.size("bid_walls") > 0) & (moved >= snap_bps), "bid_spoof"), ((F.size("ask_walls") > 0) & (moved <= -snap_bps), "ask_spoof"), otherwise="none")
    return rows.withColumns({"moved_bps": moved, "spoof": kind})


def with_path_memory(rows: DataFrame, key: str = "symbol", order: tuple[str, ...] = ("ts", "book_id"), edge: float = 0.7, memory: float = 0.85) -> DataFrame:
    """path from resistance_ratio: up below ``edge``, down above 1 / ``edge``, and harder by ``memory`` right after the opposite path.

    Beyond the harder edges a book's path doesn't depend on the one before; nor
    does it between the easy ones, or where the book before lies in the same band.
    From such a book on, the bands up to the next one alternate, so that every
    second book contradicts the one before it and is unclear: windows, no recursion.
    """
    r = F.col("resistance_ratio")
    w = Window.partitionBy(key).orderBy(*order)
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    band = ladder((r < edge * memory, 2), (r < edge, 1), (r > 1 / edge / memory, -2), (r > 1 / edge, -1), otherwise=0)
    rows = rows.withColumns({"__band": band, "__i": F.row_number().over(w)}).withColumn("__before", F.lag("__band").over(w))
    own = F.signum(F.col("__band")).cast("int")
    fixed = (F.abs("__band") != 1) | F.col("__before").isNull() | (F.col("__before") == F.col("__band"))
    rows = rows.withColumn("__from", F.last(F.when(fixed, F.struct(F.col("__i").alias("i"), own.alias("way"))), ignorenulls=True).over(seen))
    after = F.col("__i") - F.col("__from.i") - 1
    odd = after % 2 == 1
    first_way = F.when(odd, -own).otherwise(own)
    unclear = (after >= 0) & ((F.col("__from.way") == -first_way) != odd)
    way = ladder((unclear, 0), otherwise=own)
    return rows.withColumn("path", F.when(way > 0, "up").when(way < 0, "down").otherwise("unclear")).drop("__band", "__i", "__before", "__from")


def pulled_walls(rows: DataFrame, oi_rises: Column | None = None, key: str = "symbol", order: tuple[str, ...] = ("ts", "book_id"), books: int = 5, wall: float = 3.0, snap_bps: float = 2.0) -> DataFrame:
    """spoof, times_pulled and spoof_confidence: walls among the last books (three at least) that are gone, where the middle had come near and has snapped to the other side since. Once is not enough without rising open interest. Needs :func:`with_snapshot`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-books, -1)
    held = F.struct(F.slice("bids", 1, 10).alias("bids"), F.slice("asks", 1, 10).alias("asks"), F.col("mid").alias("mid"))
    rows = rows.withColumns({"__held": F.collect_list(held).over(w), "__sizes": F.transform(F.concat(F.slice("bids", 1, 20), F.slice("asks", 1, 20)), lambda x: x["qty"])})
    least = F.aggregate("__sizes", F.lit(0.0), lambda s, x: s + x) / F.size("__sizes") * wall
    rows = rows.withColumns({"__least": least, "__bids": F.slice("bids", 1, 10), "__asks": F.slice("asks", 1, 10)})

    def pulls(side: str, down: int) -> Column:
        def count(book):
            near = lambda x: (book["mid"] < x["price"] * 1.01) if down == 1 else (book["mid"] > x["price"] * 0.99)
            snapped = F.try_divide((book["mid"] - F.col("mid")) * down, book["mid"]) * 10_000 > snap_bps
            stays = lambda x: F.exists(f"__{side}", lambda y: (F.abs(y["price"] - x["price"]) < x["price"] * 0.001) & (y["qty"] >= x["qty"] * 0.5))
            return F.size(F.filter(book[side], lambda x: (x["qty"] >= F.col("__least")) & ~stays(x) & near(x) & snapped))

        return F.transform("__held", count)

    rows = rows.withColumns({"__b": pulls("bids", 1), "__a": pulls("asks", -1)})
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    latest = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x, i: F.when(x > 0, i))), F.lit(-1))
    times = total("__b") + total("__a")
    sure = 50 + F.when(times >= 2, 15).otherwise(0) + (F.when(oi_rises, 20).otherwise(0) if oi_rises is not None else F.lit(0))
    found = (F.size("__held") >= 3) & (times > 0) & (sure >= 60)
    kind = ladder((~found, "none"), (latest("__a") >= latest("__b"), "ask_spoof"), otherwise="bid_spoof")
    return rows.withColumns({"spoof": kind, "times_pulled": F.when(F.size("__held") >= 3, times).otherwise(0), "spoof_confidence": F.when(found, F.least(F.lit(90), sure).cast("double")).otherwise(0.0)}).drop("__held", "__sizes", "__least", "__bids", "__asks", "__b", "__a")


def absorption(volume_ratio: Column, price_pct: Column) -> tuple[Column, Column]:
    """The side of the book that takes a volume spike without moving, and how strongly. Unknown ratios count as 1. Needs :func:`with_snapshot`."""
    ratio, move = F.coalesce(volume_ratio, F.lit(1.0)), F.coalesce(price_pct, F.lit(0.0))
    efficiency = F.when(ratio > 0, F.abs(move) / F.when(ratio > 0, ratio)).otherwise(1.0)
    depths = F.when(F.col("ask_depth") > 0, F.try_divide(F.col("bid_depth"), F.col("ask_depth"))).otherwise(1.0)
    takes = (ratio > 1.5) & (F.abs(move) < 0.3) & (efficiency < 0.3)
    side = ladder((takes & (depths > 1.5) & (move <= 0), "bid"), (takes & (depths < 0.67) & (move >= 0), "ask"), otherwise="none")
    more = lambda d: F.least(F.lit(90.0), 50 + (d - 1) * 20 + (1 - efficiency) * 30)
    return side, ladder((side == "bid", more(depths)), (side == "ask", more(F.try_divide(F.lit(1.0), depths))), (takes, 40.0), otherwise=30.0)


def vote(rows: DataFrame) -> DataFrame:
    """book_verdict, its confidence and the way that price is forced, from absorbed, absorbed_strength, book_side, book_bait, ratio_strength, spoof, spoof_confidence and path. A spoof counts for the other side; bait and a spoof together are a trap."""
    spoof, path_, side = F.col("spoof"), F.col("path"), F.col("book_side")
    voices = (
        (F.col("absorbed") == "bid", F.col("absorbed") == "ask", F.col("absorbed_strength")),
        (~F.col("book_bait") & (side == "bid_heavy"), ~F.col("book_bait") & (side == "ask_heavy"), F.col("ratio_strength")),
        (spoof == "ask_spoof", spoof == "bid_spoof", F.col("spoof_confidence")),
        (path_ == "up", path_ == "down", F.lit(55.0)),
    )
    weigh = lambda k: sum((F.when(v[k], v[2]).otherwise(0.0) for v in voices), F.lit(0.0))
    count = lambda k: sum((F.when(v[k], 1).otherwise(0) for v in voices), F.lit(0))
    up, down, ups, downs = weigh(0), weigh(1), count(0), count(1)
    trap = F.col("book_bait") & (spoof != "none")
    rises, falls = up > down * 1.3, down > up * 1.3
    verdict = ladder((trap, "trap"), (rises, "bullish"), (falls, "bearish"), otherwise="neutral")
    sure = ladder((trap, F.greatest(F.lit(60.0), F.col("spoof_confidence"))), (ups + downs == 0, 40.0), (rises, F.least(F.lit(85.0), F.try_divide(up, ups))), (falls, F.least(F.lit(85.0), F.try_divide(down, downs))), otherwise=50.0)
    forced = ladder((path_ != "unclear", path_), (verdict == "bullish", "up_by_flow"), (verdict == "bearish", "down_by_flow"), otherwise="unclear")
    return rows.withColumns({"book_verdict": verdict, "book_confidence": sure, "forced_way": forced})
