"""The components of a market's state brought together as of each moment.

All streams and all questions go through one union, sorted once by symbol and time: a
question is a moment, perhaps some time before the row that asks, and gets what its
stream last said. Time is cut into buckets, so that a symbol is many tasks' work;
what a bucket begins with is carried from a table of one row per symbol and bucket.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ladder
from ..sources.storage import stored
from . import score as C


class Ask(NamedTuple):
    """What ``stream`` said last, ``back`` milliseconds before the asking row, at that very moment included unless ``strict``."""

    stream: str
    back: int = 0
    strict: bool = False


def asof_all(grid: DataFrame, streams: dict[str, DataFrame], asks: dict[str, Ask], width: int) -> DataFrame:
    """``grid`` (symbol and ts, each pair once) with a column for each ask: a struct of its stream's columns (all but symbol, ts and seq), null if it had said nothing yet. Rows of one time count in the order of ``seq``. ``width``: milliseconds of a bucket."""
    ms = F.unix_millis("ts")
    made = []
    for name, df in streams.items():
        value = F.struct(*[c for c in df.columns if c not in ("symbol", "ts", "seq")])
        made.append(df.select("symbol", ms.alias("at"), F.lit(0).alias("side"), "seq", value.alias(f"__{name}")))
    for name, a in asks.items():
        made.append(grid.select("symbol", (ms - a.back).alias("at"), F.lit(-1 if a.strict else 1).alias("side"), ms.alias("of"), F.lit(name).alias("ask")))
    both = made[0]
    for df in made[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    both = stored(both.withColumn("bucket", F.floor(F.col("at") / width)))  # read for the buckets' ends and for their rows
    columns = [f"__{name}" for name in streams]
    order = Window.partitionBy("symbol", "bucket").orderBy("at", "side", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns}).where("ask is not null")
    ends = both.groupBy("symbol", "bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "seq"))).alias(c) for c in columns])
    before = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("symbol", "bucket", *[F.last(c, ignorenulls=True).over(before).alias(f"{c}_0") for c in columns])
    told = within.join(begins, ["symbol", "bucket"], "left")
    said = {name: F.coalesce(f"__{a.stream}", f"__{a.stream}_0") for name, a in asks.items()}
    answers = told.groupBy("symbol", "of").agg(*[F.max_by(x, F.when(F.col("ask") == name, 1)).alias(name) for name, x in said.items()])
    return grid.withColumn("of", ms).join(answers, ["symbol", "of"], "left").drop("of")


def oi_prints(rows: DataFrame) -> DataFrame:
    """Prints of open interest (symbol, ts, seq, open_interest), a slow stream: with their number, the one before and after, and the first."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    v = F.col("open_interest")
    return rows.select("symbol", "ts", "seq", v.alias("value"), F.row_number().over(w).alias("i"), F.lag(v).over(w).alias("before"), F.lead(v).over(w).alias("after"), F.first(v).over(w).alias("first"))


def oi_change(now: str = "oi", then: str = "oi_then") -> Column:
    """Change in per cent since the first print of the window that ``then`` asks for the end of (strictly), or since the print before where the window has one print or none; null with fewer than two in all, or from nothing."""
    i, j = F.col(f"{now}.i"), F.coalesce(F.col(f"{then}.i"), F.lit(0))
    base = F.when(i - j >= 2, F.coalesce(F.col(f"{then}.after"), F.col(f"{now}.first"))).when(i >= 2, F.col(f"{now}.before"))
    return F.when(base > 0, (F.col(f"{now}.value") - base) / base * 100)


def funding_prints(rows: DataFrame, history: int = 100) -> DataFrame:
    """Prints of the funding rate (symbol, ts, seq, funding_rate), a slow stream: with zone, crowd, and the mean and deviation of the last ``history`` rates (from three on; the deviation is at least 0.00001)."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(1 - history, 0)
    n = F.count("funding_rate").over(w)
    out = C.with_funding_zone(rows, history=history)
    return out.select(
        "symbol", "ts", "seq", F.col("funding_rate").alias("rate"), F.col("funding_zone").alias("zone"), "crowd", F.when(n >= 3, F.avg("funding_rate").over(w)).alias("mean"), F.when(n >= 3, F.greatest(F.stddev_pop("funding_rate").over(w), F.lit(0.00001))).alias("deviation")
    )


def with_score(rows: DataFrame, confirmed: float = 1.0) -> DataFrame:
    """The unified score from delta_ratio, rv, price_pct, oi_pct, funding.rate and zone, and imbalance (null: unknown). A depth imbalance beyond a fifth without usual volume is bait; a rate of exactly zero counts as unknown."""
    rate, i = F.col("funding.rate"), F.col("imbalance")
    bait = (F.abs(i) > 0.2) & (F.col("rv") < confirmed)
    no = F.lit(False)
    return C.with_unified_score(
        rows.withColumns(
            {
                "volume_score": C.volume_score(F.col("delta_ratio"), F.col("rv")),
                "oi_score": C.oi_score(F.col("price_pct"), F.col("oi_pct")),
                "funding_score": F.when(rate != 0, C.funding_score(F.col("funding.zone"), F.coalesce("oi_pct", F.lit(0.0)))),
                "book_score": C.book_score(i, no, bait, no, no),
                "is_bait": bait,
            }
        )
    )


def action(total: Column) -> Column:
    """What to do on a score. Fixed names."""
    return ladder((total >= 0.55, "LONG"), (total <= -0.55, "SHORT"), (F.abs(total) < 0.25, "NO TRADE"), (total > 0, "WEAK LONG"), otherwise="WEAK SHORT")


def data_quality(coverage: Column, has_book: Column, oi_count: Column, funding_count: Column) -> Column:
    """Mean over the sources of how much of each there is, 0 to 1."""
    known = lambda x, other: F.when(x, 1.0).otherwise(other)
    return (clip(F.coalesce(coverage, F.lit(0.0)), 0.0, 1.0) + known(has_book, 0.0) + known(oi_count >= 2, 0.5) + known(funding_count >= 1, 0.5)) / 4


def with_warmup(rows: DataFrame, elapsed: Column, trades: Column, books: Column, least_ms: int, least_trades: int, least_books: int) -> DataFrame:
    """warm: whether, at this row or an earlier one of its symbol, enough time had passed and enough trades and books been seen. A latch is the time of its first closing."""
    ready = (elapsed >= least_ms) & (F.coalesce(trades, F.lit(0)) >= least_trades) & (F.coalesce(books, F.lit(0)) >= least_books)
    first = rows.where(ready).groupBy("symbol").agg(F.min("ts").alias("__warm"))
    return rows.join(first, "symbol", "left").withColumn("warm", F.coalesce(F.col("ts") >= F.col("__warm"), F.lit(False))).drop("__warm")
