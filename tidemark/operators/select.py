"""Choice of instruments: eligibility, liquidity filters and the tradability score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ladder

#: Parts of names that mark leveraged and index products.
EXCLUDED = ("UP", "DOWN", "BEAR", "BULL", "DEFI", "MOVE")

def eligible(symbols: DataFrame) -> DataFrame:
    """Trading perpetuals quoted in USDT, without excluded names."""
    return symbols.where((F.col("status") == "TRADING") & (F.col("contract_type") == "PERPETUAL") & (F.col("quote_asset") == "USDT") & ~F.col("symbol").rlike("|".join(EXCLUDED)))

def with_liquidity(tickers: DataFrame, books: DataFrame, share: float = 0.30, max_spread: float = 0.03) -> DataFrame:
    """Tickers with their best quotes and what keeps them out: volume below the top ``share`` (an interpolated percentile over positive volumes), no book, or spread."""
    cut = tickers.where("quote_volume > 0").agg(F.expr(f"percentile(quote_volume, {1 - share})").alias("cut")).scalar()
    rows = tickers.join(books, "symbol", "left")
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = rows.withColumn("spread_pct", F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("ask") - F.col("bid")) / mid * 100))
    reason = ladder((F.col("quote_volume") < cut, "volume"), (F.col("spread_pct").isNull(), "book"), (F.col("spread_pct") > max_spread, "spread"), otherwise="passed")
    return rows.withColumn("filter_result", reason)

def volatility_score(x: Column, low: float = 0.02, best: float = 0.04, high: float = 0.08) -> Column:
    inside = 1 - F.abs(x - best) / max(best - low, high - best) * 0.3
    return clip(ladder((x < 0, 0.0), (x.between(low, high), inside), (x < low, x / low * 0.5), otherwise=0.7 * F.exp((high - x) * 20)), 0.0, 1.0)

def cleanliness_score(change: Column, volume_share: Column) -> Column:
    c = F.abs(change)
    return ladder(((c > 10) & (volume_share < 0.4), 0.3), (c > 15, 0.5), (c < 2, 0.85), (c < 5, 1.0), otherwise=0.9 - (c - 5) / 100)

def crowd_score(funding: Column) -> Column:
    p = F.abs(funding * 100)
    return ladder((funding.isNull(), 0.5), (p < 0.01, 1.0), (p < 0.05, 0.9), (p < 0.1, 0.7), otherwise=0.7 * F.exp((0.1 - p) * 10))

def scored(rows: DataFrame) -> DataFrame:
    """Component scores and their weighted sum. The shares of values up to one's own run over all instruments that passed, which are a few hundred."""
    share = lambda x: F.cume_dist().over(Window.orderBy(x))
    rows = rows.withColumns({"volume_share": share("quote_volume"), "spread_share": share("spread_pct"), "depth_share": share(F.col("bid_qty") + F.col("ask_qty"))})
    range_share = F.when(F.col("last") > 0, (F.col("high") - F.col("low")) / F.col("last")).otherwise(0.0)
    quoted = (F.col("spread_pct") >= 0) & (F.col("bid_qty") > 0) & (F.col("ask_qty") > 0)
    rows = rows.withColumns(
        {
            "participation": F.when(F.col("quote_volume") > 0, F.pow("volume_share", F.lit(0.8))).otherwise(0.0),
            "liquidity": F.when(quoted, clip(0.7 * (1 - F.col("spread_share")) + 0.3 * F.col("depth_share"), 0.0, 1.0)).otherwise(0.0),
            "volatility": volatility_score(range_share),
            "cleanliness": cleanliness_score(F.col("change_pct"), F.col("volume_share")),
            "crowd": crowd_score(F.col("funding_rate") if "funding_rate" in rows.columns else F.lit(None).cast("double")),
        }
    )
    total = 0.35 * F.col("participation") + 0.25 * F.col("liquidity") + 0.2 * F.col("volatility") + 0.1 * F.col("cleanliness") + 0.1 * F.col("crowd")
    gate = (F.col("participation") >= 0.6) & (F.col("liquidity") >= 0.6) & (F.col("spread_pct") <= 0.03)
    return rows.withColumns({"tradability": total, "trade_allowed": gate})

def best(tickers: DataFrame, books: DataFrame, symbols: DataFrame, n: int = 10, max_spread: float = 0.03) -> DataFrame:
    """The n best eligible instruments, ties by name."""
    rows = with_liquidity(tickers.join(eligible(symbols).select("symbol"), "symbol", "left_semi"), books, max_spread=max_spread).where("filter_result = 'passed'")
    return scored(rows).orderBy(F.desc("tradability"), "symbol").limit(n)
