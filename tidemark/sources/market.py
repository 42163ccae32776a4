"""Domain tables: trades, bars, open interest, funding and order books.

The readers map the driver's tables to the engine's schemas; each is a plain
DataFrame, so filters and column choices reach the parquet scan. ``ts`` is a UTC
timestamp, ``seq`` breaks ties of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalized_symbol, safe_divide
from ..operators.ordered import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol, ts, seq, price."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


#: Columns that put a symbol's trades in order.
_TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades; trade_id numbers a symbol's rows from 1, in the order of all their columns, by ranges of these."""
    rows = numbered(table(spark, sf_dir, "lineitem"), ("l_returnflag",), _TRADE_ORDER)
    return rows.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("n") + 1).alias("trade_id"),
        safe_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_linestatus") == "F").alias("is_buyer_maker"),
    )


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of order prices by status."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("symbol"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return rows.agg(F.sum("o_totalprice").alias("open_interest"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")).withColumn("seq", F.lit(0).cast("long")).withColumn("tf", F.lit("1d"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as funding prints of their type."""
    return event_ticks(spark, sf_dir).select("symbol", "ts", "seq", ((F.col("price") - 100) / 1e5).alias("funding_rate"), F.col("price").alias("mark_price"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's odd lines as bids (best first), its even ones as asks."""
    rows = table(spark, sf_dir, "lineitem").withColumn("level", F.struct(safe_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty")))
    side = rows.groupBy(F.col("l_orderkey").alias("book_id")).agg(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, F.col("level"))))).alias("bids"),
        F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.col("level")))).alias("asks"),
        F.min("l_shipdate").cast("timestamp").alias("ts"),
    )
    return side


def candles_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars from JSON lines with symbol, tf, ts (epoch milliseconds) and OHLCV."""
    schema = "symbol string, tf string, ts long, seq long, open double, high double, low double, close double, volume double, quote_volume double, trades long"
    return spark.read.schema(schema).json(path).withColumn("ts", F.timestamp_millis("ts")).withColumn("symbol", normalized_symbol(F.col("symbol")))


def trades_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Exchange trade messages with the short field names s, T, a, p, q and m."""
    raw = spark.read.schema("s string, T long, a long, p string, q string, m boolean").json(path)
    return raw.select(normalized_symbol(F.col("s")).alias("symbol"), F.timestamp_millis("T").alias("ts"), F.col("a").alias("trade_id"), F.col("p").cast("double").alias("price"), F.col("q").cast("double").alias("quantity"), F.col("m").alias("is_buyer_maker"))
