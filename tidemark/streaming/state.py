"""Kernels in a stream, sliding aggregates and duplicates.

A stream runs the very kernels of the batch scans: a series' kernel is kept as
its pickled state, updated by each micro-batch's rows in order. Rows must reach
the stream in order across micro-batches, as with any arrival-order engine; rows
of one micro-batch are sorted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..operators.scan import Kernel, _values


def stream_scan(df: DataFrame, kernel: Callable[[], Kernel], keys: tuple[str, ...] = ("symbol", "tf"), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """All columns of a stream and those that the kernel makes, one row per row."""
    sample = kernel()
    names = [n for n, _ in sample.makes]
    schema = StructType([*df.schema.fields, *[StructField(n, _parse_datatype_string(t)) for n, t in sample.makes]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else kernel()
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        columns = [_values(rows[c]) for c in sample.reads]
        made = [own.step(*values) for values in zip(*columns, strict=True)]
        state.update((pickle.dumps(own),))
        yield pd.concat([rows, pd.DataFrame(made, columns=names, index=rows.index, dtype=object)], axis=1)

    return df.groupBy(*keys).applyInPandasWithState(update, schema, "kernel binary", "append", "NoTimeout")


def sliding_delta(trades: DataFrame, length: str = "60 seconds", slide: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Signed volume of sliding event-time windows, final once the watermark has passed them."""
    signed = F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))
    windows = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, slide).alias("w"))
    return windows.agg(F.sum(signed).alias("delta"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades")).select("symbol", F.col("w.end").alias("ts"), "delta", "volume", "trades")


def deduplicated(trades: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each trade id of a symbol once, within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "trade_id"])
