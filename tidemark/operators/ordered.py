"""Series cut into chunks, so that ordered work on one series is many tasks.

``numbered`` gives each row its place in its series without bringing the series
together: rows are range-partitioned by series and order, numbered within
their partition, and told where their partition's part of the series begins.
``apart`` cuts numbered series into chunks of a fixed number of rows, each with
the last rows before it, and names the chunk in ``tf``: windows over ``series()``
with a bounded reach, and all operators made of them, then run per chunk as they would over
the series. ``whole`` takes the extra rows out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SERIES
from ..sources.storage import stored

#: Rows of a chunk.
LENGTH = 512
#: Bits of a row's place within a partition, in Spark's increasing ids.
_PLACE = 33


def numbered(df: DataFrame, keys: tuple[str, ...] = SERIES, order: tuple[str, ...] = ("ts", "seq"), name: str = "n", total: str | None = None) -> DataFrame:
    """Adds ``name``, the place of each row in its series from 0 on (ties in any order, but one that stays), and ``total``, if named, the series' number of rows. Rows with a null key are series of their own."""
    rows = stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", _PLACE)
    # a row for each series, and one more for each partition that begins inside one
    heads = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], part.alias("__of")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    if total:
        heads = heads.withColumn("__total", F.sum("__rows").over(Window.partitionBy(*[f"__{k}" for k in keys])))
    same = part == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.join(heads, same)
    return joined.select(*df.columns, (F.col("__id") - F.col("__first") + F.col("__offset")).alias(name), *([F.col("__total").alias(total)] if total else []))


def apart(rows: DataFrame, before: int = 0, length: int = LENGTH) -> DataFrame:
    """Chunks of rows numbered by ``n``: adds ``chunk`` and ``pos`` (negative for the ``before`` rows that belong to the chunk before), and the chunk to ``tf``, whose own value is kept in ``series_tf``."""
    if before >= length:
        raise ValueError(f"{before} rows before a chunk of {length}")
    own = F.floor(F.col("n") / length)
    chunks = F.when(F.col("n") % length >= length - before, F.array(own, own + 1)).otherwise(F.array(own)) if before else F.array(own)
    rows = rows.withColumn("chunk", F.explode(chunks))
    named = F.concat_ws("#", "tf", "chunk")
    return rows.withColumns({"pos": (F.col("n") - F.col("chunk") * length).cast("int"), "series_tf": F.col("tf"), "tf": named})


def whole(rows: DataFrame) -> DataFrame:
    return rows.where("pos >= 0").withColumn("tf", F.col("series_tf")).drop("n", "chunk", "pos", "series_tf")
