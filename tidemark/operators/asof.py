"""As-of alignment of a slow series with a fast one, without pairing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, value: str, nearest: bool = False, key: str = "symbol") -> DataFrame:
    """``left`` (symbol, ts, seq) with the ``value`` of ``right`` (symbol, ts) last known at its time: a union sorted once by key and time. With ``nearest`` the closer of the last and the next one, the earlier if they tie. Null where there is none."""
    names = left.columns
    entry = F.struct(F.col("ts").alias("at"), F.col(value).alias("v"))
    kind = right.select(entry.alias("e")).schema["e"].dataType
    both = left.withColumn("__e", F.lit(None).cast(kind)).withColumn("__side", F.lit(1)).unionByName(right.select(key, "ts", entry.alias("__e"), F.lit(0).alias("__side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "__side")
    before = F.last("__e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # backwards, so that the frame grows with the rows; a value of the row's own time is known before and not needed here
    after = F.last("__e", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("__b", before)
    if nearest:
        rows = rows.withColumn("__a", after)
        gap: Column = lambda e: F.abs(F.unix_micros(F.col("ts")) - F.unix_micros(F.col(f"{e}.at")))
        chosen = F.when(F.col("__b").isNull() | (gap("__a") < gap("__b")), F.coalesce("__a", "__b")).otherwise(F.col("__b"))
    else:
        chosen = F.col("__b")
    return rows.where("__side = 1").withColumn("__c", chosen).select(*names, F.col("__c.v").alias(value), F.col("__c.at").alias(f"{value}_at"))
