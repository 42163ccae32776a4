"""Session, weekly and anchored VWAP with bands, place and distance. Sessions are partitions, so the running sums of a long series are dealt out by day or week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder

EPS = 1e-10


def _with_sums(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """vwap, its standard deviation (from 30 bars with volume on), and how many there were; bars without volume repeat what was."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p, v = (F.col("high") + F.col("low") + F.col("close")) / 3, F.when(F.col("volume") > 0, F.col("volume"))
    rows = rows.withColumns({"__v": F.sum(v).over(w), "__pv": F.sum(p * v).over(w), "__ppv": F.sum(p * p * v).over(w), "vwap_bars": F.count(v).over(w)})
    rows = rows.withColumn("vwap", F.col("__pv") / (F.col("__v") + EPS))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__ppv") / F.col("__v") - F.col("vwap") * F.col("vwap")))
    rows = rows.withColumn("vwap_std", F.when((F.col("vwap_bars") >= 30) & (spread > EPS), spread)).drop("__v", "__pv", "__ppv")
    away = (F.col("close") - F.col("vwap")) / (F.col("vwap") + EPS)
    position = ladder((F.col("vwap").isNull(), None), (F.abs(away) <= 0.0001, "AT"), (away > 0, "ABOVE"), otherwise="BELOW")
    return rows.withColumns({"vwap_distance": away, "vwap_sigma": (F.col("close") - F.col("vwap")) / F.col("vwap_std"), "vwap_position": position})


def with_bands(rows: DataFrame, atr_pct: str | None = None) -> DataFrame:
    """Bands at one and two deviations; where there is none, at half and one ATR share of the close, if that is known."""
    share = F.col(atr_pct) if atr_pct else F.lit(None).cast("double")
    narrow = F.coalesce(F.col("vwap_std"), F.when(share > 0, 0.5 * share * F.col("close")))
    wide = F.coalesce(2 * F.col("vwap_std"), F.when(share > 0, share * F.col("close")))
    method = ladder((F.col("vwap_std").isNotNull(), "STD"), (share > 0, "ATR_FALLBACK"), otherwise="NONE")
    v = F.col("vwap")
    return rows.withColumns({"band_1_low": v - narrow, "band_1_high": v + narrow, "band_2_low": v - wide, "band_2_high": v + wide, "band_method": method})


def session(bars: DataFrame, zone: str = "UTC") -> DataFrame:
    return _with_sums(bars.withColumn("session", F.to_date(F.from_utc_timestamp("ts", zone))), ("symbol", "tf", "session"))


def weekly(bars: DataFrame, zone: str = "UTC") -> DataFrame:
    """By ISO year and week."""
    local = F.from_utc_timestamp("ts", zone)
    return _with_sums(bars.withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), local), "iso_week": F.weekofyear(local)}), ("symbol", "tf", "iso_year", "iso_week"))


def anchored(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per bar and anchor from the anchor's time on. anchors: symbol, tf, anchor_id, anchor_time; an id counts once."""
    once = anchors.groupBy("symbol", "tf", "anchor_id").agg(F.min("anchor_time").alias("anchor_time"))
    return _with_sums(bars.join(once, ["symbol", "tf"]).where("ts >= anchor_time"), ("symbol", "tf", "anchor_id"))


def lived(bars: DataFrame, anchors: DataFrame, most: int = 3, removed: DataFrame | None = None, max_bars: int | None = None) -> DataFrame:
    """:func:`anchored` while an anchor lives: until ``most`` newer ones of its series have been set (of one time, the larger id is newer), until a row of ``removed`` (symbol, tf, anchor_id, ts) takes it out, or for ``max_bars`` bars. Each bar meets the anchors that live then and no others: an anchor's life is an interval, and a bar has at most ``most``."""
    once = anchors.groupBy("symbol", "tf", "anchor_id").agg(F.min("anchor_time").alias("anchor_time"))
    if removed is not None:
        once = once.join(removed.groupBy("symbol", "tf", "anchor_id").agg(F.min("ts").alias("until")), ["symbol", "tf", "anchor_id"], "left")
    else:
        once = once.withColumn("until", F.lit(None).cast("timestamp"))
    newest = Window.partitionBy("symbol", "tf").orderBy("anchor_time", "anchor_id").rowsBetween(1 - most, 0)
    lists = once.withColumn("__live", F.collect_list(F.struct("anchor_id", "anchor_time", "until")).over(newest))
    # the list of live anchors as of each bar: both sides sorted once by time, anchors before the bar of their time
    kind = lists.schema["__live"].dataType
    sets = lists.select("symbol", "tf", F.col("anchor_time").alias("ts"), "__live", F.col("anchor_id").alias("__id"), F.lit(0).alias("__side"))
    both = bars.withColumns({"__live": F.lit(None).cast(kind), "__side": F.lit(1)}).unionByName(sets, allowMissingColumns=True)
    seen = Window.partitionBy("symbol", "tf").orderBy("ts", "__side", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("__set", F.last("__live", ignorenulls=True).over(seen)).where("__side = 1")
    rows = rows.select(*bars.columns, F.inline("__set")).where(F.col("until").isNull() | (F.col("ts") < F.col("until"))).drop("until")
    if max_bars is not None:
        own = Window.partitionBy("symbol", "tf", "anchor_id").orderBy("ts", "seq")
        rows = rows.withColumn("__age", F.row_number().over(own)).where(F.col("__age") <= max_bars).drop("__age")
    return _with_sums(rows, ("symbol", "tf", "anchor_id"))


def structure_anchors(rows: DataFrame) -> DataFrame:
    """An anchor at each break of structure: its kind and the close, in cents, name it. Needs structure.with_breaks."""
    event = F.col("structure_event")
    return rows.where(event != "none").select("symbol", "tf", F.concat_ws("@", event, F.round(F.col("close") * 100).cast("long")).alias("anchor_id"), F.col("ts").alias("anchor_time"))
