"""Exact deduplication by a sort of contents.

Texts are normalised, range-partitioned between splitters that Spark samples from
their bytes, and sorted within each partition by Spark's external sort, so that equal
texts are neighbours; a run of neighbours ends where the whole texts differ, and of
each run the row with the smallest identifier stays.

The splitters go through the driver, so they are cut from the first ``HEAD`` bytes and, where
these tie, a hash of the whole text: both are equal for equal texts and of bounded size. Rows
are told apart by the whole text alone. A group of copies that would fill a partition is
known beforehand by a count of hashes; its rows carry one of ``SALTS`` numbers as a last sort key, so that
splitters fall inside it. Its pieces are sorted and compared like any run; only their results (smallest identifier and size) meet then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, stored

#: Bytes of a text in a splitter.
HEAD = 16
#: Pieces of a group too large for a partition.
SALTS = 4096
#: A group of copies with more bytes is cut into pieces, however few rows it has.
HOT_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """Runs of white space (space, tab to carriage return) as one space; null as empty. Only runs that are not one space already are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the ``normalised`` text, ``keep_id`` (the smallest identifier of its equals), ``group_size`` and ``kept``.

    Null texts count as empty, and all empty texts are equal to each other; a text of white space only
    is one space, which differs from the empty one. Exactly one row of each group is kept: of
    rows that repeat the smallest identifier one stays, and rows without identifier
    count as the largest. An empty table gives no rows. Other columns of ``docs``, whatever their names, are ignored.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("normalised"))
    hashed = F.xxhash64("normalised")
    sizes = rows.groupBy(hashed.alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("normalised").cast("long")).alias("bytes"))
    most = docs.count() / partitions
    hot = stored(sizes.where((F.col("n") > 1) & ((F.col("n") > most) | (F.col("bytes") > HOT_BYTES))).select("hash"))
    split = not hot.isEmpty()
    salt = F.when(bit_filter(hot)(F.col("hash")), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(-1) if split else F.lit(-1)
    keyed = rows.select("*", F.substring(F.col("normalised").cast("binary"), 1, HEAD).alias("head"), hashed.alias("hash")).withColumn("salt", salt)

    key = ["head", "hash", "salt"] if split else ["head", "hash"]
    run = Window.partitionBy(*key, "normalised").orderBy(F.asc_nulls_last("id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = keyed.repartitionByRange(*key).select("id", "normalised", "hash", "salt", F.first("id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"), F.row_number().over(run).alias("place"))
    if split:
        runs = _joined(stored(runs))
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return runs.select(F.col("id").alias(id_col), "normalised", "keep_id", "group_size", kept.alias("kept"))


def _joined(runs: DataFrame) -> DataFrame:
    """Pieces of a large group take the smallest identifier and the size of all its pieces. Pieces meet on whole texts; their rows find the result by piece, at most 1 / SALTS of the group each."""
    pieces = stored(runs.where("salt >= 0 and place = 1").select("normalised", "hash", "salt", "keep_id", "group_size"))
    every = pieces.groupBy("hash", "normalised").agg(F.min("keep_id").alias("least"), F.sum("group_size").alias("total"))
    found = pieces.join(every, ["hash", "normalised"]).select("hash", "salt", "normalised", "least", "total")
    joined = runs.where("salt >= 0").join(found, ["hash", "salt", "normalised"])
    large = joined.select("id", "normalised", F.col("least").alias("keep_id"), F.col("total").alias("group_size"), "place")
    return runs.where("salt < 0").select(*large.columns).unionByName(large)
