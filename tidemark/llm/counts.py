"""Token counts as delta-maintained rollups.

Changes come as signed rows: an insert adds a document's tokens to the totals of
its source, language and tokenizer version, a delete takes them off, and a
revised count takes the old one off and adds the new one. Each batch of changes
is summed up, map side first, before it is committed: the rollup of a batch is
a few rows, whatever the batch. A batch is committed under its own id as one
partition; to commit it again replaces that partition by the same rows, so a
repeated or retried commit changes nothing. The totals are the sums over all
batches; ``fold`` writes them as the single batch of a new rollup.

Null sources and languages are groups of their own, a null text has no tokens.
Groups whose sums are all zero are left out of the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: patterns whose matches are counted.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def token_count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows of documents with source, lang, tokenizer and tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Put the batch's sums in its own partition, in place of what is there."""
        # A row of zeros keeps the partition there, so that a batch without changes replaces what was committed under its id.
        none = self.spark.createDataFrame([(None, None, None, 0, 0)], _SCHEMA.removesuffix(", batch string"))
        sums = changes.select(*KEYS, "docs", "tokens").union(none).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def batches(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.folder)
        except AnalysisException:  # nothing was committed
            return self.spark.createDataFrame([], _SCHEMA)

    def totals(self) -> DataFrame:
        sums = self.batches().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def fold(self, folder: str, batch: str = "folded") -> Rollup:
        """The same totals as one batch of a new rollup; this one stays as it is."""
        folded = Rollup(self.spark, folder)
        folded.commit(batch, self.totals())
        return folded
