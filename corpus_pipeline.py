"""The corpus pipeline: documents in, cleaned and tokenised documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, langid, lines
from tidemark.llm.common import scratch, stored, table

#: A text is junk if its shortest code takes more bits than its own bytes and so many more have: names and new words cost a short text that much at most.
MARGIN_BYTES = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language; learned from all labelled rows' bounded sample."""
    with scratch(spark):
        model = langid.fit(docs)
    known = langid.predict(docs, model)
    size = F.octet_length("text")
    junk = (F.col("lang_pred") == langid.UNDETERMINED) | (F.col("bits_per_byte") * size >= 8 * (size + MARGIN_BYTES))
    return known.where(~junk).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; a document that had nothing but these goes."""
    made = lines.dedup(docs)
    made = made.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    columns = [F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return made.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by similar five-word shingles: that with the smallest id. Of rows with the same id one stays; rows without id stay."""
    with scratch(spark) as keep:
        copies = keep(jaccard.group(docs).where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(copies, "doc_id", "left_anti")
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    # The row with the least hash stays: of columns as JSON, since some kinds of column have no order.
    rest = F.struct(*[c for c in docs.columns if c != "doc_id"])
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(rest, F.xxhash64(F.to_json(rest))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once.select("doc_id", "row.*").select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, and the digest of what they decode to."""
    made = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))
    return made.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

#: The language model and the byte-pair merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
