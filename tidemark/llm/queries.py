"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, counts, decontaminate, exact, jaccard, langid, licenses, lines, repair, topk, warc, whitening
from .common import shared_dir, stored, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those dropped as repeated, and the digest of the text that stays."""
    made = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose crc32(doc_id) mod 3 isn't 1; the others are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its most similar window."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, those of good quality are counted anew by the second tokenizer, toxic ones go. The first batch is committed twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("doc_id is not null")
    one, two = counts.TOKENIZERS
    counted = stored(docs.select("doc_id", "source", "lang", *[counts.token_count(F.col("text"), t).alias(t) for t in (one, two)]))
    by = lambda rows, t: rows.select("source", "lang", F.lit(t).alias("tokenizer"), F.col(f"`{t}`").alias("tokens"))
    good = counted.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    toxic = labels.where("toxic = 1").select("doc_id")
    gone = counted.join(toxic, "doc_id", "left_semi")
    gone_good = good.join(toxic, "doc_id", "left_semi")
    gone_other = gone.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_anti")
    rollup = counts.Rollup(spark, shared_dir(spark))
    rollup.commit("insert", counts.inserts(by(counted, one)))
    rollup.commit("recount", counts.revisions(by(good, one), by(good, two)))
    rollup.commit("delete", counts.deletes(by(gone_good, two).union(by(gone_other, one))))
    rollup.commit("insert", counts.inserts(by(counted, one)))
    return rollup.totals()


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256.0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles and index go to the shared folder, and the rows are what is read back from there."""
    folder = shared_dir(spark)
    warc.write(warc.with_decisions(table(spark, sf_dir, "pages")), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The tool that op9's messages call.
ANSWER_SCHEMA = [("answer", "chars", "BIGINT", True), ("answer", "text", "STRING", True), ("answer", "turn", "BIGINT", False)]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as a call of a tool that answers, after the answer two turns before; the turn after it is its result."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    text = F.col("text")
    call = F.struct(
        name(F.col("turn")).alias("id"),
        F.lit("answer").alias("name"),
        F.struct("turn", "text", F.char_length("text").alias("chars")).alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("after"),
    )
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    results = turns.where("role <> 'assistant' and turn > 0").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), text.alias("content"))).alias("text"))
    linked = chat.link(calls.union(results), chat.schema_rows(spark, ANSWER_SCHEMA))
    return linked.select("conv_id", "call_id", "place", "status", "problem", F.octet_length("json").cast("long").alias("json_bytes"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "dice", "place")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with nulls as one space, damaged by the remainder of crc32(conv_id:turn) by 20: 0 drops a row, 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    blank = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), blank) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest edits that mend it, and the digest of what they make. Conversations of which damage leaves nothing have zeros, no edits and the digest of nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = repair.repair(damaged(turns))
    told = repair.with_conversation(repair.with_conversation(turns.select("conv_id").distinct(), made.counts), repair.digests(repair.repaired(made.turns)))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on each of the first eight components of all vectors, scaled to unit variance; components without variance are left out."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8)
    one = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = made.select("vec_id", "n", "deviation", "identity_error", one)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays for it, the number of its equals, and the digest of its normalised text."""
    made = exact.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.col("normalised").cast("binary"), 256).alias("text_sha256"))


def queries() -> dict[str, Query]:
    every = (
        op1_bpe, op2_line_dedup, op3_language_id, op4_decontaminate, op5_ngram_jaccard, op6_token_counts, op7_topk, op8_warc, op9_chat, op10_licenses, op11_repair, op12_whitening, op13_exact_dedup,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
