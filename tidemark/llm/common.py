"""Small helpers that the operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a local session without a setting.
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is unset, a folder of this machine is used in local mode, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        base = _local[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go at its end, instead of when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables, with their folders, of each scratch that is open in this thread, the innermost last.
_scratches: ContextVar[tuple[dict[DataFrame, str], ...]] = ContextVar("scratches", default=())


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def _stored(df: DataFrame, tables: dict[DataFrame, str] | None) -> DataFrame:
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    with _without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(f"{folder}/part")
    table = spark.read.schema(df.schema).parquet(f"{folder}/part")
    if tables is not None:
        tables[table] = folder
    return table


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there. Its files go with the innermost open scratch; without one, they stay."""
    return _stored(df, next(reversed(_scratches.get()), None))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within go at its end, and each query's shuffle files at the query's end.

    It gives a function that stores a frame for the scratch around this one (or to
    stay). What is read later must rest on such frames alone.
    """
    around, own = _scratches.get(), {}
    token = _scratches.set((*around, own))
    try:
        with _without_shuffles(spark):
            yield lambda df: _stored(df, around[-1] if around else None)
    finally:
        _scratches.reset(token)
        for folder in own.values():
            _remove(spark, folder)


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more before their scratch ends. Other frames are passed over."""
    for table in tables:
        for own in _scratches.get():
            if folder := own.pop(table, None):
                _remove(table.sparkSession, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Longest array of 64-bit words in a native filter: 8 MB.
MAX_WORDS_LOG2 = 20


def bit_filter(keys: DataFrame) -> Callable[..., Column]:
    """A membership test for rows of ``keys``, with DataFrame functions only: a function of columns like those of ``keys``.

    It is true for every row of ``keys`` and for few others, and serves to leave
    out before a shuffle what the join after it leaves out anyway. Its bits are an
    array in a scalar subquery, 16 a key but never more than 2 ** MAX_WORDS_LOG2
    words, whatever the number of keys; beyond that it only lets more through.
    """
    spark = keys.sparkSession
    with scratch(spark) as keep:
        keys = stored(keys.distinct())
        log2 = min(MAX_WORDS_LOG2, max(4, math.ceil(math.log2(max(keys.count(), 1) / 4))))

        def place(*columns: Column) -> tuple[Column, Column]:
            h = F.xxhash64(F.lit(11), *columns)
            return F.shiftrightunsigned(h, 64 - log2).cast("int"), h.bitwiseAND(63).cast("int")

        word, bit = place(*[F.col(f"`{c}`") for c in keys.columns])
        masks = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("m"))
        every = spark.range(1 << log2).select(F.col("id").cast("int").alias("w")).join(masks, "w", "left")
        words = keep(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m")))), lambda x: x["m"]).alias("words")))

    def has(*columns: Column) -> Column:
        w, b = place(*columns)
        return F.call_function("shiftright", F.get(words.select("words").scalar(), w), b).bitwiseAND(1) == 1

    return has


#: Copies of a row that meets a hot key's rows.
SALTS = 64


def hot_join(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) of many rows with a table that has each key once. Rows of the keys in ``hot`` are dealt to SALTS tasks by the hash of the columns ``by``, and the table's rows of these keys copied to each."""
    is_hot = bit_filter(hot)
    flag = lambda: is_hot(*[F.col(f"`{c}`") for c in on])
    salted = rows.withColumn("__salt", F.when(flag(), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = other.withColumn("__salt", F.explode(F.when(flag(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def rows_of(batches: Iterator[pa.RecordBatch], size: int, chars: int = 4 << 20) -> Iterator[list[list]]:
    """Columns of Python values, cut to at most ``size`` rows (and about ``chars`` bytes) at a time."""
    for batch in batches:
        start = 0
        n = batch.num_rows
        while start < n:
            step = min(size, n - start)
            while step > 1 and batch.slice(start, step).get_total_buffer_size() > chars and _nbytes(batch, start, step) > chars:
                step = (step + 1) // 2
            piece = batch.slice(start, step)
            yield [c.to_pylist() for c in piece.columns]
            start += step


def _nbytes(batch: pa.RecordBatch, start: int, step: int) -> int:
    return batch.slice(start, step).nbytes


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ``[^\\x20\\x09-\\x0D]+``, null as no words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
