"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are weighted terms: component i of a vector is the weight of term i,
left out where it is zero. Rows are packed into blocks of bounded size, and blocks dealt to
the lanes of a grid, as many as their number asks for: each block of queries
goes to all lanes of candidates and the other way round, so that each pair of blocks
meets once, and no task has more than a lane's. There, term by term, every
query row that has the term scatters its weight times the term's postings into
the query's dense array of scores. The best k of each array are selected by
partition, and those of all blocks merged.

Scores are 64-bit integers, exact as long as they fit. Ties go to the smaller
id. Vectors that are null or hold null or non-finite components, or such as
exceed 64 bits once scaled, take no part, nor do rows without id. A candidate with the query's own id is left out. Of rows that repeat a query
id and vector each gets its results; vectors of unequal length are compared on
the terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
#: Blocks of queries, and of candidates, that meet in one lane of the grid.
LANE_BLOCKS = 8
LARGEST = float(1 << 63)


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of ``ids`` and the flat ``weights`` of their vectors (``starts`` has their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, count, made = TaskContext.get().partitionId(), 0, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            vectors = t.column(1).chunk(0) if t.column(1).num_chunks else pa.array([], pa.list_(pa.float64()))
            weights = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            ids = t.column(0).to_numpy()
            starts = np.concatenate([[0], np.cumsum(lengths)])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([starts.astype(np.int64).tobytes()], pa.binary()), pa.array([weights.astype(np.int64).tobytes()], pa.binary())],
                names=["block", "ids", "starts", "weights"],
            )

        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, rows - count)
                at += piece.num_rows
                count += piece.num_rows
                held.append(piece)
                if count == rows:
                    yield block()
                    count, made = 0, made + 1
        if held:
            yield block()

    return df.mapInArrow(run, "block long, ids binary, starts binary, weights binary")


def _postings(starts: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term: the rows that have it, and their weights."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    terms = np.arange(len(weights)) - starts[rows]
    order = np.argsort(terms, kind="stable")
    order = order[weights[order] != 0]
    cuts = np.searchsorted(terms[order], np.arange(1, int(terms.max(initial=-1)) + 1))
    return [(rows[x], weights[x].astype(np.int64)) for x in np.split(order, cuts)]


def _best(query_ids: np.ndarray, queries: list, ids: np.ndarray, candidates: list, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query rows, candidate ids and scores of the best k in this block (ties beyond k not included)."""
    scores = np.zeros((len(query_ids), len(ids)), np.int64)
    for (q_rows, q_weights), (c_rows, c_weights) in zip(queries, candidates, strict=False):
        if len(c_rows) == len(ids):
            for q, w in zip(q_rows.tolist(), q_weights.tolist(), strict=True):
                scores[q] += w * c_weights
        else:
            for q, w in zip(q_rows.tolist(), q_weights.tolist(), strict=True):
                scores[q, c_rows] += w * c_weights  # a term's rows are distinct
    for q, own in enumerate(query_ids.tolist()):
        row, valid = scores[q], np.flatnonzero(ids != own)
        if len(valid) > k:
            least = np.partition(row[valid], len(valid) - k)[len(valid) - k]
            valid = valid[row[valid] >= least]
        valid = valid[np.lexsort((ids[valid], -row[valid]))][:k]
        yield np.full(len(valid), q), ids[valid], row[valid]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best candidates (all, if fewer)."""

    def usable(df: DataFrame) -> DataFrame:
        vector = F.col("v")
        fine: Column = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST))
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & vector.isNotNull() & fine).select("id", F.transform("v", lambda x: x * scale).alias("v"))

    q_lanes, c_lanes = (-(-df.count() // (rows * LANE_BLOCKS)) or 1 for df, rows in ((queries, QUERY_ROWS), (candidates, CANDIDATE_ROWS)))
    c_lanes = max(c_lanes, min(16, 16 // q_lanes))  # some tasks even where there is little to do
    lane = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _packed(usable(queries), QUERY_ROWS).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("starts").alias("q_starts"), F.col("weights").alias("q_weights"), lane(q_lanes).alias("q_lane"), every(c_lanes).alias("c_lane"))
    offered = _packed(usable(candidates), CANDIDATE_ROWS).select("*", lane(c_lanes).alias("c_lane"), every(q_lanes).alias("q_lane"))
    met = asked.join(offered, ["q_lane", "c_lane"]).select("q_block", "q_ids", "q_starts", "q_weights", "ids", "starts", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        for batch in batches:
            for r in range(batch.num_rows):
                q_block, *rest = (batch.column(c)[r] for c in range(7))
                q_ids, q_starts, ids, starts = (array(rest[i], np.int64) for i in (0, 1, 3, 4))
                parts = list(_best(q_ids, _postings(q_starts, array(rest[2], np.int64)), ids, _postings(starts, array(rest[5], np.int64)), k))
                rows, found, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), q_block.as_py())), pa.array(rows), pa.array(q_ids[rows]), pa.array(found), pa.array(scores)], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "q_block long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
