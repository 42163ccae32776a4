"""Whitening of embeddings by shifted Cholesky QR.

The centred rows X (one vector a row) are never gathered. Each pass of the
iteration sends every task the small triangular factors found so far; the task
solves its rows against them and sums its part of the Gram matrix. Parts
are added by row of the matrix, in as many tasks as the shuffle has, and the
driver sees one d x d matrix a pass, whatever the number of vectors. Its Cholesky
factor, of a matrix shifted on the diagonal where the rows may be ill-conditioned, is the pass's
R; passes go on until the rows' Gram matrix is the identity. With X = QR,
R the product of all factors, the singular values of R give the variances and its
right singular vectors the components.

Entries become whole numbers, so that sums, the means' numerators and each vector's
deviation are exact; a row is centred exactly before it is divided. Dimensions that
depend on others to the accuracy of the Gram matrix (constant ones above all) are set aside before the
factorisation and enter R as their products with Q.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: An entry is floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024.0, 100_000
#: Vectors with an entry whose whole number is larger take no part: their sums could leave the numbers that are exact.
LARGEST = 1 << 40
#: A vector has at most so many dimensions: matrices of d x d doubles are held by each task and the driver.
MAX_DIMENSIONS = 4096
#: Columns that a triangular solve takes at a time.
BLOCK = 32
#: Passes at most; three suffice for any rows of full rank.
PASSES = 8
UNIT = float(np.finfo(np.float64).eps) / 2
LONG = (1 << 63) - 1

Rows = Callable[[np.ndarray], np.ndarray]


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and whole-numbered ``x`` of the vectors that take part: those without null or non-finite entries, of entries up to LARGEST, and of the commonest length (the larger of equally common ones). Null identifiers stay."""
    v = F.col("v")
    whole = lambda c: F.floor(c * SCALE) + OFFSET
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(LARGEST >> 1)))
    rows = embeddings.select(embeddings[id_col].alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("v")).where(fine)
    rows = stored(rows.select("vec_id", F.transform("v", lambda c: whole(c).cast("long")).alias("x")))
    commonest = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = commonest.d if commonest else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MAX_DIMENSIONS}")
    return rows.where(F.size("x") == d)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # 2 ** 40 in 2 ** 22 rows fit 64 bits, and a batch has fewer
            if batch.num_rows:
                s = _matrix(batch).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s), pa.array(np.full(len(s), batch.num_rows))], names=["i", "s", "n"])

    total = F.sum(F.col("s").cast("decimal(38,0)"))
    found = rows.select("x").mapInArrow(run, "i long, s long, n long").groupBy("i").agg(total.alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row a dimension
    return (found[0].n if found else 0), [int(r.s) for r in found]


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n, from the exact n * x - s."""
    return _numerators(x, n, s).astype(np.float64) / n


def _numerators(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s: 64-bit numbers where they are sure to fit, else Python's."""
    fits = n * int(np.abs(x).max(initial=0)) < LONG >> 1
    return x * n - s.astype(np.int64) if fits else x.astype(object) * n - s


def _deviation(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row, null beyond 64 bits."""
    if d.dtype == object or (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0) > LONG / 2:
        exact = (d.astype(object) ** 2).sum(axis=1)
        return [int(v) if v <= LONG else None for v in exact]
    return (d**2).sum(axis=1).tolist()


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x R^-1 for upper triangular R, block of columns by block."""
    q = np.empty_like(x)
    for a in range(0, r.shape[0], BLOCK):
        b = min(a + BLOCK, r.shape[0])
        rest = x[:, a:b] - q[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            q[:, j] = (rest[:, j - a] - q[:, a:j] @ r[a:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, left: Rows, right: Rows | None = None) -> np.ndarray:
    """Sum over all rows of left(x)' right(x) (right is left if not given): a part from each task, added by row of the matrix."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                q = left(x)
                part = q.T @ (q if right is None else right(x))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([row.tobytes() for row in total], pa.binary())], names=["i", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), batch.column("part"), strict=True):
                row = np.frombuffer(part.as_buffer())
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([row.tobytes() for row in total.values()], pa.binary())], names=["i", "part"])

    met = rows.select("x").mapInArrow(parts, "i long, part binary").repartition("i").mapInArrow(added, "i long, part binary")
    return np.array([np.frombuffer(r.part) for r in sorted(met.collect(), key=lambda r: r.i)])  # d rows of d numbers


def _independent(g: np.ndarray) -> np.ndarray:
    """Dimensions that no others span, to the accuracy of the Gram matrix: those that a pivoted Cholesky factorisation of the correlations gets to."""
    scale = np.sqrt(np.maximum(np.diag(g), 0.0))
    live = np.flatnonzero(scale > 0)
    c = g[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    least, chosen = 64 * max(len(live), 1) * UNIT, []
    rest = np.diag(c).copy()
    lower = np.zeros((len(live), 0))
    while len(chosen) < len(live):
        p = int(np.argmax(rest))
        if rest[p] <= least:
            break
        column = (c[:, p] - lower @ lower[p]) / np.sqrt(rest[p])
        lower = np.column_stack([lower, column])
        rest = rest - column**2
        chosen.append(p)
        rest[chosen] = -1.0
    return live[sorted(chosen)]


def factorised(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """R of the centred rows: as many rows as their rank, a column for each dimension."""
    sums_ = np.array(s, dtype=object)
    spark = rows.sparkSession.sparkContext

    def orthogonal(used: np.ndarray, factors: list[np.ndarray]) -> Rows:
        held = spark.broadcast((used, factors))  # at most PASSES matrices of MAX_DIMENSIONS squared

        def run(x: np.ndarray) -> np.ndarray:
            columns, found = held.value
            q = _centred(x[:, columns], n, sums_[columns])
            for r in found:
                q = solved(q, r)
            return q

        return run

    everything = np.arange(len(s))
    g = gram(rows, orthogonal(everything, []))
    used = _independent(g)
    k = len(used)
    if not k:
        return np.zeros((0, len(s)))
    g = g[np.ix_(used, used)]
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        shift = 0.0 if factors else 11 * (n * k + k * (k + 1)) * UNIT * np.linalg.norm(g, 2)
        factors.append(_cholesky(g, shift))
        g = gram(rows, orthogonal(used, factors))
        if np.abs(g - np.eye(k)).max() <= 16 * k * UNIT:
            break
    r = np.linalg.multi_dot([*factors[::-1], np.eye(k)]) if len(factors) > 1 else factors[0]
    if k == len(s):
        return r
    out = np.zeros((k, len(s)))
    out[:, used] = r
    others = np.setdiff1d(everything, used)
    out[:, others] = gram(rows, orthogonal(used, factors), orthogonal(others, []))
    return out


def _cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g + shift; the shift grows until there is one."""
    for _ in range(60):
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 11 * len(g) * (len(g) + 1) * UNIT * np.linalg.norm(g, 2))
    raise ArithmeticError("no Cholesky factor")


def components(rows: DataFrame, n: int, s: list[int], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k first unit components (columns), their variances, and the total variance. Each component's largest entry is positive. Those without variance, to working accuracy, are left out."""
    r = factorised(rows, n, s)
    if not len(r):
        return np.zeros((len(s), 0)), np.zeros(0), 0.0
    _, sigma, vt = np.linalg.svd(r, full_matrices=False)
    e = sigma**2 / n
    vt = vt[:k][e[:k] > e[0] * 64 * len(s) * UNIT]
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (vt * signs[:, None]).T, e[: len(vt)], float(e.sum())


def whiten(embeddings: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n``, ``deviation`` (exact, null beyond 64 bits), ``explained`` (share of each component), ``identity_error`` and the ``whitened`` vector of up to k numbers, for each vector that takes part (see ``usable``).

    Repeated rows count each and get a row each. Where fewer than k components have a
    variance the vectors are shorter, and with none (one row, or equal ones) empty; ``identity_error`` is 0 then. An empty table gives no rows. Other columns
    of ``embeddings``, whatever their names, are ignored.
    """
    rows = usable(embeddings, id_col, vector_col)
    n, s = sums(rows)
    v, e, trace = components(rows, n, s, k) if n and s else (np.zeros((len(s), 0)), np.zeros(0), 0.0)
    explained = (e / trace).tolist() if trace else []
    held = rows.sparkSession.sparkContext.broadcast((np.array(s, dtype=object), v / np.sqrt(e)))

    def white(x: np.ndarray) -> np.ndarray:
        sums_, onto = held.value
        return _centred(x, n, sums_) @ onto

    error = float(np.abs(gram(rows, white) / n - np.eye(len(e))).max()) if len(e) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _matrix(batch), batch.num_rows
            w = white(x) if len(e) else np.zeros((m, 0))
            offsets = pa.array(np.arange(m + 1, dtype=np.int32) * w.shape[1])
            vectors = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            deviation = pa.array(_deviation(_numerators(x, n, held.value[0])), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, vectors], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")
    share = F.array(*[F.lit(x) for x in explained]).cast("array<double>")
    return made.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
