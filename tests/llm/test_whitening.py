"""Whitening against an eigendecomposition in one place."""

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import queries, whitening


def direct(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    d = len(x) * x - x.sum(axis=0)
    centred = d / len(x)
    v = centred.T @ centred / len(x)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    return [int(y) for y in (d.astype(object) ** 2).sum(axis=1)], centred, e[order], u[:, order]


def check(rows, fine, k=8):
    deviation, centred, e, u = direct([v for _, v in fine])
    k = min(k, int((e > e[0] * 1e-12).sum()))
    got = {r.vec_id: r for r in rows}
    assert sorted(got) == [i for i, _ in fine] and [got[i].deviation for i, _ in fine] == deviation
    white = np.array([got[i].whitened for i, _ in fine])
    assert np.allclose(np.abs(white), np.abs(centred @ u[:, :k] / np.sqrt(e[:k])), rtol=1e-6, atol=1e-7)
    first = got[fine[0][0]]
    assert np.allclose(first.explained, e[:k] / e.sum(), rtol=1e-8) and first.identity_error < 1e-8 and first.n == len(fine)
    assert np.abs(white.T @ white / len(fine) - np.eye(k)).max() < 1e-8


def test_query_equals_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_whitening(spark, sf).collect()
    fine = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    deviation, centred, e, u = direct([v for _, v in fine])
    want = centred @ u[:, :8] / np.sqrt(e[:8])
    place = {i: at for at, (i, _) in enumerate(fine)}
    assert len(rows) == 8 * len(fine)
    for r in rows:
        assert r.deviation == deviation[place[r.vec_id]] and r.n == len(fine) and r.identity_error < 1e-8
        assert abs(abs(r.whitened) - abs(want[place[r.vec_id], r.component - 1])) < 1e-6 and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10


def test_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    fine = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 12)) * np.geomspace(1, 1e-2, 12))]
    other = [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1004, [1.0]), (1005, []), (1006, [1e30] * 12)]
    df = spark.createDataFrame(fine + other, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "v", "n", "deviation")})
    check(whitening.whiten(df).collect(), fine)


def test_dependent_and_ill_conditioned_dimensions(spark):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=(300, 4)) * 512)
    dependent = np.column_stack([a, a[:, 0] + a[:, 1], np.full(300, 7.0), 2 * a[:, 2]])  # rank 4 of 7
    near = np.column_stack([a * 1e3, a[:, 0] * 1e3 + rng.integers(0, 2, 300)])  # variances a factor of 1e12 apart
    for x, k in ((dependent, 8), (near, 4)):
        fine = [(i, (v / 1024).tolist()) for i, v in enumerate(x)]
        check(whitening.whiten(spark.createDataFrame(fine, "vec_id long, embedding array<double>"), k=k).collect(), fine, k)


def test_few_or_equal_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.whitened, r.deviation, r.n, r.identity_error) for r in whitening.whiten(one).collect()] == [([], 0, 3, 0.0)] * 3
    assert whitening.whiten(one.where("false")).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert np.allclose(sorted(r.whitened[0] for r in whitening.whiten(two).collect()), [-1, 1])


def test_exact_beyond_64_bits():
    x = np.array([[1 << 40], [-(1 << 40)]])
    d = whitening._numerators(x, 1 << 30, np.array([3], dtype=object))
    assert d.dtype == object and int(d[0, 0]) == (1 << 70) - 3
    assert whitening._deviation(d) == [None, None] and whitening._deviation(np.array([[3, 4]])) == [25]
    assert whitening._deviation(np.array([[3_037_000_499]])) == [3_037_000_499**2]
