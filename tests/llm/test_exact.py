"""Exact deduplication against groups in one place."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tidemark.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out.append((i, text, keep, len(ids), n == 0))
    return sorted(out, key=repr)


def rows_of_all_kinds():
    rows = [(i, t) for i, t in enumerate(["", None, " ", "\t\n", "a b", "a  b", "a b", "a\x0bb", " a b", "A b", "a b ", "x" * 200_000 + "1", "x" * 200_000 + "2", "x" * 200_000 + " 1", "x" * 200_000 + "\r\n1"])]
    rows += [(1000 - i, "hot  copy" if i % 2 else "hot copy") for i in range(500)] + [(None, "hot copy"), (None, "no id"), (None, "no  id"), (501, "hot copy"), (77, "twice"), (77, "twice")]
    return rows + [(2000 + i, f"text {i % 60}") for i in range(150)]


@pytest.mark.parametrize("hot_bytes", [64 << 20, 300, -1])
def test_groups(spark, monkeypatch, hot_bytes):
    monkeypatch.setattr(exact, "HOT_BYTES", hot_bytes)
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *[F.lit(1).alias(c) for c in ("id", "hash", "salt", "normalised", "keep_id", "kept")])
    got = sorted(map(tuple, exact.dedup(df).collect()), key=repr)
    assert got == expected(rows)


def test_nothing_and_other_names(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert exact.dedup(df, "a", "b").collect() == [] and exact.dedup(df, "a", "b").columns[0] == "a"
    one = spark.createDataFrame([("z", "q"), ("b", " q"), ("a", "q")], "a string, b string")
    assert {r.a: (r.keep_id, r.kept) for r in exact.dedup(one, "a", "b").collect()} == {"z": ("a", False), "a": ("a", True), "b": ("b", True)}


def test_a_large_group_is_cut_into_pieces(spark):
    """No sorted run holds a group that would fill a partition."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact.dedup(df)
    assert out.where("kept").count() == 4000 - 1334 + 1 and out.where("group_size = 1334 and keep_id = 0").count() == 1334
    pieces = [f for f in out._jdf.queryExecution().toString().split("\n") if "SortMergeJoin" in f or "BroadcastHashJoin" in f]
    assert pieces  # the pieces' results are joined back
