"""Each stage of the pipeline against a brute-force version, on a small corpus with planted cases."""

import os
import random
import time
import uuid

import corpus_pipeline
import pytest
from tidemark.llm import common, decontaminate, jaccard


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "ro", "mi", "te", "lu"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(25)) for _ in range(n))
    item = " ".join(word() for _ in range(25))
    docs = [(i, text(6)) for i in range(40)]
    docs += [(100, docs[3][1]), (101, " ".join(docs[5][1].replace("\n", " ").split()[:-2] + ["zz", "yy"])), (102, text(2) + " " + item + " " + text(2)), (103, None), (104, "123 456"), (105, docs[7][1].split("\n")[0] + "\n" + text(3)), (None, text(3))]
    rows = [(i, t, "aa" if k % 5 else None, "src", len(t or "")) for k, (i, t) in enumerate(docs)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(docs)


def stage(spark, corpus, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, corpus[0])


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    kept = stage(spark, corpus, "language ID", docs)
    assert kept.columns == docs.columns and texts(kept) == {i: t for i, t in corpus[1].items() if i not in (103, 104)}
    lines = stage(spark, corpus, "line dedup", kept)
    found = texts(lines)
    assert lines.columns == docs.columns and set(found) == set(texts(kept)) - {100}
    assert found[105] == "\n".join(corpus[1][105].split("\n")[1:])
    assert all(found[i] == corpus[1][i] for i in found if i != 105)
    groups = stage(spark, corpus, "n-gram Jaccard join", lines)
    sets = {i: set(jaccard.shingles(t, 5).tolist()) for i, t in found.items() if i is not None}
    linked = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0}
    assert linked == {101} and set(texts(groups)) == set(found) - linked
    clean = stage(spark, corpus, "benchmark decontamination", groups)
    assert set(texts(clean)) == set(texts(groups)) - {102}
    tokens = stage(spark, corpus, "BPE encoding and decoding", clean)
    assert tokens.count() == clean.count()


def test_run(spark, corpus):
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus[0]).collect()} == set(corpus[1]) - {100, 101, 102, 103, 104}


def test_repeated_rows_and_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    twice = docs.where("doc_id < 3").union(docs.where("doc_id < 3"))
    assert sorted(texts(stage(spark, corpus, "n-gram Jaccard join", twice))) == [0, 1, 2]
    assert stage(spark, corpus, "n-gram Jaccard join", twice).count() == 3
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), corpus[0]).count() == 0, name


def test_clean_documents_hold_no_item(corpus):
    index = decontaminate.Items([(1, "a b c d e f g")])
    assert not index.matches(corpus[1][0], 0.8)


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared/{uuid.uuid4().hex}")
    return f"{tmp_path}/shared"


def shuffle_files(spark):
    time.sleep(1)  # they go in the background
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_spent_tables_and_shuffles_go(spark, corpus, folder):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    before = shuffle_files(spark)
    lines = stage(spark, corpus, "line dedup", docs)
    assert len(os.listdir(folder)) <= 3  # dropped lines, and the filter of their documents
    groups = stage(spark, corpus, "n-gram Jaccard join", docs)
    assert len(os.listdir(folder)) <= 3 + 2  # copies, and repeated ids
    assert not shuffle_files(spark) - before
    # What is left is all that the results rest on.
    assert lines.count() > 0 and 100 not in texts(groups)


def test_scratch(spark, folder):
    setting = spark.conf.get(common.SHUFFLES_GO, None)
    with common.scratch(spark) as stay:
        with common.scratch(spark) as keep:
            spent, kept, last = common.stored(spark.range(3)), keep(spark.range(4)), stay(spark.range(5))
            assert len(os.listdir(folder)) == 3
            common.drop(spent, last, spark.range(3))
            assert len(os.listdir(folder)) == 2
        assert kept.count() == 4 and len(os.listdir(folder)) == 2
    assert last.count() == 5 and len(os.listdir(folder)) == 1
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.stored(spark.range(3))
        1 / 0
    assert len(os.listdir(folder)) == 1 and common.stored(spark.range(6)).count() == 6 and len(os.listdir(folder)) == 2
    assert spark.conf.get(common.SHUFFLES_GO, None) == setting
