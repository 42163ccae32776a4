"""Operators on texts against brute force on small fixtures, with odd rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
import numpy as np
from tidemark.llm.membership import mixed
from tidemark.llm import bpe, decontaminate, jaccard, langid, lines
from tidemark.llm.components import components
from tokenizers import Tokenizer

ODD = [None, "", " ", "\n\n", "\t x", "a" * 3000, "é" * 500, "one\r\ntwo", "\x00\x1f", "日本語 🎉 word", "<|endoftext|> a<|endoftext|>"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, texts, lang=None):
    rows = [(i, t, lang or "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def changed(rng, text, edits, alphabet="abcé "):
    s = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0 and s:
            s.pop(min(at, len(s) - 1))
        elif kind == 1:
            s.insert(at, rng.choice(alphabet))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(alphabet)
    return "".join(s)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_bpe_equals_the_library_and_returns_the_text(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcde \n'stéß1 2🎉　<|>") for _ in range(rng.randrange(300))) for _ in range(60)]
    library = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), TOKENIZER, keep=("lang",)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(got[i].ids)).cast("I")) == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode(documents(spark, texts), TOKENIZER)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, TOKENIZER).collect()} == {i: r.decoded for i, r in got.items()}


def test_bpe_clashing_names_repeated_rows_small_slices_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    df = documents(spark, ["one two three " * 50, None, "", "x"]).select("doc_id", "text").withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1), "part.of": F.lit(2)})
    df = df.union(df)
    got = bpe.round_trip(df, TOKENIZER, keep=("n_tokens", "ids", "doc_id", "part.of"))
    assert got.columns == ["doc_id", "part.of", "ids", "n_tokens", "decoded"]
    library = Tokenizer.from_file(TOKENIZER)
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in df.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got.collect()) == want and len(want) == 8
    assert bpe.round_trip(df.where("false"), TOKENIZER).count() == 0


def test_bpe_slices_hold_all_rows_within_the_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLICE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5000, 1, 400, 400, 400, 900, 2)] + ["b"] * 90})
    pieces = list(bpe._slices(batch, 50))
    assert pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert all(p.num_rows <= 50 and (p.num_rows == 1 or p.nbytes <= 1000) for p in pieces)


def test_bpe_long_words_merge_as_short_ones():
    codec = bpe.codec(TOKENIZER)
    rng = random.Random(5)
    for _ in range(50):
        word = "".join(rng.choice("abcdeé1") for _ in range(rng.randrange(1, 120))).encode()
        assert codec.merge_long(word) == codec.merge_short(word)


def test_language_id_learns_and_marks_texts_without_letters(spark):
    rng = random.Random(2)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    kinds = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "ung", "ent"], "cc": ["eau", "ille", "que"]}
    rows = [(i, make(kinds[lang]), lang) for i, lang in enumerate(list(kinds) * 30)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, make(kinds["bb"]), None), (None, make(kinds["aa"]), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(df.where("doc_id < 60"))
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 90)
    assert out[903].lang_pred == "bb" and out[None].lang_pred == "aa"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_id_code_length_is_exact():
    model = langid.Ppm({"aa": langid.count_contexts(Counter({b"aba": 2, b"ab": 1})), "bb": langid.count_contexts(Counter({b"zz": 1}))})
    tree = langid.count_contexts(Counter({b"aba": 2, b"ab": 1}))

    def cost(word):
        import math

        s, total = b" " + word + b" ", 0.0
        for i in range(1, len(s)):
            for k in range(min(langid.ORDER, i), -1, -1):
                node = tree.get(s[i - k : i])
                if node is None:
                    continue
                n, q = sum(node.values()), len(node)
                if s[i] in node:
                    total += math.log2((n + q) / node[s[i]])
                    break
                total += math.log2((n + q) / q)
            else:
                total += 8
        return total

    text = b"aba ab zq abab"
    assert model.code_lengths([text, b""])[0][0] == pytest.approx(sum(cost(w) for w in text.split()))


def test_language_id_without_training_rows(spark):
    df = documents(spark, ["hello"])
    assert langid.predict(df, langid.fit(df.where("false"))).first().lang_pred == "und"


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [(a, changed(rng, a, rng.randrange(6))) for a in ("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 30))) for _ in range(400))]
    df = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string")
    assert df.where(lines.within(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0


@pytest.mark.parametrize("edits,least", [(1, 8), (2, 13)])
def test_line_dedup(spark, edits, least):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 40))) for _ in range(25)]
    rows = [(d, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(6)))) for d in range(80)]
    rows += [(500, None), (501, ""), (None, base[0]), (502, "\n\n"), (503, base[3] * 400), (504, base[3] * 400 + "x")]
    seen, want = [], {}
    for doc, text in rows:
        kept, gone = [], 0
        for line in (text or "").split("\n") if doc is not None else []:
            x = line.strip(" ")
            near = lambda y: min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and (len(x) < 100 and distance(x, y) <= edits or len(x) > 100 and x.startswith(y))  # noqa: B023, E731
            if x and any(x == y or near(y) for y in seen):
                gone += 1
            else:
                kept.append(line)
            seen.append(x)
        want[doc] = (text if doc is None or text is None else "\n".join(kept), gone)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    assert {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup(df, edits, least).collect()} == want


def test_line_dedup_of_lines_that_share_nearly_all(spark):
    """Hundreds of lines with the same beginning and end, so that they meet by single characters."""
    rng = random.Random(4)
    frame = lambda x: f"the common beginning of a line, number {x} of a great many, and its end"
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.choice([3, 4]))) for _ in range(400)]
    rows = [(i, frame(x) + ("" if i % 7 else " ")) for i, x in enumerate(numbers)]
    want = {i for i, x in enumerate(numbers) if any(distance(x, y) <= 1 for y in numbers[:i])}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__dropped", F.lit(1))
    made = lines.dedup(df).collect()
    assert {r.doc_id for r in made if r.n_dropped} == want and 0 < len(want) < len(rows)
    assert all(r["__dropped"] == 1 for r in made)


def test_line_dedup_of_repeated_ids(spark):
    """Rows with one id are one document: what is dropped from one is dropped from both."""
    long = "a line that is long enough to be compared"
    rows = [(1, long), (2, f"new words that stand here alone\n{long}"), (2, f"new words that stand here alone\n{long}"), (3, "}\n}"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in lines.dedup(df).collect()) == [(1, long, 0), (2, "new words that stand here alone", 1), (2, "new words that stand here alone", 1), (3, "}", 1), (4, "", 0)]
    assert lines.dedup(df.where("false")).count() == 0


def grouped(rows, n, percent):
    sets = {i: set(jaccard.shingles(t, n).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("frequent", [4, 1000])
def test_jaccard_groups(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 8, 30, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(300):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(9001, None), (9002, ""), (9003, " \t "), (9004, "A b"), (9005, "a  B"), (9006, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group(df, 4, 85).collect()} == grouped(rows, 4, 85)


def test_jaccard_words_are_those_of_the_contract():
    text = "Ab\x0bcd  EF gh É é\x1f\n"
    words = ["ab", "cd", "ef gh", "É", "é\x1f"]
    one = lambda ws: jaccard.shingles(" ".join(ws), 1)
    assert jaccard.shingles(text, 1).tolist() == one(words).tolist() and len(one(words)) == 5
    assert jaccard.shingles("a b", 4).tolist() == jaccard.shingles("A\tB", 4).tolist() != jaccard.shingles("a c", 4).tolist()


def test_jaccard_empty_table(spark):
    assert jaccard.group(documents(spark, ["x"]).where("false")).count() == 0


def test_shingles_of_patterned_words():
    """Words that sums of powers can't tell apart."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
        assert jaccard.shingles(a, 1).tolist() != jaccard.shingles(b, 1).tolist()


def test_jaccard_of_repeated_ids(spark):
    """All rows of an id are in one component, with what each of them links to."""
    w, v, u = ("one two three four five", "six seven eight nine ten", "red green blue white black")
    rows = [(5, w), (9, w), (9, v), (7, v), (7, None), (3, None), (8, u), (8, u), (None, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.group(df, 4, 85).collect()) == [(0, 0), (3, 3), (5, 5), (7, 5), (7, 5), (8, 8), (8, 8), (9, 5), (9, 5)]


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_similar_sets_share_a_key(percent, share):
    """At any choice of frequent tokens."""
    rng = np.random.default_rng(percent)
    for n in [1, 2, 3, 5, 7, 8, 13, 20, 41, 100, 333, 1000]:
        for _ in range(30):
            every = np.unique(rng.integers(1, 1 << 63, 3 * n).astype(np.uint64))
            x = np.sort(rng.permutation(every)[:n])
            size = int(rng.integers(-(-percent * n // 100), n * 100 // percent + 1))
            overlap = -(-percent * (n + size) // (100 + percent))
            if overlap > min(n, size):
                continue
            y = np.sort(np.concatenate([rng.permutation(x)[:overlap], rng.permutation(np.setdiff1d(every, x))[: size - overlap]]))
            often = lambda t: mixed(t) % np.uint64(1000) < np.uint64(int(1000 * share))
            if not np.array_equal(x, y):
                assert np.intersect1d(jaccard.keys_of(x, often(x), percent), jaccard.keys_of(y, often(y), percent)).size
                assert np.intersect1d(jaccard.class_keys(x, percent), jaccard.class_keys(y, percent)).size


def test_jaccard_of_crowded_keys(spark, monkeypatch):
    """Keys of many sets are refined before their pairs are tried."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    parts = [" ".join(word() for _ in range(12)) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(parts, 5))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + word()) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group(df, 4, 85).collect()} == grouped(rows, 4, 85)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, x) for x in range(101, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("broadcast", [1024, 0])
def test_decontamination_equals_all_windows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", broadcast)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 14, 30])))) for i in range(12)] + [(50, None), (51, "!!"), (None, "w1 w2 w3 w4 w5 w6")]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.7:
            item = rng.choice(items[:12])[1].split()
            if rng.random() < 0.5:
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
        texts.append(" ".join(words))
    texts += ODD
    want = set()
    for d, text in enumerate(texts):
        words = decontaminate.text_words(text)
        for i, item in items[:12]:
            own = item.split()
            width = min(5, len(own))
            cut = lambda ws: Counter(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))  # noqa: E731, B023
            best = max(((decontaminate.weighted_jaccard(cut(words[a : a + len(own)]), cut(own)), -a) for a in range(len(words) - len(own) + 1)), default=(0, 0))
            if best[0] >= 0.8:
                want.add((d, i, round(best[0], 9), -best[1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.at_word) for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    assert got == want and len(want) > 20
    assert decontaminate.matches(documents(spark, texts), bench.where("false")).count() == 0


def test_decontamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(60)}" for _ in range(40)]
    other = " ".join(rng.choice(item) for _ in range(45))
    texts = [" ".join(item[a:b]) for a, b in [(0, 39), (0, 38), (0, 36), (0, 33), (3, 40), (0, 25), (0, 4)]]
    want = set()
    for d, text in enumerate(texts):
        cut = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        s = decontaminate.weighted_jaccard(cut(text.split()), cut(item))
        want |= {(d, 1, round(s, 9), 0)} if s >= 0.8 else set()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.at_word) for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    assert got == want and {d for d, *_ in want} == {0, 1, 2, 3, 4}


def test_decontamination_counts_repeated_rows_once(spark, monkeypatch):
    for most in (10, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        items = spark.createDataFrame([(i, f"item number {i} has just these words here") for i in range(5)] * 2, "item_id long, text string")
        texts = [f"before item number {i} has just these words here after" for i in range(5)]
        found = decontaminate.matches(documents(spark, texts).union(documents(spark, texts)), items).where("similarity = 1").collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(5)]
