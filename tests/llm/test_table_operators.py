"""Operators on vectors, pages, messages, counts and licences."""

import hashlib
import json
import math
import random
import re
import textwrap
import time

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F
from tidemark.llm import chat, counts, licenses, topk, warc
from tidemark.llm.common import bit_filter, shared_dir


def test_topk_with_ties_nulls_and_sparse_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.25, -0.5, 1.0, 0.1]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (None, [1.0] * 6), (400, []), (450, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    fine = {i: [math.floor(256 * struct_float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.top_k(df.where("vec_id % 50 = 0"), df)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df.where("vec_id = 0"), df.where("vec_id < 3")).count() == 2


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_topk_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 7)
    df = spark.range(100).selectExpr("id as vec_id", "array(cast(id % 10 as float), cast(1 as float)) as embedding")
    got = {tuple(r) for r in topk.top_k(df.where("vec_id % 25 = 0"), df, k=3, scale=1.0).collect()}
    want = set()
    for q in range(0, 100, 25):
        best = sorted((-((q % 10) * (i % 10) + 1), i) for i in range(100) if i != q)[:3]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_warc_round_trip_with_revisits(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (7, "http://a\r\nb/7", big), (3, "u", "small"), (4, None, "small"), (5, "u", None), (6, "u", ""), (8, "u", other), (None, "u", big), (9, "u", "a" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    folder = shared_dir(spark)
    warc.write(warc.with_decisions(df), folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = html == big and page != 7
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
        assert bytes(r.block) == (b"" if revisit else payload)


def test_warc_bundles_are_plain_zstandard_with_a_seek_table(spark):
    rows = [(i, "u", chr(97 + i % 26) * 60_000) for i in range(20)]
    folder = shared_dir(spark)
    index = warc.write(warc.with_decisions(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), folder).collect()
    fs, base = pafs.FileSystem.from_uri(f"{folder}/bundles")
    assert len({r.frame for r in index}) > 1
    for name in {r.bundle for r in index}:
        data = fs.open_input_file(f"{base}/{name}").read()
        places = warc.frame_places(memoryview(data))
        whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n, _ in places)
        assert whole == zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        for r in (r for r in index if r.bundle == name):
            a, n, size = places[r.frame]
            frame = zstandard.ZstdDecompressor().decompress(data[a : a + n])
            assert len(frame) == size
            headers, block = warc.parse(memoryview(frame[r.place : r.place + r.bytes]))
            assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and block.decode() == rows[r.page_id][2]


def test_warc_attempt_in_another_order_leaves_the_index_right(spark):
    df = spark.createDataFrame([(i, "u", chr(97 + i % 26) * (20_000 + i)) for i in range(40)], "page_id long, url string, html string")
    folder, records = shared_dir(spark), warc.with_decisions(df).coalesce(1)
    warc.write(records.sortWithinPartitions("page_id"), folder)
    assert warc.bundled(records.sortWithinPartitions(F.desc("page_id")), folder).count() == 40  # as a late attempt would
    got = {r.page_id: bytes(r.block).decode() for r in warc.read(spark, folder).collect()}
    assert got == {r.page_id: r.html for r in df.collect()}


def test_warc_empty_table(spark):
    folder = shared_dir(spark)
    warc.write(warc.with_decisions(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert warc.read(spark, folder).count() == 0


def calls(*items):
    return json.dumps({"tool_calls": list(items)})


def test_chat_links_orders_and_validates(spark):
    messages = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", calls({"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": {"x": "1"}, "after": ["c"]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
        (1, 9, "tool", json.dumps({"tool_call_id": "a", "content": "late"})),
        (1, 3, "assistant", calls({"id": "c", "name": "say", "arguments": {"z": 1.5, "text": "é\n"}, "after": ["a", "zz"]}, {"id": "d", "name": "nop", "arguments": {}}, {"id": "e", "name": "what"}, {"name": "no id"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "q", "content": "nobody's"})),
        (2, 0, "assistant", calls({"id": "a", "name": "add", "arguments": {"x": 1}, "after": ["b"]}, {"id": "b", "name": "add", "arguments": [1], "after": ["a"]}, {"id": "c", "name": "add", "arguments": {"y": 1}})),
        (2, 1, "assistant", None),
        (2, 2, "assistant", "not json {"),
        (2, 3, None, "x"),
        (None, 1, "user", "x"),
        (3, None, "tool", "{}"),
        (3, 1, "tool", '{"content": 1}'),
    ]
    schema = chat.schema_rows(spark, [("add", "x", "BIGINT", True), ("add", "y", "BIGINT", False), ("say", "text", "STRING", True), ("nop", None, None, False)])
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {(r.conv_id, r.call_id): r for r in chat.link(df, schema).collect()}
    assert {k: (r.status, r.problem) for k, r in got.items()} == {
        (1, "a"): ("linked", None),
        (1, "b"): ("pending", "type: x"),
        (1, "c"): ("pending", "unknown: z"),
        (1, "d"): ("pending", None),
        (1, "e"): ("pending", "no schema"),
        (1, "q"): ("orphan", None),
        (2, "a"): ("cyclic", None),
        (2, "b"): ("cyclic", "no object"),
        (2, "c"): ("pending", "missing: x"),
    }
    assert got[1, "a"].place < got[1, "c"].place < got[1, "b"].place
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","problem":null,"result":"3","status":"linked"}'
    assert chat.link(df.where("false"), schema).count() == 0


def test_chat_orders_a_long_chain_that_was_logged_backwards(spark):
    n = 12
    rows = [(1, n - i, "assistant", calls({"id": f"c{i}", "name": "f", "arguments": {}, "after": [f"c{i - 1}"] if i else []})) for i in range(n)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.schema_rows(spark, [("f", None, None, False)]))
    assert [r.call_id for r in got.orderBy("place").collect()] == [f"c{i}" for i in range(n)]


def order_of(spark, logged):
    """call_id: (place, status) of conversations given as {(conv, turn): {call: after}}."""
    rows = [(c, t, "assistant", calls(*({"id": k, "name": "f", "arguments": {}, "after": a} for k, a in made.items()))) for (c, t), made in logged.items()]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.schema_rows(spark, [("f", None, None, False)])).collect()
    return {(r.conv_id, r.call_id): (r.place, r.status) for r in got}


def test_chat_ends_on_cycles_beside_a_far_later_turn(spark):
    far = 1 << 30
    got = order_of(spark, {(1, 1): {"a": ["b"], "b": ["a"]}, (1, far): {"z": []}, (1, 2): {"c": ["a"], "d": ["z"], "s": ["s"]}, (2, 1): {"x": ["y", "y"], "y": []}})
    assert {k[1] for k, v in got.items() if v[1] == "cyclic"} == {"a", "b", "c", "s"}
    assert got[1, "d"][0] == got[1, "z"][0] + 1 and got[2, "x"][0] == got[2, "y"][0] + 1
    assert got[1, "a"][0] == chat.PER_MESSAGE and got[1, "c"][0] == 2 * chat.PER_MESSAGE


def test_chat_orders_chains_and_meshes_as_repeated_raising_does(spark):
    rng = random.Random(2)
    chain = {(1, 300 - i): {f"c{i}": [f"c{i - 1}"] if i else []} for i in range(200)}
    mesh = {(2, rng.randrange(50)): {} for _ in range(20)}
    names = [f"m{i}" for i in range(30)]
    for i, name in enumerate(names):
        mesh[rng.choice(list(mesh))][name] = rng.sample(names[:i], min(i, rng.randrange(3)))
    got = order_of(spark, chain | mesh)
    for logged in (chain, mesh):
        place = {(c, k): t * chat.PER_MESSAGE + at for (c, t), made in logged.items() for at, k in enumerate(made)}
        edges = [((c, k), (c, b)) for (c, _), made in logged.items() for k, after in made.items() for b in after]
        moved = True
        while moved:
            moved = False
            for k, b in edges:
                if place[k] <= place[b]:
                    place[k], moved = place[b] + 1, True
        assert {k: got[k][0] for k in place} == place


def test_counts_replace_a_batch_by_an_empty_one_and_fold(spark):
    rows = spark.createDataFrame([("a", "en", "t1", 5), ("b", "en", "t1", 3)], "source string, lang string, tokenizer string, tokens long")
    rollup = counts.Rollup(spark, shared_dir(spark))
    rollup.commit("1", counts.inserts(rows.where("source = 'a'")))
    rollup.commit("2", counts.inserts(rows.where("source = 'b'")))
    rollup.commit("1", counts.inserts(rows.where("false")))
    assert [tuple(r) for r in rollup.totals().collect()] == [("b", "en", "t1", 1, 3)]
    folded = rollup.fold(shared_dir(spark))
    assert folded.totals().collect() == rollup.totals().collect() and folded.batches().select("batch").distinct().count() == 1


def test_warc_reads_records_by_identifier(spark):
    rows = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(50)] + [(100, "u", "7" * 2000), (100, "u", "7" * 2000)], "page_id long, url string, html string")
    folder = shared_dir(spark)
    warc.write(warc.with_decisions(rows), folder)
    got = warc.read(spark, folder, spark.createDataFrame([(3,), (7,), (100,), (999,)], "page_id long")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(3, "response", None), (7, "revisit", 100), (100, "response", None), (100, "response", None)]


def test_counts_keep_totals_by_batches(spark):
    rows = spark.createDataFrame([("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, None, "t1", 0), ("b", "en", "t1", 3)], "source string, lang string, tokenizer string, tokens long")
    rollup = counts.Rollup(spark, shared_dir(spark))
    assert rollup.totals().count() == 0
    rollup.commit("1", counts.inserts(rows))
    rollup.commit("2", counts.revisions(rows.where("source = 'b'"), rows.where("source = 'b'").withColumn("tokenizer", F.lit("t2")).withColumn("tokens", F.lit(4))))
    rollup.commit("1", counts.inserts(rows))
    rollup.commit("3", counts.deletes(rows.where("tokens = 5")))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t1", 1, 7), (None, None, "t1", 1, 0), ("b", "en", "t2", 1, 4)}


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    texts = [None, "", "Nothing here.\nAt all.", "x\nReleased under the MIT licence.\nReleased under the MIT License!", mit.upper(), mit.replace("Software", "Program", 1).replace(". ", ".\n"), "ALL RIGHTS RESERVED", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {(r.doc_id, r.license): (round(r.dice, 6), r.place) for r in licenses.scan(df).collect()}

    def best(text, name):
        units = [(i, u) for i, u in enumerate(text.split("\n"))] + ([(-1, text)] if "\n" in text else [])
        scores = []
        for place, unit in units:
            own = set(licenses.template_pairs(unit))
            for n, t in licenses.TEMPLATES:
                pairs = set(licenses.template_pairs(t))
                if n == name and own:
                    scores.append((2 * len(own & pairs) / (len(own) + len(pairs)), -place))
        return max(scores, default=(0, 0))

    want = {}
    for i, t in enumerate(texts):
        for name in {n for n, _ in licenses.TEMPLATES}:
            if t and best(t, name)[0] >= 0.8:
                want[i, name] = (round(best(t, name)[0], 6), -best(t, name)[1])
    assert got == want and (3, "MIT") in want and (5, "MIT") in want


def test_licenses_inside_longer_texts(spark):
    body = {n: t for n, t in licenses.TEMPLATES if len(t) > 500}
    rng = random.Random(8)
    other = lambda n: " ".join(rng.choice("tool build the of data in a fast small to run".split()) for _ in range(n))
    texts = [f"{other(200)}\n{textwrap.fill(body[n], 78)}\n{other(200)}" for n in ("MIT", "ISC")]
    texts += ["We built this tool. Released under the MIT License. See the manual for more.", f"{other(5)}\nReleased under\nthe MIT License.\n{other(5)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.dice, r.place) for r in licenses.scan(df).collect()}
    assert got == {(0, "MIT"): (1.0, 1), (1, "ISC"): (1.0, 1), (2, "MIT"): (1.0, 0), (3, "MIT"): (1.0, 1)}


@pytest.mark.parametrize("probe", [16, 1, 0])
def test_licenses_equal_all_runs_of_sentences(spark, monkeypatch, probe):
    monkeypatch.setattr(licenses, "PROBE", probe)  # with less, texts are gone through backwards
    rng = random.Random(9)
    templates = [("A", "a b a b c"), ("A", "b c a"), ("B", "d a b c a b e a d"), ("C", "q")]
    texts = ["".join(rng.choice("abcde") + rng.choice([" ", " ", ". ", "! ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(80)]
    texts += [" ".join(rng.choice(templates)[1].replace(" ", rng.choice([" ", "\n", ". "]), 2) for _ in range(3)) for _ in range(20)]
    texts += ["a q b", "a. q. b", "q q", "a b " * 40 + "c", "x. " + "a b. " * 40 + "b c. x"]
    want = {}
    for d, text in enumerate(texts):
        parts = [(s, k) for k, t in enumerate(text.split("\n")) for s in re.split(licenses.SENTENCE_END, t) if s.strip(" .!")]
        units = [(" ".join(s for s, _ in parts[i:j]), parts[i][1]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
        units += [(text, -1)] if "\n" in text else []
        for name, t in templates:
            pairs = set(licenses.template_pairs(t))
            for unit, place in units:
                own = set(licenses.template_pairs(unit))
                dice = 2 * len(own & pairs) / (len(own) + len(pairs))
                if dice >= 0.8:
                    want[d, name] = max(want.get((d, name), (0, 0)), (dice, -place))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.license): (r.dice, -r.place) for r in licenses.scan(df, templates).collect()} == want
    assert {name for _, name in want} == {"A", "B", "C"} and len(want) > 20


def test_licenses_make_a_units_words_once(spark):
    df = spark.createDataFrame([(1, "Licensed under the MIT License.\nmore")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_licenses_in_a_text_that_repeats_itself(spark):
    """A licence's sentence said eleven thousand times, 400 kB in all: seconds, not minutes."""
    sentence = "Released under the MIT License."
    text = " ".join([sentence] * 12_500)
    assert len(text) > 390_000
    df = spark.createDataFrame([(1, text), (2, "Something else. " + text)], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    assert {(1, "MIT"), (2, "MIT")} <= got and time.time() - began < 90


def test_no_templates_find_nothing(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(df, []).collect() == [] and licenses.scan(df).count() == 1


def test_size_bounds_lose_no_pair():
    for a in range(1, 80):
        lo, hi = licenses.size_bounds(a, 0.8)
        assert all((2 * min(a, b) / (a + b) >= 0.8 - 1e-12) == (lo <= b <= hi) for b in range(1, 200))


def test_bit_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 5).selectExpr("id as k", "cast(id as string) as s")
    has = bit_filter(keys)
    assert spark.range(5000).where(has(F.col("id"), F.col("id").cast("string")) & (F.col("id") % 5 == 0)).count() == 1000
    assert spark.range(5000).where(has(F.col("id"), F.col("id").cast("string"))).count() < 1600
    empty = bit_filter(keys.where("false"))
    assert spark.range(100).where(empty(F.col("id"), F.lit("x"))).count() == 0
