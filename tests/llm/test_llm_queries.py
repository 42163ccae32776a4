"""Queries against their SQL, or a plain computation, on the given tables."""

import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from compare import difference
from tidemark.llm import queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""


def test_op1_equals_the_library_on_every_document(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = set()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.add((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert {tuple(r) for r in queries.op1_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op3_holds_out_and_predicts(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op3_language_id(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in langs} and len(got) == len(langs)
    assert all(0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(judged) > 20 and sum(judged) / len(judged) > 0.95
