"""Texts that hold the tokenizer's own control string, against the plain call of tokenizers."""

import zlib

import numpy as np

import corpus_pipeline
from lettermill.llm import queries
from tests.llm.test_operators import docs_of

TEXTS = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x<|endoftext|><|endoftext|>  y\n<|endoftext", 4: "plain é 🙂", 5: None}


def test_control_string(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs_of(spark, TEXTS.items())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in TEXTS.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert want[1][0] == 5
    for got in (queries.op2_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got.collect()} == want
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op4_token_output(spark, str(tmp_path)).collect()} == want
