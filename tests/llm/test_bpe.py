"""Byte-level BPE against the library: ids, pieces, classes of all code points, round trips, edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lettermill.llm import bpe, queries
from tests.llm.test_operators import DOC, EDGES, SF, docs_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_classes_are_those_of_the_library():
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.SPACE)):
        one = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = np.flatnonzero(bpe.code_point_classes() == kind)
        assert one.decode(one.encode_ordinary(text)) == "".join(chr(c) for c in found if not 0xD800 <= c <= 0xDFFF)


def test_maps_compose_associatively():
    products = bpe.automaton()[1]
    a, b, c = np.random.default_rng(0).integers(0, len(products), (3, 5000))
    assert (products[products[a, b], c] == products[a, products[b, c]]).all()


def test_random_texts(library):
    rng = random.Random(5)
    signs = [*"abLl sStTmdreveLl''\n\t\r!?.-_12½²é日🙂　\xa0\x1c​", "'re", "'ve", "'ll", "'s", " '", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["aB" * 3000, "'" * 999 + "s", " " * 1000, " " * 1000 + "x", "日本" * 500, "x" * 65, "ÿ" * 100]
    ranks = bpe.load_ranks(PATH)
    length = np.zeros(len(ranks), dtype=np.int64)
    length[list(ranks.values())] = [len(b) for b in ranks]
    ids, starts, many = bpe.encode_texts(texts, bpe.PieceCache(ranks), length)
    at = np.cumsum(many) - many
    for t, a, n in zip(texts, at.tolist(), many.tolist(), strict=True):
        want = library.encode_ordinary(t)
        assert ids[a : a + n].tolist() == want, t
        assert starts[a : a + n].tolist() == [sum(length[want[:i]]) for i in range(n)] if n < 50 else True


def test_short_and_long_pieces_merge_alike(library, monkeypatch):
    rng = random.Random(8)
    ranks = bpe.load_ranks(PATH)
    pieces = ["".join(rng.choice("aabbccddeeé") for _ in range(rng.randint(1, 60))).encode() for _ in range(2000)]
    short = [bpe.merge(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT_PIECE", 0)
    assert [bpe.merge(p, ranks) for p in pieces] == short


def test_small_chunks_and_cache_change_nothing(library, monkeypatch):
    ranks = bpe.load_ranks(PATH)
    cache = bpe.PieceCache(ranks)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 5)
    length = np.ones(len(ranks), dtype=np.int64)
    for t in ("some words here", "some other words", "", "here"):
        assert bpe.encode_texts([t], cache, length)[0].tolist() == library.encode_ordinary(t)
        assert cache.chars <= 5
    assert list(bpe._chunks([3, bpe.CHUNK, 2, 2])) == [(0, 1), (1, 2), (2, 4)]


def test_query_matches_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_edges_and_ranges(spark, library):
    docs = docs_of(spark, [*EDGES, (9, "<|endoftext|> as text"), (10, " " * 7)]).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    coded = bpe.encode(docs, PATH)
    rows = bpe.decode(coded.withColumn("decoded", F.lit("old")).withColumn("starts_more", F.lit(2)), PATH).collect()
    assert sorted((r["id"] or 0, bytes(r["decoded"]).decode()) for r in rows) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert all(list(r["ids"]) == library.encode_ordinary(bytes(r["decoded"]).decode()) and r["starts_more"] == 2 for r in rows)
    part = coded.where("id = 6").select("id", F.slice("ids", 3, 4).alias("ids"), F.slice("starts", 3, 4).alias("starts"))
    r = bpe.decode(part, PATH).first()
    assert bytes(r["decoded"]) == "日本語 text é ü 🙂🙂 end".encode()[r["starts"][0] : r["starts"][0] + len(r["decoded"])]
    assert bpe.encode(spark.createDataFrame([], DOC), PATH).count() == 0
    null = spark.createDataFrame([(1, None, None)], "id long, ids array<int>, starts array<int>")
    assert bpe.decode(null, PATH).first()["decoded"] is None


def test_wrong_ids_are_errors(spark):
    for ids, starts in (([99_999_999], [0]), ([-1], [0]), ([5, 5], [0, 7]), ([5, 5], [0])):
        with pytest.raises(Exception, match="vocabulary does not have|do not fit"):
            bpe.decode(spark.createDataFrame([(ids, starts)], "ids array<int>, starts array<int>"), PATH).collect()
