"""Packing keeps columns whatever their names, and ranks the pieces of one length in as many parts as there are rows."""

from pyspark.sql import functions as F

from lettermill.llm import packing


def test_clashing_columns_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(i, 0, 64 if i % 3 else 1 + i % 64) for i in range(500)] + [(None, 0, 64), (None, 0, 64), (3, 0, 5), (3, 0, 5)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long")
    for c in ("_rank", "_salt", "_lm_part", "_LM_RANK", "sequence_id", "offset", "first"):
        pieces = pieces.withColumn(c, F.lit(c))
    out = packing.pack(pieces, 64)
    assert sorted(out.columns) == sorted(pieces.columns)
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == sorted((i or 0, n) for i, _, n in rows)
    assert {(r["_rank"], r["_salt"], r["_lm_part"], r["_LM_RANK"], r["first"]) for r in got} == {("_rank", "_salt", "_lm_part", "_LM_RANK", "first")}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 64
    assert packing.pack(pieces.limit(0), 64).count() == 0
