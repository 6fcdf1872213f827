"""The corpus pipeline against its stages done plainly."""

from lettermill.llm import decontam, toxicity
from tests.llm.test_near_copies import shingle_set, similar
from tests.llm.test_operators import plain_overlap, roots

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frames[-1].columns == columns
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), corpus_pipeline._rest(4) != 2)
    scores = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < 0.3}
    # the stage's own contract, five words and a similarity of 0.8; op7's three bits bind its query only
    sets = {i: shingle_set(r["text"]) for i, r in rows[1].items()}
    groups = roots(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    assert set(rows[2]) == set(groups.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {}
    sets = [set(decontam.word_hashes(t, known).tolist()) for t in items]
    for i, r in rows[2].items():
        words = set(decontam.word_hashes(r["text"], known).tolist())
        near = [t for t, s in zip(items, sets, strict=True) if len(s & words) >= 0.5 * min(12, len(s))]
        assert (i in rows[3]) == (not any(plain_overlap(r["text"], t) for t in near))
    assert set(rows[4]) == set(rows[3]) and all(r["n_chars"] == len(r["text"]) for r in rows[4].values() if r["text"] is not None)
    assert set(rows[5]) == set(rows[4])
    assert corpus_pipeline.run(spark, SF).count() == frames[-1].count()
