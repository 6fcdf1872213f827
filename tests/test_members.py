"""Members of contents as rows, and what the entity query returns."""

from lettermill.functions import text as X
from lettermill.operators import attach, catalog
from lettermill.plans import registry

SF = "/root/testdata/sf0.001"


def test_members_and_representatives(spark):
    rows = [("a2", "e1", "h", "b.txt"), ("a1", "e2", "h", "a.txt"), ("a3", "e1", "h", "c.txt"), ("a4", "e1", None, "d"), ("a5", "e3", " ", "e"), ("a6", None, "k", None)]
    rows += [(f"z{i}", f"hot{i % 500}", "hot", "same") for i in range(1000)]
    a = spark.createDataFrame(rows, "id string, email_id string, hash string, filename string")
    members = {tuple(r) for r in attach.content_members(a).collect()}
    assert members == {("h", "e1"), ("h", "e2"), ("k", None)} | {("hot", f"hot{i}") for i in range(500)}
    got = {r["hash"]: tuple(r)[1:] for r in attach.content_representatives(a).collect()}
    assert got == {"h": ("a1", "a.txt", 2), "k": ("a6", None, 0), "hot": ("z0", "same", 500)}
    plan = attach.content_representatives(a)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan


def test_members_of_duplicate_files(spark):
    rows = [(1, "h", 5), (2, "h", 5), (3, "h", 6), (4, None, 5), (5, None, 5), (6, "z", 0), (7, "z", 0)]
    files = spark.createDataFrame(rows, "id long, content_hash string, size long")
    assert {(r["id"], r["n"], r["first"]) for r in catalog.duplicate_members(files).collect()} == {(1, 2, True), (2, 2, False)}


def test_entities_of_whole_documents(spark):
    names = {"the": "TOPIC", "und": "TOPIC", "les": "ORG", "para": "LOCATION"}
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["d1_extract_entities"](spark, SF).collect()
    assert {r["id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        low = (texts[r["id"]] or "")[: X.MODEL_CHARS].lower()
        assert [(e["name"], e["type"]) for e in r["entities"]] == [(n, names[n]) for n in sorted((n for n in names if n in low), key=low.find)] and r["error"] is None
