"""Decontamination where many items share a phrase."""

import random
from itertools import combinations

from lettermill.llm import decontam
from tests.llm import test_operators as whole


def test_windows_alone_give_the_same(spark, monkeypatch):
    """With next to no hash joined as it is, the brute force of whole tables still holds."""
    monkeypatch.setattr(decontam, "HOT", 0)
    whole.test_decontamination_against_brute_force(spark)


def test_windows_alone_in_the_query(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decontam, "HOT", 0)
    whole.test_decontamination_query_against_brute_force(spark, tmp_path)


def test_broad_and_full_masks_leave_out_what_may_differ():
    assert all(any(m[i] == m[j] == "0" for m in decontam.BROAD) for i, j in combinations(range(decontam.LEAST), 2))
    assert {len(decontam.full_masks(n)) for n in (1, 4)} == {1} and len(decontam.full_masks(12)) == 66


def test_a_phrase_of_all_items_meets_few_documents(spark, monkeypatch):
    """2000 documents and 1000 items that share nine words; ten documents hold an item, changed in two of its words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    phrase = "what is the correct answer to the following question".split()
    items = {i: phrase + [word() for _ in range(12)] for i in range(1000)}
    docs = {k: [word() for _ in range(20)] + phrase + [word() for _ in range(20)] for k in range(2000)}
    for k in range(10):
        part = list(items[k])
        part[10] = part[14] = "other"
        docs[k][5:5] = part
    rows: list[int] = []
    kept = decontam.staged

    def counted(df, label, *rest):
        out = kept(df, label, *rest)
        if label == "met":
            rows.append(out.count())
        return out

    monkeypatch.setattr(decontam, "staged", counted)
    frame = lambda d, name: spark.createDataFrame([(i, " ".join(w)) for i, w in d.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(k, k) for k in range(10)} and rows[0] < 10_000
