"""The graph over batches of mails: counts add up, dates move on, threads keep their first mail."""

from datetime import datetime

import pytest

from lettermill.operators import graph, rag

MAIL = "id string, message_key string, sender_key string, sender_name string, recipients array<string>, cc array<string>, subject string, received timestamp, conversation_id string, pst_file string, owner string"


def mail(k, day, sender="a@x", to=("b@x",), name="", thread="t", subject=None):
    return (f"e{k}", f"m{k}", sender, name, list(to), [], subject or f"subject {k}", datetime(2024, 1, day), thread, "f.pst", "f")


def write(spark, path, rows, batch):
    raw = spark.createDataFrame([], "email_id string, raw string")
    graph.write_graph(path, graph.build_graph(spark.createDataFrame(rows, MAIL), raw, spark.createDataFrame([], "message_key string")), batch)


def test_batches_add_up(spark, tmp_path):
    path = str(tmp_path / "graph")
    write(spark, path, [mail(2, 2), mail(3, 3), mail(4, 4)], "one")
    write(spark, path, [mail(5, 9, name="Ann"), mail(1, 1, name="Anna"), mail(6, 5, thread=None)], "two")
    write(spark, path, [mail(5, 9, name="Ann"), mail(1, 1, name="Anna"), mail(6, 5, thread=None)], "two")  # again: takes its own place
    got = graph.read_graph(spark, path)
    assert [tuple(r) for r in got["communicates_with"].collect()] == [("a@x", "b@x", 6, datetime(2024, 1, 9))]
    assert [tuple(r) for r in got["thread"].collect()] == [("t", "subject 1", datetime(2024, 1, 9))]
    assert {r["email_id"]: r["parent"] for r in got["reply_to"].collect()} == {f"e{k}": "e1" for k in (2, 3, 4, 5)}
    assert {r["email"]: r["name"] for r in got["person"].collect()} == {"a@x": "Anna", "b@x": ""}
    assert got["email"].count() == 6
    graph.write_graph(f"{path}-whole", graph.read_parts(spark, path), "whole")
    whole = graph.read_graph(spark, f"{path}-whole")
    for name, rows in got.items():
        assert sorted(rows.collect(), key=str) == sorted(whole[name].select(rows.columns).collect(), key=str), name


def test_a_cut_batch_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "graph")
    write(spark, path, [mail(2, 2)], "one")
    raw, none = spark.createDataFrame([], "email_id string, raw string"), spark.createDataFrame([], "message_key string")
    tables = graph.build_graph(spark.createDataFrame([mail(3, 3)], MAIL), raw, none)
    broken = dict(list(tables.items())[:4]) | {"mentions": spark.range(1).selectExpr("raise_error('cut') as x")}
    for batch in ("two", "one"):
        with pytest.raises(Exception, match="cut"):
            graph.write_graph(path, broken, batch)
        if batch == "two":
            assert {n: df.count() for n, df in graph.read_graph(spark, path).items()}["email"] == 1
    with pytest.raises(ValueError):
        graph.read_graph(spark, path)
    graph.write_graph(path, tables, "two")
    assert [r["id"] for r in graph.read_graph(spark, path)["email"].collect()] == ["e3"]


def test_thread_position_of_a_hot_thread(spark):
    rows = [mail(k, 1 + k % 28, thread="hot" if k % 10 else "cold") for k in range(500)]
    mails = spark.createDataFrame(rows, MAIL).repartition(7)
    got = {r["id"]: r["position"] for r in graph.thread_position(mails).collect()}
    for thread in ("hot", "cold"):
        order = [r[0] for r in sorted((r for r in rows if r[8] == thread), key=lambda r: (r[7], r[0]))]
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    parent = {r["id"]: r["parent"] for r in graph.thread_parent(mails).collect()}
    first = min((r for r in rows if r[8] == "hot"), key=lambda r: (r[7], r[0]))[0]
    assert parent[first] is None and {parent[r[0]] for r in rows if r[8] == "hot"} == {first, None}


def test_short_names_are_found_in_concepts(spark):
    concepts = spark.createDataFrame([("big widget", "Big widget"), ("ab", "ab"), ("xaby", "xaby")], "concept_key string, name string")
    mentions = spark.createDataFrame([("e1", "big widget"), ("e2", "ab"), ("e3", "xaby")], "email_id string, concept_key string")
    mails = spark.createDataFrame([(f"e{k}", datetime(2024, 1, k)) for k in (1, 2, 3)], "id string, received timestamp")
    asked = spark.createDataFrame([(1, 0, "widg"), (2, 0, "ab"), (3, 0, ""), (4, 0, "nothing"), (5, 0, "a"), (6, 0, "Widg")], "question int, place int, name string")
    got = {}
    for r in rag.rag_context(asked, mails, mentions, concepts, 5).collect():
        got.setdefault(r["question"], {})[r["rank"]] = r["id"]
    assert got == {1: {1: "e1"}, 2: {1: "e3", 2: "e2"}, 3: {1: "e3", 2: "e2", 3: "e1"}, 5: {1: "e3", 2: "e2"}}
