"""Files, streams, dead letters and staged runs."""

import os

import pytest
from pyspark.sql import functions as F

from lettermill.operators import attach, graph, mail, ops, rag
from lettermill.sources import files
from lettermill.streaming import index_sync

EML = """From: "A" <Alice@X.example>
To: bob@y.example, Carol <carol@z.example>
Cc: dan@z.example
Subject: Report
Message-ID: <m1@x.example>
Date: Mon, 01 Jan 2024 10:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/plain; charset=utf-8

Hello
--b
Content-Type: text/plain
Content-Disposition: attachment; filename="a.txt"

data
--b--
"""


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a/one.pst": "1", "a/two.PST": "2", "a/skip/three.pst": "3", "a/skipped.pst": "4", "a/x.tmp": "5", "mail/m.eml": EML, "mail/box.mbox": "From a\n" + EML + "\nFrom b\n" + EML}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_scan_mail_files(spark, tree):
    got = files.scan_mail_files(spark, [f"{tree}/a"], [f"{tree}/a/skip"])
    assert sorted(r["file_name"] for r in got.collect()) == ["one.pst", "skipped.pst"] and got.first()["status"] == "New"


def test_directory_index(spark, tree):
    listing = files.scan_directory_index(spark, f"{tree}/a", ["skip/"])
    assert sorted(r["file_name"] for r in listing.collect()) == ["one.pst", "skipped.pst", "two.PST"]
    index = spark.createDataFrame([(f"{tree}/a/one.pst", "Processed"), (f"{tree}/a/gone.pst", "New")], "path string, status string")
    got = {os.path.basename(r["path"]): r["status"] for r in files.refresh_directory_index(index, listing).collect()}
    assert got == {"one.pst": "Processed", "skipped.pst": "New", "two.PST": "New"}


def test_path_lists(spark, tree, tmp_path):
    found = files.scan_mail_files(spark, [f"{tree}/a"])
    files.export_file_list(found, str(tmp_path / "list"))
    lines = files.read_path_list(spark, str(tmp_path / "list"))
    assert lines.count() == found.count() and all(r["path"].split("\t")[0].endswith(".pst") for r in lines.collect())


def test_read_mail_archives(spark, tree):
    got = files.read_mail_archives(spark, [f"{tree}/mail"])
    rows = got.collect()
    assert len(rows) == 3 and all(r["error"] is None for r in rows)
    assert {r["sender"] for r in rows} == {"Alice@X.example"} and rows[0]["recipients"] == ["bob@y.example", "carol@z.example"] and rows[0]["body"].strip() == "Hello"
    a = files.message_attachments(got)
    assert a.count() == 3 and a.select("hash").distinct().count() == 1 and a.first()["filename"] == "a.txt"


def test_hashes_and_bytes(spark, tree):
    hashed = files.hash_files(spark, [f"{tree}/a"], "*.pst")
    assert hashed.count() == 3
    wanted = hashed.select(F.col("new_hash").alias("hash"), F.col("path").alias("local_path"))
    assert sorted(bytes(r["content"]) for r in files.read_attachment_bytes(wanted).collect()) == [b"1", b"3", b"4"]


def test_sync_resumes_and_ignores_late_changes(spark, tmp_path):
    schema = "id string, seq long, op string, subject string"
    folder, index, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = index_sync.sync_index(index_sync.change_stream(spark, folder, schema), index, checkpoint)
        stream.awaitTermination()
        return {r["id"]: (r["seq"], r["op"]) for r in index_sync.read_index(spark, index, schema).collect()}

    put(("a", 1, "insert", "x"), ("b", 2, "insert", "y"))
    assert run() == {"a": (1, "insert"), "b": (2, "insert")}
    put(("a", 9, "delete", None))
    put(("a", 5, "update", "late"), ("c", 7, "insert", "z"))
    assert run() == {"a": (9, "delete"), "b": (2, "insert"), "c": (7, "insert")}
    assert run() == {"a": (9, "delete"), "b": (2, "insert"), "c": (7, "insert")}
    # a batch that is replayed changes nothing, and neither does compacting
    index_sync.apply_changes(spark.createDataFrame([("a", 1, "insert", "x"), ("b", 2, "insert", "y")], schema), index, 0)
    index_sync.compact_index(spark, index, f"{index}-2", schema)
    for path in (index, f"{index}-2"):
        got = index_sync.read_index(spark, path, schema)
        assert {r["id"]: r["seq"] for r in got.collect()} == {"a": 9, "b": 2, "c": 7} and index_sync.live(got).count() == 2
    index_sync.apply_changes(spark.createDataFrame([("b", 11, "delete", None)], schema), f"{index}-2", 5)
    assert index_sync.live(index_sync.read_index(spark, f"{index}-2", schema)).count() == 1
    assert index_sync.read_index(spark, f"{index}-none", schema).count() == 0


def test_log_tail_and_progress(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ERROR"), (2, "INFO"), (3, "ERROR")], "seq long, level string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = index_sync.observed(index_sync.tail_logs(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ERROR"))
    q = stream.writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tail").count() == 2 and q.lastProgress.observedMetrics["progress"]["processed"] == 2


def test_staged_run_and_metrics(spark):
    def fail():
        raise RuntimeError("no")

    rows = ops.run_pipeline([("find", lambda: 5), ("skipme", fail), ("load", fail), ("graph", lambda: 1)], {"skipme"})
    assert [r[1] for r in rows] == ["DONE", "SKIPPED", "FAILED", "PENDING"]
    m = ops.stage_metrics(spark, [("load", "RUNNING", 200, 66, 1, 30.0), ("graph", "PENDING", 0, 0, 0, 0.0)]).collect()
    assert (m[0]["percent"], m[0]["rate_per_minute"], m[0]["eta_seconds"]) == (33, 134.0, 60) and m[1]["percent"] == 0


def test_failing_plug_ins_are_rows(spark):
    docs = spark.createDataFrame([("h1", "a.html", b"<p>x &amp; y</p>"), ("h2", "b.txt", b"t"), ("h2", "c.txt", b"t")], "hash string, filename string, content binary")
    got = {r["hash"]: (r["markdown"], r["error"]) for r in attach.convert_documents(docs).collect()}
    assert got == {"h1": ("x & y", None), "h2": ("t", None)}

    def broken(*_):
        raise ValueError("bad")

    assert {r["error"] for r in attach.convert_documents(docs, broken).collect()} == {"ValueError: bad"}
    texts = spark.createDataFrame([("1", "Acme in Paris"), ("2", None)], "id string, text string")
    got = rag.extract_entities(texts, rag.dictionary_matcher({"Paris": "LOCATION", "acme": "ORG"})).collect()
    assert [e["name"] for e in got[0]["entities"]] == ["acme", "Paris"] and got[1]["entities"] == []
    assert all(r["error"] or r["id"] == "2" for r in rag.extract_entities(texts, broken).collect())


def test_chat_tail_cuts_before_it_drops(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, None, "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert rag.chat_tail(turns, 1).first()["history"] == ["assistant: d"]


def test_sort_locale(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["z", "csap", "ő", "cukor", "o", None])], "id long, w string")
    assert [r["w"] for r in mail.sort_locale(df, "w").collect()] == [None, "cukor", "csap", "o", "ő", "z"]


def test_graph_json(spark):
    assert graph.as_json(spark.createDataFrame([(1, "a")], "x long, y string")).first()["row"] == '{"x":1,"y":"a"}'
