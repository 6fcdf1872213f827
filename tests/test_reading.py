"""Hashes of large files by ranged reads, pages by cursors, the log tail by range."""

import hashlib
import time

import pytest

from lettermill.operators import mail
from lettermill.sources import files


def test_large_files_are_hashed_by_ranges(spark, tmp_path):
    with open(tmp_path / "large file.pst", "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)  # sparse
    (tmp_path / "small.pst").write_bytes(b"abc")
    (tmp_path / "empty.pst").write_bytes(b"")
    began = time.time()
    got = {r["path"].rsplit("/", 1)[1]: r["new_hash"] for r in files.hash_files(spark, [str(tmp_path)], "*.pst").collect()}
    assert time.time() - began < 20
    assert got == {"large file.pst": hashlib.sha256(b"head" + bytes((1 << 20) - 4)).hexdigest(), "small.pst": hashlib.sha256(b"abc").hexdigest()}
    (tmp_path / "large file.pst").unlink()
    big = bytes(range(256)) * 50_000
    (tmp_path / "whole.pst").write_bytes(big)
    got = {r["path"].rsplit("/", 1)[1]: r["new_hash"] for r in files.hash_files(spark, [str(tmp_path)], "*.pst", most=None).collect()}
    assert got["whole.pst"] == hashlib.sha256(big).hexdigest() and len(got) == 2


@pytest.mark.parametrize("up", [True, False])
def test_pages_by_cursor_are_pages_by_offset(spark, tmp_path, up):
    rows = [(i, None if i % 5 == 0 else i % 7, ["x", None, "y"][i % 3]) for i in range(83)]
    spark.createDataFrame(rows, "id long, a long, b string").write.parquet(f"{tmp_path}/{up}")
    df = spark.read.parquet(f"{tmp_path}/{up}")
    order = [("a", up), ("b", not up), ("id", True)]
    columns = [df.a.asc_nulls_first() if up else df.a.desc_nulls_last(), df.b.desc_nulls_last() if up else df.b.asc_nulls_first(), df.id.asc()]
    after, n = None, 0
    while True:
        page = mail.page_after(df, order, after, 10)
        if after is not None and after[0] is not None and up:
            assert "GreaterThanOrEqual(a" in page._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in page.select("a", "b", "id").collect()]
        assert got == [tuple(r) for r in mail.page(df, columns, n, 10).select("a", "b", "id").collect()]
        if not got:
            break
        after, n = got[-1], n + 1
    assert n == 9
