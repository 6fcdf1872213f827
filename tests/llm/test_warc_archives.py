"""Archives of many records: their size, and a reader whose work grows with them."""

import time

import pytest

from lettermill.llm import warc


def test_archives_of_revisits_have_an_upper_size(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://u/', id) as url", "'same' as html").coalesce(1)
    path = str(tmp_path / "out")
    manifest = warc.write_archives(pages, path, archive_bytes=100_000).collect()
    assert len(manifest) > 5 and sum(r["records"] for r in manifest) == 4000
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("*.warc.gz")]
    assert max(sizes) < 102_000
    got = warc.read_archives(spark, path).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 1, "revisit": 3999}


def test_reader_is_linear():
    def archive(n):
        return b"".join(warc.write_record(i, i, f"http://u/{i}", warc.digest_of(b""), 0, None, (0, 0)) for i in range(n))

    took = []
    for n in (5_000, 20_000):
        raw, began = archive(n), time.process_time()
        assert sum(1 for _ in warc.read_records(raw)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_a_cut_archive_is_an_error():
    raw = warc.write_record(1, 1, "u", warc.digest_of(b"abc" * 9000), 27_000, b"abc" * 9000, None)
    assert [b for _, b in warc.read_records(raw + raw)] == [b"abc" * 9000] * 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_records(raw + raw[:-20]))
