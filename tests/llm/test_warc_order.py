"""WARC archives of pages whose scans give no fixed order."""

import random

import pyarrow as pa

from lettermill.llm import warc
from tests.llm.test_operators import check_pages


def test_pages_in_another_order_each_scan(spark):
    rows = [(i, f"http://u/{i}", f"<p>{i % 40}</p>") for i in range(400)]

    def shuffled(batches):
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").mapInArrow(shuffled, "page_id long, url string, html string")
    check_pages([(i, h) for i, _, h in rows], warc.deduplicate(pages).collect())
