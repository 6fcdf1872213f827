"""Staged tables leave neither settings nor intermediate files behind."""

from pathlib import Path

import pytest

from lettermill.llm import common, queries, simhash
from lettermill.sources import stored
from tests.llm.test_operators import SF

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("setting", [None, "7", "9000", "0"])
def test_settings_stay(spark, setting):
    before = spark.conf.get(NAME, None)
    try:
        spark.conf.unset(NAME) if setting is None else spark.conf.set(NAME, setting)
        told = spark.conf.get(NAME, None)
        common.discard(common.staged(spark.range(3), "settings"))
        queries.op1_toxicity(spark, SF).count()
        assert spark.conf.get(NAME, None) == told
    finally:
        spark.conf.unset(NAME) if before is None else spark.conf.set(NAME, before)


def test_only_what_results_read_is_left(spark):
    folder = Path(stored.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("*"))
    out = simhash.simhash_components(spark.read.parquet(f"{SF}/documents.parquet"))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert left == {"fingerprints", "named"} and out.count() > 0
