"""Tables written to the shared folder."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from lettermill.sources import stored


def files(spark):
    return {str(p) for p in Path(stored.shared_dir(spark).removeprefix("file://")).glob("*")}


def test_discard_deletes_what_was_stored(spark):
    before = files(spark)
    one, two = stored.stored(spark.range(10), "one"), stored.stored(spark.range(5), "two", "id")
    assert len(files(spark) - before) == 2 and one.count() == 10
    stored.discard(one, spark.range(3), one)
    assert len(files(spark) - before) == 1 and two.count() == 5
    stored.discard(two)
    assert files(spark) == before


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint.dir"):
        stored.shared_dir(session("spark://host:7077"))
    assert stored.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    local = stored.shared_dir(session("local[2]"))
    assert local.startswith("file://") and local == stored.shared_dir(session("local[2]"))
