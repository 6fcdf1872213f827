"""The queries load wherever Spark's jars lie, and the SQL's stop list is Spark's own."""

import subprocess
import sys
from pathlib import Path

from lettermill.operators import search as S
from lettermill.plans import search_queries

LOAD = "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_queries_load_without_jars_beside_pyspark():
    run = subprocess.run([sys.executable, "-c", LOAD], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and min(map(int, run.stdout.split())) > 100, run.stderr


def test_stop_list_is_that_of_spark(spark):
    assert search_queries._STOP_WORDS == S.hungarian_stop_words(spark)
