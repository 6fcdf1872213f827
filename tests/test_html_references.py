"""References without ';' in the query's text of HTML: text as in its SQL; a mail's HTML is read as a browser does."""

import duckdb
import pytest

from lettermill.functions import text as X
from lettermill.plans import registry


@pytest.mark.parametrize(
    "html, want",
    [
        ("<title>a&amp;&amp</title>b", "a&&amp b"),
        ("x &quot; &copy 5 &lt", 'x " &copy 5 &lt'),
        ("&am &a; &ampfoo; & &# &#;", "&am &a; &ampfoo; & &# &#;"),
        ("&#233;&#xe9; &#233 &amp;lt; &eacute;&eacute", "éé &#233 &lt; é&eacute"),
        (None, ""),
    ],
)
def test_closed_references_only(html, want):
    assert X.visible_text(html, closed=True) == want


def test_open_references_as_a_browser_reads_them():
    assert X.visible_text("<title>a&amp;&amp</title>b &copy 5") == "a&& b © 5"


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(1, "<title>cut&amp;&amp</title><p>a &lt; b &copy; &quot</p>"), (2, "&amp"), (3, "<p>x&ampy&middot;</p>"), (4, None), (4, "&amp;lt")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["f8_html_to_text"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        con.execute(registry.oracle_sql()["f8_html_to_text"])
        want = con.fetchall()
    assert sorted((r["page_id"], r["plain"]) for r in got) == sorted(want)
