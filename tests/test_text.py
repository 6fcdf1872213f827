"""Text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import search as S


def one(spark, make, **columns):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'binary' if isinstance(v, bytes) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(make(*[F.col(c) for c in columns]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "body, want",
    [
        ("Thanks!\n\nOn Mon, 1 Jan 2024, Alice wrote:\n> old", "Thanks!"),
        ("See below\n\n-----Original Message-----\nFrom: a@b.c", "See below"),
        ("Szia\n\nFeladó: Kovács Péter\nrégi", "Szia"),
        ("Hello\n-- \nsignature", "Hello"),
        ("No marker here", "No marker here"),
        ("On Mon, 1 Jan 2024, Alice wrote:\n> only", "On Mon, 1 Jan 2024, Alice wrote:\n> only"),
        ("Text\n--- Eredeti üzenet ---\nx", "Text"),
        ("Text\n--- EREDETI ÜZENET ---\nx", "Text\n--- EREDETI ÜZENET ---\nx"),
        ("", ""),
        (None, None),
    ],
)
def test_strip_replies(spark, body, want):
    assert one(spark, X.strip_replies, t=body) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>Hello <b>World</b></p>", "Hello World"),
        ("<html><head><style>p{}</style><script>x()</script></head><body><div>A &amp; B</div><a href='#'>li</a>nk<!-- c --></body></html>", "A & B link"),
        ("  <p>  padded   text </p> ", "padded text"),
        ("&lt;b&gt;&nbsp;x", "<b> x"),
        (None, ""),
        ("", ""),
    ],
)
def test_html_to_text(spark, html, want):
    assert one(spark, X.html_to_text, t=html) == want


def test_html_is_capped(spark):
    assert len(one(spark, X.html_to_text, t="<p>" + "x" * 200_000)) == X.BODY_CHARS


@pytest.mark.parametrize("body, html, want", [(" plain \n", "<p>html</p>", "plain"), ("  ", "<p>html</p>", "html"), (None, None, ""), ("", " ", "")])
def test_best_text(spark, body, html, want):
    assert one(spark, X.best_text, b=body, h=html) == want


def test_hashes(spark):
    want = "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, X.content_hash, c=b"hello world") == want
    assert one(spark, X.partial_hash, c=b"\0" * ((1 << 20) + 5)) == one(spark, X.content_hash, c=b"\0" * (1 << 20))
    assert one(spark, X.entry_id, a="a.pst", n="7") != one(spark, X.entry_id, a="b.pst", n="7")


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (5 << 40, "5120.0 GB")])
def test_human_bytes(spark, n, want):
    assert one(spark, X.human_bytes, n=n) == want


def test_addresses_and_paths(spark):
    assert one(spark, X.split_addresses, t="a@x; B@y;;") == ["a@x", "B@y"] and one(spark, X.split_addresses, t=None) == []
    assert one(spark, X.address_domain, t="a@b@c") == "b@c" and one(spark, X.address_domain, t="none") == ""
    assert one(spark, X.source_owner, t="a.b.pst") == "a.b" and one(spark, X.source_owner, t=".pst") == ".pst" and one(spark, X.source_owner, t=None) == ""
    assert one(spark, X.folder_path, n=["Top of Information Store", "Inbox", "2024"]) == "Inbox / 2024"
    assert one(spark, X.folder_path, n=["Inbox", "Személyes mappák"]) == "Inbox / Személyes mappák"
    assert one(spark, lambda c: X.remap_path(c, "/volume1/shared", "/mnt"), p="/volume1/shared/a.pst") == "/mnt/a.pst"
    assert one(spark, lambda c: X.remap_path(c, "/volume1/shared", "/mnt"), p="/x/a.pst") == "/mnt/x/a.pst"
    assert one(spark, X.default_filename, n="", i=3) == "attachment3"
    assert one(spark, X.guess_content_type, n="A.PDF") == "application/pdf" and one(spark, X.guess_content_type, n="a") == "application/octet-stream"
    assert one(spark, X.normalize_message_id, m=" <Msg1@X.com> ", u="u", k="k") == "msg1@x.com" and one(spark, X.normalize_message_id, m=" ", u="", k="k") == "k"


@pytest.mark.parametrize("raw, names", [
    ('{"entities":[{"name":"Acme","type":"ORG"},{"name":"ab","type":"ORG"},{"name":"Budget Q3"}]}', [("Acme", "ORG"), ("Budget Q3", "TOPIC")]),
    ('```json\n{"entities":[{"name":"Acme","type":"ORG"}]}\n```', [("Acme", "ORG")]),
    ("not json", []), ("[1]", []), ('{"entities":', []), ("", []), (None, []),
])
def test_parse_k1_entities(spark, raw, names):
    assert [(e["name"], e["type"]) for e in one(spark, X.parse_k1, r=raw)["entities"]] == names


def test_parse_k1_defaults(spark):
    k = one(spark, X.parse_k1, r='{"claims":[{"text":" c "},{"text":" "}],"evidence":[{"text":"e"}],"mechanisms":[{"name":"m"}],"relations":[{"subject":"a","predicate":"PROVES","object":"b"},{"subject":"a"}]}')
    assert [tuple(c) for c in k["claims"]] == [("c", "FACTUAL", 0.8)] and [tuple(e) for e in k["evidence"]] == [("e", "INFERENCE", "")]
    assert [tuple(m) for m in k["mechanisms"]] == [("m", "", "ORGANIZATIONAL")] and [tuple(r) for r in k["relations"]] == [("a", "PROVES", "b")]


def test_documents(spark):
    md = "# T\n\npara\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\n\n![alt](s.png) ![](t.png) [1] [Smith, 2020] [1]"
    d = one(spark, X.parse_document, m=md)
    assert d["text_blocks"] == ["# T", "para", "![alt](s.png) ![](t.png) [1] [Smith, 2020] [1]"]
    assert [(t["headers"], t["rows"]) for t in d["tables"]] == [(["a", "b"], [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}])]
    assert d["figures"] == ["alt", "t.png"] and d["citations"] == ["[1]", "[Smith, 2020]"] and d["error"] is None


def test_analysis(spark):
    assert one(spark, lambda c: S.tokenize_folded(c, ["a"]), t="A Szerződés, kész!") == ["szerzodes", "kesz"]
    assert S.stem("szerződések") == S.stem("szerződést") == "szerződés" and S.stem("házakban") == "ház" and S.stem("az") == "az"
    assert one(spark, lambda c: S.snippet(c, "kész"), t="x" * 500 + " Kész " + "y" * 500).count("<em>Kész</em>") == 1
    assert one(spark, lambda c: S.snippet(c, "nothing"), t="text") == ""
    assert len(S.hungarian_stop_words(spark)) > 100


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("   ", ""),
        ("<p>Hello <b>World</b></p>", "Hello World"),
        ("<html><body><h1>Title</h1><p>Paragraph with <a href='#'>link</a></p></body></html>", "Title Paragraph with link"),
        ("<p>  text  </p>", "text"),
        ("Szerz&odblac;d&eacute;s &#233; &#x27;a&#x27; 1 < 2 &amp; 3 > 2", "Szerződés é 'a' 1 < 2 & 3 > 2"),
        ("a&nbsp;&nbsp;b&#160;c &copy; &lt;b&gt; &unknown; &", "a b c © <b> &unknown; &"),
        ("<style>p {x: '<b>'}</style>one<script>if (1 < 2) { '</p>' }</script>two<br/>three<!-- <p>no</p> -->four", "one two threefour"),
        ("<td>a</td><td>b</td><li>c<li>d", "a b c d"),
        ("un<b>bro</b>ken <a title='x > y'>word</a>", "unbroken word"),
        ("kept <a href='lost", "kept"),
        ("if a<b then", "if a"),
        ("5 <6 and <3", "5 <6 and <3"),
        ("<div>x</div" , "x"),
    ],
)
def test_html_as_a_reader_sees_it(spark, html, want):
    assert one(spark, X.html_to_text, t=html) == want


def test_html_cap_inside_a_tag(spark):
    html = "<p>start</p>" + " " * (X.HTML_CHARS - 20) + "<a href='http://long.example'>never</a>"
    assert one(spark, X.html_to_text, t=html) == "start"


def test_local_time(spark):
    rows = spark.sql("select timestamp_ntz'2026-01-01 10:00:00' as w, timestamp_ntz'2026-07-01 10:00:00' as s")
    assert [str(x) for x in rows.select(X.to_local_time(F.col("w"), "Europe/Budapest"), X.to_local_time(F.col("s"), "Europe/Budapest")).first()] == ["2026-01-01 11:00:00", "2026-07-01 12:00:00"]
