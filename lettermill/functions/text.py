"""Column expressions over mail texts, addresses, paths and documents."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What starts a reply chain, a forwarded block or a signature, and the caps on text lengths.
REPLY_MARKER = (
    r"(?mi)^[ \t]*(-{3,}[ \t]*(?:original message|eredeti üzenet|forwarded message|továbbított üzenet)[^\n]*$"
    r"|On .{5,120}?wrote:\s*$|Van:[ \t]*.+@.+|Feladó:[ \t]*.+|From:[ \t]*.+@.+)|^--[ \t]*$"
)
BODY_CHARS, HTML_CHARS, MODEL_CHARS, CONTEXT_CHARS, HEAD_CHARS = 50_000, 100_000, 3_000, 500, 2_000
# Display names of a mail file's top folder.
TOP_FOLDERS = ["outlook-adatfájl teteje", "top of outlook data file", "top of information store", "top of personal folders", "személyes mappák"]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def normalize_message_id(message_id: Column, unique_entry_id: Column, key: Column) -> Column:
    """Message id trimmed, in lower case, without angle brackets and white space; else the entry id, else the key."""
    return F.coalesce(blank_to_null(F.regexp_replace(F.lower(F.trim(message_id)), r"[<>\s]", "")), blank_to_null(unique_entry_id), key)


def source_owner(name: Column) -> Column:
    """File name up to its last dot, unless the name starts there; null gives ''."""
    return F.coalesce(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(""))


def address_key(address: Column) -> Column:
    return F.lower(F.trim(address))


def address_domain(address: Column) -> Column:
    """What follows the first @, else ''."""
    return F.coalesce(F.regexp_extract(address, r"^[^@]*@(.*)$", 1), F.lit(""))


def split_addresses(display: Column) -> Column:
    """Addresses of a ;-separated list, trimmed, empty ones dropped; null gives no address."""
    return F.filter(F.transform(F.split(F.coalesce(display, F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")


def entry_id(file_name: Column, node: Column) -> Column:
    return F.sha2(F.concat_ws("-", file_name, node), 256)


def strip_replies(text: Column) -> Column:
    """Text up to the first marker, right-trimmed; the whole text if nothing would be left."""
    cut = F.regexp_replace(F.split(text, REPLY_MARKER, 2)[0], r"\s+$", "")
    return F.when(cut.rlike(r"\S"), cut).otherwise(text)


#: Elements that leave no space between the texts around them; every other one does.
INLINE = frozenset("a abbr b bdi bdo big cite code dfn em font i kbd label mark q s samp small span strike strong sub sup tt u var".split())


class _Visible(HTMLParser):
    """Collects what a reader sees: no scripts, styles and comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.parts.append("" if tag in INLINE else " ")

    def handle_startendtag(self, tag, attrs):
        self.parts.append("" if tag in INLINE else " ")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        self.parts.append("" if tag in INLINE else " ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _bare(m: re.Match) -> str:
    """A reference as it is if it has its ';' and a meaning, else with its '&' as a sign of its own."""
    return m[0] if m[0].endswith(";") and (m[1] == "#" or m[0][1:] in html5) else "&amp;" + m[0][1:]


def visible_text(html: str | None, closed: bool = False) -> str:
    """Visible text of HTML, both capped: entities as signs, space collapsed; a tag that the end or the cap cuts off is left out,
    a '<' that begins no tag is text. With closed only references that end in ';' are signs, and '&amp' without it is text; as
    a browser has it, some old names need none."""
    source = re.sub(r"<[a-zA-Z/!][^>]*\Z", "", (html or "")[:HTML_CHARS])
    if closed:
        source = re.sub(r"&(#?)(?:(?<=#)(?:\d+|[xX][0-9a-fA-F]+)|(?<!#)[a-zA-Z][a-zA-Z0-9]*);?|&", _bare, source)
    parser = _Visible()
    parser.feed(source)
    parser.close()
    return " ".join("".join(parser.parts).split())[:BODY_CHARS]


@F.pandas_udf(T.StringType())
def _visible_texts(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


@F.pandas_udf(T.StringType())
def _closed_texts(html: pd.Series) -> pd.Series:
    return html.map(lambda h: visible_text(h, closed=True))


def html_to_text(html: Column, closed: bool = False) -> Column:
    """visible_text() of a column, in Arrow batches: entities and broken markup need a parser, which no built-in function has."""
    return _closed_texts(html) if closed else _visible_texts(html)


def best_text(body: Column, html: Column | None = None) -> Column:
    """Stripped plain body if there is one, else stripped text of the HTML, else ''. Only rows without a body have their HTML
    parsed."""
    plain = F.regexp_replace(body, r"^\s+|\s+$", "")
    out = F.when(body.rlike(r"\S"), F.substring(strip_replies(plain), 1, BODY_CHARS))
    if html is not None:
        needed = html_to_text(F.when(F.coalesce(body.rlike(r"\S"), F.lit(False)), F.lit(None)).otherwise(html))
        out = out.when(html.rlike(r"\S"), strip_replies(needed))
    return out.otherwise(F.lit(""))


def strip_reply_or_head(body: Column) -> Column:
    """The visible reply, else the first 2000 characters, trimmed."""
    return F.trim(F.coalesce(blank_to_null(strip_replies(body)), F.substring(body, 1, HEAD_CHARS), F.lit("")))


def truncate(text: Column, chars: int = MODEL_CHARS) -> Column:
    return F.substring(text, 1, chars)


def folder_path(names: Column) -> Column:
    """Folder names joined by ' / '; a top folder that only stands for the file is left out."""
    top = F.lower(F.element_at(names, 1)).isin(TOP_FOLDERS)
    return F.array_join(F.when(top, F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names), " / ")


def remap_path(path: Column, prefix: str, mount: str) -> Column:
    """A path below the prefix moves below the mount; any other gets the mount in front."""
    return F.when(path.startswith(prefix), F.concat(F.lit(mount), F.substring(path, len(prefix) + 1, 1 << 30))).otherwise(F.concat(F.lit(mount), path))


def default_filename(name: Column, position: Column) -> Column:
    return F.coalesce(F.when(name != "", name), F.concat(F.lit("attachment"), position.cast("string")))


# Content types by file extension.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "txt": "text/plain",
    "html": "text/html",
    "md": "text/markdown",
    "csv": "text/csv",
    "json": "application/json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "zip": "application/zip",
    "eml": "message/rfc822",
}


def extension(filename: Column) -> Column:
    """Extension in lower case, '' without one."""
    return F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))


def guess_content_type(filename: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, extension(filename)), F.lit("application/octet-stream"))


def human_bytes(n: Column, decimals: int = 1, units: tuple[str, ...] = ("B", "KB", "MB", "GB")) -> Column:
    """Bytes in the largest fitting unit; plain bytes have no decimals."""
    step = F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10), F.lit(len(units) - 1)).cast("int")
    scaled = F.format_string(f"%.{decimals}f", n / F.pow(F.lit(1024.0), step))
    return F.when(step == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(scaled, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), step + 1)))


def hex_id(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def partial_hash(content: Column, most: int = 1 << 20) -> Column:
    return F.sha2(F.substring(content, 1, most), 256)


def to_epoch_millis(received: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), received.cast("timestamp_ntz"))


def to_local_time(instant: Column, zone: str) -> Column:
    """The time of day that clocks in a zone show at an instant given without zone in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))


def in_days(received: Column, first: str | None, last: str | None) -> Column:
    """Whether a time lies on the days from first to last, both included; either may be left out."""
    out = F.lit(True)
    if first:
        out = out & (received >= F.lit(first).cast("date").cast("timestamp_ntz"))
    if last:
        out = out & (received < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return out


K1_SCHEMA = (
    "struct<entities:array<struct<name:string,type:string>>,claims:array<struct<text:string,claimType:string,confidence:double>>,"
    "evidence:array<struct<text:string,evidenceType:string,sourceRef:string>>,mechanisms:array<struct<name:string,description:string,mechanismType:string>>,"
    "relations:array<struct<subject:string,predicate:string,object:string>>>"
)


def parse_k1(raw: Column) -> Column:
    """A model's JSON as five arrays: fences stripped, defaults filled in, short names and blank texts dropped; anything but a
    JSON object gives empty arrays."""
    text = F.trim(raw)
    text = F.when(text.startswith("```"), F.trim(F.regexp_replace(text, r"```(?:json)?\s*", ""))).otherwise(text)
    k1 = F.from_json(F.when(text.startswith("{"), text), K1_SCHEMA)

    def kept(field: str, keep, make) -> Column:
        array = k1[field]
        made = F.transform(F.coalesce(array, F.expr("array()").cast(dict(_K1_TYPES)[field])), make)
        return F.filter(made, keep).alias(field)

    def text_of(c: Column, default: str = "") -> Column:
        return F.coalesce(c, F.lit(default))

    return F.struct(
        kept("entities", lambda e: F.char_length(e["name"]) >= 3, lambda e: F.struct(F.trim(text_of(e["name"])).alias("name"), text_of(e["type"], "TOPIC").alias("type"))),
        kept("claims", lambda e: e["text"] != "", lambda e: F.struct(F.trim(text_of(e["text"])).alias("text"), text_of(e["claimType"], "FACTUAL").alias("claimType"), F.coalesce(e["confidence"], F.lit(0.8)).alias("confidence"))),
        kept("evidence", lambda e: e["text"] != "", lambda e: F.struct(F.trim(text_of(e["text"])).alias("text"), text_of(e["evidenceType"], "INFERENCE").alias("evidenceType"), text_of(e["sourceRef"]).alias("sourceRef"))),
        kept("mechanisms", lambda e: e["name"] != "", lambda e: F.struct(F.trim(text_of(e["name"])).alias("name"), text_of(e["description"]).alias("description"), text_of(e["mechanismType"], "ORGANIZATIONAL").alias("mechanismType"))),
        kept(
            "relations",
            lambda e: (e["subject"] != "") & (e["predicate"] != "") & (e["object"] != ""),
            lambda e: F.struct(F.trim(text_of(e["subject"])).alias("subject"), F.trim(text_of(e["predicate"])).alias("predicate"), F.trim(text_of(e["object"])).alias("object")),
        ),
    )


_K1_TYPES = [
    ("entities", "array<struct<name:string,type:string>>"),
    ("claims", "array<struct<text:string,claimType:string,confidence:double>>"),
    ("evidence", "array<struct<text:string,evidenceType:string,sourceRef:string>>"),
    ("mechanisms", "array<struct<name:string,description:string,mechanismType:string>>"),
    ("relations", "array<struct<subject:string,predicate:string,object:string>>"),
]

#: Instruction that goes before a mail's text when knowledge is to be extracted.
K1_PROMPT = (
    "Read this business mail and answer with one JSON object only, with the arrays entities (name, type of PERSON, ORG, TOPIC or LOCATION), "
    "claims (text, claimType, confidence), evidence (text, evidenceType, sourceRef), mechanisms (name, description, mechanismType) and "
    "relations (subject, predicate, object). Leave an array empty where nothing fits.\n\nMail:\n"
)


def k1_prompt(text: Column) -> Column:
    """Instruction and the first 3000 characters; null for a blank text."""
    return F.when(text.rlike(r"\S"), F.concat(F.lit(K1_PROMPT), truncate(text)))


# What counts as an image and as a citation in Markdown.
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
CITATION = r"(?<!!)\[(?:\d[\d,\s\-]*|\w[^\[\]]{0,40}(?:,\s*\d{4})?)\]"


def md_text_blocks(markdown: Column) -> Column:
    """Blocks between blank lines, trimmed; empty blocks and tables are dropped."""
    blocks = F.transform(F.split(markdown, r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.filter(blocks, lambda b: (b != "") & ~b.startswith("|"))


def md_figures(markdown: Column) -> Column:
    """Image references: the alternative text, else the source."""
    return F.zip_with(F.regexp_extract_all(markdown, F.lit(IMAGE), 1), F.regexp_extract_all(markdown, F.lit(IMAGE), 2), lambda alt, src: F.coalesce(blank_to_null(F.trim(alt)), F.trim(src)))


def md_citations(markdown: Column) -> Column:
    """Bracketed citations, once each, in order; not the alternative texts of images."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit(CITATION), 0))


def md_tables(markdown: Column) -> Column:
    """Pipe tables as (headers, rows); a row maps headers to cells. A table is a block of lines that start with | and whose
    second line is the separator."""
    table = r"(?m)^(\|[^\n]*)\n\|[ \t\-|:]+\|[ \t]*(?:\n\|[^\n]*)*"
    whole = F.regexp_extract_all(markdown, F.lit(table), 0)

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+\s*$", ""), r"\|"), lambda c: F.trim(c))

    def one(block: Column) -> Column:
        lines = F.split(block, "\n")
        headers = cells(lines[0])
        n = F.size(headers)
        rows = F.transform(
            F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))),
            lambda line: F.map_from_arrays(F.slice(headers, 1, F.least(n, F.size(cells(line)))), F.slice(cells(line), 1, n)),
        )
        return F.struct(headers.alias("headers"), rows.alias("rows"))

    return F.transform(whole, one)


def parse_document(markdown: Column) -> Column:
    """The structure of a document: blocks, tables, figures and citations, with an error where there is no text."""
    return F.struct(
        md_text_blocks(markdown).alias("text_blocks"),
        md_tables(markdown).alias("tables"),
        md_figures(markdown).alias("figures"),
        md_citations(markdown).alias("citations"),
        F.when(markdown.isNull(), F.lit("no text")).alias("error"),
    )
