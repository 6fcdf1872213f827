"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings.

Positions come from marking: a regular-expression replacement puts one sign before and one after each match, the marked
text is split at the signs, and the lengths of the pieces add up to code-point positions. Candidates of a character class
(hexadecimal, base64) slide a window over their characters; an aggregate keeps the count of each character in the window,
five bits each in a few long numbers, and the sum of n * log2(n) over them, both changed by the character that enters and the
one that leaves. Each step costs the same, so a candidate costs in proportion to its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order, and the least length of what must be long.
ASSIGN = r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
# runs of at least so many signs: what is left of [0-9a-f]+ when shorter matches drop
LONG_HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

#: Entropy classes: run of characters, signs, window, least bits a character in the window.
CLASSES = {
    "entropy_hex": (r"[0-9a-fA-F]{24,}", "0123456789abcdef", 24, 3.2),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
}
#: Counting and keyboard rows and placeholders: a candidate, or a part of one that is cut, with one of these is no secret.
PLACEHOLDERS = r"(?i)example|placeholder|changeme|dummy|lorem|0123456789|abcdefgh|qwertyuiop|x{8}"
#: Candidates that hold one of these, or a path of words, are cut before they are scored.
ALLOWED = PLACEHOLDERS + r"|(?:[a-z]{3,}[/_=-]){3}"
#: The same for a backtracking engine: words begin where no letter stands before and are read once.
ALLOWED_ONCE = f"(?i:{PLACEHOLDERS.removeprefix('(?i)')})" + r"|(?<![A-Za-z])(?:[A-Za-z]{3,}+[/_=-]){3}"
#: Where they are cut: at whole words (lower, upper or camel case) with the separators that follow, and at '=' before other
#: signs. With a placeholder only two or more words at the front are, so that it still stands for what surrounds it.
_WORD = r"(?=[A-Za-z]{3})(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*+)[/_=-]+"
CUTS = r"(?<![A-Za-z0-9+])" + _WORD + r"|(?<!=)=++(?=.)"
FRONT_CUTS = r"^[/_=-]*+(?:" + _WORD + r"){2,}+|(?<!=)=++(?=.)"
OPEN, CLOSE = "\x01", "\x02"


def _pieces(text: Column, pattern: str) -> Column:
    """Array of the text's pieces: what comes before the first match, then for each match the match, CLOSE and what follows."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)


#: Matches whose positions are added up together: arrays that grow by one are copied each time, so they are kept short.
BLOCK = 256


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value) of all matches, code points, end exclusive. Positions are added up within blocks of
    matches first, then over the blocks."""
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string,value:string>>")

    def one(acc: Column, piece: Column) -> Column:
        value = F.substring_index(piece, CLOSE, 1)
        at = acc["at"]
        span = F.array(F.struct(at.alias("start"), (at + F.char_length(value)).alias("end"), F.lit(kind).alias("kind"), value.alias("value")))
        # a piece has one sign more than the text
        return F.struct((at + F.char_length(piece) - 1).cast("int").alias("at"), F.concat(acc["found"], span).alias("found"))

    def block(pieces: Column) -> Column:
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("found")), one)

    def after(acc: Column, b: Column) -> Column:
        moved = F.transform(b["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.struct((acc["at"] + b["at"]).cast("int").alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    def all_of(pieces: Column) -> Column:
        """pieces: what comes before the first match, then a piece a match, one at least."""
        blocks = F.transform(F.sequence(F.lit(2), F.size(pieces), F.lit(BLOCK)), lambda i: block(F.slice(pieces, i, BLOCK)))
        none = F.from_json(F.lit("[]"), "array<array<struct<start:int,end:int,kind:string,value:string>>>")
        return F.flatten(F.aggregate(blocks, F.struct(F.char_length(pieces[0]).alias("at"), none.alias("found")), after, lambda acc: acc["found"]))

    # one row's pieces under a name, so they are made once
    named = F.array(_pieces(text, pattern))
    return F.transform(named, lambda p: F.when(F.size(p) > 1, all_of(p)).otherwise(empty))[0]


#: Bits of a character's count, and characters whose counts one long holds.
COUNT_BITS, COUNTS_A_LONG = 5, 12


def _entropy_window(value: Column, alphabet: str, window: int, least: float) -> Column:
    """(first, last): starts of the first and the last window of `value` with `least` bits a character; first is -1 without one.

    The longs n0, n1, .. hold how often each character stands in the window, total the sum of counts * log2(counts);
    H = log2(w) - total / w. The window, its counts below 2 ** COUNT_BITS, is at most 31 characters.
    """
    longs = range(-(-len(alphabet) // COUNTS_A_LONG))
    weight = F.array(*[F.lit(0.0)] + [F.lit(float(n * math.log2(n))) for n in range(1, window + 2)])
    limit = F.round(F.log2(F.lit(float(window))) - F.lit(least), 9)
    # for each character the long and the place in it of its count; -1 where no character leaves yet
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    places = F.arrays_zip(codes.alias("new"), F.slice(leaving, 1, F.char_length(value)).alias("old"))
    step = lambda c, name: [F.floor(c / COUNTS_A_LONG).cast("int").alias(f"{name}_long"), (F.pmod(c, F.lit(COUNTS_A_LONG)) * COUNT_BITS).cast("int").alias(f"{name}_shift")]
    steps = F.transform(places, lambda p: F.struct(*step(p["new"], "in"), *step(p["old"], "out"), (p["new"] == p["old"]).alias("same")))

    def count(acc: Column, s: Column, name: str) -> Column:
        long = F.lit(0).cast("long")
        for k in longs:
            long = F.when(s[f"{name}_long"] == k, acc[f"n{k}"]).otherwise(long)
        return F.call_function("shiftright", long, s[f"{name}_shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def slide(acc: Column, s: Column) -> Column:
        one = lambda name, k: F.when(s[f"{name}_long"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), s[f"{name}_shift"])).otherwise(F.lit(0).cast("long"))
        counts = [(acc[f"n{k}"] + one("in", k) - one("out", k)).alias(f"n{k}") for k in longs]
        n_in, n_out = count(acc, s, "in"), count(acc, s, "out")
        change = F.element_at(weight, n_in + 2) - F.element_at(weight, n_in + 1) + F.when(s["out_long"] >= 0, F.element_at(weight, F.greatest(n_out, F.lit(1))) - F.element_at(weight, n_out + 1)).otherwise(F.lit(0.0))
        return F.struct(*counts, (acc["total"] + F.when(s["same"], F.lit(0.0)).otherwise(change)).alias("total"), (acc["i"] + 1).alias("i"), *ends(acc))

    def ends(acc: Column) -> list[Column]:
        """first and last, the window before this step counted too."""
        hit = (acc["i"] >= window) & (F.round(acc["total"] / window, 9) <= limit)
        start = acc["i"] - window
        return [F.when(hit & (acc["first"] < 0), start).otherwise(acc["first"]).cast("int").alias("first"), F.when(hit, start).otherwise(acc["last"]).cast("int").alias("last")]

    zero = F.struct(*[F.lit(0).cast("long").alias(f"n{k}") for k in longs], F.lit(0.0).cast("double").alias("total"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(steps, zero, slide, lambda acc: F.struct(*ends(acc)))


def _parts(s: Column) -> Column:
    """Array of (start, value): what is left of an allow-listed candidate between its cuts, if without placeholders."""
    words = F.when(s["value"].rlike(PLACEHOLDERS), _spans(s["value"], FRONT_CUTS, "cut")).otherwise(_spans(s["value"], CUTS, "cut"))
    starts = F.concat(F.array(F.lit(0)), F.transform(words, lambda w: w["end"]))
    ends = F.concat(F.transform(words, lambda w: w["start"]), F.array(F.char_length(s["value"])))
    signs = s["value"].cast("binary")  # candidates are ASCII: a part of the bytes is found without reading those before it
    parts = F.zip_with(starts, ends, lambda a, b: F.struct((s["start"] + a).alias("start"), F.substring(signs, a + 1, b - a).cast("string").alias("value")))
    return F.filter(parts, lambda x: ~x["value"].rlike(PLACEHOLDERS))


def _entropy_spans(text: Column, kind: str) -> Column:
    """Spans of the windows of high entropy in the candidates of a class: from the first such window's start to the last one's
    end. Candidates of prose (no digit, or no letter) have none; of allow-listed ones the parts between words are scored."""
    pattern, alphabet, window, least = CLASSES[kind]
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    whole = lambda s: F.array(F.struct(s["start"].alias("start"), s["value"].alias("value")))
    found = F.transform(F.filter(_spans(text, pattern, kind), mixed), lambda s: F.when(s["value"].rlike(ALLOWED_ONCE), _parts(s)).otherwise(whole(s)))
    found = F.filter(F.flatten(found), lambda s: mixed(s) & (F.char_length(s["value"]) >= window))
    value = (lambda s: F.lower(s["value"])) if kind == "entropy_hex" else (lambda s: s["value"])
    scored = F.transform(found, lambda s: F.struct(s.alias("s"), _entropy_window(value(s), alphabet, window, least).alias("w")))
    return F.transform(
        F.filter(scored, lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct((x["s"]["start"] + x["w"]["first"]).alias("start"), (x["s"]["start"] + x["w"]["last"] + window).alias("end"), F.lit(kind).alias("kind"), F.substring(x["s"]["value"], 1, 0).alias("value")),
    )


def _ordered(spans: Column) -> Column:
    """Spans by start, then in the order of KINDS."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", all_col: str = "all_spans") -> DataFrame:
    """docs with two columns more: base_col and all_col, arrays of (kind, start, end) ordered by start, then kind.

    Whole texts are scanned; a null text is empty and has no spans. all_col adds to base_col the entropy spans that no base
    span covers. Texts in which no pattern can match skip the marking. Rows and other columns stay as they are, but for
    columns that already have the two names, which are replaced.
    """
    # one-for-one replacement keeps positions: no pattern holds the two signs
    rows = docs.withColumn("__lm_text", F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, "\x03\x03"))
    t = F.col("__lm_text")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string,value:string>>")
    assign = F.filter(_spans(t, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST["assign"])
    access = F.filter(_spans(t, ACCESS, "access"), lambda s: F.char_length(s["value"]) >= LEAST["access"])
    hexes = F.filter(_spans(t, LONG_HEX, "hex"), lambda s: F.char_length(s["value"]) >= LEAST["hex"])
    rows = rows.withColumn(
        "__lm_base",
        F.concat(F.when(t.rlike(ASSIGN), assign).otherwise(none), F.when(t.contains("AKIA"), access).otherwise(none), F.when(t.rlike(LONG_HEX), hexes).otherwise(none)),
    )
    rows = rows.withColumn("__lm_more", F.concat(*[F.when(t.rlike(CLASSES[k][0]), _entropy_spans(t, k)).otherwise(none) for k in CLASSES]))
    uncovered = F.filter("__lm_more", lambda s: ~F.exists(F.col("__lm_base"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    out = rows.withColumn(base_col, _ordered(F.col("__lm_base"))).withColumn(all_col, _ordered(F.concat("__lm_base", uncovered)))
    return out.drop("__lm_text", "__lm_base", "__lm_more")


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of all_spans replaced by the mask; spans that overlap become one mask. Texts without spans, null
    ones included, stay as they are."""
    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).cast("int").alias("at"),
        )

    done = F.aggregate(
        F.col("__lm_all"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        cut,
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(F.col(text_col)))),
    )
    return scan(docs, text_col, "__lm_found", "__lm_all").withColumn(text_col, F.when(F.size("__lm_all") > 0, done).otherwise(F.col(text_col))).drop("__lm_found", "__lm_all")
