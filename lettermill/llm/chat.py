"""Chat formatting with offset-aligned loss masks.

A turn is written as <s>[ROLE] text</s> and a line end; a user's as <s>[INST] text [/INST]</s>. Control strings inside
texts get a backslash more than they have, which reading takes away again. A conversation is rendered whole and encoded
once, with character offsets; the sorted spans of its assistant texts are intersected with the token spans by binary
search, and each masked token keeps the part of its characters that lies in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLES = frozenset({"assistant"})
#: A conversation of more characters is written as several segments, cut between turns. A turn ends in a line end and the
#: next starts with a sign, which the encoder never joins, so the segments' tokens are those of the whole.
SEGMENT_CHARS = 1_000_000

CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>\[([^\]]*)\] (.*?)</s>\n", re.S)

FORMATTED = "conv_id long, segment long, turns long, formatted string, ids binary, mask binary, mask_starts binary, mask_ends binary"


def escape(text: str) -> str:
    """Text without control strings: <s>, </s>, [INST] and [/INST] get a backslash after their first sign, and so do those that
    have backslashes there already."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _tag(role: str) -> str:
    if role == "user":
        return "INST"
    return "%49NST" if role == "INST" else quote(role, safe="")


def _role(tag: str) -> str:
    return "user" if tag == "INST" else unquote(tag)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A written turn, with the span of its text."""
    head, body = f"<s>[{_tag(role)}] ", escape(text)
    tail = " [/INST]</s>\n" if role == "user" else "</s>\n"
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each written turn."""
    for tag, body in TURN.findall(formatted):
        role = _role(tag)
        yield role, unescape(body.removesuffix(" [/INST]") if role == "user" else body)


def masked(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For token spans and sorted text spans (rows of start, end): which tokens overlap a text, and the overlaps."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool), np.zeros(0, dtype="<u4"), np.zeros(0, dtype="<u4")
    at = np.minimum(np.searchsorted(spans[:, 1], offsets[:, 0], side="right"), len(spans) - 1)
    lo, hi = np.maximum(offsets[:, 0], spans[at, 0]), np.minimum(offsets[:, 1], spans[at, 1])
    mask = lo < hi
    return mask, lo[mask].astype("<u4"), hi[mask].astype("<u4")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def _formatter(vocabulary: str, loss_roles: frozenset[str], segment_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        rows: list[tuple] = []
        conv, segment, turns, size = None, 0, 0, 0
        texts: list[str] = []
        spans: list[tuple[int, int]] = []

        def flush() -> None:
            nonlocal segment, turns, size, texts, spans
            if turns:
                whole = "".join(texts)
                got = tokenizer.encode(whole, add_special_tokens=False)
                mask, lo, hi = masked(np.array(got.offsets, dtype=np.int64).reshape(-1, 2), np.array(spans, dtype=np.int64).reshape(-1, 2))
                rows.append((conv, segment, turns, whole, np.array(got.ids, dtype="<u4").tobytes(), mask.astype(np.uint8).tobytes(), lo.tobytes(), hi.tobytes()))
                segment += 1
            turns, size, texts, spans = 0, 0, [], []

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4]
            names = [c.split()[0] for c in FORMATTED.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        started, held = False, 0
        for batch in batches:
            for key, role, text in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                key = key.as_py()
                if not started or key != conv:
                    flush()
                    conv, segment, started = key, 0, True
                written, a, b = render_turn(role.as_py() or "", text.as_py() or "")
                if turns and size + len(written) > segment_chars:
                    flush()
                if (role.as_py() or "") in loss_roles and a < b:
                    spans.append((size + a, size + b))
                texts.append(written)
                size += len(written)
                held += len(written)
                turns += 1
                if held > 8_000_000 and rows:
                    held = 0
                    yield batch_of()
        flush()
        if rows:
            yield batch_of()

    return run


def format_conversations(conversations: DataFrame, vocabulary: str, loss_roles: frozenset[str] = LOSS_ROLES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row for each conversation, or for each segment of a very long one: (conv_id, segment, turns, formatted, ids, mask,
    mask_starts, mask_ends). ids are little-endian unsigned 32-bit tokens of the formatted text, mask has a byte a token,
    mask_starts and mask_ends the characters that each masked token covers of a text with loss.

    conversations has conv_id, turn, role and text; rows go by turn, then role and text where turns tie. Null roles and
    texts are empty; rows with a null conv_id are one conversation; repeated rows stay; other columns are ignored. Rows are
    dealt by conversation and sorted outside the task, which holds one segment at a time however long a conversation is.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(vocabulary, loss_roles, segment_chars), FORMATTED)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out = None, None, []

    def close() -> None:
        if state:
            out.append((conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    for batch in batches:
        for key, formatted, starts, ends in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "formatted", "mask_starts", "mask_ends")), strict=True):
            if state is None or key.as_py() != conv:
                close()
                conv, state = key.as_py(), {"turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            whole = formatted.as_py()
            state["chars"] += len(whole)
            for role, text in parse(whole):
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
            lo, hi = (np.frombuffer(c.as_py(), dtype="<u4").astype(np.int64) for c in (starts, ends))
            if len(lo):
                # tokens of one text follow each other without a gap; those that share a character overlap
                new = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]])
                first = np.flatnonzero(new)
                for a, b in zip(lo[first], np.maximum.reduceat(hi, first), strict=True):
                    text = unescape(whole[a:b])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
    close()
    if out:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of formatted conversations finds: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). The formatted text is parsed into turns; the text with loss is what the masked tokens cover, unescaped."""
    rows = formatted.select("conv_id", "segment", "formatted", "mask_starts", "mask_ends").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(_reader, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
