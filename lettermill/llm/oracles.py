"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from lettermill.llm import secret_scan as S


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pieces(column: str, pattern: str) -> str:
    return f"string_split(regexp_replace({column}, {_q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"


def _spans(pieces: str) -> str:
    """Starts and values of the marked matches: each earlier match has one sign more than the text."""
    value = f"string_split({pieces}[i], chr(2))[1]"
    start = f"cast(list_sum(list_transform({pieces}[1:i-1], lambda x: length(x))) as bigint) - (i - 2)"
    return f"list_transform(range(2, len({pieces}) + 1), lambda i: {{'s': {start}, 'v': {value}}})"


def _total(window: str) -> str:
    return f"list_sum(list_transform(map_values(list_histogram(string_split({window}, ''))), lambda n: n * log2(n)))"


def _entropy(kind: str, rank: int) -> str:
    _, _, window, least = S.CLASSES[kind]
    v = "lower(x.v)" if kind == "entropy_hex" else "x.v"
    hits = f"list_filter(range(0, length(x.v) - {window} + 1), lambda j: round({_total(f'substr({v}, cast(j + 1 as int), {window})')} / {window}, 9) <= round(log2({window}.0::double) - {least}::double, 9))"
    return f"""select doc_id, {rank} as r, '{kind}' as kind, x.s + h[1] as a, x.s + h[-1] + {window} as b from (select doc_id, x, {hits} as h from
        (select doc_id, unnest({_spans('p')}) as x from (select doc_id, {_pieces('t', S.CLASSES[kind][0])} as p from d))
        where regexp_matches(x.v, '[0-9]') and regexp_matches(x.v, '[A-Za-z]') and not regexp_matches(x.v, {_q(S.ALLOWED)})) where len(h) > 0"""


def _base(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"select doc_id, {rank} as r, '{kind}' as kind, x.s as a, x.s + length(x.v) as b from (select doc_id, unnest({_spans('p')}) as x from (select doc_id, {_pieces('t', pattern)} as p from d)) where {keep}"


SECRETS = f"""with d as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents),
 base as ({_base('assign', 0, S.ASSIGN, f"length(regexp_extract(x.v, {_q(S.ASSIGN)}, 2)) >= {S.LEAST['assign']}")}
  union all {_base('access', 1, S.ACCESS, f"length(x.v) >= {S.LEAST['access']}")}
  union all {_base('hex', 2, S.LONG_HEX, f"length(x.v) >= {S.LEAST['hex']}")}),
 more as ({_entropy('entropy_hex', 3)} union all {_entropy('entropy_base64', 4)}),
 every as (select * from base union all select * from more m where not exists (select 1 from base c where c.doc_id = m.doc_id and c.a <= m.a and c.b >= m.b)),
 told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(concat(kind, ':', a, ':', b), ',' order by a, r, b) filter (r < 3) as base, string_agg(concat(kind, ':', a, ':', b), ',' order by a, r, b) as spans from every group by doc_id)
 select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
 from d left join told on d.doc_id = told.doc_id"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NUMBER = "cast(('0x' || substr(h, 5 * p + 1, 5)) as bigint)"
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda p: concat(" + ", ".join(f"substr('{_LETTERS}', cast(({_NUMBER} >> {s}) & 31 as int) + 1, 1)" for s in (15, 10, 5, 0)) + ")), '')"

WARC = f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
 b as (select h, max(page_id) as best from p group by h)
 select page_id, cast(payload_bytes as bigint) as payload_bytes, {_BASE32.replace('(h,', '(p.h,')} as payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type,
 case when page_id = best then null else best end as refers_to from p join b on p.h = b.h""".replace("lambda p:", "lambda k:").replace("5 * p + 1", "5 * k + 1")

_CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
_TURNS = """t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""

CHAT = f"""with {_TURNS} select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length(text) + len(regexp_extract_all(text, {_q(_CONTROL)})) + case role when 'user' then {len('<s>[INST]  [/INST]</s>') + 1} else {len('<s>[] </s>') + 1} + length(role) end) as bigint) as formatted_chars
 from t group by conv_id"""

ORACLE_SQL = {"op6_secret_scan": SECRETS, "op8_warc": WARC, "op9_chat": CHAT}
