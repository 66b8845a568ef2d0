"""DuckDB SQL for the operators that SQL can express.

The others are tested against plain versions in Python: XXH64 fingerprints,
hashed draws, language models, approximate search, packing and suffix sorting
have no counterpart there.
"""

from __future__ import annotations

from . import pii, urlvocab

_VECTORS = """
with recursive usable as (
    select vec_id, label, cast(embedding as double[]) as e, row_number() over () as n from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.n as a, b.n as b from usable a join usable b on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(a, b) as (select n, n from usable union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select r.a as n, min(u.vec_id) as component_id from reach r join usable u on u.n = r.b group by 1),
counts as (select a as n, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from usable join low using (n) left join counts using (n)
union all
select vec_id, 0, vec_id, true from embeddings where not (label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

_CHAT = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from turns group by 1
"""


def _url_sql(rules: list[tuple[str, str, str]]) -> str:
    edge = r"[^\p{L}\p{N}]"
    hit = lambda t: f"regexp_matches(u, '(^|{edge}){t}({edge}|$)')"
    # between two hits one character may close the first and open the second: it is doubled for counting
    count = lambda t: f"len(regexp_extract_all(regexp_replace(u, '({edge})', '\\1\\1', 'g'), '(^|{edge}){t}({edge}|$)'))"
    strict = " + ".join(count(t) for t in urlvocab.STRICT_TERMS)
    soft = " + ".join(f"{hit(t)}::int" for t in urlvocab.SOFT_TERMS)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' or suffix(host, '.{r[1]}')) and prefix(path, '{r[2]}')"
    parts = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    return f"""
with p as (select page_id, lower(coalesce(url, '')) as u, coalesce(translate({parts.format(1)}, '{urlvocab.UPPER}', '{urlvocab.LOWER}'), '') as host, coalesce({parts.format(2)}, '') as path from pages),
h as (select *, cast({strict} as bigint) as n_strict, cast({soft} as bigint) as n_soft from p)
select page_id, host, path, case {' '.join(f"when {fits(r)} then '{r[1]}{r[2]}'" for r in longest)} end as rule,
    case {' '.join(f"when {fits(r)} then '{r[0]}'" for r in longest)} when n_strict >= 1 or n_soft >= 2 then 'block' else 'allow' end as verdict, n_strict, n_soft from h
"""


def _pii_sql() -> str:
    """Matches are marked and split as in the operator; the patterns are the plain forms."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,6}(?: ?[A-Z0-9]{1,4})?\b",
        "secret": r"\b[A-Za-z0-9]{32,64}\b",
    }
    context = {k.name: k for k in pii.KINDS}
    pieces = " union all ".join(
        f"select doc_id, {k} as k, '{name}' as kind, string_split(regexp_replace(t, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as pieces from d" for k, (name, p) in enumerate(patterns.items())
    )
    digit = "cast(digits[i] as int)"
    worth = " ".join(f"when '{name}' then {round(100 * k.score)} + case when regexp_matches(near, '(?i)(?:^|[^A-Za-z])(?:{k.context})') then {round(100 * pii.BONUS)} else 0 end" for name, k in context.items())
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents),
s as (select * from ({pieces}) where len(pieces) > 1),
e as (select doc_id, k, kind, unnest(pieces) as piece, generate_subscripts(pieces, 1) as n from s),
a as (select doc_id, k, kind, n, split_part(piece, chr(2), 1) as m, piece,
        sum(length(piece) - case when n > 1 then 1 else 0 end) over (partition by doc_id, k order by n rows between unbounded preceding and current row) - (length(piece) - case when n > 1 then 1 else 0 end) as start from e),
m as (select a.*, regexp_replace(m, '[^0-9]', '', 'g') as digits, replace(m, ' ', '') as bare,
        substr(t, cast(greatest(start - {pii.NEAR}, 0) as bigint) + 1, cast(least(start, {pii.NEAR}) as bigint)) || ' ' || substr(split_part(piece, chr(2), 2), 1, {pii.NEAR}) as near from a join d using (doc_id) where n > 1),
w as (select *, case kind {worth} end as worth from m),
ok as (select doc_id, k, kind, worth, cast(start as bigint) as start, cast(start + length(m) as bigint) as stop from w where case kind
    when 'email' then true
    when 'ip' then len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or (length(ltrim(p, '0')) > 0 and cast(ltrim(p, '0') as bigint) > 255))) = 0
    when 'secret' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and worth >= 70
    when 'phone' then length(digits) between 8 and 15
    when 'card' then length(digits) between 16 and 19 and list_sum(list_transform(generate_series(1, length(digits)),
        lambda i: case when (length(digits) - i) % 2 = 0 then {digit} when {digit} >= 5 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0
    else worth >= 70 and length(bare) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[1:4], ''), lambda c: ascii(c))),
        lambda r, c: case when c >= 65 then r * 100 + c - 55 else r * 10 + c - 48 end % 97) = 1 end)
select doc_id, count(kind) filter (kind = 'email') as n_email, count(kind) filter (kind = 'ip') as n_ip, count(kind) filter (kind = 'card') as n_card, count(kind) filter (kind = 'phone') as n_phone,
    sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by k, start) filter (k < 4), '')) as base_sha256, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by k, start), '') as spans,
    coalesce(string_agg(kind || ':' || worth, ',' order by k, start), '') as scores
from d left join ok using (doc_id) group by doc_id
"""


def _oracles() -> dict[str, str]:
    from . import queries

    return {
        queries.op1_pivot_near_duplicates.__name__: _VECTORS, queries.op6_chat_format.__name__: _CHAT,
        queries.op7_url_filter.__name__: _url_sql(queries.URL_RULES), queries.op9_personal_data.__name__: _pii_sql(),
    }


ORACLES = _oracles()
