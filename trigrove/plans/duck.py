"""The same name rules as SQL text for DuckDB, from the same patterns."""

from __future__ import annotations

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(pattern)})"


def trim(x: str) -> str:
    return sub(x, tx.TRIM)


def clean_entity(x: str) -> str:
    out = trim(x)
    for p in tx.ENTITY_PASSES:
        out = trim(sub(out, p))
    return f"case when {has(trim(x), f'^{tx.DATE}$')} then {trim(x)} else {out} end"


def normalize(x: str) -> str:
    out = trim(sub(x, tx.COMPANY_TRADE))
    return f"case when length({out}) < 2 then {x} else {out} end"


def normalize_e2(x: str) -> str:
    company = trim(sub(x, tx.COMPANY))
    both = trim(sub(company, tx.COMPANY_TRADE))
    return f"case when length({company}) < 2 or {company} = {x} or length({both}) < 2 then {x} else {both} end"


def generic(x: str) -> str:
    return f"({x} in {listed(lx.GENERIC_ENTITIES)} or length({x}) < 2 or {has(x, '^[0-9]+$')})"


def pair_fault(e1: str, rel: str, e2: str) -> str:
    tests = [
        (f"{rel} = '位于' and length({e1}) <= 2 and not {has(e1, f'^[{tx.CJK}]+$')}", "short_place"),
        (f"{rel} in ('研发', '创建', '成立', '包含') and {generic(e2)}", "generic_e2"),
        (f"{rel} in ('研发', '创建', '成立', '位于', '包含') and {generic(e1)}", "generic_e1"),
        (f"{rel} = '包含' and (contains({e1}, {e2}) or contains({e2}, {e1}))", "one_holds_other"),
        (f"{e2} like '%等领域' or {e2} like '%等方面'", "field_list"),
        (f"{rel} = '成立' and {e1} like '帝%'", "emperor"),
        (f"{rel} = '生产' and length({e1}) > 15", "long_producer"),
    ]
    for r, firsts, seconds in lx.NO_FACTS:
        tests.append((f"{rel} = {quote(r)}" + (f" and {e1} in {listed(firsts)}" if firsts else "") + (f" and {e2} in {listed(seconds)}" if seconds else ""), "no_fact"))
    return "case " + " ".join(f"when {t} then '{n}'" for t, n in tests) + " end"


def fault(e1: str = "e1", rel: str = "rel", e2: str = "e2") -> str:
    return (
        f"case when {e1} = '' or {rel} = '' or {e2} = '' then 'empty' when length({e1}) > 50 or length({e2}) > 50 then 'too_long' when {e1} = {e2} then 'self'"
        f" when {generic(e1)} or {generic(e2)} then 'generic' when {pair_fault(e1, rel, e2)} is not null then 'bad_pair' end"
    )


def cleaned(source: str, keep: str) -> str:
    """Two steps: names cleaned, then normalised."""
    tail = trim(sub(trim(sub("e2", rf"^(?:[了着过]{tx.SPACE}*)+")), tx.TAIL))
    return f"""(select {keep}, {normalize('e1')} as e1, rel, {normalize_e2('e2')} as e2 from (select {keep}, e1, rel, {tail} as e2
      from (select {keep}, {clean_entity('e1')} as e1, {trim('rel')} as rel, {clean_entity('e2')} as e2 from {source})))"""


def clean_mention(x: str) -> str:
    front = trim(sub(trim(x), rf"^(?:(?:{tx.EDGE}){tx.SPACE}*)+"))
    return trim(sub(front, rf"(?:{tx.SPACE}*(?:{tx.EDGE}))+$"))


def valid_mention(x: str) -> str:
    return (
        f"case when length({x}) not between 2 and 30 or not {has(x, f'[{tx.CJK}]')} then false when {has(x, f'^{tx.DATE}$')} then true when {x} in {listed(lx.GENERIC_NOUNS)} then false"
        f" when {has(x, '[0-9]{4}')} and {has(x, f'[{tx.CJK}]{{2,}}')} then false when length({sub(x, f'[{tx.CJK}]')}) * 10 > length({x}) * 7 then false"
        f" when {has(x, '[0-9]{3,}')} and length({sub(x, '[0-9]')}) < 3 then false else true end"
    )


def person(x: str, etype: str) -> str:
    return f"case when {etype} in ('组织名', '其他') and length({x}) between 2 and 4 and {has(x, f'^[{lx.SURNAMES}]')} and {x} not in {listed(lx.ORG_SUFFIXES + lx.GENERIC_NOUNS)} then '人名' else {etype} end"


def clauses(source: str) -> str:
    """doc_id, clause_idx, clause of ``source(doc_id, text)``."""
    parts = f"list_filter(list_transform(regexp_split_to_array(text, {quote(tx.CLAUSE_END)}), lambda p: {trim('p')}), lambda p: p <> '')"
    return f"(select doc_id, (i - 1)::int as clause_idx, ps[i] as clause from (select doc_id, {parts} as ps from {source}) c, lateral (select unnest(range(1, len(ps) + 1)) as i) r)"


def sentences(source: str) -> str:
    parts = f"regexp_extract_all(text, {quote(tx.SENTENCE)})"
    return f"(select doc_id, (i - 1)::int as sent_idx, ps[i] as sent_text from (select doc_id, {parts} as ps from {source}) c, lateral (select unnest(range(1, len(ps) + 1)) as i) r where {sub('ps[i]', tx.SPACE + '+')} <> '')"


def case(x: str, values: dict) -> str:
    return f"case {x} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in values.items()) + " end"


#: Mentions of tokens: runs of labels, compound parts by recursion over the links, and a walk over the names of a sentence in order.
TOKEN_MENTIONS = f"""
runs as (select doc_id, sent_idx, ent_type, string_agg(text, '' order by tok_i) as raw, min(char_start) as s, arg_max(char_start + length(text), tok_i) as e, list(tok_i) as ids
  from (select *, tok_i - row_number() over (partition by doc_id, sent_idx, ent_type order by tok_i) as run from annotated where ent_type <> '') group by doc_id, sent_idx, ent_type, run)
, spans as (select * from (select *, {clean_mention('raw')} as text, {case('ent_type', lx.MODEL_LABELS)} as kind from runs) where kind is not null and {valid_mention('text')})
, taken as (select doc_id, sent_idx, flatten(list(ids)) as used from spans group by doc_id, sent_idx)
, free as (select a.*, coalesce(used, []::int[]) as used from annotated a left join taken t on t.doc_id = a.doc_id and t.sent_idx = a.sent_idx where not list_contains(coalesce(used, []::int[]), tok_i) and {has('text', f'[{tx.CJK}]')}
  and (pos = 'PROPN' or (pos = 'NOUN' and length(text) >= 2 and {trim('text')} not in {listed(lx.GENERIC_NOUNS)} and (ent_type <> '' or {has('text', f"({'|'.join(e.replace(')', '[)]') for e in lx.UNIT_ENDINGS)})$")}))))
, clo as (select doc_id, sent_idx, tok_i as root, tok_i as i, pos from free union select clo.doc_id, clo.sent_idx, root, a.tok_i, clo.pos from clo join annotated a on a.doc_id = clo.doc_id and a.sent_idx = clo.sent_idx and a.head_i = clo.i where a.dep = 'compound:nn' and clo.pos = 'NOUN')
, parts as (select doc_id, sent_idx, root, unnest(case when max(i) - min(i) + 1 = count(*) then list(i) else [root] end) as i from clo group by doc_id, sent_idx, root)
, whole as (select p.doc_id, p.sent_idx, root, string_agg(text, '' order by i) as raw, min(char_start) as s, arg_max(char_start + length(text), i) as e, list(i) as ids from parts p join annotated a on a.doc_id = p.doc_id and a.sent_idx = p.sent_idx and a.tok_i = i group by all)
, named as (select *, row_number() over (partition by doc_id, sent_idx order by root) as rk from (select *, {clean_mention('raw')} as text from whole) where {valid_mention('text')})
, walk as (select distinct doc_id, sent_idx, 0::bigint as rk, used, false as picked from free union all select n.doc_id, n.sent_idx, n.rk, case when list_contains(used, root) then used else used || ids end, not list_contains(used, root) from walk join named n on n.doc_id = walk.doc_id and n.sent_idx = walk.sent_idx and n.rk = walk.rk + 1)
, token_names as (select doc_id, sent_idx, text, {person('text', 'kind')} as etype, s as start, e as "end" from spans union all select n.doc_id, n.sent_idx, text, '组织名', s, e from named n join walk w on w.doc_id = n.doc_id and w.sent_idx = n.sent_idx and w.rk = n.rk where picked)"""

_HEAD = "struct(rk bigint, s bigint, e bigint, t varchar, k varchar)[]"
#: Fused mentions of ``gm`` in the sentences ``st``: every possible joint span is judged beforehand, then a walk over the mentions keeps the open ones in a list.
FUSED = f"""
hm as materialized (select doc_id, sent_idx, start::bigint as s, "end"::bigint as e, m.text as t, m.etype as k, row_number() over (partition by doc_id, sent_idx order by start, "end") as rk from (select doc_id, sent_idx, start, "end", min(struct_pack(text := text, etype := etype)) as m from gm group by all))
, nxt as materialized (select a.doc_id, a.sent_idx, a.s as s, a.e as e, b.s as s2, b.e as e2 from hm a join hm b on a.doc_id = b.doc_id and a.sent_idx = b.sent_idx and b.s - a.e between 0 and 3 join st on st.doc_id = a.doc_id and st.sent_idx = a.sent_idx where {has(trim('substr(sent_text, a.e + 1, b.s - a.e)'), '^[的之和与及、,，/·]*$')})
, gps as materialized (select doc_id, sent_idx, list(e * 1000000 + s2) as near from nxt group by all)
, spn as materialized (select a.doc_id, a.sent_idx, s, e2 as e, substr(sent_text, s + 1, e2 - s) as w from (select distinct doc_id, sent_idx, s from nxt) a join (select distinct doc_id, sent_idx, e2 from nxt) b on a.doc_id = b.doc_id and a.sent_idx = b.sent_idx and s < e2 join st on st.doc_id = a.doc_id and st.sent_idx = a.sent_idx)
, nms as materialized (select doc_id, sent_idx, map_from_entries(list(struct_pack(k := s * 1000000 + e, v := struct_pack(name := name, mark := mark, ok := length(name) <= 25 and {valid_mention('name')})))) as nm from (select *, {clean_mention('w')} as name, {has('w', '[。！？；;]')} as mark from spn) group by all)
, fw as (select n.doc_id, n.sent_idx, 0::bigint as rk, []::{_HEAD} as op, []::{_HEAD} as done from (select distinct doc_id, sent_idx from hm) n
  union all select doc_id, sent_idx, rk, list_transform(list_filter(list_transform(op, lambda h, i: struct_pack(stays := kinds[i] <> 2 or (j is not null and i > j), h := case when i = j then struct_pack(rk := h.rk, s := h.s, e := m.e, t := nm[h.s * 1000000 + m.e].name, k := '组织名') else h end)), lambda x: x.stays), lambda x: x.h)
      || case when j is null then [m] else []::{_HEAD} end, done || list_filter(op, lambda h, i: kinds[i] = 2 and (j is null or i < j))
    from (select *, list_position(kinds, 1) as j from (select fw.doc_id, fw.sent_idx, hm.rk, fw.op, fw.done, nm, struct_pack(rk := hm.rk, s := hm.s, e := hm.e, t := hm.t, k := hm.k) as m,
      list_transform(fw.op, lambda h: case when hm.s < h.e then 0 when hm.s - h.e > 3 or not coalesce(list_contains(near, h.e * 1000000 + hm.s), false) then 2 when h.k <> hm.k and h.k <> '组织名' and hm.k <> '组织名' then 0 when nm[h.s * 1000000 + hm.e].mark then 2 when nm[h.s * 1000000 + hm.e].ok then 1 else 0 end) as kinds
      from fw join hm on hm.doc_id = fw.doc_id and hm.sent_idx = fw.sent_idx and hm.rk = fw.rk + 1 left join nms n on n.doc_id = fw.doc_id and n.sent_idx = fw.sent_idx left join gps g on g.doc_id = fw.doc_id and g.sent_idx = fw.sent_idx)))
, fm as (select doc_id, sent_idx, (row_number() over (partition by doc_id, sent_idx order by h.rk) - 1)::int as m_idx, h.t as text, {person('h.t', 'h.k')} as etype, h.s::int as start, h.e::int as "end"
  from (select doc_id, sent_idx, unnest(done || op) as h from (select *, row_number() over (partition by doc_id, sent_idx order by rk desc) as last from fw) where last = 1))"""

_ALLOWED = "case " + " ".join(f"when a.etype = {quote(x)} and b.etype = {quote(y)} then [{', '.join(map(quote, rels))}]" for (x, y), rels in lx.TYPE_COMPAT.items() if rels) + " else []::varchar[] end"


def pairs(mentions: str, how: str) -> str:
    """Pairs of mentions of a sentence with the text between and the allowed relations."""
    return f"""(select a.doc_id, a.sent_idx, a.m_idx as a_m_idx, b.m_idx as b_m_idx, a.text as e1, b.text as e2, a.etype as ta, b.etype as tb, substr(sent_text, a."end" + 1, b.start - a."end") as raw, {_ALLOWED} as allowed
      from {mentions} a join {mentions} b on a.doc_id = b.doc_id and a.sent_idx = b.sent_idx and a."end" <= b.start and {how} join st on st.doc_id = a.doc_id and st.sent_idx = a.sent_idx)"""


def matched(source: str, most: int, ends: str | None = None) -> str:
    """The relation that the words between allow, of pairs of ``source``."""
    tests = " ".join(f"when (len(allowed) = 0 or list_contains(allowed, {quote(rel)})) and {has('t', words)} and (length(t) <= 8 or {has('t', f'^(?:{words})')}) then {quote(rel)}" for rel, words in lx.BETWEEN_WORDS)
    clause = f" and not {has('t', ends)}" if ends else ""
    return f"""select doc_id, sent_idx, a_m_idx, b_m_idx, e1, rel, e2, 'rule' as technique from (select *, case {tests} when len(allowed) = 1 and length(t) <= 6 then allowed[1] end as rel
      from (select *, {trim('raw')} as t from {source}) where length(t) between 1 and {most}{clause}) where rel is not null"""


def typed_pairs(source: str) -> str:
    """One select for each template of two types."""
    out = []
    for k, (words, rel, one, two) in enumerate(lx.PAIR_TEMPLATES):
        types = (f" and ta = {quote(one)}" if one else "") + (f" and tb = {quote(two)}" if two else "")
        out.append(f"select doc_id, sent_idx, {k} as tmpl_id, a_m_idx, b_m_idx, e1, {quote(rel)} as rel, e2, 'template' as technique from mid where list_contains(allowed, {quote(rel)}) and ({' or '.join(f'contains(m, {quote(w)})' for w in words)}){types}")
    return f"mid as (select *, substr(raw || e2, 1, position(e2 in raw || e2) - 1) as m from {source} where not {has('raw', '[。！？；;]')}) " + " union all ".join(out)


def typed_triples(mentions: str) -> str:
    """One select for each template of three types: the first three mentions that fill it."""
    out = []
    for k, (pattern, rel, one, two, three) in enumerate(lx.TRIPLE_TEMPLATES):
        filled = f"replace(replace(replace({quote(pattern)}, '{{e1}}', a.text), '{{e2}}', b.text), '{{e3}}', c.text)"
        types = "".join(f" and {x}.etype = {quote(t)}" for x, t in (("a", one), ("b", two), ("c", three)) if t)
        best = "min(struct_pack(x := a.m_idx, y := b.m_idx, z := c.m_idx, e1 := a.text, e2 := b.text))"
        same = lambda x: f"{x}.doc_id = a.doc_id and {x}.sent_idx = a.sent_idx"
        rows = f"""select a.doc_id, a.sent_idx, {best} as t from {mentions} a join {mentions} b on {same('b')} and b.start > a."end" and b.m_idx > a.m_idx join {mentions} c on {same('c')} and c.start > a."end" and c.m_idx > b.m_idx and c.start >= b.start
          join st on {same('st')} where contains(sent_text, {filled}){types} group by a.doc_id, a.sent_idx"""
        out.append(f"select doc_id, sent_idx, {k} as tmpl_id, t.e1 as e1, {quote(rel)} as rel, t.e2 as e2, 'template' as technique from ({rows})")
    return " union all ".join(out)
