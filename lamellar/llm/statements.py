"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from lamellar.llm import collocations as c
from lamellar.llm import license_scan as t
from lamellar.llm import quality_rules as q
from lamellar.llm import spelling as s
from lamellar.llm import url_filter as u

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WHITE_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWERED}, '{_WORD}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWERED}, '{_WORD}') as w from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
bw as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as win, least(len(w), 10) as size from bi),
di as (select r, w, size, unnest(range(1, len(w) - size + 2)) as pos from d, (select distinct size from bw)),
m as (select r, pos, size, item_id from (select r, pos, size, array_to_string(w[pos:pos + size - 1], ' ') as win from di) join bw using (win, size)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(pos, pos + size)) as p from m) group by r),
it as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from m where item_id is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (r) left join it using (r)"""

OP3 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWERED}, '{_WHITE_WORD}') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from i),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as both_of from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_of >= 75 * (a.n + b.n - both_of)),
e as (select x, y from l union all select y, x from l),
r as (select distinct x as v, x as root from e union select e.y, r.root from r join e on e.x = r.v where r.root < e.y),
m as (select v, min(root) as root from r group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.root, d.doc_id)) as component_id
from d left join n using (doc_id) left join m on m.v = d.doc_id"""


def _op4() -> str:
    values = {
        "symbol_rate": "1000 * n_symbols // greatest(word_chars, 1)",
        "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
        "word_length": "100 * word_chars // greatest(n_words, 1)",
    }
    listed = " union all ".join(f"select lang, source, '{k}' as measure, {v} as v from m where not base_failed" for k, v in values.items())
    least = "case measure " + " ".join(f"when '{k}' then {n}" for k, n in q.MEASURES.items()) + " end"

    def fences(name: str, keys: str) -> str:
        own = f"{keys}, " if keys else ""
        tenth = lambda k: f"min(bin) filter (upto * 10 >= size * {k})"
        over = f"partition by {own}measure"
        return (
            f"{name}_s as (select {own}measure, bin, sum(sum(n)) over ({over} order by bin) as upto, sum(sum(n)) over ({over}) as size from sk group by {own}measure, bin), "
            f"{name} as (select {own}measure, max(size) as size, {tenth(1)} - {q.SPREADS} * greatest({tenth(5)} - {tenth(1)}, {least}) as low, "
            f"{tenth(9)} + {q.SPREADS} * greatest({tenth(9)} - {tenth(5)}, {least}) as high from {name}_s group by {own}measure)"
        )

    shrunk = lambda size, own, parent: f"floor(({size} * {own} + {q.PRIOR_DOCS} * {parent})::double / ({size} + {q.PRIOR_DOCS}))"
    pick = lambda s: shrunk("o.size", f"o.{s}", shrunk("g.size", f"g.{s}", f"e.{s}"))
    tests = " and ".join(f"max({v}) <= max(f.high) filter (measure = '{k}')" for k, v in values.items())
    return f"""
with w as (select doc_id, lang, source, row_number() over () as r, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WHITE_WORD}') as w from documents),
ln as (select r, x from (select r, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '{_WHITE_WORD}')),
lc as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from ln group by r),
wi as (select r, w, unnest(range(1, len(w) - {q.WINDOW} + 2)) as i from w),
ww as (select r, i, count(*) over (partition by r, array_to_string(w[i:i + {q.WINDOW - 1}], ' ')) as k from wi),
rp as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + {q.WINDOW})) as p from ww where k > 1) group by r),
m0 as (select doc_id, lang, source, r, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_lines, 0) as n_lines from w left join lc using (r) left join rp using (r)),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m0),
sk as (select lang, source, measure, v - v % (1 << greatest(length(bin(v)) - 6, 0)) as bin, count(*) as n from ({listed}) group by all),
{fences("o", "lang, source")}, {fences("g", "lang")}, {fences("e", "")},
f as (select o.lang, o.source, o.measure, {pick("low")} as low, {pick("high")} as high
  from o join g on o.measure = g.measure and o.lang is not distinct from g.lang join e on o.measure = e.measure)
select doc_id, max(n_words) as n_words, max(word_chars) as word_chars, max(n_symbols) as n_symbols, max(n_dup_lines) as n_dup_lines,
max(n_repeat_words) as n_repeat_words, bool_or(base_failed) as base_failed, not bool_or(base_failed) and coalesce({tests} and max({values["word_length"]}) >=
max(f.low) filter (measure = 'word_length'), false) as kept
from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source group by r, doc_id"""


def _op7(rules: list[tuple[str, str]]) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = {}
    for _, text in ranked:
        host, slash, path = text.partition("/")
        fits[text] = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash + path}')"
    rule = " ".join(f"when {fits[t]} then '{t}'" for _, t in ranked)
    verdict = " ".join(f"when {fits[t]} then '{v}'" for v, t in ranked)

    def level(name: str, source: str, parent: str | None, key: str) -> str:
        s = (
            f"{name}_t as (select coalesce(sum(bad) / nullif(sum(n), 0), 0) as m, sum(n) as tn, count(*) as k, sum(n * n) as qn from {source} where n > 0), "
            f"{name}_x as (select m, tn, k, qn, m * (1 - m) as v, (select sum(n * power(bad / n - m, 2)) from {source}, {name}_t where n > 0) as sp from {name}_t), "
            f"{name}_p as (select m, coalesce((sp - (k - 1) * v) / nullif(v * (tn - qn / nullif(tn, 0) - (k - 1)), 0), 0) as rho from {name}_x), "
            f"{name}_k as (select m, case when rho > 0 then least(greatest(1 / rho - 1, {u.WEAKEST}), {u.STRONGEST}) else {u.STRONGEST} end::double as s from {name}_p)"
        )
        prior = f"p.mean" if parent else "y.m"
        join = f" join {parent} p on p.{key} = x.{key}" if parent else ""
        return f"{s}, {name} as (select x.*, ({prior} * y.s + x.bad) / (y.s + x.n) as mean, y.s + x.n as weight from {source} x cross join {name}_k y{join})"

    return rf"""
with r0 as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
r as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r0),
known as (select doc_id as page_id, count(*) as n, sum(cast(quality = 0 or toxic = 1 as int)) as bad from labels
  where doc_id is not null and (quality = 0 or toxic = 1) is not null group by 1),
h0 as (select host, sum(coalesce(n, 0))::double as n, sum(coalesce(bad, 0))::double as bad from r left join known using (page_id) group by host),
h1 as (select *, regexp_replace(host, '^.*@', '') as bare from h0),
h2 as (select *, regexp_replace(case when starts_with(bare, '[') then regexp_extract(bare, '^\[([^\]]*)\]', 1) else regexp_replace(bare, ':[0-9]*$', '') end, '\.+$', '') as nm from h1),
h3 as (select *, contains(nm, ':') or regexp_matches(nm, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') as address,
  case when regexp_matches(nm, '(^|\.)({u.SECOND})\.[a-z]{{2}}$') then 2 else 1 end as labels from h2),
h as (select host, n, bad, case when address then nm else array_to_string(string_split(nm, '.')[-labels - 1:], '.') end as domain,
  case when address then '' else array_to_string(string_split(nm, '.')[-labels:], '.') end as suffix from h3),
dm as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all), sx as (select suffix, sum(n) as n, sum(bad) as bad from dm group by all),
{level("ls", "sx", None, "suffix")}, {level("ld", "dm", "ls", "suffix")}, {level("lh", "h", "ld", "domain")},
blocked as (select host from lh where mean - {u.Z} * sqrt(mean * (1 - mean) / (weight + 1)) > {u.LIMIT})
select page_id, host, path, case {rule} end as rule, coalesce(case {verdict} end, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict from r"""


#: Words are near if one is the other without a letter, or both are equal without the letter at one place.
OP11 = rf"""
with recursive bits(k, v, i) as (select range, range, 0 from range(256) union all select k, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i + 1 from bits where i < 8),
crc_table as materialized (select list(v::bigint order by k) as t from bits where i = 8),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
few as (select id, run, count(*) as n from runs where length(run) >= {s.SHORTEST} group by all),
hexed as (select *, hex(encode(id || ':' || run)) as h from few),
octets as (select *, list_transform(range(1, len(h) // 2 + 1), lambda k: ((instr('0123456789ABCDEF', h[2 * k - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * k]) - 1)::bigint) as o from hexed),
summed as (select id, run, n, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, o), lambda st, b: xor(st >> 8, t[(xor(st, b) & 255) + 1]))) as c from octets, crc_table),
spoilt as (select case when c % {s.SPOILT} = 0 then run[:c % length(run)] || run[c % length(run) + 2:] else run end as word, n from summed),
w as materialized (select word, sum(n)::bigint as n from spoilt where length(word) >= {s.SHORTEST} group by word having sum(n) >= {s.LEAST}),
less as materialized (select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near0 as (select a.word as a, b.word as b, b.n as m from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join w b on a.rest = b.word union select b.word, a.word, a.n from less a join w b on a.rest = b.word),
best as (select a as word, count(*) as n_near, arg_min(b, (-m, b)) as form, max(m) as form_n from near0 group by a),
f as materialized (select w.word, n, coalesce(n_near, 0) as n_near, case when form_n >= {s.TIMES} * n then form end as form, case when form_n >= {s.TIMES} * n then form_n end as form_n from w left join best using (word)),
up as (select word, form as at from f where form is not null union all select up.word, f.form from up join f on f.word = up.at where f.form is not null),
last as (select up.word, up.at as root from up join f on f.word = up.at where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join last using (word)"""


def _op12() -> str:
    """Phrases are named by their words, each with those behind it in its piece."""
    said = lambda k: " || ' ' || ".join(f"w{i}" for i in range(1, k + 1))
    counts = " union all ".join(f"select lang, {said(k)} as p, {k} as k, count(*) as n from near where w{k} is not null group by all" for k in range(1, c.LONGEST + 1))
    behind = ", ".join(f"lead(x, {k - 1}) over (partition by piece order by i) as w{k}" for k in range(1, c.LONGEST + 1))
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?
-
]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
numbered as (select lang, w, row_number() over () as piece from words),
near as (select lang, {behind} from (select lang, piece, unnest(w) as x, unnest(range(len(w))) as i from numbered)),
f as materialized ({counts}), cand as materialized (select *, string_split(p, ' ') as ws from f where k > 1 and n >= {c.LEAST}),
inner_of as (select lang, array_to_string(ws[i:i + s - 1], ' ') as p, n from (select *, unnest(range(1, k - s + 2)) as i from (select *, unnest(range(2, k)) as s from cand))),
held as (select lang, p, max(n) as longer from inner_of group by all),
x as (select cand.* from cand left join held using (lang, p) where coalesce(100 * longer::hugeint < {c.SUBSUMES} * n, true)),
cuts as (select lang, p, n as a, k, ws, unnest(range(1, k)) as j from x),
scored as (select cuts.lang, cuts.p as phrase, a, j, l.n as l, r.n as r, (2000000 * a::hugeint // (l.n + r.n))::bigint as score from cuts
  join f l on l.lang = cuts.lang and l.p = array_to_string(ws[:j], ' ') join f r on r.lang = cuts.lang and r.p = array_to_string(ws[j + 1:], ' ')),
one as (select lang, phrase, a, arg_min(l, (score, j)) as l, arg_min(r, (score, j)) as r, min(score) as score from scored group by all),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from one),
totals as (select lang, sum(len(w))::bigint as n from words group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {c.LISTED}"""


def _op13() -> str:
    listed = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, text) in enumerate(t.TEMPLATES))
    phrase = lambda ws: " and ".join(f"w{i} = '{w}'" for i, w in enumerate(ws.split(), 1))
    base = " union all ".join(f"select r, '{label}' as label, i from near where {phrase(p)}" for p, label in t.PHRASES)
    behind = ", ".join(f"lead(x, {k - 1}) over (partition by r order by i) as w{k}" for k in range(1, t.GRAM + 1))
    gram = " || ' ' || ".join(f"w{i}" for i in range(1, t.GRAM + 1))
    of_template = f"array_to_string(w[i:i + {t.GRAM - 1}], ' ')"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
with d as materialized (select doc_id, row_number() over () as r, regexp_extract_all({_LOWERED}, '{_WORD}') as w from documents),
near as materialized (select r, i, {behind} from (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d)),
b as materialized ({base}),
nb as (select r, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by r),
tp as (select tpl, label, regexp_extract_all({lowered}, '{_WORD}') as w from (values {listed}) v(tpl, label, text)),
tg as (select tpl, label, len(w) as words, i as q, {of_template} as g from (select *, unnest(range(1, len(w) - {t.GRAM - 2})) as i from tp)),
v as (select r, tpl, label, words, i, q from (select r, i, {gram} as g from near) join tg using (g)),
dg as (select r, tpl, label, words, i - q as diag, min(i) as lo, max(i) + {t.GRAM} as hi, list(q) as qs from v group by all),
ap as (select *, case when diag - lag(diag) over (partition by r, tpl order by diag) <= words // {t.PER_SHIFT} then 0 else 1 end as apart from dg),
sg as (select *, sum(apart) over (partition by r, tpl order by diag) as span from ap),
sp as (select r, tpl, label, words, span, min(lo) as lo, max(hi) as hi, len(list_distinct(flatten(list(flatten(list_transform(qs, lambda q: range(q, q + {t.GRAM}))))))) as covered from sg group by all),
wh as (select *, 100 * covered >= {t.COVERS} * words as whole from sp),
cl0 as (select *, case when lo < max(hi) over (partition by r order by lo, hi, tpl rows between unbounded preceding and 1 preceding) then 0 else 1 end as first from wh where whole),
cl as (select *, sum(first) over (partition by r order by lo, hi, tpl) as cluster from cl0),
own as (select r, label from (select *, rank() over (partition by r, cluster order by covered desc, words) as k from cl) where k = 1),
labels as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from own union all select r, label from b) group by r),
share as (select r, max(covered::double / words) as share from sp group by r)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
case when n_base > 0 then 1.0 else coalesce(share, 0) end::double as score from d left join nb using (r) left join labels using (r) left join share using (r)"""


def statements(rules: list[tuple[str, str]]) -> dict[str, str]:
    return {"op1_decontamination": OP1, "op3_jaccard_join": OP3, "op4_quality_rules": _op4(), "op7_url_filter": _op7(rules), "op11_spelling_variants": OP11, "op12_collocations": _op12(), "op13_license_scan": _op13()}
