"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from loomgraph.llm.chat import BUDGET, HISTORY, HISTORY_TURNS
from loomgraph.llm.licenses import AGREE, BASE, RARE, STOP, TEMPLATES
from loomgraph.llm.mixing import SLACK

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = rf"""
with recursive raw as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc as (select *, length(text) + (length(text) - length(replace(text, '\', ''))) + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{{3,}}')]), 0) + (length(text) - length(replace(text, '</turn>', ''))) // 7 as k,
  row_number() over (partition by conv_id order by turn, role, text) as n from raw),
tok as (select *, ((k + 3) // 4 + 4)::bigint as t, (k + length(role) + 14)::bigint as r from esc),
pre as (select *, sum(t) over w - t as t0, max(case when n = 1 and role = 'system' then 1 else 0 end) over (partition by conv_id) as s0, count(*) over (partition by conv_id) as m from tok window w as (partition by conv_id order by n)),
lim as (select *, greatest(1, {BUDGET} - {HISTORY} - s0 * max(case when n = 1 then t end) over (partition by conv_id)) as room, max(case when n = 1 then r end) over (partition by conv_id) as r1 from pre),
walk(conv_id, n, base, w) as (select conv_id, n, t0, 0 from lim where n = s0 + 1
  union all select l.conv_id, l.n, case when l.t0 + l.t - walk.base > l.room then l.t0 else walk.base end, case when l.t0 + l.t - walk.base > l.room then walk.w + 1 else walk.w end from walk join lim l on l.conv_id = walk.conv_id and l.n = walk.n + 1),
span as (select conv_id, w, min(n) as first, max(n) as last from walk group by 1, 2),
back as (select s.*, f.s0, f.r1, (select count(*) from lim b where s.w > 0 and b.conv_id = s.conv_id and b.n between s.first - {HISTORY_TURNS} and s.first - 1 and b.n > f.s0 and f.t0 - b.t0 <= {HISTORY}) as back from span s join lim f on f.conv_id = s.conv_id and f.n = s.first),
chars as (select b.conv_id, b.w, sum(l.r) + max(case when b.w > 0 and b.s0 = 1 then b.r1 else 0 end) as c from back b join lim l on l.conv_id = b.conv_id and l.n between case when b.w = 0 then 1 else b.first - b.back end and b.last group by 1, 2
  union all select conv_id, 0, r from lim where m = 1 and s0 = 1)
select e.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256, (select sum(c)::bigint from chars c where c.conv_id = e.conv_id) as formatted_chars from esc e group by e.conv_id"""

#: Rounds that the SQL unrolls; further ones would find nothing left.
ROUNDS = 12
_ROUND = f"""
fit{{k}} as (select b.s, b.n, b.size, t.gap, sum(b.size) over (partition by b.s order by b.n rows unbounded preceding) as up from base b join st{{k}} t on b.s is not distinct from t.s where b.size <= t.gap and b.n > t.n and t.gap > t.slack),
in{{k}} as (select s, n, size from fit{{k}} where up <= gap),
sum{{k}} as (select s, sum(size) as took, max(n) as n from in{{k}} group by s),
st{{j}} as (select t.s, t.gap - coalesce(u.took, 0) as gap, t.slack, coalesce(u.n, t.n) as n from st{{k}} t left join sum{{k}} u on u.s is not distinct from t.s)"""

MIX = rf"""
with doc as (select doc_id as id, source as s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  0.25 + 0.75 * length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) / greatest(length(coalesce(text, '')), 1) as weight,
  ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as tie from documents),
drawn as (select *, (('0x' || substr(sha256(coalesce(id::varchar, 'null ' || tie::varchar)), 1, 13))::bigint + 0.5) / 4503599627370496 as u from doc),
base as materialized (select *, row_number() over (partition by s order by -ln(u) / weight, id nulls first, size, tie) as n from drawn),
src as (select s, sum(size)::bigint as total, ((row_number() over (order by s nulls last) - 1) % 3 + 1)::int as w from base group by s),
lev as (select *, (sum(total) over () - coalesce(sum(total * 3) over (order by 3 * total / w, s nulls last rows between unbounded preceding and 1 preceding), 0))::double / sum(w) over (order by 3 * total / w, s nulls last rows between current row and unbounded following) as level,
  row_number() over (order by 3 * total / w, s nulls last) as k from src),
tar as (select *, least((total * 3)::double, coalesce((select arg_min(level, k) from lev where level * w <= total * 3), 0.0) * w) as target from lev),
sp as (select *, case when total > 0 then floor(target / total) else 0 end::int as epochs from tar),
st0 as (select s, target - epochs * total as gap, least(target * {SLACK}, target - epochs * total - 1e-9) as slack, 0 as n from sp where target - epochs * total > 0),{",".join(_ROUND.format(k=k, j=k + 1) for k in range(ROUNDS))},
took as ({" union all ".join(f"select s, n from in{k}" for k in range(ROUNDS))})
select b.id as doc_id, b.size, r.total as source_size, r.target, (b.size * (r.epochs + case when t.n is null then 0 else 1 end))::bigint as taken
from base b join sp r on b.s is not distinct from r.s left join took t on t.s is not distinct from b.s and t.n = b.n"""

LINES = r"""
with doc as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
line as (select r, doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from doc),
keyed as (select *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
shared as (select k, max(doc_id) as keep from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select any_value(l.doc_id) as doc_id, count(*) as n_lines, count(*) filter (l.doc_id <> s.keep) as n_dropped,
  sha256(coalesce(string_agg(x, chr(10) order by i) filter (not coalesce(l.doc_id <> s.keep, false)), '')) as kept_sha256 from keyed l left join shared s on s.k = l.k group by l.r"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


_INDEX = [(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in STOP]
_KEYS = [(t, text.split().index(key.split()[0]) if text.startswith(key) else len(text[: text.index(" " + key)].split()), j, w) for t, (_, text, key) in enumerate(TEMPLATES) for j, w in enumerate(key.split())]
_LABELS = [(t, label, len(key.split())) for t, (label, _, key) in enumerate(TEMPLATES)]
_PLACES = " union all ".join(
    f"select w0.r, w0.i, '{label}' as l from word w0 " + " ".join(f"join word w{j} on w{j}.r = w0.r and w{j}.i = w0.i + {j} and w{j}.w = '{w}'" for j, w in enumerate(phrase.split()) if j) + f" where w0.w = '{phrase.split()[0]}'" for phrase, label in BASE
)

LICENSES = rf"""
with doc as (select row_number() over () as r, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
word as materialized (select r, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from doc),
idx as (select * from (values {_values(_INDEX)}) t(t, p, w)),
lbl as (select * from (values {_values(_LABELS)}) t(t, label, n_key)),
keys as (select * from (values {_values(_KEYS)}) t(t, p, j, w)),
vocab as (select distinct w from idx),
df as (select v.w, count(distinct r) as n from vocab v left join word using (w) group by v.w),
rnk as (select w, row_number() over (order by -ln(((select count(*) from doc) + 1) / (n + 1)), w) as k from df),
rare as (select t, w from (select t, w, row_number() over (partition by t order by k) as q from (select distinct t, w, k from idx join rnk using (w))) where q <= {RARE}),
place as (select idx.t, idx.p, idx.w from idx join rare on rare.t = idx.t and rare.w = idx.w),
tot as (select t, least({RARE}, count(*)) as total, any_value(label) as label, any_value(n_key) as n_key from place join lbl using (t) group by t),
vote as (select h.r, x.t, h.i - x.p as o, count(*) as n from word h join place x using (w) group by all),
most as (select v.*, tot.total, tot.label, tot.n_key from vote v join tot using (t) where v.n / tot.total >= {AGREE}),
ok as (select b.r, b.t, b.o, b.label, b.n, b.total from most b join keys k on k.t = b.t join word w on w.r = b.r and w.i = b.o + k.p + k.j and w.w = k.w group by all having count(*) = any_value(b.n_key)),
share as (select r, label, least(1.0, n / total) as s from ok),
base as materialized ({_PLACES}),
lab as (select r, l from base union select r, label from share where s >= {AGREE})
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word, coalesce(b.ls, '') as base_labels, coalesce(a.ls, '') as labels,
  greatest(coalesce(s.m, 0.0), case when b.n > 0 then 0.5 else 0.0 end)::double as score from doc d
left join (select r, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct l, ',' order by l) as ls from base group by r) b on b.r = d.r
left join (select r, string_agg(distinct l, ',' order by l) as ls from lab group by r) a on a.r = d.r
left join (select r, max(s) as m from share where s >= {AGREE} group by r) s on s.r = d.r"""

NEAR = rf"""
with recursive doc as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as ws from documents),
shin as (select doc_id, case when len(ws) >= 4 then list_distinct([array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)]) when len(ws) > 0 then ['# ' || array_to_string(ws, ' ')] else [] end as xs from doc),
cls as (select doc_id, len(xs)::bigint as n, case when len(xs) > 0 then sha256(array_to_string(list_sort(xs), chr(10))) end as h from shin),
rep as (select h, min(doc_id) as a, any_value(n) as n from cls where h is not null group by h),
item as (select r.a, unnest(s.xs) as x from rep r join shin s on s.doc_id = r.a),
pair as (select p.a as a, q.a as b, count(*) as c from item p join item q on p.x = q.x and p.a < q.a group by 1, 2),
link as (select p.a, p.b from pair p join rep x on x.a = p.a join rep y on y.a = p.b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a as u, b as v from link union select b, a from link),
reach(u, v) as (select a, a from rep union select r.u, e.v from reach r join edge e on e.u = r.v),
comp as (select u, min(v) as m from reach group by u)
select c.doc_id, c.n as n_shingles, coalesce(m.m, c.doc_id) as component_id, c.doc_id = coalesce(m.m, c.doc_id) as kept from cls c left join rep on rep.h = c.h left join comp m on m.u = rep.a"""

ORACLES = {"op1_chat_windows": CHAT, "op7_source_mix": MIX, "op8_line_dedup": LINES, "op9_license_scan": LICENSES, "op10_near_duplicates": NEAR}
