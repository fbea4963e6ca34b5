"""DuckDB SQL for the contracts that SQL can express."""

from __future__ import annotations

from .chat import CONTROL, ESCAPE, MARKS

_SAID = "</s>[INST] ok [/INST]"
_SPECIAL = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in x) for x in (ESCAPE, *CONTROL))


def chat_digests() -> str:
    """Digests straight from the turns; only formatted_chars knows the template."""
    begin, turn, role_end, turn_end = map(len, MARKS)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_SAID}' union all select -1, 1, 'assistant', '{_SAID}'
),
sized as (
  select *, {turn + role_end + turn_end}
    + length(regexp_replace(role, '({_SPECIAL})', '\\\\\\1', 'g')) + length(regexp_replace(text, '({_SPECIAL})', '\\\\\\1', 'g')) as chars
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast({begin} + sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


def mixed(weights=(5, 2, 1), share=1.5, max_repeats=2, seed=7) -> str:
    """Weighted fair queueing in one sorted sequence."""
    kinds = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('{seed}-' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents
),
by_source as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as src from sized group by source
),
weighed as (
  select *, cast(case src % {len(weights)} {kinds} end as double) as weight, {max_repeats} * source_size as most, sum(source_size) over () * cast({share} as double) as budget
  from by_source
),
filling as (
  select *, sum(weight) over () - sum(weight) over upto + weight as open, sum(most) over upto - most as full_, most / weight as full_at
  from weighed window upto as (order by most / weight, src rows between unbounded preceding and current row)
),
level as (
  select min_by((budget - full_) / open, full_at * 1e6 + src) as level from filling where (budget - full_) / open <= full_at
),
targets as (
  select src, source, source_size, weight, budget, least(cast(most as double), coalesce(weight * level, cast(most as double))) as target from filling, level
),
queued as (
  select d.doc_id, d.size, d.h, t.*, sum(d.size) over (partition by t.src order by d.h, d.doc_id, d.size rows between unbounded preceding and current row) as run
  from sized d join targets t on d.source is not distinct from t.source
),
events as (
  select *, cast(copy * source_size + run as double) / weight as finish from queued, range({max_repeats}) r(copy)
),
line as (
  select *, sum(size) over (order by finish, src, h, doc_id, copy, size rows between unbounded preceding and current row) as spent from events
),
cut as (select max(row(finish, src, h)) as last from line where spent <= budget)
select doc_id, size, source_size, target, cast(size * (count(*) filter (row(finish, src, h) <= last)) as bigint) as taken
from events, cut group by doc_id, size, source_size, target, run, src
"""


def repeats(length=100) -> str:
    """All strings of ``length`` bytes (by their 128-bit MD5), the later ones' spans, and what is left."""
    return f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
strings as (
  select doc_id, s, md5_number(substr(x, 2 * s + 1, {2 * length})) as w
  from (select doc_id, x, unnest(range(0, length(x) // 2 - {length - 1})) as s from docs)
),
later as (select doc_id, s from (select *, row_number() over (partition by w order by doc_id, s) as place from strings) where place > 1),
marked as (
  select *, case when s <= lag(s) over (partition by doc_id order by s) + {length} then 0 else 1 end as opens from later
),
grouped as (select *, sum(opens) over (partition by doc_id order by s) as span from marked),
spans as (select doc_id, span, min(s) as low, max(s) + {length} as high from grouped group by doc_id, span),
gaps as (
  select doc_id, low as stop, lag(high, 1, 0) over (partition by doc_id order by low) as since from spans
  union all select d.doc_id, length(any_value(d.x)) // 2, coalesce(max(p.high), 0) from docs d left join spans p using (doc_id) group by d.doc_id
),
kept as (
  select doc_id, string_agg(substr(x, 2 * since + 1, 2 * (stop - since)), '' order by stop, since) as k from gaps join docs using (doc_id) group by doc_id
),
removed as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans from spans group by doc_id)
select d.doc_id, cast(length(d.x) // 2 as bigint) as n_bytes, cast(coalesce(r.n_removed, 0) as bigint) as n_removed,
  cast(coalesce(r.n_spans, 0) as bigint) as n_spans, sha256(unhex(k.k)) as kept_sha256
from docs d join kept k using (doc_id) left join removed r using (doc_id)
"""


def product_codes(parts=8, entries=16, rounds=6, scale=4096) -> str:
    """Plain Lloyd rounds: every part against every entry, all in integers."""
    steps = "".join(
        f"""
near{r} as materialized (
  select vec_id, p, min(d * {entries} + k) as m from (
    select v.vec_id, v.p, b.k, sum((v.x - b.c) * (v.x - b.c)) as d from comps v join book{r} b on v.p = b.p and v.j = b.j group by v.vec_id, v.p, b.k
  ) group by vec_id, p
),"""
        + (
            f"""
sums{r} as (select v.p, n.m % {entries} as k, v.j, sum(v.x) as s, count(*) as n from comps v join near{r} n on v.vec_id = n.vec_id and v.p = n.p group by all),
book{r + 1} as materialized (
  select b.p, b.k, b.j, case when s.n is null then b.c else (s.s - ((s.s % s.n) + s.n) % s.n) // s.n end as c
  from book{r} b left join sums{r} s on b.p = s.p and b.k = s.k and b.j = s.j
),"""
            if r < rounds
            else ""
        )
        for r in range(rounds + 1)
    )
    return f"""
with flat as (
  select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // {parts} as deep from embeddings where embedding is not null
),
kept as (select vec_id from flat group by vec_id having bool_and(x is not null and isfinite(x))),
comps as materialized (
  select vec_id, i // deep as p, i % deep as j, cast(floor({scale} * cast(x as double)) as bigint) as x from flat where vec_id in (from kept)
),
book0 as materialized (
  select c.p, f.k, c.j, c.x as c from comps c join (select vec_id, row_number() over (order by vec_id) - 1 as k from kept order by vec_id limit {entries}) f using (vec_id)
),{steps}
coded as (
  select vec_id, string_agg(printf('%02x', cast(m % {entries} as integer)), '' order by p) as code, cast(sum(m // {entries}) as bigint) as error from near{rounds} group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by p, k, j)) from book{rounds}) as codebooks_sha256
from coded join (select distinct vec_id, label from embeddings) using (vec_id)
"""


def prefix_trie(block=100, most=6) -> str:
    """Every prefix of every rebuilt conversation spelled out; CRC-32 bit by bit."""
    return f"""
with own as (
  select conv_id, role, text, length(text) as chars, md5(length(role) || ':' || role || text) as digest,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text)) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
),
convs as (
  select conv_id, conv_id - conv_id % {block} as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), cast(range(8) as bigint[])), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % {most} as h
  from (select distinct conv_id from own)
),
turns as (
  select conv_id, row_number() over (partition by conv_id order by grafted desc, pos) as depth, digest, chars from (
    select c.conv_id, o.pos, o.digest, o.chars, 1 as grafted from convs c join own o on o.conv_id = c.base and o.pos <= c.h
    union all select c.conv_id, o.pos, o.digest, o.chars, 0 from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h
  )
),
lengths as (select conv_id, coalesce(max(depth), 0) as len from convs left join turns using (conv_id) group by conv_id),
paths as materialized (
  select conv_id, depth, chars, md5(string_agg(digest, '') over (partition by conv_id order by depth)) as k from turns
  union all select conv_id, 0, 0, '' from convs
),
nodes as materialized (
  select p.depth, p.k, min(p.conv_id) as conv_id, count(*) as n, any_value(p.chars) as chars,
    sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (l.len = p.depth), '')) as ends_sha256
  from paths p join lengths l using (conv_id) group by p.depth, p.k
),
parents as (
  select n.depth, n.k, a.k as up, a.conv_id as parent_conv_id from nodes n join paths p on p.conv_id = n.conv_id and p.depth = n.depth - 1 join nodes a on a.depth = p.depth and a.k = p.k
),
kids as (select depth - 1 as depth, up as k, count(*) as n_children from parents group by all),
below as (
  select p.depth, p.k, sum((n.n - 1) * n.chars) as saved, count(*) filter (kids.k is null) as n_leaves
  from nodes n left join kids on kids.depth = n.depth and kids.k = n.k join paths p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.depth, p.k
)
select n.conv_id, cast(n.depth as bigint) as depth, u.parent_conv_id, n.n as n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves,
  cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n left join parents u on u.depth = n.depth and u.k = n.k left join kids c on c.depth = n.depth and c.k = n.k join below b on b.depth = n.depth and b.k = n.k
"""


ORACLE_SQL = {"op12_trie": prefix_trie(), "op13_codes": product_codes(), "op3_chat": chat_digests(), "op5_mixing": mixed(), "op7_suffix": repeats()}
