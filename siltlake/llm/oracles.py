"""SQL equivalents (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS
from .sharding import MULTIPLIER, SHARDS, SUB_BUCKETS
from .urlfilter import DEFAULT

ORACLES: dict[str, str] = {}

ORACLES["op1_cover_tree_topk"] = """
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null
    and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true)),
s as (
  select q.r, q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v x on q.vec_id % 50 = 0 and x.r <> q.r),
r as (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule(r) -> str:
    sign = "<=" if r.kind == "at_most" else ">="
    return f"{r.scale} * {r.top} {sign} {r.limit} * {r.base}"


ORACLES["op3_quality_rules"] = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
t as (select r, unnest(w) as a, generate_subscripts(w, 1) as i from d),
g as (select r, i, a, lead(a) over o as b, lead(a, 2) over o as c from t window o as (partition by r order by i)),
h as (select r, i, count(*) over (partition by r, a, b, c) as n from g where c is not null),
c as (select r, count(distinct i + k) as n from h, range(3) k(k) where h.n > 1 group by r),
f as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$'))) as n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t-\r]*[•▪●*-][ \t]'))) as n_bullet_lines,
    len(list_filter(w, lambda x: x in ({', '.join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) as n_stop_words,
    coalesce(c.n, 0) as n_repeat_words
  from d left join c using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {' and '.join(_rule(r) for r in RULES)} as kept
from b
"""

ORACLES["op4_mixed_sources"] = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2.0::double * source_size as cap,
        [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as wt from s),
t as (select sum(source_size) * 150 / 100.0 as total from s),
l as (
  select w.*, (total - coalesce(sum(cap) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(wt) over (order by cap / wt, source nulls last rows between current row and unbounded following) as level
  from w, t),
v as (select max(level) as level from l where level * wt <= cap),
r as (select source, source_size, least(cap, coalesce(v.level, 'inf'::double) * wt)::double as target from l, v),
u as (
  select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 13))::bigint / 4503599627370496.0 as draw
  from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, case when source_size > 0 then target else 0 end as target,
  (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken
from u
"""



def _nibbles() -> str:
    """Remainders of the 16 low half-bytes under the reflected CRC-32 polynomial."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    return f"({table}::bigint[])"


_LOW = f"xor(a >> 4, {_nibbles()}[(xor(a, x) & 15) + 1])"
_BOTH = f"xor(({_LOW}) >> 4, {_nibbles()}[(xor({_LOW}, x >> 4) & 15) + 1])"

ORACLES["op5_jump_shards"] = rf"""
with recursive d as (
  select row_number() over () as r, doc_id, octet_length(encode(coalesce(text, ''))) as bytes, md5(coalesce(doc_id::varchar, '')) as m,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as b
  from documents),
c as (select r, doc_id, bytes, m, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: {_BOTH}), 4294967295) as crc from d),
j as (
  select r, n, 0::bigint as b, 0::bigint as j, ('0x' || substr(m, 1, 15))::hugeint as k from d, (values ({SHARDS}), ({SHARDS + 1})) s(n)
  union all
  select r, n, j, floor((j + 1) * (2147483648.0::double / (((k * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1)::double))::bigint,
    (k * {MULTIPLIER} + 1) % 18446744073709551616
  from j where j < n),
p as (select r, n, max(b)::int as shard from j group by r, n),
q as (
  select c.*, a.shard, g.shard as grown_shard, ((('0x' || substr(m, 25, 8))::bigint + c.crc) % {SUB_BUCKETS}) as part
  from c join p a on a.r = c.r and a.n = {SHARDS} join p g on g.r = c.r and g.n = {SHARDS + 1})
select doc_id, (bytes + 8)::bigint as size, crc::bigint as text_crc32, 'key' as law, shard,
  (row_number() over (partition by shard order by part, doc_id nulls first, crc, bytes) - 1)::bigint as slot, grown_shard
from q
"""

ORACLES["op10_url_rules"] = rf"""
with p as (
  select row_number() over () as n, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from p),
r(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (
  select h.n, arg_max(r.host || r.path, 100000 * length(r.host) + length(r.path)) as rule, arg_max(verdict, 100000 * length(r.host) + length(r.path)) as verdict
  from h join r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path) group by h.n)
select page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') as verdict from h left join m using (n)
"""
