"""DuckDB SQL for the queries that SQL can express, in forms of its own."""

from __future__ import annotations

from nava.llm import licenses, mixing

_UPPER, _LOWER = licenses.UPPER, licenses.UPPER.lower()


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def mixing_sql(seed: int = 17) -> str:
    """Targets by a search for the first source that isn't full; blocks, slots and their ranks as the operator defines them."""
    return f"""
with d as (
    select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
        ('0x' || substring(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint as h from documents),
s as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k,
        ([5.0, 2.0, 1.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
t as (select sum(source_size)::bigint as total from s),
f as (
    select *, 3.0::double * source_size as most,
        (total - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / w, k rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (order by 3.0::double * source_size / w, k rows between current row and unbounded following) as level from s, t),
g as (
    select *, least(most, w * coalesce((select max(level) from f where level <= most / w), 0)) as target,
        greatest(1, least({mixing.BLOCK}, source_size // {mixing.FINEST}))::bigint as block from f),
u as (select *, sum(case when total > 0 then target / block else 0 end) over (order by k rows unbounded preceding) as needed, max(case when target > 0 then k end) over () as last from g),
v as (select *, max(needed) over () as whole, greatest(1, (source_size + block - 1) // block)::bigint as blocks from u),
p as (select *, case when k = last then 1.0 when whole > 0 then needed / whole else 0 end as top, coalesce(lag(case when whole > 0 then needed / whole else 0 end) over (order by k), 0.0) as bottom from v),
n as (select range as slot, range * {mixing.PHI}::double as x from (select ceil(max(whole))::bigint as slots from v), range(slots)),
c as (select p.k, blocks, row_number() over (partition by p.k order by slot) - 1 as rank from n join p on x - floor(x) >= bottom and x - floor(x) < top),
b as (select k, rank % blocks as at, count(*)::bigint as times from c where rank < 3 * blocks group by all),
o as (
    select d.*, k, source_size, target, block,
        coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from d join p on d.source is not distinct from p.source),
e as (select r, k, start, size, block, unnest(range(start // block, (start + size - 1) // block + 1)) as at from o where size > 0),
x as (select r, sum(times * (least(start + size, (e.at + 1) * block) - greatest(start, e.at * block)))::bigint as taken from e join b on e.k = b.k and e.at = b.at group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from o left join x on o.r = x.r"""


def licenses_sql() -> str:
    """All alignments of all vocabulary words with all templates, without an index."""
    words = [(k, label, i, w) for k, (label, text, _) in enumerate(licenses.TEMPLATES) for i, w in enumerate(text.split())]
    needed = []
    for k, (_, text, phrase) in enumerate(licenses.TEMPLATES):
        own, need = text.split(), phrase.split()
        at = next(i for i in range(len(own)) if own[i : i + len(need)] == need)
        needed.append((k, at, at + len(need)))
    base = [(k, label, len(p.split()), i, w) for k, (p, label) in enumerate(licenses.BASE) for i, w in enumerate(p.split())]
    return f"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
t(k, label, i, w) as (values {_values(words)}), need(k, a, z) as (values {_values(needed)}), b(k, label, n, i, w) as (values {_values(base)}),
v as (select distinct w from t union select distinct w from b),
h as (select r, w, pos - 1 as pos from (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from d) where w in (select w from v)),
df as (select v.w, length(bin((select count(*) from d) // greatest(1, count(distinct h.r))))::bigint as weight from v left join h on h.w = v.w group by v.w),
tw as (select t.*, weight, i >= a and i < z as needed from t join df on t.w = df.w join need on t.k = need.k),
whole as (select k, sum(weight)::bigint as whole, count(*) filter (needed) as must from tw group by k),
al as (
    select h.r, tw.k, label, pos - i as start, sum(weight)::bigint as got, count(*) filter (needed) as kept
    from h join tw on h.w = tw.w group by all),
m as (select r, max(got::double / whole) as score, list(distinct label) as more from al join whole on al.k = whole.k where kept = must and got >= {licenses.MIN_SCORE}::double * whole group by r),
bs as (select h.r, label, pos - i as start from h join b on h.w = b.w group by h.r, b.k, label, n, pos - i having count(*) = n),
bp as (select r, count(*)::bigint as n_base, min(start)::bigint as first_word, max(start)::bigint as last_word, list(distinct label) as base from bs group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
    greatest(coalesce(score, 0), case when n_base > 0 then {licenses.MIN_SCORE} else 0 end)::double as score
from d left join bp on d.r = bp.r left join m on d.r = m.r"""


def topk_sql(k: int = 5, modulus: int = 50) -> str:
    """All products of queries and vectors."""
    return f"""
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q, v c where q.vec_id % {modulus} = 0 and q.vec_id <> c.vec_id),
k as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from k where rank <= {k}"""
