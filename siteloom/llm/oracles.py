"""SQL for the queries that SQL can express."""

from __future__ import annotations

from siteloom.llm.licenses import ACROSS_LINES, BY_LINE, HINTS, RULES, SENTENCES

ORACLES: dict[str, str] = {}

ORACLES["op5_topk_search"] = """
with points as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from points q join points c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select query_id, vec_id, score,
    row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def _license_reading(name: str, ends: str) -> str:
    hint = "|".join(HINTS)
    cases = " ".join(f"when '{s}' then '{i}'" for i, s in SENTENCES.items())
    clean = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
{name}_ids as (
  select r, list_filter(list_transform(
      list_filter(regexp_split_to_array(coalesce(text, ''), '{ends}'),
        lambda s: regexp_matches(s, '{hint}', 'i')),
      lambda s: case {clean} {cases} end), lambda i: i is not null) as ids
  from numbered),
{name}_text as (
  select r, len(ids) as n, case when len(ids) = 0 then ''
    else ' ' || array_to_string(ids, '  ') || ' ' end as s0 from {name}_ids)"""


def _license_sql() -> str:
    steps, at = [], "chosen"
    for k, (_, rule) in enumerate(RULES):
        run = "".join(f" {i} " for i in rule)
        steps.append(
            f"rule_{k} as (select *, contains(s{k}, '{run}') as f{k},"
            f" replace(s{k}, '{run}', '|') as s{k + 1} from {at})"
        )
        at = f"rule_{k}"
    tests = []
    for name in dict.fromkeys(n for n, _ in RULES):
        own = " or ".join(f"f{k}" for k, (n, _) in enumerate(RULES) if n == name)
        tests.append(f"case when {own} then '{name}' end")
    rules = ",\n".join(steps)
    return f"""
with numbered as (select doc_id, text, row_number() over () as r from documents),
{_license_reading("a", BY_LINE)},
{_license_reading("b", ACROSS_LINES)},
chosen as (
  select doc_id, greatest(a.n, b.n) as n, case when b.n > a.n then b.s0 else a.s0 end as s0
  from numbered join a_text a using (r) join b_text b using (r)),
{rules}
select doc_id, trim(replace(s0, '  ', ' ')) as sentence_ids, n::bigint as n_known,
  concat_ws(',', {", ".join(tests)}) as licenses,
  len(list_filter(string_split(s{len(RULES)}, ' '), lambda x: regexp_matches(x, '[a-z]')))::bigint as n_left
from {at}
"""


ORACLES["op10_license_scan"] = _license_sql()

_SCALED = (
    "select _source, _lang, _topic, tokens, weight * target / sum(weight) over (partition by {d})"
    " as weight, i from ({inner}) join target_{d} using ({d})"
)
_ROUND = (
    "select _source, _lang, _topic, tokens, case when i = 0 then weight else least(weight,"
    " tokens / (0.5 * (select sum(tokens) from cells))) end as weight, i from raked where i < 10"
)
for _d in ("_source", "_lang", "_topic"):
    _ROUND = _SCALED.format(d=_d, inner=_ROUND)

ORACLES["op6_mixing"] = f"""
with recursive docs as (
  select doc_id, source, lang, coalesce(length(text), 0) // 4 + 1 as n_tokens,
    case when text is null then null when contains(text, 'License') then 'licensed'
      when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact'
      when length(text) >= 4000 then 'long' else 'prose' end as topic
  from documents),
keyed as (
  select *, coalesce('=' || source, '') as _source, coalesce('=' || lang, '') as _lang,
    coalesce('=' || topic, '') as _topic from docs),
cells as (
  select _source, _lang, _topic, sum(n_tokens)::bigint as tokens from keyed group by all),
target__source as (select _source, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) over () as target
  from cells group by 1),
target__lang as (select _lang, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) over () as target
  from cells group by 1),
target__topic as (select _topic, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) over () as target
  from cells group by 1),
raked as (
  select _source, _lang, _topic, tokens, tokens::double as weight, 0 as i from cells
  union all
  select _source, _lang, _topic, tokens, weight, i + 1 from ({_ROUND})),
drawn as (
  select _source, _lang, _topic, least(1.0,
    weight / (tokens / (0.5 * (select sum(tokens) from cells)))) as p from raked where i = 10)
select doc_id, source, lang, topic, n_tokens, round(p, 6) as probability,
  ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 13))::bigint
    / 4503599627370496.0 < p as kept
from keyed join drawn using (_source, _lang, _topic)
"""


def _centroid_sql(width: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Distances here are inner products of whole numbers in doubles, exact below 2^53."""
    far = "(p.n + c.n - 2 * list_inner_product(p.v, c.c))::bigint"

    def assigned(i: int) -> str:
        return f"""
assigned_{i} as materialized (
  select r, min(struct_pack(distance := distance, j := j)) as best from (
    select p.r, c.j, {far} as distance from points p cross join (
      select j, c, list_inner_product(c, c) as n from centroids_{i}) c)
  group by r)"""

    def moved(i: int) -> str:
        return f"""
sums_{i} as (
  select j, d, sum(x::bigint)::bigint as s, count(*) as n from (
    select a.best.j as j, unnest(p.v) as x, unnest(range({width})) as d
    from assigned_{i} a join points p using (r))
  group by j, d),
centroids_{i + 1} as materialized (
  select o.j, coalesce(m.c, o.c) as c from centroids_{i} o left join (
    select j, list(((s - ((s % n) + n) % n) // n)::double order by d) as c from sums_{i} group by j) m using (j))"""

    steps = ",".join(assigned(i) + "," + moved(i) for i in range(rounds))
    return f"""
with points as materialized (
  select row_number() over () as r, vec_id, v, list_inner_product(v, v) as n from (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where len(embedding) = {width}
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
centroids_0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) - 1 as j, v as c
  from points order by j limit {k}),
{steps},
{assigned(rounds)},
totals as (select best.j as j, sum(best.distance)::bigint as own from assigned_{rounds} group by 1)
select p.vec_id, c.j::int as cluster, a.best.distance as distance, t.own as cluster_inertia,
  (select sum(own)::bigint from totals) as inertia,
  sha256(array_to_string(c.c::bigint[], ',')) as centroid_sha256
from assigned_{rounds} a join points p using (r) join centroids_{rounds} c on c.j = a.best.j
  join totals t on t.j = c.j
"""


ORACLES["op12_centroid_clustering"] = _centroid_sql()

# Checksums byte by byte, for all distinct features at once.
ORACLES["op13_importance_resampling"] = r"""
with recursive
table_steps as (
  select x as byte, x::bigint as crc, 0 as k from range(256) t(x)
  union all
  select byte, case when crc % 2 = 1 then xor(crc // 2, 3988292384) else crc // 2 end, k + 1
  from table_steps where k < 8),
crc_table as (select byte, crc from table_steps where k = 8),
texts as (
  select 's' as side, row_number() over () as r, doc_id, text from documents
  union all select 't', row_number() over (), null, text from benchmark),
worded as materialized (
  select side, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
features as materialized (
  select side, r, f, count(*) as n from (
    select side, r, unnest(w) as f from worded
    union all select side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
    union all select side, r, unnest(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded)
  group by all),
distinct_features as materialized (
  select row_number() over () as id, f, hex(encode(f)) as h from (select distinct f from features)),
walked as (
  select id, h, 1 as place, 4294967295::bigint as crc from distinct_features
  union all
  select id, h, place + 2, xor(c.crc, w.crc // 256)
  from walked w join crc_table c on c.byte = xor(w.crc % 256, ('0x' || substr(h, place, 2))::bigint)
  where place < length(h)),
bucketed as materialized (
  select d.f, xor(w.crc, 4294967295) % 10000 as bucket
  from walked w join distinct_features d using (id) where w.place > length(w.h)),
counts as (
  select bucket, sum(n) filter (side = 's') as s, sum(n) filter (side = 't') as t
  from features join bucketed using (f) group by bucket),
totals as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from counts),
gain as (
  select bucket, floor(1000 * ln((coalesce(c.t, 0)::double + 1) * (a.s + 10000)
    / ((coalesce(c.s, 0)::double + 1) * (a.t + 10000))))::bigint as gain
  from counts c, totals a),
weights as (
  select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight
  from features join bucketed using (f) join gain using (bucket) where side = 's' group by r),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features,
    coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
      / 4294967296::double)))::bigint)::bigint as score
  from worded left join weights using (r) where side = 's'),
ranked as (
  select doc_id, score, n_features, weight, n_words >= 20 as fit,
    row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as place,
    count(*) filter (n_words >= 20) over () as n
  from scored)
select doc_id, n_features, weight, score, case when fit and place <= n * 5 // 100 then place end as rank
from ranked
"""
