"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Words and distinct five-word shingles of every document.
_SHINGLES = r"""
words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words)"""

_OP10 = f"""
with recursive {_SHINGLES},
flat as (select doc_id, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.other) as component_id
from sets s join reach r on r.doc_id = s.doc_id group by 1, 2"""

_OP8 = """
with fit as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (select vec_id, unnest(x) as c, generate_subscripts(x, 1) as i from fit),
scores as (
  select q.vec_id as query_id, b.vec_id as vec_id, cast(sum(q.c * b.c) as bigint) as score
  from flat q join flat b on q.i = b.i and q.vec_id % 50 = 0 and q.vec_id <> b.vec_id group by 1, 2)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5"""

_OP9 = """
with hashed as (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h from pages),
named as (
  select page_id, strlen(p)::bigint as payload_bytes, min(page_id) over (partition by h) as first, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((list_reduce(list_transform(range(1, 6), lambda j: instr('0123456789abcdef', substr(h, (k // 4) * 5 + j, 1)) - 1), lambda a, b: a * 16 + b)
      // (32 ** (3 - k % 4))::bigint) % 32)::bigint + 1, 1)), '') as payload_digest
  from hashed)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from named"""

_OP11 = r"""
with recursive held as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by 1),
judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(h.doc_id > min(h.doc_id) over (partition by t), false)] as fails
  from held h left join marks using (doc_id)),
orders(o) as (select '' union all select o || x from orders, unnest(['A', 'B', 'C', 'D', 'E']) as f(x) where not contains(o, x)),
steps as (select o as filter_order, cast(k as integer) as step, instr('ABCDE', o[k]) as f, list_transform(range(1, k), lambda i: instr('ABCDE', o[i])) as before from orders, unnest(range(1, 6)) as s(k) where length(o) = 5),
counted as (
  select part, filter_order, step, f,
    count(*) filter (where not gone and not fails[f]) as kept,
    count(*) filter (where not gone and fails[f]) as removed,
    count(*) filter (where gone and fails[f]) as redundant,
    count(*) filter (where fails[f] and len(list_filter(fails, lambda x: x)) = 1) as unique_fails,
    count(*) filter (where not gone and fails[f] and good) as good_lost,
    count(*) filter (where not gone and fails[f] and toxic) as toxic_lost
  from (select *, len(list_filter(before, lambda b: fails[b])) > 0 as gone from judged, steps)
  group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from counted"""

_OP12 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""

_OP13 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
words as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
sizes as (select lang, cast(sum(len(w)) as bigint) as n from words group by 1),
counts as (
  select lang, phrase, k, count(*) as f from (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, unnest(range(1, 6)) as s(k) where len(w) >= k)
  group by 1, 2, 3 having count(*) >= 100),
parts as (select *, string_split(phrase, ' ') as w from counts),
inside as (
  select lang, phrase, max(f) as f from (
    select lang, f, unnest(list_transform(range(1, len(w) - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) as phrase from parts, unnest(range(2, 5)) as s(j) where len(w) > j)
  group by 1, 2),
kept as (select p.* from parts p left join inside i using (lang, phrase) where p.k > 1 and (i.f is null or 100 * i.f < 100 * p.f)),
cuts as (select lang, phrase, f as a, c, array_to_string(w[1:c], ' ') as x, array_to_string(w[c + 1:], ' ') as y from kept, unnest(range(1, 5)) as s(c) where c < k),
scored as (
  select c.lang, c.phrase, c.a, c.c, l.f as l, r.f as r, n, (1000 * c.a::hugeint * n::hugeint) // (l.f::hugeint * r.f::hugeint) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.x join counts r on r.lang = c.lang and r.phrase = c.y join sizes s on s.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score from lowest
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""

ORACLE_SQL: dict[str, str] = {
    "op8_exact_topk_search": _OP8,
    "op9_warc_zip": _OP9,
    "op10_ngram_jaccard_join": _OP10,
    "op11_filter_interaction_audit": _OP11,
    "op12_exact_dedup": _OP12,
    "op13_phrase_collocations": _OP13,
}
