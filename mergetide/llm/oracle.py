"""DuckDB SQL for the queries that SQL can say, by another way than theirs: no hashes, sketches, bands or leaders.

Words, shingles and spans stand in rows of their own, sets are compared pair by pair,
and binomial tails are summed term by term.
"""

from __future__ import annotations

from mergetide.llm import quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _shingles(table: str, key: str) -> str:
    """Distinct (key, shingle) of a table's texts, as a subquery."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""(
  select distinct {key}, shingle from (
    select {key}, pos, n, concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as shingle
    from (
      select {key}, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n
      from (select {key}, regexp_extract_all({lower}, {_WORD}) as ws from {table})
    )
    window o as (partition by {key} order by pos)
  ) where pos <= greatest(n - 4, 1)
)"""


NEAR_DUPLICATES = f"""
with recursive shingles as materialized {_shingles("documents", "doc_id")},
sizes as (select doc_id, count(*) as n, md5(string_agg(shingle, chr(10) order by shingle)) as class from shingles group by doc_id),
nodes as (select class, min(doc_id) as node, min(n) as n from sizes group by class),
own as materialized (select node, n, shingle from nodes join shingles on node = doc_id),
alike as materialized (
  select a.node as a, b.node as b from own a join own b on a.shingle = b.shingle and a.node < b.node
  group by all having 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))
),
edges as materialized (select a, b from alike union all select b, a from alike),
reach(node, other) as (select node, node from nodes union select r.node, e.b from reach r join edges e on r.other = e.a),
components as (select node, min(other) as component from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(c.component, d.doc_id) as component_id,
       coalesce(c.component, d.doc_id) = d.doc_id as kept
from documents d left join sizes s using (doc_id) left join nodes using (class) left join components c using (node)
"""

DECONTAMINATION = f"""
with items as materialized {_shingles("benchmark", "item_id")},
sizes as (select item_id, count(*) as n_item from items group by item_id),
shared as (
  select d.doc_id, i.item_id, count(*) as n_shared
  from {_shingles("documents", "doc_id")} d join items i using (shingle) group by all
)
select doc_id, item_id, n_item, n_shared from shared join sizes using (item_id) where 100 * n_shared >= 75 * n_item
"""


def _per_mille(part: str, whole: str) -> str:
    return f"1000 * {part} // greatest({whole}, 1)"


_STATISTICS = {
    "symbols": _per_mille("n_symbols", "word_chars"),
    "duplicate_lines": _per_mille("n_dup_lines", "n_lines"),
    "repeated_words": _per_mille("n_repeat_words", "n_words"),
    "long_words": _per_mille("word_chars", "n_words"),
    "short_words": _per_mille("n_words", "word_chars"),
    "capitals": _per_mille("n_capitals", "word_chars"),
    "shouts": _per_mille("n_shouts", "n_words"),
}
_TESTS = [(rule, cutoff) for rule, cutoffs in quality.CUTOFFS.items() for cutoff in cutoffs]

QUALITY = rf"""
with body as (select doc_id, lang, coalesce(text, '') as text from documents),
words as materialized (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n
  from (select doc_id, regexp_extract_all(text, {_WORD}) as ws from body)
),
counts as (select doc_id, count(*) as n_words, sum(length(w))::bigint as word_chars from words group by doc_id),
grams as (
  select doc_id, pos, n, concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o) as gram
  from words window o as (partition by doc_id order by pos)
),
twice as (
  select doc_id, pos from grams where pos <= n - 2
  qualify count(*) over (partition by doc_id, gram) > 1
),
repeats as (
  select doc_id, count(distinct pos + step) as n_repeat_words from twice, (select unnest([0, 1, 2]) as step) group by doc_id
),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from body)
  where regexp_matches(line, {_WORD}) group by doc_id
),
basic as materialized (
  select b.doc_id, b.lang, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(text, '[A-Z]')) as n_capitals,
         len(regexp_extract_all(text, '!')) as n_shouts, coalesce(n_lines, 0) as n_lines,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(n_words, 0) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) as base_failed
  from body b left join counts using (doc_id) left join repeats using (doc_id) left join lines using (doc_id)
),
featured as materialized (select *, {", ".join(f"{e} as {name}" for name, e in _STATISTICS.items())} from basic),
good as (select doc_id from labels group by doc_id having max(quality) = 1),
holdout as (select f.* from featured f join good using (doc_id) where not base_failed),
tested as (
  {" union all ".join(
    f"select lang, '{rule}' as rule, {cutoff} as cutoff, count(*) as n, count(*) filter ({rule} > {cutoff}) as k from holdout group by lang"
    for rule, cutoff in _TESTS
  )}
),
passed as (
  select lang, rule, cutoff from tested
  where k < n * {quality.RISK} and list_sum([
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.RISK}) + (n - j) * ln(1 - {quality.RISK}))
    for j in range(k + 1)
  ]) <= {quality.LEVEL} / {len(_TESTS)}
),
cutoffs as (
  select lang, {", ".join(f"min(cutoff) filter (rule = '{r}') as most_{r}" for r in quality.CUTOFFS)} from passed group by lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or {" or ".join(f"coalesce({r} > most_{r}, false)" for r in quality.CUTOFFS)}) as kept
from featured f left join cutoffs c on f.lang is not distinct from c.lang
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "bare": "[A-Za-z0-9+/_=-]{20,}"}
_MATCHES = " union all ".join(
    f"select doc_id, source, {kind} as kind, unnest(regexp_extract_all(text, '{p}')) as m,"
    f" unnest(string_split_regex(text, '{p}')) as gap, generate_subscripts(string_split_regex(text, '{p}'), 1) as i from body"
    for kind, p in enumerate(_PATTERNS.values())
)
_DIFFERENT = "len(list_distinct(string_split(value, '')))"

SECRETS = f"""
with body as (select doc_id, source, coalesce(text, '') as text from documents),
matches as (select * from ({_MATCHES})),
placed as (
  select doc_id, source, kind, m, sum(length(gap) + length(coalesce(m, ''))) over (partition by doc_id, kind order by i) as stop from matches
),
spans as materialized (
  select doc_id, source, kind, (stop - length(m))::bigint as start, stop::bigint as stop,
         case when kind = 0 then regexp_extract(m, '{_ASSIGN}', 2) else m end as value
  from placed where m is not null
),
sure as materialized (
  select * from spans where kind = 0 and length(value) >= 12 or kind = 1 and length(value) >= 18 or kind = 2 and length(value) >= 16
),
bare as (
  select * from spans b where kind = 3 and {_DIFFERENT} >= 10 and len(regexp_extract_all(value, '[0-9]')) >= 3
    and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')
    and not exists (select 1 from sure s where s.doc_id = b.doc_id and s.start < b.stop and b.start < s.stop)
),
candidates as materialized (select * from sure union all select * from bare),
holders as (select value, count(distinct source) as holders from candidates group by value),
judged as (
  select c.*, array_extract(['assign', 'access', 'hex', 'bare'], kind + 1) || ':' || start || ':' || stop as span,
         holders <= 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and {_DIFFERENT} >= 8 as live
  from candidates c join holders using (value)
),
found as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans,
         count(*) filter (live) as n_live
  from judged where kind < 3 or live group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from documents d left join found using (doc_id)
"""

_CHUNK = " + ".join(f"(strpos('0123456789abcdef', x[5 * (i // 4) + {j + 1}]) - 1) * {16 ** (4 - j)}" for j in range(5))

ARCHIVES = f"""
with payloads as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as x from pages),
firsts as (select *, min(page_id) over (partition by html) as first from payloads)
select page_id, strlen(html) as payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({_CHUNK}) >> (15 - 5 * (i % 4))::integer) & 31)::integer, 1) for i in range(32)
       ], '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from firsts
"""

HARD_NEGATIVES = """
with vectors as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

_HALVES = "substr(word, 1, i) as before, substr(word, i + 2) as after"

SPELLING = f"""
with recursive crc_bytes as materialized (
  select list(list_reduce(list_concat([b], range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from range(256) bytes(b)
),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) as run
  from documents
),
hashed as (
  select run, k, xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
      lambda ch: case when ord(ch) < 128 then [ord(ch)::bigint] else [195::bigint, ord(ch)::bigint - 64] end))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from (select id, run, count(*) as k from runs group by all), crc_bytes
),
words as materialized (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n
  from hashed group by word having length(word) >= 5 and sum(k) >= 3
),
holes as materialized (select word, n, i, {_HALVES} from (select word, n, unnest(range(length(word))) as i from words)),
shorter as (select h.word, w.word as near from holes h join words w on w.word = h.before || h.after),
near as materialized (
  select word, near from shorter union select near, word from shorter
  union select a.word, b.word from holes a join holes b on a.before = b.before and a.after = b.after and a.i = b.i and a.word <> b.word
),
best as (
  select s.word, count(*) as n_near, arg_min(near, (-w.n, near)) as first, max(w.n) as near_n
  from near s join words w on w.word = s.near group by s.word
),
told as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then first end as form, case when near_n >= 2 * n then near_n end as form_n
  from words left join best using (word)
),
walk as (
  select word, word as at, form as next from told
  union all
  select w.word, w.next, t.form from walk w join told t on t.word = w.next
)
select t.word, t.form, w.at as root, t.n, t.n_near, t.form_n from told t join walk w on w.word = t.word and w.next is null
"""

SQL = {
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_spelling_variants": SPELLING,
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op3_quality_rules": QUALITY,
    "op7_decontamination": DECONTAMINATION,
    "op8_secret_scan": SECRETS,
    "op9_archives": ARCHIVES,
}
