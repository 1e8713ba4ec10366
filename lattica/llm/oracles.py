"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

REPEATS_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), starts as (
    select doc_id, words, unnest(range(1, len(words) - 18)) as i from d
), windows as (
    select doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') as k from starts
), later as (
    select doc_id, i from (select doc_id, i, min(struct_pack(d := doc_id, i := i)) over (partition by k) as first from windows) where struct_pack(d := doc_id, i := i) > first
), w as (
    select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from d
), marked as (
    select w.doc_id, w.i, word, max(case when later.i is not null then 1 else 0 end) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) as gone
    from w left join later on later.doc_id = w.doc_id and later.i = w.i
), kept as (
    select doc_id, count(*) as n, sum(gone) as r, string_agg(word, ' ' order by i) filter (gone = 0) as rest from marked group by doc_id
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(kept.r, 0)::bigint as n_removed, sha256(coalesce(kept.rest, '')) as kept_sha256 from d left join kept using (doc_id)
"""

VECTORS_SQL = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, seen) as (
    select vec_id, vec_id from embeddings union select reach.id, links.b from reach join links on links.a = reach.seen
), least as (
    select id, min(seen) as c from reach group by id
), counts as (
    select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from embeddings join least on id = vec_id left join counts on a = vec_id
"""

JACCARD_SQL = r"""
with recursive d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
    select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as s from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from d where len(words) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as met from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), pairs as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * met >= 4 * (x.n + y.n - met)
), links as (
    select a, b from pairs union all select b, a from pairs
), reach(id, seen) as (
    select doc_id, doc_id from documents union select reach.id, links.b from reach join links on links.a = reach.seen
), least as (
    select id, min(seen) as c from reach group by id
), counts as (
    select a, count(*) as n from links group by a
)
select doc_id, c as class_id, coalesce(n, 0)::bigint as n_links, doc_id = c as kept from documents join least on id = doc_id left join counts on a = doc_id
"""

DIVERGENCE_SQL = r"""
with d as (
    select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), t as (
    select lang, source, id, unnest(terms) as term from d
), kept as (
    select lang, term, count(*)::bigint as total from t group by all having count(distinct id) >= 10
), langs as (
    select lang, count(*)::bigint as v, sum(total)::bigint as n from kept group by lang
), c as (
    select t.lang, source, t.term, count(*)::bigint as n from t join kept using (lang, term) group by all
), groups as (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce(s.n, 0)::bigint as size from (select distinct lang, source from d) g left join langs using (lang) left join (select lang, source, sum(n) as n from c group by all) s using (lang, source)
), p as (
    select lang, source, term, total, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (size + 2 * v))::bigint as p from groups join kept using (lang) left join c using (lang, source, term)
), pair as (
    select a.lang, a.source, b.source as item, (((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join (select lang, source, item, sum(f) as f from pair group by all) x on x.lang = a.lang and x.source = a.source and x.item = b.source
), whole as (
    select p.*, (1 + (1000000000::hugeint * (total + 2)) // (langs.n + 2 * v))::bigint as q from p join langs using (lang)
), terms as (
    select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from whole where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""

CHAT_SQL = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
    select *, length(regexp_replace(role || chr(0) || text, '([<\[])(STUFF*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\]|/?(?:start|end)_of_turn>)', '\1STUFF\2\3', 'g')) - 1 as chars from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(chars + length('<|start|><|message|><|end|>') + 1)::bigint as formatted_chars from e group by conv_id
""".replace("STUFF", "\u2063")

# CRC-32 bit by bit, by its polynomial; the tree level by level, one more for the forest of sources
MANIFEST_SQL = r"""
with recursive d as (
    select *, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substring(doc_id::varchar, i, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as crc,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from documents
), leaves as (
    select doc_id, coalesce('1' || source, '0') as tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when xor(crc, 4294967295) % 5 = 0 then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as claim from d
), ranked as (
    select *, row_number() over (partition by tree order by doc_id nulls last, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves
), nodes(tree, i, n, level, h) as (
    select tree, i, n, 0, leaf from ranked
    union all select tree, i // 16, any_value((n + 15) // 16), level + 1, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by tree, i // 16, level
), subroots as (
    select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1
), upper(i, n, level, h) as (
    select i, n, 0, h from subroots union all select i // 16, any_value((n + 15) // 16), level + 1, sha256(string_agg(h, '' order by i)) from upper where n > 1 group by i // 16, level
), both_ as (
    select tree, i, n, level, h from nodes union all select null, i, n, level, h from upper
), ways as (
    select r.doc_id, r.leaf, r.claim, r.tree, r.i // (1::bigint << (4 * l)::int) as at, 0 as part, l as level from ranked r, range(0, 15) x(l) where (r.n + (1::bigint << (4 * l)::int) - 1) // (1::bigint << (4 * l)::int) > 1
    union all select r.doc_id, r.leaf, r.claim, null, s.i // (1::bigint << (4 * l)::int), 1, l from ranked r join subroots s using (tree), range(0, 15) x(l) where (s.n + (1::bigint << (4 * l)::int) - 1) // (1::bigint << (4 * l)::int) > 1
), steps as (
    select w.doc_id, w.leaf, w.claim, row_number() over (partition by w.doc_id, w.leaf order by part, w.level) as step,
        (select coalesce(string_agg(h, '' order by i), '') from both_ b where b.tree is not distinct from w.tree and b.level = w.level and b.i // 16 = w.at // 16 and b.i < w.at) as before,
        (select coalesce(string_agg(h, '' order by i), '') from both_ b where b.tree is not distinct from w.tree and b.level = w.level and b.i // 16 = w.at // 16 and b.i > w.at) as after from ways w
), folded(doc_id, leaf, step, h) as (
    select doc_id, leaf, 0, claim from ranked union all select s.doc_id, s.leaf, s.step, sha256(before || h || after) from folded f join steps s on s.doc_id is not distinct from f.doc_id and s.leaf = f.leaf and s.step = f.step + 1
), proofs as (
    select doc_id, leaf, sha256(string_agg(before || after, '' order by step)) as proof from steps group by doc_id, leaf
), last as (
    select doc_id, leaf, max_by(h, step) as h from folded group by doc_id, leaf
)
select r.doc_id, r.leaf, s.h as subroot, (select h from upper where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256, l.h as folded_root, l.h = (select h from upper where n = 1) as verified
from ranked r join subroots s using (tree) join last l on l.doc_id is not distinct from r.doc_id and l.leaf = r.leaf left join proofs p on p.doc_id is not distinct from r.doc_id and p.leaf = r.leaf
"""
