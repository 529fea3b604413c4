"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

Fingerprints (XXH64), spans in code points, tokens, fitted mixes and scores have none; tests/llm
holds those queries against plain Python.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from benchmark),
iw as (select distinct item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from (select *, least(10, len(w)) as n from b where len(w) > 0))),
sizes as (select distinct n from iw),
dw as (select doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select dw.doc_id, dw.i, dw.n, iw.item from dw join iw on dw.win = iw.win and dw.n = iw.n),
spots as (select distinct doc_id, unnest(range(i, i + n)) as p from hits),
covered as (select doc_id, count(*) as n_hit from spots group by doc_id),
items as (select doc_id, count(distinct item) as n_items, list_aggregate(list_sort(list(distinct item)), 'string_agg', ',') as listed from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a)
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links, component_id, v.vec_id = component_id as kept from v join least on v.vec_id = least.a"""

LINES = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_UPPER}', '{_LOWER}') as key from l),
held as (select key, max(doc_id) as holder from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, held.key is not null and holder <> doc_id as gone from k left join held on k.key = held.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id"""

SUBSTRINGS = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
win as (select doc_id, i, case when i + 34 <= len(w) then md5(list_aggregate(w[i : i + 34], 'string_agg', ' ')) end as h, w[i] as word from p),
rep as (select h from win where h is not null group by h having count(*) > 1),
seen as (select win.*, max(case when rep.h is not null then i end) over (partition by doc_id order by i) as last from win left join rep on win.h = rep.h),
kept as (select doc_id, count(*) filter (last is not null and i - last < 35) as n_removed, string_agg(word, ' ' order by i) filter (last is null or i - last >= 35) as t from seen group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

SQL = {"op2_decontaminate": DECONTAMINATE, "op6_embedding_dedup": EMBEDDINGS, "op8_line_dedup": LINES, "op10_substring_dedup": SUBSTRINGS}
