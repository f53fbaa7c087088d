"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

#: op1: windows of 50 words by their own text, the least id of each, and the words that are left.
SUBSTRING_DEDUP = f"""
with docs as (select doc_id, {WORDS.format(text="text")} w from documents),
places as (select doc_id, w, unnest(range(1, len(w) - 48)) s from docs where len(w) >= 50),
windows as materialized (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) k from places),
least as (select k, min(doc_id) m from windows group by k),
gone as (select distinct doc_id, unnest(range(s, s + 50)) i from windows join least using (k) where doc_id > m),
words as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from docs),
kept as (select doc_id, string_agg(x, ' ' order by i) t from words anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, len(d.w) n_words, coalesce(n.n, 0) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from docs d left join n using (doc_id) left join kept using (doc_id)
"""

#: op3: shared two-word shingles of every pair, links at 0.8, and the least id reached over them.
NEAR_DEDUP = f"""
with recursive docs as (select doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
sets as materialized (select distinct doc_id, unnest(case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) g from docs where len(w) > 0),
n as materialized (select doc_id, count(*) n from sets group by doc_id),
shared as materialized (select a.doc_id a, b.doc_id b, count(*) k from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
ends as materialized (select a, b from links union all select b, a from links),
reach(node, root) as (select doc_id, doc_id from documents union select e.b, r.root from reach r join ends e on e.a = r.node where r.root < e.b),
comp as (select node, min(root) component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, d.doc_id = c.component_id kept
from docs d left join n using (doc_id) join comp c on c.node = d.doc_id
"""


#: op11: units by their place; cut and put together by string places instead of unit lists.
FILL_IN_MIDDLE = """
with docs as (select doc_id, coalesce(text, '') t, sha256('1:' || doc_id) d from documents),
cut as materialized (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u, list_transform(range(4), lambda i: ('0x' || d[8 * i + 1:8 * i + 8])::bigint) h from docs),
places as (select *, len(u) n, list_sum(list_transform(u[1:least(h[1] % (len(u) + 1), h[2] % (len(u) + 1))], lambda x: length(x))) a,
  list_sum(list_transform(u[1:greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1))], lambda x: length(x))) b from cut),
forms as (select doc_id, t, n, coalesce(a, 0)::bigint a, coalesce(b, 0)::bigint b,
  case when t = '' or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end form from places)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('<P>', substr(t, 1, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a))
    else concat('<S>', substr(t, b + 1), '<P>', substr(t, 1, a), '<M>', substr(t, a + 1, b - a)) end) output_sha256, sha256(t) restored_sha256
from forms
"""

#: op12: CRC-32 of each distinct word by a table that its polynomial gives, then gains, weights and ranks.
IMPORTANCE = """
with texts as (select 0 side, doc_id, coalesce(text, '') t from documents union all select 1, item_id, coalesce(text, '') from benchmark),
words as materialized (select side, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts),
crc as (select list(x order by b) lut from (select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) x from range(256) r(b))),
places as materialized (select side, doc_id, unnest(w) x from words),
vocab as (select distinct x, hex(encode(x)) h from places),
bucket as materialized (select x, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)), lambda c, y: xor(c >> 8, lut[xor(c & 255, y) + 1]))) % 10000 k from vocab, crc),
held as materialized (select k, sum(1 - side) s, sum(side) t from places join bucket using (x) group by k),
alls as (select sum(s)::double s, sum(t)::double t from held),
gain as (select k, floor(1000 * ln((held.t + 1) * (alls.s + 10000) / ((held.s + 1) * (alls.t + 10000))))::bigint g from held, alls),
weights as (select doc_id, count(*) n, sum(g) s from places join bucket using (x) join gain using (k) where side = 0 group by doc_id),
scores as (select d.doc_id, coalesce(n, 0) n, coalesce(case when s >= 0 then s // n else -((-s + n - 1) // n) end, 0)::bigint weight,
  ('0x' || sha256('2024:' || d.doc_id)[1:8])::bigint h from documents d left join weights using (doc_id)),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score from scores),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () m from scored where n >= 20)
select doc_id, n n_features, weight, score, case when r <= 10 * m // 100 then r end as rank from scored left join ranked using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_DEDUP, "op3_near_dedup": NEAR_DEDUP, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_importance_resampling": IMPORTANCE}
