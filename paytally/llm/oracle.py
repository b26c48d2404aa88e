"""Expected results of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
with docs as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as data from documents),
sized as (select *, octet_length(data) as n from docs),
starts as (select rid, unnest(range(0, n - 199)) as s from sized where n >= 200),
hashed as (select rid, s, md5(d.data[s + 1 : s + 200]) as h from starts join sized d using (rid)),
twice as (select h from hashed group by h having count(*) > 1),
flagged as (select rid, s from hashed semi join twice using (h)),
fresh as (
  select rid, s, case when s > lag(s) over (partition by rid order by s) + 200 or lag(s) over (partition by rid order by s) is null
    then 1 else 0 end as first from flagged),
island as (select rid, s, sum(first) over (partition by rid order by s) as k from fresh),
runs as (select rid, k, min(s) as lo, max(s) + 200 as hi from island group by rid, k),
gaps as (
  select rid, k, lo, coalesce(lag(hi) over (partition by rid order by k), 0) as from_, lo as to_ from runs
  union all select rid, max(k) + 1, null, max(hi), null from runs group by rid),
parts as (select rid, k, hex(d.data[from_ + 1 : coalesce(to_, n)]) as part from gaps join sized d using (rid) where from_ < coalesce(to_, n)),
kept as (select rid, string_agg(part, '' order by k) as kept from parts group by rid),
sums as (select rid, sum(hi - lo) as removed, count(*) as spans from runs group by rid)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(case when s.rid is null then d.data else unhex(coalesce(kept, '')) end) as kept_sha256
from sized d left join sums s using (rid) left join kept using (rid)
"""

OP3 = f"""
with words as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
sized as (select item_id, w, least(13, len(w)) as m from items where len(w) > 0),
windows as (select distinct item_id, m, array_to_string(w[k + 1 : k + m], ' ') as win from (select *, unnest(range(0, len(w) - m + 1)) as k from sized)),
lengths as (select distinct m from windows),
places as (select rid, w, m, unnest(range(0, len(w) - m + 1)) as k from words, lengths where len(w) >= m),
found as (
  select rid, k, p.m, item_id from (select rid, k, m, array_to_string(w[k + 1 : k + m], ' ') as win from places) p
  join windows v on p.m = v.m and p.win = v.win),
hit as (select rid, count(distinct pos) as n_hit from (select rid, unnest(range(k, k + m)) as pos from found) group by rid),
named as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct rid, cast(item_id as varchar) as id from found where item_id is not null) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (rid) left join named using (rid)
"""

OP5 = """
with steps as (
  select k, list_reduce(list_prepend(k, cast(range(8) as bigint[])), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
  from (select unnest(range(256)) as k)),
lookup as (select list(v order by k) as t from steps),
docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
sized as (
  select rid, doc_id, cast(octet_length(encode(text)) as bigint) + 8 as size, md5(text) as digest, hex(encode(text)) as h from docs),
sums as (
  select rid, doc_id, size, digest, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as text_crc32 from sized, lookup),
ordered as (
  select *, sum(size) over (order by digest, doc_id, rid) as up_to, row_number() over (order by digest, doc_id, rid) as place,
    sum(size) over () as total from sums),
placed as (select *, cast(least(23, ((2 * up_to - size) * 24) // (2 * total)) as int) as shard from ordered)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, cast(null as int) as grown_shard
from placed
"""

OP6 = f"""
with recursive words as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (
  select distinct rid, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k + 1 : k + 5], ' ') end as g
  from (select rid, w, unnest(range(0, greatest(1, len(w) - 4))) as k from words where len(w) > 0)),
sizes as (select rid, count(*) as n from shingles group by rid),
common as (select a.rid as a, b.rid as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.rid <> b.rid group by 1, 2),
links as (
  select a, b from common join sizes x on x.rid = a join sizes y on y.rid = b where 100 * c >= 75 * (x.n + y.n - c)),
reached as (select rid as a, rid as b from words union select reached.a, links.b from reached join links on links.a = reached.b),
least_ids as (select reached.a as rid, min(doc_id) as component_id from reached join words on words.rid = reached.b group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, md5(coalesce(text, '')) as text_digest, doc_id is not distinct from component_id as kept
from (select row_number() over () as rid, text from documents) join words using (rid) left join sizes using (rid) join least_ids using (rid)
"""

OP10 = """
with payloads as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first from payloads group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id is distinct from first then first end as refers_to
from payloads join firsts using (payload_digest)
"""

OP11 = """
with rows as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.rid as anchor, a.vec_id as anchor_id, b.rid as other, b.vec_id as other_id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) as bigint) as score
  from rows a join rows b on a.rid <> b.rid where a.vec_id % 100 = 0),
positives as (
  select * from scored where same qualify row_number() over (partition by anchor order by score desc, other_id nulls last) <= 5),
windows as (
  select p.anchor_id, p.other_id as positive_id, p.score as positive_score, n.other_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.anchor, p.other order by n.score desc, n.other_id nulls last) as rank
  from positives p join scored n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from windows where rank <= 5
"""

_CRC32 = """
steps as (
  select k, list_reduce(list_prepend(k, cast(range(8) as bigint[])), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
  from (select unnest(range(256)) as k)),
lookup as (select list(v order by k) as t from steps)"""

OP13 = f"""
with recursive {_CRC32},
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} as run from documents),
distinct_runs as (select id, run, count(*) as times from runs group by id, run),
summed as (
  select run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: cast('0x' || x as bigint))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as h from distinct_runs, lookup),
spelt as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from summed),
words as (select word, cast(sum(times) as bigint) as n from spelt where length(word) >= 5 group by word having sum(times) >= 3),
gaps as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (
  select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word and length(a.word) = length(b.word)
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
  from words left join best using (word)),
chain as (select word, word as root, form as further from formed
  union all select c.word, c.further, f.form from chain c join formed f on f.word = c.further)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.further is null
"""


def queries() -> dict[str, str]:
    return {
        "op2_repeated_strings": OP2,
        "op3_decontamination": OP3,
        "op5_sharding": OP5,
        "op6_minhash": OP6,
        "op10_warc": OP10,
        "op11_hard_negatives": OP11,
        "op13_spelling": OP13,
    }
