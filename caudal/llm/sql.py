"""Check SQL of the queries that SQL can express."""

EXACT_DEDUP = r"""
with folded as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as digest from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = min(doc_id) over same as kept, digest as text_sha256
from folded window same as (partition by digest)
"""

WARC = """
with payloads as (select page_id, coalesce(html, '') as payload, sha256(coalesce(html, '')) as digest from pages),
placed as (
    select page_id, strlen(payload) as payload_bytes, digest,
        case when strlen(payload) >= 100 then min(page_id) over (partition by digest) else page_id end as first_id
    from payloads
)
select page_id, payload_bytes, digest as payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
    case when first_id <> page_id then first_id end as refers_to
from placed
"""

CHAT = r"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
    cast(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) as bigint) as formatted_chars
from said group by conv_id
"""

SUBSTRING_DEDUP = r"""
with split as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from split),
windows as (select doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) as w from starts),
repeats as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as least from windows) where doc_id > least),
covered as (select distinct doc_id, unnest(range(i, i + 50)) as at from repeats),
placed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from split),
kept as (
    select p.doc_id, count(*) as n_kept, string_agg(word, ' ' order by p.at) as kept
    from placed p anti join covered c on p.doc_id = c.doc_id and p.at = c.at group by p.doc_id
)
select s.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id
"""

JACCARD_JOIN = r"""
with recursive split as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
long as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) as s from split where len(w) >= 3),
elements as (select * from long union all select doc_id, array_to_string(w, ' ') || ' ' from split where len(w) in (1, 2)),
sizes as (select doc_id, count(*) as n from elements group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared from elements a join elements b on a.s = b.s and a.doc_id <> b.doc_id
    group by all
),
links as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
reach(doc_id, node) as (select doc_id, doc_id from split union select r.doc_id, l.b from reach r join links l on l.a = r.node)
select s.doc_id, cast(coalesce(any_value(z.n), 0) as bigint) as n_shingles, min(r.node) as component_id
from split s join reach r on r.doc_id = s.doc_id left join sizes z on z.doc_id = s.doc_id group by s.doc_id
"""

SPELLING_VARIANTS = r"""
with recursive bits as (select b, list_reduce(range(9), lambda c, i: case when i = 0 then c when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as c from range(256) t(b)),
crc as (select list(c order by b) as tab from bits),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) as run from documents),
lowered as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from runs),
coded as (select run, hex(encode(doc_id || ':' || run)) as h from lowered),
hashed as (
    select run, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: cast('0x' || h[i : i + 1] as bigint)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295)) as crc
    from coded, crc
),
damaged as (select case when crc % 31 = 0 then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word from hashed),
words as (select word, count(*) as n from damaged where length(word) >= 7 group by word having count(*) >= 2),
cuts as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
    select a.word, b.word as other from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select c.word, w.word from cuts c join words w on c.rest = w.word union select w.word, c.word from cuts c join words w on c.rest = w.word
),
best as (select p.word, count(*) as n_near, max(w.n) as most, arg_min(p.other, (-w.n, p.other)) as other from pairs p join words w on w.word = p.other group by p.word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * n then other end as form, case when most >= 10 * n then most end as form_n from words w left join best b on b.word = w.word),
chain(word, here, step) as (select word, word, 0 from formed union all select c.word, f.form, step + 1 from chain c join formed f on f.word = c.here where f.form is not null),
ends as (select word, arg_max(here, step) as root from chain group by word)
select f.word, form, root, cast(n as bigint) as n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from formed f join ends e on e.word = f.word
"""
