"""SQL for DuckDB that gives the same rows as queries that it can express."""

#: Strings of 50 bytes as hexadecimal digits, cut out of blocks so that no long text is walked for each of them.
SUFFIX_DEDUP = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
    b as (select doc_id, unnest(range(0, greatest(length(x) // 2 - 49, 0), 200)) as begins, length(x) // 2 as n, x from h),
    y as (select doc_id, begins, least(200, n - 49 - begins) as strings, substr(x, 2 * begins + 1, 498) as block from b),
    j as (select doc_id, begins, block, unnest(range(strings)) as j from y),
    w as (select doc_id, begins + j as pos, substr(block, 2 * j + 1, 100) as s from j),
    f as (select s, min(doc_id) as first from w group by s),
    c as (select w.doc_id, w.pos from w join f using (s) where w.doc_id > f.first),
    m as (select doc_id, pos, coalesce(pos > lag(pos) over o + 50, true) as new from c window o as (partition by doc_id order by pos)),
    n as (select doc_id, pos, sum(new::int) over (partition by doc_id order by pos) as run from m),
    r as (select doc_id, run, min(pos) as start, max(pos) + 50 as stop from n group by doc_id, run),
    g as (select doc_id, run, coalesce(lag(stop) over (partition by doc_id order by run), 0) as start, start as stop from r
        union all select h.doc_id, 1000000000, coalesce(max(r.stop), 0), any_value(length(h.x)) // 2 from h left join r using (doc_id) group by h.doc_id),
    k as (select h.doc_id, string_agg(substr(h.x, 2 * g.start + 1, 2 * (g.stop - g.start)), '' order by g.run) as kept from h join g using (doc_id) group by h.doc_id),
    t as (select doc_id, sum(stop - start) as n_removed, count(*) as n_spans from r group by doc_id)
select h.doc_id, length(h.x) // 2 as n_bytes, coalesce(t.n_removed, 0)::bigint as n_removed, coalesce(t.n_spans, 0) as n_spans,
    sha256(unhex(k.kept)) as kept_sha256
from h join k using (doc_id) left join t using (doc_id)"""

NGRAM_JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents),
    s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
    x as (select doc_id, len(s) as n, unnest(s) as t from s),
    l as (select a.doc_id as a, b.doc_id as b from x a join x b on a.t = b.t and a.doc_id < b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    e as (select a, b from l union all select b, a from l),
    r as (select doc_id as id, doc_id as c from s union select e.b, r.c from r join e on e.a = r.id)
select s.doc_id, len(s.s) as n_shingles, m.component_id from s join (select id, min(c) as component_id from r group by id) m on m.id = s.doc_id"""

WARC = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
    d as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31))::int, 1)), '') as payload_digest from p),
    f as (select payload_digest, min(page_id) as first from d group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id <> first then first end as refers_to from d join f using (payload_digest)"""
