"""DuckDB SQL for the operators that it can express, apart from their code."""

from __future__ import annotations

_PARTS = {
    "assign": (0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (2, r"[0-9a-f]+", 0, 24),
    "identifier": (3, r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", 0, 3),
    "run": (4, r"[A-Za-z0-9+/=_-]+", 0, 40),
    "endpoint": (5, r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|amqp|redis|s3)://[A-Za-z0-9._:@/?&=%+~#-]+", 0, 8),
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(name: str) -> str:
    kind, pattern, group, least = _PARTS[name]
    p = _text(pattern)
    key = " and length(w) = 40 and not regexp_matches(w, '[=_-]') and regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Z]') and regexp_matches(w, '[a-z]')" if name == "run" else ""
    return f"""
      select doc_id, {kind} as kind, stop - length(w) as start, stop from (
        select doc_id, w, g, sum(length(gap) + length(w)) over (partition by doc_id order by i) as stop from (
          select doc_id, unnest(regexp_extract_all(t, {p}, 0)) as w, unnest(regexp_extract_all(t, {p}, {group})) as g, unnest(string_split_regex(t, {p})[:-2]) as gap,
            generate_subscripts(regexp_extract_all(t, {p}, 0), 1) as i
          from texts)) where length(g) >= {least}{key}"""


SECRETS = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
parts as ({" union all ".join(map(_found, _PARTS))}),
near as (
  select x.doc_id, x.kind, x.start, x.stop, bool_or(y.kind in (1, 3)) as ids, bool_or(y.kind in (0, 2, 4)) as secrets
  from parts x join parts y on x.doc_id = y.doc_id and y.start <= x.stop + 200 and y.stop >= x.start - 200
  where x.kind > 2 group by all),
spans as (
  select doc_id, kind, start, stop from parts where kind < 3
  union all select doc_id, kind, start, stop from near where case kind when 3 then secrets when 4 then ids else ids and secrets end),
named as (select *, (['assign', 'access', 'hex', 'identifier', 'key', 'endpoint'])[kind + 1] || ':' || start || ':' || stop as named from spans),
listed as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(named, ',' order by start, kind) filter (kind < 3) as base, string_agg(named, ',' order by start, kind) as spans
  from named group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join listed using (doc_id)"""

PAGES = r"""
with p as (select page_id, url, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages),
f as (select h, min(page_id) as first from p where n >= 100 group by h)
select page_id, n as payload_bytes, sha256(p.h) as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to, url as target_uri, case when first <> page_id then null else true end as digest_ok
from p left join f on p.h = f.h"""

MIXTURE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) as n, md5(concat_ws(':', doc_id, source, md5(text))) as key from documents),
s as (select source, sum(n)::bigint as all_n from d group by source),
ends as (select max(all_n)::double as most, min(all_n)::double as least from s where all_n > 0),
e as (select most, case when most / least <= 2 then 0 else 1 - ln(2) / ln(most / least) end as a from ends),
w as (select source, all_n, case when all_n > 0 then pow(all_n / most, a) / all_n end as rate from s left join e on true),
r as (select source, all_n, coalesce(rate / (select min(rate) from w), 1.0) as times from w),
t as (select source, all_n, case when abs(times - round(times)) * all_n < 0.5 then round(times) else times end as times, greatest(ceil(all_n / 200000), 1)::bigint as blocks from r),
plan as (select *, floor(times)::bigint as whole, (times - floor(times)) * all_n as quota from t),
shown as (
  select d.*, blocks, whole, quota, unnest(range(1, whole + 2)) as epoch from d join plan on d.source is not distinct from plan.source),
drawn as (select *, ('0x' || substr(md5(concat_ws(':', 17, epoch, key)), 1, 15))::bigint as draw from shown),
placed as (select *, draw % blocks as block from drawn),
units as (select source, block, draw, sum(n) as n from placed where epoch > whole group by all),
before as (select source, block, draw, coalesce(sum(n) over (partition by source order by block, draw rows between unbounded preceding and 1 preceding), 0) as seen from units),
kept as (
  select p.* from placed p left join before b on p.epoch > p.whole and p.source is not distinct from b.source and p.block = b.block and p.draw = b.draw
  where p.epoch <= p.whole or b.seen < p.quota)
select doc_id, source, n::bigint as n_tokens, epoch::int as epoch, block, row_number() over (partition by source, epoch, block order by draw, key) as slot from kept"""

LINKS = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [md5('short ' || array_to_string(w, ' '))] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
ids as (select doc_id, bit_xor(('0x' || substr(s, 1, 15))::bigint) as x, count(*) as c from shingles group by doc_id),
alike as (select doc_id, min(doc_id) over (partition by x, c) as one, count(*) over (partition by x, c) as copies from ids),
ones as (select distinct one, copies from alike),
held as (select doc_id, s, n from shingles join ones on doc_id = one join sizes using (doc_id)),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n + b.n) as total from held a join held b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all),
links as (select a, b from pairs where 100 * shared >= 75 * (total - shared)),
ways as (select a, b from links union all select b, a from links),
reached(a, b) as (select one, one from ones union select r.a, w.b from reached r join ways w on r.b = w.a),
least as (select a, min(b) as c from reached group by a),
more as (select w.a, sum(o.copies) as n from ways w join ones o on w.b = o.one group by w.a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(copies - 1, 0) + coalesce(m, 0) as n_links
from documents d left join sizes using (doc_id) left join alike using (doc_id) left join least on one = least.a left join (select a, n::bigint as m from more) more on one = more.a"""

REPEATS = r"""
with d as (select doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, unnest(range(n - 99)) as i, h from d where n >= 100),
strings as (select doc_id, i, md5_number(h[2 * i + 1 : 2 * i + 200]) as s from starts),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from strings) where k > 1),
runs as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from later),
ranges as (select doc_id, min(i) as a, max(i) + 100 as b from runs group by doc_id, run),
marked as (select *, case when a > max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from ranges),
numbered as (select *, sum(new) over (partition by doc_id order by a) as span from marked),
spans as (select doc_id, min(a) as a, max(b) as b from numbered group by doc_id, span),
cuts as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, list(a order by a) as xs, list(b order by a) as ys from spans group by doc_id),
kept as (select doc_id, n, h, n_spans, n_removed, list_concat([0], ys) as starts, list_concat(xs, [n]) as stops from d left join cuts using (doc_id))
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(1, len(starts) + 1), lambda i: h[2 * starts[i] + 1 : 2 * stops[i]]), '') end)) as kept_sha256
from kept"""

ORACLES = {"op2_secrets": SECRETS, "op3_warc": PAGES, "op8_suffix": REPEATS, "op9_jaccard": LINKS, "op10_mixing": MIXTURE}
