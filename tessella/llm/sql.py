"""SQL (DuckDB) for the queries that SQL can say on small tables."""

from __future__ import annotations

import zlib

from tessella.llm import secrets
from tessella.llm.quality import RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINES = f"""
with t as (select doc_id, string_split(text, chr(10)) s from documents where text is not null),
 l as (select doc_id, i - 1 i, doc_id * 1000000 + i - 1 pos, list_sort(list_distinct({WORDS.replace("coalesce(text, '')", "s[i]")})) w from (select doc_id, s, unnest(range(1, len(s) + 1)) i from t)),
 c as (select w, len(w) n, min(pos) first, row_number() over () c from l where len(w) > 0 group by w),
 f as (select x, count(*) k from (select unnest(w) x from c) group by x),
 r as (select c, n, first, x, row_number() over (partition by c order by k, x) p from (select c, n, first, unnest(w) x from c) join f using (x)),
 q as (select * from r where p <= n - ceil(4 * n / 5.0) + 1),
 y as (select distinct a.c, b.c d from q a join q b using (x) where a.c < b.c and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
 o as (select y.c, y.d, a.first a, b.first b, a.n + b.n n, len(list_intersect(a.w, b.w)) k from y join c a on a.c = y.c join c b on b.c = y.d),
 z as (select c, b as first from o where 5 * k >= 4 * (n - k) union all select d, a from o where 5 * k >= 4 * (n - k)),
 m as (select c, min(first) first from (select c, first from z union all select c, first from c) group by c),
 g as (select l.doc_id, list(l.i order by l.i) removed from l join c using (w) join m on m.c = c.c where l.pos > m.first group by l.doc_id)
select d.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end::bigint n_lines, coalesce(len(g.removed), 0)::bigint n_removed, coalesce(g.removed, [])::bigint[] removed_lines from documents d left join g on g.doc_id = d.doc_id
"""

SUFFIX = """
with d as (select doc_id, row_number() over () r, hex(encode(coalesce(text, ''))) h from documents),
 p as (select doc_id, r, unnest(range(0, length(h) // 2 - 49)) i, h from d where length(h) >= 100),
 k as (select doc_id, r, i, md5_number(substr(h, 2 * i + 1, 100)) w from p),
 f as (select w, min(doc_id) m from k group by w having min(doc_id) < max(doc_id)),
 s as (select k.r, k.i, lag(k.i) over (partition by k.r order by k.i) before from k join f using (w) where k.doc_id > f.m),
 v as (select r, i, count(*) filter (before is null or i - before > 50) over (partition by r order by i) span from s),
 u as (select r, span, min(i) a, max(i) + 50 b from v group by all),
 g as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) after from u),
 n as (select r, sum(b - a)::bigint removed, count(*) spans, string_agg(substr(d.h, 2 * after + 1, 2 * (a - after)), '' order by a) kept, max(b) last from g join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, sha256(unhex(case when n.r is null then h else kept || substr(h, 2 * last + 1) end)) kept_sha256 from d left join n using (r)
"""

SUBSTRING = f"""
with d as (select doc_id, row_number() over () r, {WORDS} w from documents),
 p as (select doc_id, r, unnest(range(1, len(w) - 11)) i, w from d where len(w) >= 13),
 q as (select doc_id, r, i, array_to_string(w[i:i + 12], ' ') g from p),
 f as (select g, min(doc_id) m from q group by g having count(*) > 1),
 h as (select distinct q.r, unnest(range(q.i, q.i + 13)) j from q join f using (g) where f.m < q.doc_id),
 k as (select d.r, d.doc_id, len(w) n, unnest(range(1, len(w) + 1)) j, unnest(w) x from d),
 s as (select k.r, count(*) filter (h.j is not null) gone, string_agg(x, ' ' order by k.j) filter (h.j is null) t from k left join h on h.r = k.r and h.j = k.j group by k.r)
select d.doc_id, len(d.w)::bigint n_words, coalesce(s.gone, 0)::bigint n_removed, sha256(coalesce(s.t, '')) kept_sha256 from d left join s using (r)
"""

NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
 g as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end s from d),
 x as (select doc_id, len(s) n, unnest(s) h from g),
 l as (select a.doc_id u, b.doc_id v from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 c(u, v) as (select doc_id, doc_id from d union select c.u, l.v from c join l on l.u = c.v)
select g.doc_id, len(s)::bigint n_shingles, m.m component_id, g.doc_id = m.m kept from g join (select u, min(v) m from c group by u) m on m.u = g.doc_id
"""

WARC = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
 m as (select s, max(page_id) m from p group by s),
 b as (select p.*, m.m, bin(('0x' || substr(s, 1, 8))::bigint + 4294967296)[2:] || bin(('0x' || substr(s, 9, 8))::bigint + 4294967296)[2:] || bin(('0x' || substr(s, 17, 8))::bigint + 4294967296)[2:] || bin(('0x' || substr(s, 25, 8))::bigint + 4294967296)[2:] || bin(('0x' || substr(s, 33, 8))::bigint + 4294967296)[2:] bits from p join m using (s))
select page_id, octet_length(encode(h))::bigint payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1) for i in range(0, 32)], '') payload_digest,
 case when page_id < m then 'revisit' else 'response' end record_type, case when page_id < m then m end refers_to from b
"""


#: crc32 of a decimal number: the remainder of each byte, folded over its digits.
_BYTES = [zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)]
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, ({_BYTES}::bigint[])[1 + (xor(a, b) & 255)])))"

PERIODIC = f"""
with a as (select doc_id, row_number() over () r, {WORDS} w, case when doc_id is null then 1 else {_CRC} end h from documents),
 b as (select *, len(w) n, h // 10 g from a),
 c as (select *, case when h % 10 = 0 and n > 0 then g % n else n end a from b),
 d as (select doc_id, r, n, case when a = n then w else [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end] for i in range(0, n)] end w from c),
 q as (select r, n, w, unnest(range(1, n // 4 + 1)) q from d where n >= 6),
 j as (select r, q, w, unnest(range(0, (n - 1) // q)) j from q),
 k as (select r, q, j, j - row_number() over (partition by r, q order by j) z from j where w[j * q + 1] = w[(j + 1) * q + 1]),
 l as (select r, q, min(j) j0, max(j) j1 from k group by r, q, z having count(*) >= (greatest(6, 4 * q) - q) // q),
 m as (select r, q, d.w, unnest(range(greatest((j0 - 1) * q + 1, 0), least((j1 + 1) * q, n - q))) i from l join d using (r)),
 o as (select distinct r, q, i from m where w[i + 1] = w[i + q + 1]),
 p as (select r, q, i, i - row_number() over (partition by r, q order by i) z from o),
 s as (select r, q, min(i) s, count(*) + q n from p group by r, q, z having count(*) >= greatest(6, 4 * q) - q),
 t as (select r, s, n, min(q) q from s group by r, s, n),
 u as (select r, count(*) n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) listed, first(s order by n desc, s, q) s, first(n order by n desc, s, q) n, first(q order by n desc, s, q) q from t group by r),
 v as (select distinct r, unnest(range(s + q, s + n)) i from t),
 x as (select r, unnest(range(0, n)) i, unnest(w) w from d),
 y as (select r, string_agg(w, ' ' order by i) t from x anti join v using (r, i) group by r)
select d.doc_id, coalesce(u.n_runs, 0)::bigint n_runs, u.s::bigint as start, u.n::bigint as length, u.q::bigint as period, (1000 * u.n // u.q)::bigint exponent_milli, sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(y.t, '')) collapsed_sha256, d.n::bigint n_words from d left join u using (r) left join y using (r)
"""


def secrets_sql() -> str:
    """Matches by the expressions; their places from the lengths of what lies between them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " union all ".join(f"select r, {i} i, '{r.kind}' kind, {quoted(r.keep)} keep, regexp_extract_all(t, {quoted(r.find)}) m, string_split_regex(t, {quoted(r.find)}) s from d where regexp_matches(t, {quoted(r.keep)})" for i, r in enumerate(secrets.RULES))
    kept = " or ".join(f"(i = {i} and regexp_full_match(m, {quoted(r.keep)}))" for i, r in enumerate(secrets.RULES))
    base = len(secrets.BASE)
    counts = ", ".join(f"coalesce(n{i}, 0)::bigint n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t from documents),
 e as ({each}),
 f as (select r, i, kind, unnest(range(1, len(m) + 1)) k, unnest(m) m, unnest(s[:len(m)]) s from e),
 g as (select r, i, kind, m, (sum(length(s) + length(m)) over (partition by r, i order by k))::bigint stop from f),
 h as (select r, i, kind || ':' || (stop - length(m)) || ':' || stop x, stop - length(m) as start from g where {kept}),
 n as (select r, {", ".join(f"count(*) filter (i = {i}) n{i}" for i in range(base))}, string_agg(x, ',' order by start, i) filter (i < {base}) base, string_agg(x, ',' order by start, i) spans from h group by r)
select doc_id, {counts}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join n using (r)
"""


def quality_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """Base rules, the exact binomial tests of the fixed grids, and the verdict."""
    signals = {r.name: "case when {1} > 0 then {0} / {1}::double else 0 end".format(*r.signal.split(" / ")) for r in RULES}
    grid = ", ".join(f"('{r.name}', {i}, {c}::double)" for r in RULES for i, c in enumerate(r.cutoffs))
    long = " union all ".join(f"select r, lang, doc_id, '{n}' as rule, {s} as x from f where not base_failed" for n, s in signals.items())
    a = alpha / len(RULES)
    return f"""
with d as (select doc_id, row_number() over () r, lang, {WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint n_symbols from documents),
 q as (select r, unnest(range(1, len(w) - 6)) i, w from d where len(w) >= 8),
 g as (select r, i, array_to_string(w[i:i + 7], ' ') s from q),
 t as (select r, i from g join (select r, s from g group by r, s having count(*) > 1) using (r, s)),
 n as (select r, count(distinct j) n from (select r, unnest(range(i, i + 8)) j from t) group by r),
 e as (select d.r, doc_id, lang, len(w)::bigint n_words, coalesce(list_sum([len(x) for x in w]), 0)::bigint word_chars, n_symbols, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n.n, 0)::bigint n_repeat_words from d left join n using (r)),
 f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from e),
 x as ({long}),
 good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having min(quality) = 1),
 y as (select x.* from x semi join good using (doc_id)),
 c as (select y.lang, v.rule, v.i, v.cutoff, count(*) n, count(*) filter (y.x >= v.cutoff) k from y join (values {grid}) v(rule, i, cutoff) using (rule) group by all),
 p as (select *, k < n * {a} and list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a})) for j in range(0, k + 1)]) <= {delta} / (select count(distinct (lang, rule)) from c) ok from c),
 z as (select lang, rule, min(cutoff) cutoff from (select *, bool_and(ok) over (partition by lang, rule order by i) all_ok from p) where all_ok group by all),
 b as (select distinct x.r from x join z on z.rule = x.rule and z.lang is not distinct from x.lang where x.x >= z.cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and b.r is null kept from f left join b using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINES, "op2_quality_rules": quality_sql(), "op4_suffix_array_dedup": SUFFIX, "op5_substring_dedup": SUBSTRING, "op9_minhash_near_dedup": NEAR, "op10_warc": WARC, "op11_periodic_runs": PERIODIC, "op12_secret_scan": secrets_sql()}
