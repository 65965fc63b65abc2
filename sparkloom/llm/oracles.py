"""DuckDB equivalents of the queries that SQL can express.

Dynamic programming decides op6, trained models op2 and op9; tests hold those against brute force."""

from __future__ import annotations

import math

from . import licences, secrets

OP7 = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as d from pages),
     f as (select d, max(page_id) as first from p where n >= 1000 group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest,
       case when first is not null and n >= 1000 and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and n >= 1000 and page_id is distinct from first then first end as refers_to
from p left join f on p.d = f.d
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
     b as (select item_id, w, least(10, len(w)) as k from (select item_id, {_WORDS} as w from benchmark where item_id is not null) where len(w) > 0),
     bw as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from b)),
     ks as (select distinct k from bw),
     dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
     hit as (select doc_id, dw.k, i, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
     n as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
     it as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)
"""


# ---- op1: base columns, the badness score, and cutoffs by the exact binomial tail, whose terms are taken in logarithms

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LEFT = lambda pattern: f"length(regexp_replace(coalesce(text, ''), '{pattern}', '', 'g'))"
_UPPER = _LEFT(r"[^\p{Lu}]+")

OP1 = rf"""
with w as materialized (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, {_SPACED} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
     g as (select rid, i, array_to_string(w[i : i + 7], ' ') as g from w, lateral (select unnest(range(1, len(w) - 6)) as i)),
     twice as (select rid, g from g group by 1, 2 having count(*) > 1),
     rep as (select rid, count(distinct p)::bigint as n from (select rid, unnest(range(i, i + 8)) as p from g join twice using (rid, g)) group by 1),
     f as (select doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {_LEFT('[^#*$%&|<>]+')}::bigint as n_symbols, {_UPPER} as upper, {_LEFT('[^!?]+')} as marks,
                  len(l) as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep using (rid)),
     r as (select *, greatest(least(1, case when word_chars > 0 then n_symbols / word_chars else 0 end / 0.25), least(1, case when n_lines > 0 then n_dup_lines / n_lines else 0 end), least(1, case when n_words > 0 then n_repeat_words / n_words else 0 end),
                  least(1, case when word_chars > 0 then upper / word_chars else 0 end), least(1, case when word_chars > 0 then marks / word_chars else 0 end / 0.5)) as worst from f),
     s as (select *, floor(worst * 100 + 1e-9)::int as badness from r),
     good as (select doc_id from labels where doc_id is not null and quality is not null group by 1 having max(quality) > 0),
     h as (select lang, badness from s join good using (doc_id)),
     n as (select lang, count(*) as n, (count(*) over ()) as strata from h group by 1),
     grid as (select n.lang, n, strata, t, (select count(*) from h where h.lang is not distinct from n.lang and badness > t) as k from n, (select unnest(range(15, 100)) as t)),
     tested as (select lang, t, case when k < n * 0.02 then list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))) else 1 end <= 0.1 / strata as passes from grid),
     sound as (select lang, t from (select *, min(passes::int) over (partition by lang order by t desc) as ok from tested) where ok = 1),
     c as (select lang, min(t)::int as cutoff from sound group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and (cutoff is null or badness <= cutoff) as kept, badness, cutoff
from (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as failed from s) x left join c on x.lang is not distinct from c.lang
"""

# ---- op3: CRC-32 byte by byte over its table, which a rule gives; seeded order from md5

_SEEDED = lambda *parts: "('0x' || substr(md5(" + " || '|' || ".join(f"coalesce({p}::varchar, '')" for p in parts) + "), 1, 15))::bigint"

OP3 = f"""
with bits as (select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) as c from (select unnest(range(0, 256)) as i)),
     t as (select list(c order by i) as tab from bits),
     b as (select doc_id, source, strlen(coalesce(text, '')) + 16 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bytes from documents),
     d as (select doc_id, source, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from b, t),
     h as (select *, {_SEEDED("17", "doc_id", "source", "text_crc32")} as h, {_SEEDED("17", "source")} as hs, count(*) over () as total, count(*) over (partition by source) as n from d),
     r as (select *, row_number() over (partition by source order by h, doc_id nulls first, text_crc32, size) as rank from h),
     p as (select *, row_number() over (order by (rank - 0.5::double) / n, hs, source nulls first, h, doc_id nulls first, text_crc32, size) - 1 as place from r)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (place * 40 // total)::int as shard, (place - ((place * 40 // total) * total + 39) // 40)::bigint as slot, null::int as grown_shard, source from p
"""


# ---- op8: spans from what stands between matches; entropy of each window from its characters' counts


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """Rows (rid, start, end, kind, m): the matches of a pattern with the lengths of all that stands before them."""
    q = pattern.replace("'", "''")
    return (
        f"select rid, e - length(m) as s, e, '{kind}' as kind, m from (select rid, found[i] as m, list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + list_sum(list_transform(found[1 : i], lambda x: length(x))) as e "
        f"from (select rid, string_split_regex(text, '{q}') as gaps, regexp_extract_all(text, '{q}') as found, unnest(range(1, len(regexp_extract_all(text, '{q}')) + 1)) as i from d)) where {keep}"
    )


_ASSIGN = secrets.ASSIGN.replace("'", "''")
#: Runs of one character without a reference back, which RE2 lacks.
_RUNS = "|".join(f"[{c}]{{6,}}" if c != "-" else "-{6,}" for c in secrets.WIDE_ALPHABET)
_PASSED = secrets.PASSED.replace("(.)\\1{5,}", _RUNS)
_SHANNON = "-list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: len(list_filter(string_split(w, ''), lambda x: x = c)) / 20.0 * log2(len(list_filter(string_split(w, ''), lambda x: x = c)) / 20.0)))"

OP8 = f"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
     base as ({_spans("assign", secrets.ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 12")} union all {_spans("access", secrets.ACCESS, "length(m) >= 18")} union all {_spans("hex", secrets.HEX)}),
     cand as materialized ({_spans("entropy", secrets.CANDIDATE, "not regexp_matches(m, '" + "|".join(f"(?:{x})" for x in secrets.ALLOWED) + "')")}),
     parts as (select distinct m, regexp_full_match(m, '[0-9a-fA-F]+') as is_hex, unnest(string_split_regex(m, '{_PASSED}')) as part from cand),
     wins as (select m, is_hex, case when is_hex then lower(substr(part, i, 20)) else substr(part, i, 20) end as w from (select *, unnest(range(1, length(part) - 18)) as i from parts)),
     best as (select m from wins where {_SHANNON} >= case when is_hex then {secrets.HEX_BITS} else {secrets.WIDE_BITS} end group by 1),
     spans as (select * from base union all select cand.* from cand semi join best using (m)),
     named as (select rid, kind, s, kind || ':' || s::bigint || ':' || e::bigint as x, case kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end as r from spans),
     a as (select rid, count(*) filter (r = 0) as n_assign, count(*) filter (r = 1) as n_access, count(*) filter (r = 2) as n_hex, count(*) filter (r = 3) as n_entropy,
                  string_agg(x, ',' order by s, r) filter (r < 3) as base, string_agg(x, ',' order by s, r) as spans from named group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0)::bigint as n_entropy
from d left join a using (rid)
"""


# ---- op4: all pairs that share a shingle, and what is reachable over links

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
     sh as materialized (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as g from w)),
     n as (select doc_id, count(*) as n from sh group by 1),
     pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
     links as materialized (select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
     reach(id, root) as (select doc_id, doc_id from documents union select y, root from reach join links on id = x),
     c as (select id, min(root) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from w left join n using (doc_id) join c on id = doc_id
"""

# ---- op5: each segment and window against each template that its size allows


def _templates(t: float = licences.THRESHOLD) -> str:
    rows = []
    for i, (name, text) in enumerate(licences.TEMPLATES):
        grams = licences.bigram_set(text)
        least, most = math.ceil(t / (2 - t) * len(grams) - 1e-9), int((2 - t) / t * len(licences.bigrams(text)) + 1e-9)
        rows.append(f"('{name}', {i}, {len(grams)}, {least}, {most}, [{', '.join(repr(g) for g in sorted(grams))}])")
    return "(values " + ", ".join(rows) + ") v(name, i, n, least, most, grams)"


_NORMAL = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '')"
_GRAMS = lambda w: f"list_transform(range(1, len({w})), lambda j: {w}[j] || ' ' || {w}[j + 1])"
_MEASURED = lambda rows, more="": f"select rid, seg, max({{'dice': dice, 'n': n, 'rank': -i, 'licence': name}}) as m{more} from (select x.*, t.name, t.i, t.n, 2.0::double * len(list_intersect(g, t.grams)) / (len(g) + t.n) as dice from (select rid, seg, g{more and ', pos'} from {rows} where len(g) > 0) x, t where len(g) * 1.2 >= t.n * 0.8 - 1e-9 and len(g) * 0.8 <= t.n * 1.2 + 1e-9) where dice >= 0.8 group by rid, seg"
_RENAMED = "case " + " ".join(f"when licence = '{part}' and list_contains(names, '{whole}') then '{whole}'" for whole, part in licences.CONTAINS.items()) + " else licence end"

OP5 = f"""
with t as materialized (select * from {_templates()}),
     d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
     p as (select rid, list_concat([text], string_split_regex(text, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n'), string_split(text, chr(10)), string_split_regex(regexp_replace(text, '([.!?])[\\x20\\x09]+', '\\1' || chr(1), 'g'), '\\n|\\x01')) as ps from d),
     q as (select rid, trim(ps[k]) as seg, min(k) as pos from (select rid, ps, unnest(range(1, len(ps) + 1)) as k from p) group by 1, 2),
     s as materialized (select rid, seg, pos, list_distinct({_GRAMS('w')}) as g from (select *, {_NORMAL('seg')} as w from q)),
     cut as materialized ({_MEASURED("s", ", min(pos) as pos")}),
     w as materialized (select rid, w, {_GRAMS('w')} as g from (select rid, {_NORMAL('text')} as w from d)),
     pl as (select rid, t.*, list_filter(list_transform(range(1, len(g) + 1), lambda k: case when list_contains(t.grams, g[k]) then k - 1 end), lambda k: k is not null) as own, g from w, t where len(list_filter(g, lambda x: list_contains(t.grams, x))) >= t.least),
     st as (select *, unnest(range(1, len(own) + 1)) as j from pl),
     en as (select rid, i, n, name, least, most, own, g, j, unnest(range(j, least(len(own), j + most - 1) + 1)) as e from st where own[j + least - 1] - own[j] < most),
     sc as (select rid, i, n, own[j] as a, own[e] as b, len(list_distinct(list_transform(own[j : e], lambda k: g[k + 1]))) as seen, e - j + 1 as hits from en where own[e] - own[j] < most),
     dc as (select rid, i, n, a, b, 2.0::double * seen / (b - a + 1 - hits + seen + n) as dice from sc),
     of_start as (select rid, i, n, a, max(dice) as dice, arg_min(b, [-dice, b]) as b from dc group by 1, 2, 3, 4),
     of_template as (select rid, i, max({{'dice': dice, 'n': n, 'rank': -i, 'pos': -a, 'fin': b}}) as x from of_start where dice >= 0.8 - 1e-9 group by 1, 2),
     kept as (select rid, list_reduce(list([x] order by x desc), lambda acc, x: case when len(list_filter(acc, lambda y: -y.pos <= x[1].fin + 1 and -x[1].pos <= y.fin + 1)) > 0 then acc else list_concat(acc, x) end) as xs from of_template group by 1),
     win as (select rid, k as pos, array_to_string(w[1 - x.pos : x.fin + 2], ' ') as seg from (select rid, unnest(xs) as x, unnest(range(1, len(xs) + 1)) as k from kept) join w using (rid)),
     wg as (select rid, seg, pos, list_distinct({_GRAMS('w')}) as g from (select *, {_NORMAL('seg')} as w from win)),
     wm as ({_MEASURED("wg", ", min(pos) as pos")}),
     also as (select * from wm where not exists (select 1 from cut where cut.rid = wm.rid and cut.m.licence = wm.m.licence and cut.m.dice >= wm.m.dice)),
     f as (select rid, 0 as part, pos, m.dice as dice, m.n as n, m.rank as rank, m.licence as licence from cut union all select rid, 1, pos, m.dice, m.n, m.rank, m.licence from also),
     o as (select f.* replace ({_RENAMED} as licence) from f join (select rid, list(licence) as names from f group by 1) using (rid)),
     a as (select rid, max({{'dice': dice, 'n': n, 'rank': rank, 'licence': licence}}) as top, count(*) as n, string_agg(licence || ':' || round(dice, 6)::varchar, ',' order by part, pos) as matches from o group by 1)
select doc_id, top.licence as licence, round(top.dice, 6) as dice, coalesce(n, 0)::bigint as n_matches, coalesce(matches, '') as matches from d left join a using (rid)
"""


# ---- op11: three rounds and a last assignment, written out


def _clusters() -> str:
    from .clustering import CENTROIDS, DIMS, ROUNDS, SCALE, SEED

    near = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::bigint"
    steps = [
        f"v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS})",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, q) - 1 as k, q as c from v qualify k < {CENTROIDS})",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} as materialized (select rid, vec_id, q, k, d from (select rid, vec_id, q, k, {near} as d from v, c{t}) qualify row_number() over (partition by rid order by d, k) = 1)")
        if t < ROUNDS:
            steps.append(f"s{t} as (select k, i, sum(q[i])::bigint as s, count(*) as n from (select k, q, unnest(range(1, {DIMS + 1})) as i from a{t}) group by k, i)")
            steps.append(f"m{t} as (select k, list((s - ((s % n) + n) % n) // n order by i) as c from s{t} group by k)")
            steps.append(f"c{t + 1} as materialized (select k, coalesce(m{t}.c, c{t}.c) as c from c{t} left join m{t} using (k))")
    last = f"a{ROUNDS}"
    return "with " + ", ".join(steps) + (
        f" select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from {last} join c{ROUNDS} using (k)"
    )


OP11 = _clusters()


# ---- op12: level by level, up to 3 ** 8 leaves a tree


def _crc_even() -> str:
    """The lowest bit of a CRC-32 of decimal digits, from the table that a rule gives."""
    return "(select list(c order by i) as tab from (select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) as c from (select unnest(range(0, 256)) as i)))"


def _trees(depth: int = 8) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    steps = [
        f"tab as materialized {_crc_even()}",
        f"""l0 as materialized (select rid, doc_id, source, leaf, tampered, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from (
        select row_number() over () as rid, doc_id, source, {row("text")} as leaf, case when doc_id is not null and xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 2 = 0 then {row("replace(text, chr(10), '')")} end as tampered from documents, tab))""",
        "n0 as materialized (select source as tree, pos, leaf as node from l0)",
    ]

    def grown(a: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            out.append(f"{a}s{k} as (select tree, count(*) as size from {a}{k} group by tree)")
            out.append(f"{a}{k + 1} as materialized (select x.tree, case when size > 1 then pos // 3 else pos end as pos, case when any_value(size) > 1 then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node from {a}{k} x join {a}s{k} y on x.tree is not distinct from y.tree group by x.tree, case when size > 1 then pos // 3 else pos end)")
        return out

    def path(a: str, base: str, n: int) -> list[str]:
        out = [f"{a}p0 as (select *, '' as sib, tampered_or as fold from {base})"]
        for k in range(n):
            other = lambda c: f"coalesce((select string_agg(node, '' order by o.pos) from {a}{k} o where o.tree is not distinct from p.tree and o.pos // 3 = p.slot // 3 and {c}), '')"
            out.append(f"{a}q{k} as materialized (select p.*, size, {other('o.pos < p.slot')} as lt, {other('o.pos > p.slot')} as rt from {a}p{k} p join {a}s{k} y on p.tree is not distinct from y.tree)")
            out.append(f"{a}p{k + 1} as materialized (select rid, doc_id, source, leaf, tree, case when size > 1 then slot // 3 else slot end as slot, case when size > 1 then sib || lt || rt else sib end as sib, case when size > 1 then sha256(lt || fold || rt) else fold end as fold from {a}q{k})")
        return out

    steps += grown("n", depth)
    steps.append(f"m0 as materialized (select 0 as tree, row_number() over (order by tree nulls first) - 1 as pos, node, tree as source from n{depth})")
    steps += grown("m", depth)
    steps.append("b0 as (select rid, doc_id, source, leaf, source as tree, pos as slot, coalesce(tampered, leaf) as tampered_or from l0)")
    steps += path("n", "b0", depth)
    steps.append(f"b1 as (select rid, doc_id, p.source, leaf, 0 as tree, m.pos as slot, fold as tampered_or, p.sib as below, m.node as subroot from np{depth} p join m0 m on p.source is not distinct from m.source)")
    steps += path("m", "(select rid, doc_id, source, leaf, tree, slot, tampered_or from b1)", depth)
    return "with " + ", ".join(steps) + (
        f" select p.doc_id, p.leaf, b1.subroot, r.node as root, sha256(b1.below || p.sib) as proof_sha256, p.fold as folded_root, p.fold = r.node as verified, p.source from mp{depth} p join b1 using (rid), m{depth} r"
    )


OP12 = _trees()


# ---- op13: all windows as bytes; the least doc_id of each; runs of covered bytes

OP13 = """
with d as materialized (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as h, strlen(coalesce(text, ''))::bigint as n from documents),
     w as (select rid, doc_id, i, h[i + 1 : i + 50] as s from (select *, unnest(range(0, n - 49)) as i from d)),
     f as (select s, min(doc_id) as least from w group by 1 having min(doc_id) < max(doc_id)),
     c as (select rid, i from w join f using (s) where least < doc_id),
     e as (select *, case when i <= lag(i) over (partition by rid order by i) + 50 then 0 else 1 end as new from c),
     r as (select *, sum(new) over (partition by rid order by i) as k from e),
     s as (select rid, k, min(i) as a, max(i) + 50 as b from r group by 1, 2),
     g as (select rid, a, b, lag(b, 1, 0) over (partition by rid order by a) as p from s),
     t as (select rid, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, max(b) as last, string_agg(hex(h[p + 1 : a]), '' order by a) as kept from g join d using (rid) group by 1)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(unhex(kept || hex(h[last + 1 : n])), h)) as kept_sha256
from d left join t using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1, "op3_stratified_shards": OP3, "op4_superminhash": OP4, "op5_licence_dice": OP5, "op7_warc_members": OP7, "op8_entropy_secrets": OP8, "op10_winnowing": OP10,
        "op11_delta_lloyd": OP11, "op12_merkle_manifest": OP12, "op13_radix_suffixes": OP13,
    }
