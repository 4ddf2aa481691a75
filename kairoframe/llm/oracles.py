"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .common import LOWER, UPPER, WORD
from .secret_scan import BASE_RULES, RULES

WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def _secrets() -> str:
    parts = []
    for i, (_, pattern, group, least, _) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"select doc_id, {i} as kind, {least} as least, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {group}) as c, string_split_regex(t, {p}) as g from d")
    name = "case kind " + " ".join(f"when {i} then '{r[0]}'" for i, r in enumerate(RULES)) + " end"
    span = f"concat({name}, ':', start, ':', stop)"
    base = len(BASE_RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), k as ({' union all '.join(parts)}),
        s as (select *, unnest(range(1, len(m) + 1)) as i from k where len(m) > 0),
        x as (select doc_id, kind, least, length(c[i]) as counted, length(m[i]) as n, cast(coalesce(list_sum(list_transform(g[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as bigint) as start from s),
        y as (select doc_id, kind, start, start + n as stop from x where counted >= least)
        select d.doc_id, {', '.join(f"count(*) filter (where kind = {i}) as n_{r[0]}" for i, r in enumerate(BASE_RULES))},
            sha256(coalesce(string_agg({span}, ',' order by start, kind) filter (where kind < {base}), '')) as base_sha256, coalesce(string_agg({span}, ',' order by start, kind) filter (where kind is not null), '') as spans
        from d left join y using (doc_id) group by d.doc_id"""


def _mixing(seed: int = 17, limit: float = 1.25) -> str:
    key = f"md5(concat_ws(':', '{seed}', source, {{0}}, doc_id))"
    return f"""with c as (select doc_id, coalesce(source, '') as source, len({WORDS}) as tokens from documents), t as (select source, sum(tokens)::bigint as total from c group by source),
        p as (select source, total, total / cast((select sum(total) from t) as double) as p from t where total > 0),
        a as (select round(greatest(0, 1 - ln({limit} * (1 + 1e-12)) / ln(max(p) / min(p))), 9) as a from p), w as (select *, pow(p, (select a from a)) as w from p), z as (select sum(w) as z, max(p / w) as most from w),
        q as (select source, total, greatest(total, cast(floor(w / z.z * ((select sum(total) from t) * z.most * z.z) + 1e-6) as bigint)) as quota from w, z),
        b as (select t.source, case when t.total > 0 then quota // t.total else 1 end as whole, case when t.total > 0 then quota - quota // t.total * t.total else 0 end as rest from t left join q using (source)),
        k as (select c.*, b.whole, b.rest, {key.format('b.whole')} as key from c join b using (source)), s as (select *, sum(tokens) over (partition by source order by key) as upto from k),
        u as (select *, unnest(range(0, whole + case when rest > 0 and upto <= rest then 1 else 0 end)) as block from s)
        select doc_id, source, block, {key.format('block')} as block_key, tokens from u"""


def _join() -> str:
    return f"""with recursive w as (select doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        r as (select doc_id as node, doc_id as other from n union select r.node, l.b from r join l on l.a = r.other), c as (select node, min(other) as component_id from r group by node)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, w.doc_id) as component_id from w left join n on n.doc_id = w.doc_id left join c on c.node = w.doc_id"""


def _chat() -> str:
    return """with e as (select conv_id, max(turn) as last, arg_max(text, turn) as last_text from conversations group by conv_id),
        t as (select c.conv_id, c.turn, c.role, c.text as a, case when c.turn = e.last then coalesce(o.last_text, '') else c.text end as b from conversations c join e on e.conv_id = c.conv_id left join e o on o.conv_id = xor(c.conv_id, 1)),
        s as (select *, concat('<|im_start|>', role, chr(10), a, '<|im_end|>', chr(10)) as sa, concat('<|im_start|>', role, chr(10), b, '<|im_end|>', chr(10)) as sb, min(case when a <> b then turn end) over (partition by conv_id) as apart from t),
        f as (select *, coalesce(turn < apart, true) as common from s),
        g as (select *, sum(length(sa)) over (partition by conv_id, common order by turn) - length(sa) as oa, sum(length(sb)) over (partition by conv_id, common order by turn) - length(sb) as ob from f)
        select conv_id, coalesce(string_agg(sa, '' order by turn) filter (where common), '') as prompt, coalesce(string_agg(sa, '' order by turn) filter (where not common), '') as chosen, coalesce(string_agg(sb, '' order by turn) filter (where not common), '') as rejected,
            coalesce(string_agg(concat(oa + 22, ':', oa + length(sa) - 1), ',' order by turn) filter (where not common and role = 'assistant'), '') as chosen_mask,
            coalesce(string_agg(concat(ob + 22, ':', ob + length(sb) - 1), ',' order by turn) filter (where not common and role = 'assistant'), '') as rejected_mask, count(*) filter (where common) as prompt_turns
        from g group by conv_id"""


ORACLES = {"op4_mixing": _mixing(), "op5_jaccard_join": _join(), "op6_secret_scan": _secrets(), "op10_chat_format": _chat()}
