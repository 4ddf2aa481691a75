"""Identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import identity
from ..plans import pit
from .pit import AS_OF, MASKED

SEEN = """sets as (select cik, snapshot_date, list(distinct ticker) as now from [listings] group by 1, 2), numbered as (select snapshot_date, row_number() over (order by snapshot_date) as no from (select distinct snapshot_date from [listings]) x),
    st as (select s.*, lag(now) over w as was, lag(s.snapshot_date) over w as lower, n.no - lag(n.no) over w - 1 as away from sets s join numbered n using (snapshot_date) window w as (partition by cik order by snapshot_date)),
    df as (select cik, snapshot_date as "date", lower as date_lower, list_filter(was, lambda x: not list_contains(now, x)) as gone, list_filter(now, lambda x: not list_contains(was, x)) as came, away from st where was is not null),
    seen as (select gone[1] as old_symbol, came[1] as new_symbol, "date", date_lower from df where len(gone) = 1 and len(came) = 1 and away <= 2
        and not exists (select 1 from [listings] x where x.cik = df.cik and x.ticker = gone[1] and x.snapshot_date > df."date") and not exists (select 1 from [listings] x where x.cik = df.cik and x.ticker = came[1] and x.snapshot_date < df.date_lower))"""


def listed(w: World):
    return identity.listing_edges(w.listings)


@query("edges_from_listings", f"with {SEEN} select * from seen")
def edges_from_listings(w: World):
    return listed(w)


@query("edges_merge", f"""with {SEEN}, ex as (select old_symbol, new_symbol, min(process_date) as e from [renames] group by 1, 2), sn as (select old_symbol, new_symbol, max("date") as s, max(date_lower) as l from seen group by 1, 2),
    b as (select old_symbol, new_symbol, ex.e, sn.s, sn.l from ex full outer join sn using (old_symbol, new_symbol)),
    m as (select b.*, (select max(x.e) from ex x where x.new_symbol in (b.old_symbol, b.new_symbol) and x.e <= b.s and date_diff('day', x.e, b.s) <= 183) as moved from b)
    select old_symbol, new_symbol, coalesce(e, moved, s) as "date", case when e is null and moved is null then l end as date_lower, case when e is null then 'listing' when s is null then 'exact' else 'both' end as evidence from m""")
def edges_merge(w: World):
    exact = w.renames.select("old_symbol", "new_symbol", F.col("process_date").alias("date"))
    return identity.merged_edges(exact, listed(w))


@query("components", "with recursive e as (select old_symbol as u, new_symbol as v from [renames] where old_symbol < 'S5' union select new_symbol, old_symbol from [renames] where old_symbol < 'S5'), r as (select u as node, u as other from e union select r.node, e.v from r join e on e.u = r.other) select node, min(other) as component from r group by node")
def components(w: World):
    return identity.components(w.renames.filter("old_symbol < 'S5'"), "old_symbol", "new_symbol")


@query("cik_switches", "with s as (select ticker, snapshot_date, list(distinct cik) as now from [listings] group by 1, 2), l as (select *, lag(now) over w as was, lag(snapshot_date) over w as lower from s window w as (partition by ticker order by snapshot_date)) select ticker, snapshot_date as \"day\", lower from l where was is not null and not list_has_any(now, was)")
def cik_switches(w: World):
    return identity.switches(w.listings)


@query("mass_corrections", "with s as (select ticker, snapshot_date, list(distinct cik) as now from [listings] group by 1, 2), l as (select *, lag(now) over w as was from s window w as (partition by ticker order by snapshot_date)) select snapshot_date as \"day\", count(*) as n from l where was is not null and not list_has_any(now, was) group by 1 having count(*) >= 1")
def mass_corrections(w: World):
    return identity.mass_corrections(identity.switches(w.listings), 1)


@query("symbol_windows", "with s as (select snapshot_date, lag(snapshot_date) over (order by snapshot_date) as b, lead(snapshot_date) over (order by snapshot_date) as a from (select distinct snapshot_date from [snapshots]) x), t as (select ticker, min(snapshot_date) as lo, max(snapshot_date) as hi from [snapshots] group by 1) select ticker, x.b as start, y.a as \"end\" from t join s x on x.snapshot_date = lo join s y on y.snapshot_date = hi")
def symbol_windows(w: World):
    return identity.symbol_windows(w.snapshots)


@query("otc_only", "select ticker from (select concat(ticker, snapshot_date) as ticker, exchange from [snapshots]) x group by ticker having count(*) filter (where exchange <> 'OTC') = 0")
def otc_only(w: World):
    return identity.only_over_the_counter(w.snapshots.withColumn("ticker", F.concat("ticker", F.col("snapshot_date").cast("string"))))


@query("spelling", "with l as (select distinct cik, case when c_custkey % 2 = 0 then concat('S.', c_custkey % 20) else concat('S', c_custkey % 20) end as ticker from (select *, c_custkey % 10 as cik from customer) x), f as (select *, replace(ticker, '.', '') as k, ticker in (select concat('S', s_suppkey) from supplier where s_suppkey % 2 = 0) as held from l), n as (select *, count(*) filter (where held) over (partition by cik, k) as many from f) select cik, ticker from (select *, row_number() over (partition by cik, k order by case when many = 1 and held then 0 else 1 end, not contains(ticker, '.'), ticker) as place from n) y where place = 1")
def spelling(w: World):
    ticker = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("S."), (F.col("c_custkey") % 20).cast("string"))).otherwise(F.concat(F.lit("S"), (F.col("c_custkey") % 20).cast("string")))
    listings = w.customer.select((F.col("c_custkey") % 10).alias("cik"), ticker.alias("ticker")).distinct()
    stored = w.supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    return identity.normal_spelling(listings, stored).select("cik", "ticker").distinct()


@query("first_match_classify", "select p_partkey, case when p_type like '%BRASS%' then 'etf' when p_size > 40 then 'leveraged_etf' when p_brand like '%3' then 'common' else 'unknown' end as class, case when p_type like '%BRASS%' then 'name_brass' when p_size > 40 then 'large' when p_brand like '%3' then 'brand' else 'none' end as rule from part")
def first_match_classify(w: World):
    rules = [("name_brass", "etf", F.col("p_type").rlike("BRASS")), ("large", "leveraged_etf", F.col("p_size") > 40), ("brand", "common", F.col("p_brand").rlike("3$"))]
    return identity.first_match(w.part, rules).select("p_partkey", "class", "rule")


CHAINED = "ch as (select concat('C', o_custkey) as security_id, concat('S', o_orderkey) as symbol, cast(o_orderdate as date) as valid_from, case when o_orderkey % 3 = 0 then 'unknown' when o_custkey % 5 = 0 then 'etf' when o_orderkey % 7 = 0 then 'etf' else 'common' end as class, 'pattern' as rule from orders)"


def chain(w: World):
    cls = F.when(F.col("o_orderkey") % 3 == 0, "unknown").when(F.col("o_custkey") % 5 == 0, "etf").when(F.col("o_orderkey") % 7 == 0, "etf").otherwise("common")
    return w.orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("security_id"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("valid_from"), cls.alias("class"), F.lit("pattern").alias("rule"))


@query("inherit_later", f"with {CHAINED}, i as (select a.*, (select list(distinct b.class) from ch b where b.security_id = a.security_id and b.valid_from > a.valid_from and b.class <> 'unknown') as later from ch a) select security_id, symbol, valid_from, case when class = 'unknown' and len(later) = 1 then later[1] else class end as class, case when class = 'unknown' and len(later) = 1 then 'inherited' else rule end as rule from i")
def inherit_later(w: World):
    return identity.inherited(chain(w))


@query("canonical_name", f"with {MASKED} select security_id, arg_min(concat(symbol, '@', valid_from), (valid_from, symbol)) as name from masked group by security_id")
def canonical_name(w: World):
    return identity.canonical_names(pit.masked_segments(w.segments, AS_OF))


@query("stable_ids", "with f as (select security_id, min((valid_from, symbol)) as f from [segments] group by 1), n as (select security_id, concat('S', lpad(cast(row_number() over (order by f, security_id) as varchar), 6, '0')) as security_no from f) select s.symbol, s.valid_from, n.security_no from [segments] s join n using (security_id)")
def stable_ids(w: World):
    return identity.stable_ids(w.segments, "security_id").select("symbol", "valid_from", "security_no")


@query("chain_filer", """select security_id, symbol, valid_from, cik, cik_was is null and cik is not null as filled from (select a.security_id, a.symbol, a.valid_from, a.cik as cik_was, coalesce(a.cik, b.cik) as cik, row_number() over (partition by a.security_id, a.symbol, a.valid_from order by abs(date_diff('day', b.valid_from, a.valid_from)) nulls last, b.valid_from, b.cik) as place
    from [segments] a left join [segments] b on a.cik is null and b.cik is not null and b.security_id = a.security_id and b.cik_available_at <= a.available_at) x where place = 1""")
def chain_filer(w: World):
    return identity.chain_filer(w.segments).select("security_id", "symbol", "valid_from", "cik", "filled")


#: A rebuild that knows some segments, ends and filers otherwise.
REBUILT = "rb as (select case when k % 13 = 1 then 'Z' else security_id end as security_id, symbol, case when k % 17 = 2 and valid_to is null then cast(valid_from + 3 as date) else valid_from end as valid_from, case when k % 19 = 3 then cast(valid_to - 5 as date) else valid_to end as valid_to, case when k % 11 = 4 then null else cik end as cik, case when k % 11 = 4 then null else cik_available_at end as cik_available_at, available_at, end_available_at from [segments] where k % 23 <> 5)"


def rebuilt(w: World):
    k, c = F.col("k"), F.col
    return w.segments.filter("k % 23 <> 5").select(
        F.when(k % 13 == 1, "Z").otherwise(c("security_id")).alias("security_id"), "symbol", F.when((k % 17 == 2) & c("valid_to").isNull(), F.date_add("valid_from", 3)).otherwise(c("valid_from")).alias("valid_from"),
        F.when(k % 19 == 3, F.date_sub("valid_to", 5)).otherwise(c("valid_to")).alias("valid_to"), F.when(k % 11 != 4, c("cik")).alias("cik"), F.when(k % 11 != 4, c("cik_available_at")).alias("cik_available_at"), "available_at", "end_available_at",
    )


def _mask(source: str) -> str:
    at = f"timestamp '{AS_OF}'"
    return f"(select symbol, valid_from, security_id, case when end_available_at <= {at} then valid_to end as valid_to, case when cik_available_at <= {at} then cik end as cik, case when cik_available_at <= {at} then cik_available_at end as cik_available_at from {source} where available_at <= {at})"


@query("truncation_diff", f"""with {REBUILT}, f as (select *, true as has from {_mask('[segments]')} x), t as (select *, true as has from {_mask('rb')} y), b as (select symbol, valid_from, f.has as fh, t.has as th, f.security_id as fs, t.security_id as ts, f.valid_to as fv, t.valid_to as tv, f.cik as fc, t.cik as tc, f.cik_available_at as fk, t.cik_available_at as tk,
        concat_ws('+', case when f.cik is distinct from t.cik then 'cik' end, case when f.cik_available_at is distinct from t.cik_available_at then 'cik_available_at' end, case when f.security_id is distinct from t.security_id then 'security_id' end, case when f.valid_to is distinct from t.valid_to then 'valid_to' end) as fields from f full outer join t using (symbol, valid_from)),
    c as (select *, exists (select 1 from f where f.symbol = b.symbol and f.valid_from < coalesce(b.tv, date '9999-12-31') and b.valid_from < coalesce(f.valid_to, date '9999-12-31')) as hit, fs is not distinct from ts and fv is not distinct from tv and (fc is null or (fc = tc and fk > tk)) as held from b)
    select symbol, valid_from, kind, reason, case when fh and th then fields else '' end as fields from (select *, case when th is null then 'leak' when fh is null then case when hit then 'leak' else 'delay' end when fields = '' then null when held then 'delay' else 'leak' end as kind,
        case when th is null then 'only_in_full' when fh is null then case when hit then 'replaced' else 'only_in_rebuild' end when held then 'cik_withheld' else 'fields_differ' end as reason from c) z where kind is not null""")
def truncation_diff(w: World):
    return identity.truncation_diff(w.segments, rebuilt(w), AS_OF)


@query("cell_impact", f"""with {REBUILT}, f as (select * from {_mask('[segments]')} x), t as (select * from {_mask('rb')} y), o as (select b.symbol, b.session_date, coalesce((select string_agg(distinct security_id, '+' order by security_id) from f where f.symbol = b.symbol and b.session_date >= f.valid_from and b.session_date < coalesce(f.valid_to, date '9999-12-31')), '') as full_owner,
    coalesce((select string_agg(distinct security_id, '+' order by security_id) from t where t.symbol = b.symbol and b.session_date >= t.valid_from and b.session_date < coalesce(t.valid_to, date '9999-12-31')), '') as rebuilt_owner from [bars] b)
    select symbol, full_owner, rebuilt_owner, min(session_date) as first, max(session_date) as last, count(*) as days from o where full_owner <> rebuilt_owner group by 1, 2, 3""")
def cell_impact(w: World):
    return identity.cell_impact(w.bars, w.segments, rebuilt(w), AS_OF)
