"""Supporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import supporting as sup


@query("weekday_index", "select d as session_date, row_number() over (order by d) as idx from (select cast(unnest(generate_series((select min(session_date) from [bars] where volume > 0), (select max(session_date) from [bars] where volume > 0), interval 1 day)) as date) as d) x where isodow(d) < 6")
def weekday_index(w: World):
    return sup.weekday_index(w.bars)


@query("masked_at_instants", "select i as as_of, security_id, symbol, valid_from, case when end_available_at <= i then valid_to end as valid_to, case when cik_available_at <= i then cik end as cik from [segments], (select unnest([timestamp '1996-01-01', timestamp '1998-01-25', timestamp '1999-01-01']) as i) t where available_at <= i")
def masked_at_instants(w: World):
    return sup.masked_at(w.segments, ["1996-01-01 00:00:00", "1998-01-25 00:00:00", "1999-01-01 00:00:00"])


@query("default_instants", "select distinct available_at - interval 1 microsecond as instant from (select form, available_at, row_number() over (partition by form order by available_at) as r, count(*) over (partition by form) as n from [facts]) x where r = 1 or r = n or r = (n + 1) // 2")
def default_instants(w: World):
    return sup.default_instants(w.facts, "form")


@query("instants_fingerprint", "select form, substr(sha256(string_agg(accn, ',' order by accn)), 1, 16) as print from [facts] group by form")
def instants_fingerprint(w: World):
    return w.facts.groupBy("form").agg(sup.fingerprint(F.collect_list("accn")).alias("print"))


@query("impact_ratchet", "with a as (select symbol, count(*) as n from [splits] where kind = 'forward_split' group by 1), b as (select symbol, count(*) as n from [splits] where factor > 1 group by 1) select symbol, a.n as was, b.n as now, case when a.n is null then 'new' when b.n is null then 'gone' when b.n > a.n then 'worse' when b.n < a.n then 'better' else 'same' end as verdict from a full outer join b using (symbol)")
def impact_ratchet(w: World):
    count = lambda df: df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return sup.ratchet(count(w.splits.filter("kind = 'forward_split'")), count(w.splits.filter("factor > 1")), "symbol", "n")


@query("merged_ids", "with o as (select greatest(old_symbol, new_symbol) as s, min(least(old_symbol, new_symbol)) as t from [renames] group by 1) select b.symbol, coalesce(o.t, b.symbol) as security_id, count(*) as bars from [bars] b left join o on o.s = b.symbol group by 1, 2")
def merged_ids(w: World):
    rows = w.bars.select("symbol", F.col("symbol").alias("security_id"))
    made = sup.merged_ids(rows, w.renames.select(F.col("old_symbol").alias("first"), F.col("new_symbol").alias("second")))
    return made.groupBy("symbol", "security_id").agg(F.count(F.lit(1)).alias("bars"))


def _overrides(w: World):
    return w.classes.filter("name_source = 'sec'").select("symbol", "valid_from", F.lit("common").alias("class"), F.when(F.col("class") == "etf", "etf").otherwise("never").alias("expected"))


OVER = "ov as (select symbol, valid_from, case when class = 'etf' then 'etf' else 'never' end as expected from [classes] where name_source = 'sec')"


@query("class_overrides", f"with {OVER} select c.security_id, c.symbol, c.valid_from, case when exists (select 1 from ov where ov.symbol = c.symbol and ov.valid_from = c.valid_from and ov.expected = c.class) then 'common' else c.class end as class from [classes] c where c.name_source <> 'none'")
def class_overrides(w: World):
    c = w.classes.filter("name_source <> 'none'")
    return sup.overridden_classes(c, _overrides(w))[0].select("security_id", "symbol", "valid_from", "class")


@query("stale_class_overrides", f"with {OVER} select symbol, valid_from, 'common' as class, expected from ov where not exists (select 1 from [classes] c where c.symbol = ov.symbol and c.valid_from = ov.valid_from and c.class = ov.expected)")
def stale_class_overrides(w: World):
    return sup.overridden_classes(w.classes, _overrides(w))[1]


@query("era_names", """with n as (select ticker as symbol, concat(name, '/', cik) as name, snapshot_date as "day", 0 as r, 'listing' as src from [snapshots] where snapshot_date < date '1997-01-01' and exchange = 'NYSE' union all select symbol, name, valid_from, 1, 'class' from [classes] where rule = 'pattern'),
    x as (select s.security_id, s.symbol, s.valid_from, n.name, n.src, row_number() over (partition by s.security_id, s.symbol, s.valid_from order by (n."day" >= s.valid_from and n."day" < coalesce(s.valid_to, date '9999-12-31')) desc, n.r, n."day" desc, n.name) as place from [segments] s join n on n.symbol = s.symbol)
    select s.security_id, s.symbol, s.valid_from, s.valid_to, x.name, coalesce(x.src, 'none') as name_source from [segments] s left join x on x.security_id = s.security_id and x.symbol = s.symbol and x.valid_from = s.valid_from and x.place = 1""")
def era_names(w: World):
    a = w.snapshots.filter("snapshot_date < date'1997-01-01' and exchange = 'NYSE'").select(F.col("ticker").alias("symbol"), F.concat("name", F.lit("/"), F.col("cik").cast("string")).alias("name"), F.col("snapshot_date").alias("day"))
    b = w.classes.filter("rule = 'pattern'").select("symbol", "name", F.col("valid_from").alias("day"))
    return sup.era_names(w.segments, [("listing", a), ("class", b)])


@query("spelling_since", "with r as (select distinct cik, snapshot_date, case when exchange = 'NYSE' and snapshot_date < date '1997-01-01' then concat('S.', substr(ticker, 2)) else ticker end as ticker from [snapshots]), m as (select distinct cik, replace(ticker, '.', '') as l from r where contains(ticker, '.')) select r.ticker, r.cik, min(r.snapshot_date) as since from r join m on m.cik = r.cik and m.l = r.ticker where not contains(r.ticker, '.') group by 1, 2")
def spelling_since(w: World):
    early = (F.col("exchange") == "NYSE") & (F.col("snapshot_date") < F.lit("1997-01-01").cast("date"))
    raw = w.snapshots.select("cik", "snapshot_date", F.when(early, F.concat(F.lit("S."), F.expr("substr(ticker, 2)"))).otherwise(F.col("ticker")).alias("ticker")).distinct()
    return sup.spelling_since(raw, w.snapshots.select("cik", "ticker").distinct())


@query("known_with", "with recursive n as (select l_orderkey as id, l_orderkey // 3 as parent from lineitem where l_orderkey > 0 group by 1, 2), r as (select id, parent as up from n union select r.id, n.parent from r join n on n.id = r.up) select f.o_orderkey as id, greatest(f.o_orderdate, coalesce(max(u.o_orderdate), f.o_orderdate)) as known from orders f left join r on r.id = f.o_orderkey left join orders u on u.o_orderkey = r.up group by f.o_orderkey, f.o_orderdate")
def known_with(w: World):
    facts = w.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("known"))
    needs = w.lineitem.filter("l_orderkey > 0").select(F.col("l_orderkey").alias("id"), F.floor(F.col("l_orderkey") / 3).alias("on")).distinct()
    return sup.known_with(facts, needs)


@query("issuer_shelves", "select cik, count(distinct ticker) as tickers from [snapshots] group by cik having count(distinct ticker) >= 2")
def issuer_shelves(w: World):
    return sup.issuer_shelves(w.snapshots, 2)


@query("fifth_letter", "with t as (select distinct cik % 2 as cik, ticker from [snapshots]) select a.cik, a.ticker, b.ticker as base, right(a.ticker, 1) as letter from t a join t b on a.cik = b.cik and length(a.ticker) = length(b.ticker) + 1 and starts_with(a.ticker, b.ticker)")
def fifth_letter(w: World):
    return sup.fifth_letter(w.snapshots.select((F.col("cik") % 2).alias("cik"), "ticker"))


@query("registry_overlaps", "select symbol, start, \"end\", next_start from (select symbol, ex_date as start, cast(ex_date + 200 as date) as \"end\", lead(ex_date) over (partition by symbol order by ex_date) as next_start from (select distinct symbol, ex_date from [splits]) d) x where next_start <= \"end\"")
def registry_overlaps(w: World):
    rows = w.splits.select("symbol", F.col("ex_date").alias("start")).distinct().withColumn("end", F.date_add("start", 200))
    return sup.registry_overlaps(rows)


@query("child_sale", "with c as (select distinct child_symbol as symbol, ex_date as known_on from [spinoffs]) select c.symbol, c.known_on, coalesce(arg_min(b.open, b.session_date) filter (where b.session_date > known_on), arg_max(b.close, b.session_date) filter (where b.session_date <= known_on)) as price from c left join [bars] b on b.symbol = c.symbol and b.volume > 0 group by 1, 2")
def child_sale(w: World):
    return sup.child_sale(w.spinoffs.select(F.col("child_symbol").alias("symbol"), F.col("ex_date").alias("known_on")).distinct(), w.bars)


@query("parameter_grid", "select zone, hold from (select unnest([0.25, 0.5, 0.75]::double[]) as zone) a, (select unnest([5, 10, 20]::double[]) as hold) b")
def parameter_grid(w: World):
    return sup.parameter_grid({"zone": (0.25, 0.5, 0.75), "hold": (5, 10, 20)}, w.spark)


@query("closes_of_run", "select security_id, max(session_date) as session_date from [trades] where run_id = 7 and exit_at <= timestamp '2024-01-20' group by security_id")
def closes_of_run(w: World):
    return w.trades.filter("run_id = 7 and exit_at <= timestamp_ntz'2024-01-20 00:00:00'").groupBy("security_id").agg(F.max("session_date").alias("session_date"))


@query("excursions", "select run_id, median(pnl) as pnl, median(r_multiple) as r, count(*) filter (where leg = 2) as second_legs from [trades] group by run_id")
def excursions(w: World):
    return w.trades.groupBy("run_id").agg(F.median("pnl").alias("pnl"), F.median("r_multiple").alias("r"), F.count_if(F.col("leg") == 2).alias("second_legs"))


@query("repeated_rows", "select security_id, session_date, count(*) as rows from (select concat('X', k % 50) as security_id, session_date from [bars]) x group by 1, 2 having count(*) > 1")
def repeated_rows(w: World):
    rows = w.bars.select(F.concat(F.lit("X"), (F.col("k") % 50).cast("string")).alias("security_id"), "session_date")
    return sup.repeated_rows(rows, ["security_id", "session_date"])


@query("splits_after_import", "select distinct s.symbol, s.ex_date from [splits] s join (select symbol, min(session_date) as start from [imported] group by symbol) i using (symbol) where s.ex_date > i.start")
def splits_after_import(w: World):
    return sup.splits_after(w.splits, w.imported.groupBy("symbol").agg(F.min("session_date").alias("start")))


@query("request_windows", "select ticker as symbol, min(snapshot_date) as start from [snapshots] where ticker not in (select symbol from [bars] where k % 2 = 0) group by ticker")
def request_windows(w: World):
    seen = w.snapshots.groupBy(F.col("ticker").alias("symbol")).agg(F.min("snapshot_date").alias("start"))
    return sup.request_windows(seen, w.bars.filter("k % 2 = 0").select("symbol"))
