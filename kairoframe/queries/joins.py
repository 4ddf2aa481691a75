"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import aggregates, joins
from ..plans import pit
from .pit import AS_OF, EVENTS, MASKED, RESOLVED, VISIBLE_DOCS, DOC_AT, resolved


@query("validity_join", f"with {MASKED} select b.symbol, b.session_date, m.security_id, m.cik from [bars] b join masked m on m.symbol = b.symbol and b.session_date >= m.valid_from and (m.valid_to is null or b.session_date < m.valid_to)")
def validity_join(w: World):
    return pit.owned(w.bars, pit.masked_segments(w.segments, AS_OF), columns=("security_id", "cik")).select("symbol", "session_date", "security_id", "cik")


@query("split_day_join", f"with {EVENTS} select b.symbol, b.session_date, e.symbol is not null as split_day from [bars] b left join (select distinct symbol, ex_date from events_known) e on e.symbol = b.symbol and e.ex_date = b.session_date")
def split_day_join(w: World):
    days = pit.splits_as_of(w.splits, AS_OF).select("symbol", F.col("ex_date").alias("session_date"), F.lit(True).alias("x")).distinct()
    return w.bars.select("symbol", "session_date").join(days, ["symbol", "session_date"], "left").select("symbol", "session_date", F.coalesce("x", F.lit(False)).alias("split_day"))


@query("as_of_backward", "with m as (select b.symbol, b.session_date, (select max(ex_date) from [splits] s where s.symbol = b.symbol and s.ex_date <= b.session_date) as ex_date from (select distinct symbol, session_date from [bars]) b) select m.*, (select max(new_rate) from [splits] s where s.symbol = m.symbol and s.ex_date = m.ex_date) as new_rate from m")
def as_of_backward(w: World):
    right = w.splits.groupBy("symbol", "ex_date").agg(F.max("new_rate").alias("new_rate"))
    return joins.as_of_backward(w.bars.select("symbol", "session_date").distinct(), right, "symbol", "session_date", "ex_date", ["ex_date", "new_rate"])


@query("as_of_forward", "with m as (select e.symbol, e.ex_date, (select min(session_date) from [bars] b where b.symbol = e.symbol and b.session_date >= e.ex_date) as session_date from (select distinct symbol, ex_date from [dividends]) e) select m.*, b.close from m left join [bars] b on b.symbol = m.symbol and b.session_date = m.session_date")
def as_of_forward(w: World):
    return joins.as_of_forward(w.dividends.select("symbol", "ex_date").distinct(), w.bars, "symbol", "ex_date", "session_date", ["session_date", "close"])


@query("as_of_forward_strict", "select e.symbol, e.ex_date, (select min(session_date) from [bars] b where b.symbol = e.symbol and b.session_date > e.ex_date) as session_date from (select distinct symbol, ex_date from [splits]) e")
def as_of_forward_strict(w: World):
    return joins.as_of_forward(w.splits.select("symbol", "ex_date").distinct(), w.bars, "symbol", "ex_date", "session_date", ["session_date"], strict=True)


@query("anti_override", "select symbol, session_date, close from [bars] b where not exists (select 1 from [imported] i where i.symbol = b.symbol and i.session_date = b.session_date)")
def anti_override(w: World):
    return w.bars.join(w.imported.select("symbol", "session_date"), ["symbol", "session_date"], "left_anti").select("symbol", "session_date", "close")


@query("anti_stale_class", f"with {MASKED} select security_id, symbol, valid_from from masked m where not exists (select 1 from [classes] c where c.security_id = m.security_id and c.symbol = m.symbol and c.valid_from = m.valid_from)")
def anti_stale_class(w: World):
    keys = ["security_id", "symbol", "valid_from"]
    return pit.masked_segments(w.segments, AS_OF).select(*keys).join(w.classes.select(*keys), keys, "left_anti")


@query("semi_visible", f"with {MASKED} select c.* from [classes] c where exists (select 1 from masked m where c.security_id = m.security_id and c.symbol = m.symbol and c.valid_from = m.valid_from)")
def semi_visible(w: World):
    keys = ["security_id", "symbol", "valid_from"]
    return w.classes.join(pit.masked_segments(w.segments, AS_OF).select(*keys), keys, "left_semi")


@query("anti_not_equal", "select symbol, session_date from [bars] b where not exists (select 1 from [bars] o where o.session_date = b.session_date and o.volume = b.volume and o.trade_count = b.trade_count and o.symbol <> b.symbol)")
def anti_not_equal(w: World):
    b, o = w.bars.select("symbol", "session_date", "volume", "trade_count"), w.bars.select(F.col("symbol").alias("other"), "session_date", "volume", "trade_count")
    return b.join(o, (b["session_date"] == o["session_date"]) & (b["volume"] == o["volume"]) & (b["trade_count"] == o["trade_count"]) & (b["symbol"] != o["other"]), "left_anti").select("symbol", "session_date")


@query("overlap_self_join", "select a.symbol, a.ex_date as first_from, b.ex_date as second_from from (select distinct symbol, ex_date from [splits]) a join (select distinct symbol, ex_date from [splits]) b on a.symbol = b.symbol and a.ex_date < b.ex_date and b.ex_date < a.ex_date + 400")
def overlap_self_join(w: World):
    rows = w.splits.select("symbol", "ex_date").distinct().withColumn("until", F.date_add("ex_date", 400)).withColumn("tie", F.lit(0))
    return pit.overlapping(rows, "symbol", "ex_date", "until", "tie").select("symbol", "first_from", "second_from")


@query("identical_rows_self_join", "select session_date, trade_count, volume, a.symbol as first, b.symbol as second from [bars] a join [bars] b using (session_date, trade_count, volume) where a.symbol < b.symbol")
def identical_rows_self_join(w: World):
    return joins.identical_pairs(w.bars, "symbol", ["session_date", "trade_count", "volume"])


@query("near_days_semi", "select distinct symbol, ex_date from [splits] s where exists (select 1 from [dividends] d where d.symbol = s.symbol and abs(date_diff('day', d.ex_date, s.ex_date)) <= 92)")
def near_days_semi(w: World):
    return joins.near_in_days(w.splits.select("symbol", "ex_date").distinct(), w.dividends, "symbol", "ex_date", "ex_date", 92)


@query("split_owner_choice", "select symbol, ex_date, security_id from (select sp.symbol, sp.ex_date, m.security_id, row_number() over (partition by sp.symbol, sp.ex_date order by (m.valid_to = sp.ex_date) nulls first, m.valid_from desc) as place from (select distinct symbol, ex_date from [splits]) sp left join [segments] m on m.symbol = sp.symbol and m.valid_from <= sp.ex_date and (m.valid_to is null or sp.ex_date <= m.valid_to)) x where place = 1")
def split_owner_choice(w: World):
    sp = w.splits.select(F.col("symbol").alias("s"), "ex_date").distinct()
    rows = sp.join(w.segments, (F.col("symbol") == F.col("s")) & (F.col("valid_from") <= F.col("ex_date")) & (F.coalesce("valid_to", F.lit(pit.FAR).cast("date")) >= F.col("ex_date")), "left")
    return pit.first_of(rows, ["s", "ex_date"], [(F.col("valid_to") == F.col("ex_date")).asc_nulls_first(), F.desc("valid_from")]).select(F.col("s").alias("symbol"), "ex_date", "security_id")


@query("first_session_after", "select ex_date, (select min(session_date) from [bars] b where b.session_date >= e.ex_date) as session_date from (select distinct ex_date from [splits]) e")
def first_session_after(w: World):
    left = w.splits.select("ex_date", F.lit(1).alias("all")).distinct()
    right = w.bars.select("session_date", F.lit(1).alias("all")).distinct()
    return joins.as_of_forward(left, right, "all", "ex_date", "session_date", ["session_date"]).drop("all")


@query("cross_join_scalar", "select symbol, date_diff('day', max(session_date), (select max(session_date) from [bars])) as behind from [bars] group by symbol")
def cross_join_scalar(w: World):
    newest = w.bars.agg(F.max("session_date").alias("newest"))
    return w.bars.groupBy("symbol").agg(F.max("session_date").alias("last")).crossJoin(F.broadcast(newest)).select("symbol", F.datediff("newest", "last").cast("long").alias("behind"))


@query("not_in_dates", "select distinct session_date from [bars] where session_date not in (select ex_date from [splits])")
def not_in_dates(w: World):
    days = w.bars.select("session_date").distinct()
    return days.join(w.splits.select(F.col("ex_date").alias("session_date")), "session_date", "left_anti")


@query("null_safe_diff", f"with {MASKED} select s.security_id, s.symbol, s.valid_from from [segments] s join masked m using (security_id, symbol, valid_from) where s.valid_to is distinct from m.valid_to or s.cik is distinct from m.cik")
def null_safe_diff(w: World):
    keys = ["security_id", "symbol", "valid_from"]
    changed = joins.keyed_diff(w.segments, pit.masked_segments(w.segments, AS_OF), keys, ["valid_to", "cik"])
    return changed.filter("change not in ('gone', 'new')").select(*keys)


@query("full_outer_diff", f"with {MASKED} select security_id, symbol, valid_from, case when m.available_at is null then 'gone' else concat_ws(',', case when s.valid_to is distinct from m.valid_to then 'valid_to' end, case when s.cik is distinct from m.cik then 'cik' end) end as change from [segments] s left join masked m using (security_id, symbol, valid_from) where m.available_at is null or s.valid_to is distinct from m.valid_to or s.cik is distinct from m.cik")
def full_outer_diff(w: World):
    return joins.keyed_diff(w.segments, pit.masked_segments(w.segments, AS_OF), ["security_id", "symbol", "valid_from"], ["valid_to", "cik"])


@query("interval_lead_join", "with iv as (select snapshot_date as lo, lead(snapshot_date) over (order by snapshot_date) as hi from (select distinct snapshot_date from [snapshots]) x) select b.symbol, s.cik, count(*) as bars from [bars] b join iv on b.session_date >= iv.lo and (iv.hi is null or b.session_date < iv.hi) join (select distinct snapshot_date, ticker, cik from [snapshots]) s on s.snapshot_date = iv.lo and s.ticker = b.symbol group by b.symbol, s.cik")
def interval_lead_join(w: World):
    listed = w.snapshots.select("ticker", "cik", F.col("snapshot_date").alias("lo")).distinct().join(F.broadcast(joins.intervals(w.snapshots, "snapshot_date")), "lo")
    b = w.bars.select("symbol", "session_date")
    return b.join(listed, (b["symbol"] == F.col("ticker")) & pit.within(F.col("session_date"), F.col("lo"), F.col("hi"))).groupBy("symbol", "cik").agg(F.count(F.lit(1)).alias("bars"))


@query("panel_tier_join", f"with {RESOLVED}, tier as (select security_id from resolved group by security_id having sum(volume) > 2000) select r.security_id, r.session_date, r.symbol from resolved r join tier using (security_id)")
def panel_tier_join(w: World):
    bars = resolved(w)
    tier = bars.groupBy("security_id").agg(F.sum("volume").alias("v")).filter("v > 2000").select("security_id")
    return bars.join(tier, "security_id").select("security_id", "session_date", "symbol")


@query("filer_securities", f"with {VISIBLE_DOCS} select distinct s.security_id from shown d join [segments] s on s.cik = cast(regexp_extract(d.url, '/Archives/edgar/data/(\\d+)/', 1) as bigint) - 1000 where d.doc_type = '8-K'")
def filer_securities(w: World):
    shown = pit.visible_documents(w.docs, DOC_AT).filter("doc_type = '8-K'")
    filers = shown.select((F.regexp_extract("url", r"/Archives/edgar/data/(\d+)/", 1).cast("long") - 1000).alias("cik")).distinct()
    return w.segments.join(filers, "cik", "left_semi").select("security_id").distinct()


@query("filer_only_match", "select concat(snapshot_date, ticker) as listing, case when count(distinct cik) = 1 then min(cik) else min(cik) filter (where exchange = 'NYSE') end as cik from [snapshots] group by 1 having count(distinct cik) = 1 or count(distinct cik) filter (where exchange = 'NYSE') = 1")
def filer_only_match(w: World):
    return joins.only_match(w.snapshots.withColumn("listing", F.concat(F.col("snapshot_date").cast("string"), "ticker")), "listing", "cik", F.col("exchange") == "NYSE")


@query("split_record_owner", "select sp.symbol, sp.ex_date, sp.factor, m.security_id from [splits] sp join [segments] m on m.symbol = sp.symbol and sp.ex_date >= m.valid_from and (m.valid_to is null or sp.ex_date < m.valid_to)")
def split_record_owner(w: World):
    return pit.owned(w.splits.select("symbol", "ex_date", "factor"), w.segments, day="ex_date")


@query("pair_runs", "select coalesce(a.id, b.id) as id, a.pnl as pnl_a, b.pnl as pnl_b from (select id, pnl from [trades] where leg = 1 or id % 3 = 0) a full outer join (select id, pnl from [trades] where leg = 2 or id % 5 = 0) b on a.id = b.id")
def pair_runs(w: World):
    a = w.trades.filter("leg = 1 or id % 3 = 0").select("id", F.col("pnl").alias("pnl_a"))
    b = w.trades.filter("leg = 2 or id % 5 = 0").select("id", F.col("pnl").alias("pnl_b"))
    return a.join(b, "id", "full_outer")


@query("parent_around_event", "select sp.parent_symbol, sp.ex_date, max(b.session_date) filter (where b.session_date < sp.ex_date) as last_before, arg_max(b.close, b.session_date) filter (where b.session_date < sp.ex_date) as close_before, min(b.session_date) filter (where b.session_date >= sp.ex_date) as first_after from (select distinct parent_symbol, ex_date from [spinoffs]) sp join [bars] b on b.symbol = sp.parent_symbol group by sp.parent_symbol, sp.ex_date")
def parent_around_event(w: World):
    sp = w.spinoffs.select("parent_symbol", "ex_date").distinct()
    day, before = F.col("session_date"), F.col("session_date") < F.col("ex_date")
    return sp.join(w.bars, F.col("symbol") == F.col("parent_symbol")).groupBy("parent_symbol", "ex_date").agg(
        F.max(F.when(before, day)).alias("last_before"), F.max_by("close", F.when(before, day)).alias("close_before"), F.min(F.when(~before, day)).alias("first_after")
    )
