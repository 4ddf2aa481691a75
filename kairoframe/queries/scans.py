"""Scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import joins, scans, spinoffs
from ..operators.aggregates import tidy
from ..plans import pit
from .pit import AS_OF, AT, EVENTS, panel


@query("momentum_panel")
def momentum_panel(w: World):
    made = scans.momentum_panel(scans.adjusted(panel(w), pit.splits_as_of(w.splits, AS_OF)))
    return made.select("security_id", "session_date", *[tidy(F.col(c)).alias(c) for c in ("bx_daily", "bx_weekly", "bx_monthly")], "bx_daily_bars")


@query("momentum_scan")
def momentum_scan(w: World):
    bars = panel(w)
    made = scans.momentum_panel(scans.adjusted(bars, pit.splits_as_of(w.splits, AS_OF)))
    tier = bars.groupBy("security_id").agg(F.sum("volume").alias("v")).filter("v > 1000")
    return scans.rising(scans.eligible(made, tier), 3).select("session_date", "security_id", tidy(F.col("rise")).alias("rise"), "place")


@query("spinoff_panel")
def spinoff_panel(w: World):
    bars = panel(w)
    events = spinoffs.events(pit.spinoffs_as_of(w.spinoffs, AS_OF), bars).filter("security_id is not null")
    return scans.blank_sessions(scans.rescaled(bars.select("security_id", "session_date", "open", "high", "low", "close"), events), events).groupBy("security_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("blank").alias("blank"))


@query("gap_events", f"""with {EVENTS}, f as (select security_id, symbol, session_date, open / lag(close) over w - 1 as gap, volume / (case when count(volume) over (w rows between 3 preceding and 1 preceding) = 3 then avg(volume) over (w rows between 3 preceding and 1 preceding) end) as rvol from (select symbol as security_id, * from [bars] where volume > 0) b window w as (partition by security_id order by session_date))
    select security_id, session_date, floor(gap * 1e6 + 0.5) / 1e6 as gap from f where gap >= 0.04 - 1e-9 and rvol >= 1.5 - 1e-9 and not exists (select 1 from events_known e where e.symbol = f.symbol and e.ex_date between f.session_date - 28 and f.session_date)""")
def gap_events(w: World):
    from ..operators import windows

    bars = w.bars.filter("volume > 0").withColumn("security_id", F.col("symbol"))
    rows = windows.daily_features(bars, rvol=3).filter((F.col("gap") >= 0.04 - 1e-9) & (F.col("rvol") >= 1.5 - 1e-9))
    s = pit.splits_as_of(w.splits, AS_OF).select(F.col("symbol").alias("_s"), F.col("ex_date").alias("_e")).distinct()
    rows = rows.join(s, (F.col("_s") == F.col("symbol")) & F.col("_e").between(F.date_sub("session_date", 28), F.col("session_date")), "left_anti")
    return rows.select("security_id", "session_date", tidy(F.col("gap")).alias("gap"))


@query("reaction_filings", f"select f.accn, min(d.session_date) as session_date from [facts] f left join (select distinct session_date from [bars]) d on d.session_date + interval 570 minute > f.available_at where f.form = '10-K' and f.available_at <= {AT} group by f.accn")
def reaction_filings(w: World):
    filings = pit.visible(w.facts, AS_OF).filter("form = '10-K'").select("accn", "available_at")
    days = w.bars.select("session_date").distinct()
    return scans.reaction_sessions(filings, days, F.col("session_date").cast("timestamp_ntz") + F.expr("interval 570 minute")).select("accn", "session_date")


@query("latest_filers", f"select security_id, accn from (select s.security_id, f.accn, row_number() over (partition by s.security_id order by f.available_at desc, f.accn desc) as place from [facts] f join (select distinct security_id, cik from [segments] where available_at <= {AT} and cik_available_at <= {AT}) s using (cik) where f.available_at <= {AT}) x where place = 1")
def latest_filers(w: World):
    return scans.latest_filers(w.facts, w.segments, AS_OF).select("security_id", "accn")


@query("pool_colours", "select b.symbol, b.session_date, (select max(ex_date) from [splits] s where s.symbol = b.symbol and s.ex_date <= b.session_date) as last_split from (select distinct symbol, session_date from [bars] where volume > 0) b")
def pool_colours(w: World):
    left = w.bars.filter("volume > 0").select("symbol", "session_date").distinct()
    return joins.as_of_backward(left, w.splits.select("symbol", F.col("ex_date").alias("last_split")).distinct(), "symbol", "session_date", "last_split", ["last_split"])


@query("trend_panel")
def trend_panel(w: World):
    bars = panel(w)
    events = spinoffs.events(pit.spinoffs_as_of(w.spinoffs, AS_OF), bars).filter("security_id is not null")
    made = scans.trend_panel(bars.select("security_id", "session_date", "open", "high", "low", "close"), events, 10, 5)
    return made.groupBy("security_id").agg(F.count("fv").alias("valued"), F.count_if(F.col("colour") == "red").alias("red"), F.count_if(F.col("colour") == "green").alias("green"))
