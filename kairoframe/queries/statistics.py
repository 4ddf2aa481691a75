"""Statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import evaluation, statistics, windows
from ..operators.aggregates import tidy
from ..plans import pit
from ..session import cut
from .pit import AS_OF, EVENTS, PANEL
from .pit import panel, resolved

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("max_statistic", f"""with rl as (select cast(run_id % 5 as varchar) as variant, pnl as ret from [trades] where id % 3 = 0), nl as (select cast(run_id % 5 as varchar) as variant, (id * 7) % 40 as perm, pnl as ret from [trades]),
    mine as (select variant, count(*) as trades, avg(ret) as mean from rl group by 1), means as (select variant, perm, avg(ret) as m from nl group by 1, 2), sp as (select variant, avg(m) as c, stddev_pop(m) as sd, count(*) as k from means group by 1),
    best as (select perm, max((m - c) / sd) as b from means join sp using (variant) group by 1), st as (select *, (mean - c) / sd as z from mine join sp using (variant))
    select variant, trades, {T6.format('mean')} as mean, {T6.format('c')} as null_mean, {T6.format('mean - c')} as excess, {T6.format('z')} as z, (1 + (select count(*) from means m where m.variant = st.variant and m.m >= st.mean)) / (1 + k) as p_raw, (1 + (select count(*) from best where b >= st.z)) / (1 + k) as p_adjusted from st""")
def max_statistic(w: World):
    v = (F.col("run_id") % 5).cast("string").alias("variant")
    real = w.trades.filter("id % 3 = 0").select(v, F.col("pnl").alias("ret"))
    null = w.trades.select(v, ((F.col("id") * 7) % 40).alias("perm"), F.col("pnl").alias("ret"))
    made = statistics.max_statistic(real, null)
    return made.select("variant", "trades", *[tidy(F.col(c)).alias(c) for c in ("mean", "null_mean", "excess", "z")], "p_raw", "p_adjusted")


@query("walk_forward_windows", "with d as (select date '2020-01-31' as start, date '2025-06-30' as \"end\"), k as (select *, unnest(range(0, 14)) as k from d) select cast(start + to_months(cast(k * 6 as integer)) as date) as train_start, cast(cast(start + to_months(cast(k * 6 + 24 as integer)) as date) - 1 as date) as train_end, cast(start + to_months(cast(k * 6 + 24 as integer)) as date) as test_start, cast(cast(start + to_months(cast(k * 6 + 30 as integer)) as date) - 1 as date) as test_end from k where cast(start + to_months(cast(k * 6 + 30 as integer)) as date) - 1 <= \"end\"")
def walk_forward_windows(w: World):
    dev = w.spark.range(1).select(F.lit("2020-01-31").cast("date").alias("start"), F.lit("2025-06-30").cast("date").alias("end"))
    return statistics.walk_forward(dev, 24, 6)


@query("sharpe_error", f"select run_id, {T6.format('sqrt((1 + x * x / 504) / (n / 252.0))')} as error from (select run_id, avg(r_multiple) as x, count(*) as n from [trades] group by 1) t")
def sharpe_error(w: World):
    rows = w.trades.groupBy("run_id").agg(F.avg("r_multiple").alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("run_id", tidy(statistics.sharpe_error(F.col("x"), F.col("n"))).alias("error"))


@query("best_run", f"select grp, run_id, {T6.format('sharpe')} as sharpe from (select run_id % 10 as grp, run_id, sharpe, row_number() over (partition by run_id % 10 order by sharpe desc nulls last, run_id) as place from (select run_id, case when count(*) % 3 > 0 then max(pnl) end as sharpe from [trades] group by 1) x) y where place = 1")
def best_run(w: World):
    rows = w.trades.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("pnl").alias("m")).select((F.col("run_id") % 10).alias("grp"), "run_id", F.when(F.col("n") % 3 > 0, F.col("m")).alias("sharpe"))
    return statistics.best_run(rows, "grp").withColumn("sharpe", tidy(F.col("sharpe")))


def entries(w: World):
    return panel(w).filter("day(session_date) in (3, 17)").select("security_id", "session_date")


CAL = f"{PANEL}, cal as (select session_date, row_number() over (order by session_date) as idx from (select distinct session_date from resolved) d), en as (select security_id, session_date from resolved where day(session_date) in (3, 17))"


@query("fixed_hold", f"""with {CAL}, x as (select e.security_id, e.session_date, t.session_date as exit_day, o.open as buy, q.open as sell from en e join cal c using (session_date) left join cal t on t.idx = c.idx + 5 join resolved o on o.security_id = e.security_id and o.session_date = e.session_date left join resolved q on q.security_id = e.security_id and q.session_date = t.session_date),
    s as (select *, exit_day is null or exit_day > date '1997-06-30' as beyond from x)
    select security_id, session_date, case when not beyond then exit_day end as exit_day, case when beyond then 'beyond' when sell is null then 'unpriced' else 'held' end as status, {T6.format('case when not beyond then (sell * 1.0 + 0.0) * (1 - 5.0 / 1e4) / (buy * (1 + 5.0 / 1e4)) - 1 end')} as ret from s""")
def fixed_hold(w: World):
    bars = panel(w)
    made = statistics.fixed_hold(entries(w), bars, windows.session_index(bars), 5, "1997-06-30", 5.0)
    return made.withColumn("ret", tidy(F.col("ret")))


@query("reentry_flags", f"with {CAL}, cl as (select r.security_id, c.idx from resolved r join cal c using (session_date) where day(session_date) = 12) select e.security_id, e.session_date, exists (select 1 from cl where cl.security_id = e.security_id and c.idx - cl.idx between 1 and 10) as reentry from en e join cal c using (session_date)")
def reentry_flags(w: World):
    bars = panel(w)
    closes = bars.filter("day(session_date) = 12").select("security_id", "session_date")
    return statistics.reentries(entries(w), closes, windows.session_index(bars))


@query("pool_excess", f"with {PANEL}, g as (select security_id, session_date, close / open - 1 as r from resolved), m as (select session_date, avg(r) as m, count(*) as n from g group by 1) select security_id, session_date, {T6.format('r - m')} as excess, n as pool from g join m using (session_date) where n > 1")
def pool_excess(w: World):
    rows = panel(w).select("security_id", "session_date", (F.col("close") / F.col("open") - 1).alias("r"))
    pool = rows.groupBy("session_date").agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("pool")).filter("pool > 1")
    return rows.join(pool, "session_date").select("security_id", "session_date", tidy(F.col("r") - F.col("m")).alias("excess"), "pool")


@query("versions_tried", "select run_id % 10 as strategy, count(distinct run_id) as versions, count(*) as attempts from [trades] where session_date between date '2024-01-05' and date '2024-01-20' group by 1")
def versions_tried(w: World):
    rows = w.trades.filter("session_date between date'2024-01-05' and date'2024-01-20'")
    return rows.groupBy((F.col("run_id") % 10).alias("strategy")).agg(F.count_distinct("run_id").alias("versions"), F.count(F.lit(1)).alias("attempts"))


@query("null_returns")
def null_returns(w: World):
    """Every bar of every session is a span and a member of its session's pool."""
    bars = panel(w).select(F.col("session_date").alias("day"), "security_id", F.when(F.col("volume") % 3 > 0, F.col("close") / F.col("open") - 1).alias("ret"))
    # Draws take long for their few bytes, so days stay in as many parts as they are dealt to.
    bars = bars.repartition(int(w.spark.conf.get("spark.sql.shuffle.partitions")), "day")
    rows = bars.select("*", F.lit("a").alias("variant"), F.concat_ws(":", "security_id", F.col("day").cast("string")).alias("key"))
    return statistics.null_totals(rows, 50, 7).groupBy("perm", "variant").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("spans"))


@query("cluster_bootstrap")
def cluster_bootstrap(w: World):
    return statistics.bootstrap(w.trades, "exit_reason", "pnl", "session_date", 500, 11)


def evaluated(w: World):
    """(spans of two entry days held 5 and 10 sessions, priced pools of their windows, calendar)."""
    bars = panel(w).select("security_id", "symbol", "session_date", "open", "close")
    days = [r["session_date"] for r in evaluation.numbered(resolved(w)).orderBy("idx").collect()]  # a calendar: a row a session
    at = [i for i, d in enumerate(days) if d.day in (3, 17)]
    used = sorted({days[i + k] for i in at for k in (-1, 0, 5, 10) if 0 <= i + k < len(days)})
    calendar = w.spark.createDataFrame([(d,) for d in days], "session_date date")
    bars = cut(bars.filter(F.col("session_date").isin(used)))  # only these sessions can meet; looked at six times
    rows = bars.filter("day(session_date) in (3, 17)").select("security_id", "session_date", F.concat(F.lit("d"), F.dayofmonth("session_date").cast("string")).alias("variant"))
    spans = evaluation.entry_spans(rows, bars, calendar, (5, 10), "1997-06-30", 5.0)
    members = bars.select("session_date", F.col("security_id").alias("member"))
    pools = evaluation.pools_for(spans.select(*evaluation.WINDOW), calendar, members)
    splits = pit.splits_as_of(w.splits, AS_OF).join(bars.select("security_id", "symbol").distinct(), "symbol").select("security_id", "ex_date", "factor")
    none = splits.limit(0).select("security_id", "ex_date")
    return spans, cut(evaluation.priced(pools, bars, splits, none.withColumn("paid", F.lit(0.0)), none, 5.0)), calendar


@query("entry_test")
def entry_test(w: World):
    spans, prices, calendar = evaluated(w)
    some = prices.groupBy(*evaluation.WINDOW).agg(F.count("ret").alias("n")).filter("n > 0").select(*evaluation.WINDOW)
    keep = lambda x: x.join(some, list(evaluation.WINDOW), "left_semi")
    made = evaluation.entry_test(keep(spans), keep(prices), calendar, 100, 7, 200)
    return made.select("variant", "trades", *[tidy(F.col(c)).alias(c) for c in ("mean", "null_mean", "p_adjusted", "excess_low", "excess_high")])


EVAL = f"""{CAL}, h as (select unnest([5, 10]) as hold), s0 as (select e.security_id, c.idx, e.session_date as entry_session, t.session_date as exit_session, h.hold, concat('d', day(e.session_date), ':', h.hold) as variant, o.open as i, x.open as z from en e join cal c using (session_date) cross join h
    join cal t on t.idx = c.idx + h.hold and t.session_date <= date '1997-06-30' join resolved o on o.security_id = e.security_id and o.session_date = e.session_date join resolved x on x.security_id = e.security_id and x.session_date = t.session_date),
    sp as (select *, z * (1 - 5.0 / 1e4) / (i * (1 + 5.0 / 1e4)) - 1 as ret from s0), k as (select distinct variant, security_id, entry_session, exit_session, idx, hold from sp),
    sx as (select distinct r.security_id, e.ex_date, e.factor from events_known e join (select distinct security_id, symbol from resolved) r using (symbol)),
    pm as (select k.variant, k.security_id, k.entry_session, k.exit_session, m.security_id as member from k join cal b on b.idx = k.idx - 1 join (select distinct security_id, session_date from resolved) m on m.session_date = b.session_date),
    pr as (select pm.*, (q.open * coalesce((select product(factor) from sx where sx.security_id = pm.member and sx.ex_date > pm.entry_session and sx.ex_date <= pm.exit_session), 1)) * (1 - 5.0 / 1e4) / (p.open * (1 + 5.0 / 1e4)) - 1 as r from pm left join resolved p on p.security_id = pm.member and p.session_date = pm.entry_session left join resolved q on q.security_id = pm.member and q.session_date = pm.exit_session)"""


@query("entry_pools", f"with {EVENTS}, {EVAL} select variant, security_id, entry_session, count(*) as members, count(r) as priced, {T6.format('avg(r)')} as mean from pr group by variant, security_id, entry_session")
def entry_pools(w: World):
    spans, prices, _ = evaluated(w)
    rows = prices.groupBy(*evaluation.WINDOW).agg(F.count(F.lit(1)).alias("members"), F.count("ret").alias("priced"), tidy(F.avg("ret")).alias("mean"))
    return spans.join(rows, list(evaluation.WINDOW)).select("variant", "security_id", "entry_session", "members", "priced", "mean")


@query("equity_slices", "with m as (select run_id, session_date, 1000 + sum(sum(floor(pnl))) over (partition by run_id order by session_date) as equity from [trades] group by run_id, session_date), b as (select *, lag(equity) over (partition by run_id order by session_date) as before from m) select run_id, session_date, equity, coalesce(first_value(before) over (partition by run_id order by session_date), 1000) as base from b where session_date between date '2024-01-05' and date '2024-01-20'")
def equity_slices(w: World):
    past = Window.partitionBy("run_id").orderBy("session_date")
    marks = w.trades.groupBy("run_id", "session_date").agg(F.sum(F.floor("pnl").cast("double")).alias("p")).select("run_id", "session_date", (F.lit(1000.0) + F.sum("p").over(past)).alias("equity"))
    day = lambda x: F.lit(x).cast("date")
    return evaluation.equity_slice(marks, day("2024-01-05"), day("2024-01-20"), F.lit(1000.0))


@query("basket_curve", f"""with {PANEL}, d as (select distinct session_date from resolved), rb as (select min(session_date) as a from d group by date_trunc('month', session_date)), f as (select a, lead(a) over (order by a) as z from rb),
    mb as (select a, z, security_id from (select f.*, r.security_id, row_number() over (partition by a order by r.close * r.volume desc, r.security_id) as p from f join resolved r on r.session_date = f.a) x where p <= 5),
    g0 as (select mb.a, mb.z, mb.security_id, d.session_date, (select arg_max(close, r.session_date) from resolved r where r.security_id = mb.security_id and r.session_date between mb.a and d.session_date) / (select min(close) from resolved r where r.security_id = mb.security_id and r.session_date = mb.a) as ratio from mb join d on d.session_date >= mb.a and (mb.z is null or d.session_date <= mb.z)),
    g as (select a, z, session_date, avg(ratio) as g from g0 group by 1, 2, 3), c as (select a, coalesce(product(g) over (order by a rows between unbounded preceding and 1 preceding), 1) as start from (select rb.a, g.g from rb left join g on g.a = rb.a and g.session_date = g.z) y)
    select g.session_date, {T6.format('c.start * g.g')} as equity from g join c using (a) where z is null or g.session_date < z""")
def basket_curve(w: World):
    bars = panel(w)
    first = bars.groupBy(F.date_trunc("month", "session_date").alias("m")).agg(F.min("session_date").alias("session_date")).select("session_date")
    place = F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc(F.col("close") * F.col("volume")), "security_id"))
    members = bars.join(first, "session_date", "left_semi").withColumn("place", place).filter("place <= 5").select("session_date", "security_id")
    return evaluation.basket_curve(members, bars, bars).withColumn("equity", tidy(F.col("equity")))
