"""Sizing, legs, books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import aggregates, replay, simulation, spinoffs, windows
from ..operators.aggregates import tidy
from ..plans import pit
from ..session import cut
from .pit import AS_OF, EVENTS
from .pit import panel as resolved

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("position_shares", "select s_suppkey, cast(case when risk > 0 then greatest(0, least(floor(budget / risk + 1e-9), floor(equity * 10.0 / 100 / price + 1e-9), case when equity * 150.0 / 100 - gross > 0 then floor((equity * 150.0 / 100 - gross) / price + 1e-9) else 0 end)) else 0 end as bigint) as shares from (select s_suppkey, cast(s_suppkey * 37 % 500 as double) as budget, cast(20 + s_suppkey % 80 as double) as price, cast(s_suppkey % 7 - 1 as double) as risk, cast(100000 as double) as equity, cast(s_suppkey * 2000 as double) as gross from supplier) x")
def position_shares(w: World):
    k = F.col("s_suppkey")
    price, d = (20 + k % 80).cast("double"), lambda x: x.cast("double")
    return w.supplier.select("s_suppkey", simulation.position_shares(d(k * 37 % 500), price, price - d(k % 7 - 1), F.lit(100000.0), 10.0, 150.0, d(k * 2000)).alias("shares"))


@query("zone_and_stops", "select s_suppkey, key_level - least(0.5 * atr, 0.02 * key_level) as bottom, key_level + least(0.5 * atr, 0.02 * key_level) as top, key_level - 1.5 * atr as hard, greatest(key_level, key_level + 4 - 3.0 * atr) as trail from (select s_suppkey, cast(50 + s_suppkey % 50 as double) as key_level, cast(s_suppkey % 9 + 1 as double) / 4 as atr from supplier) x")
def zone_and_stops(w: World):
    key, atr = (50 + F.col("s_suppkey") % 50).cast("double"), (F.col("s_suppkey") % 9 + 1).cast("double") / 4
    bottom, top = simulation.zone(key, atr, 0.5, 2.0)
    return w.supplier.select("s_suppkey", bottom.alias("bottom"), top.alias("top"), simulation.hard_stop(key, atr, 1.5).alias("hard"), simulation.trail_key(key, key + 4, atr, 3.0).alias("trail"))


@query("fills_and_r", "select id, pnl * (1 + 5.0 / 1e4) as bought, pnl * (1 - 5.0 / 1e4) as sold, (pnl + 7 - pnl + 0.0) / (pnl - (pnl - 2)) as r from [trades]")
def fills_and_r(w: World):
    p = F.col("pnl")
    return w.trades.select("id", simulation.buy_price(p).alias("bought"), simulation.sell_price(p).alias("sold"), simulation.r_multiple(p, p + 7, p - 2).alias("r"))


@query("reentry_budget", "select id, 500.0 - greatest(0.0, -pnl) as shared, 500.0 as independent from [trades]")
def reentry_budget(w: World):
    return w.trades.select("id", simulation.reentry_budget(F.lit(500.0), F.col("pnl"), True).alias("shared"), simulation.reentry_budget(F.lit(500.0), F.col("pnl"), False).alias("independent"))


@query("exit_flags", "select id, coalesce(d < 0, false) as daily_red, coalesce(wk < bf, false) as weekly_down from (select id, case when id % 5 > 0 then pnl end as d, case when id % 7 > 0 then pnl end as wk, case when id % 3 > 0 then r_multiple end as bf from [trades]) x")
def exit_flags(w: World):
    k = F.col("id")
    red, down = simulation.exit_flags(F.when(k % 5 > 0, F.col("pnl")), F.when(k % 7 > 0, F.col("pnl")), F.when(k % 3 > 0, F.col("r_multiple")))
    return w.trades.select("id", red.alias("daily_red"), down.alias("weekly_down"))


@query("buy_and_hold", f"""with {EVENTS}, p as (select symbol, session_date, open, close, lag(session_date) over (partition by symbol order by session_date) as prev from [bars] where volume > 0), dv as (select distinct * from [dividends] where available_at <= timestamp '{AS_OF}'),
    g as (select p.*, coalesce((select product(factor) from events_known e where e.symbol = p.symbol and e.ex_date > p.prev and e.ex_date <= p.session_date), 1) as s, coalesce((select sum(rate) from dv where dv.symbol = p.symbol and dv.ex_date > p.prev and dv.ex_date <= p.session_date), 0) as r from p)
    select symbol, session_date, {T6.format("exp(sum(ln(s * (1 + r / close))) over w) * close / first_value(open) over w")} as equity from g window w as (partition by symbol order by session_date rows between unbounded preceding and current row)""")
def buy_and_hold(w: World):
    made = simulation.buy_and_hold(w.bars.filter("volume > 0"), pit.splits_as_of(w.splits, AS_OF), pit.dividends_as_of(w.dividends, AS_OF))
    return made.withColumn("equity", tidy(F.col("equity")))


@query("equity_marks", f"select run_id, session_date, {T6.format('100000 + sum(sum(pnl)) over (partition by run_id order by session_date)')} as equity from [trades] group by run_id, session_date")
def equity_marks(w: World):
    return simulation.equity_marks(w.trades, "run_id", "session_date", "pnl", 100000.0).withColumn("equity", tidy(F.col("equity")))


@query("curve_metrics", f"""with c as (select run_id, session_date, 100000 + sum(sum(pnl)) over (partition by run_id order by session_date) as e from [trades] group by run_id, session_date), r as (select *, e / lag(e) over (partition by run_id order by session_date) - 1 as r, e / max(e) over (partition by run_id order by session_date rows between unbounded preceding and current row) - 1 as dd from c)
    select run_id, count(r) as days, {T6.format('arg_max(e, session_date) / arg_min(e, session_date) - 1')} as total_return, {T6.format('case when count(r) > 0 then pow(arg_max(e, session_date) / arg_min(e, session_date), 252.0 / count(r)) - 1 end')} as annual_return, {T6.format('min(dd)')} as max_drawdown, {T6.format('case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(252.0) end')} as sharpe from r group by run_id""")
def curve_metrics(w: World):
    curves = simulation.equity_marks(w.trades, "run_id", "session_date", "pnl", 100000.0)
    made = aggregates.curve_metrics(curves, "run_id", "session_date", "equity")
    return made.select("run_id", "days", *[tidy(F.col(c)).alias(c) for c in ("total_return", "annual_return", "max_drawdown", "sharpe")])


def decisions(w: World):
    rows = windows.inclusive_atr(resolved(w)).filter("signal_atr is not null and day(session_date) = 15")
    return rows.select(F.abs(F.xxhash64("security_id", "session_date")).alias("decision_id"), "security_id", F.date_add("session_date", 1).alias("day"), F.col("signal_atr").alias("atr"), F.lit(100).cast("long").alias("shares"), (F.length("security_id").cast("long")).alias("run_id"))


@query("step_leg")
def step_leg(w: World):
    return simulation.simulated_legs(decisions(w), resolved(w), simulation.LegRules(max_sessions=20))


@query("replay_runs")
def replay_runs(w: World):
    made = decisions(w).withColumn("day", F.date_sub("day", 1)).select("run_id", "decision_id", "security_id", "day", "atr")
    return simulation.replay(made, resolved(w).select("security_id", "session_date", "open", "high", "low", "close"), simulation.LegRules(max_sessions=20), 10000000.0, 1.0, 150.0)


@query("signal_scan", f"""with x as (select symbol, session_date, open, volume, close, lag(close) over w as pc, lag(volume) over w as pv from [bars] where volume > 0 window w as (partition by symbol order by session_date)), s as (select *, open / pc - 1 as gap from x where pc is not null)
    select symbol, session_date, {T6.format('gap')} as gap, row_number() over (partition by session_date order by gap desc, symbol) as place from s where gap >= 0.04 - 1e-9 and volume >= 2 * pv and pc >= 5 - 1e-6""")
def signal_scan(w: World):
    from pyspark.sql import Window

    o = Window.partitionBy("symbol").orderBy("session_date")
    rows = w.bars.filter("volume > 0").withColumn("pc", F.lag("close").over(o)).withColumn("pv", F.lag("volume").over(o)).filter("pc is not null").withColumn("gap", F.col("open") / F.col("pc") - 1)
    rows = rows.filter((F.col("gap") >= 0.04 - 1e-9) & (F.col("volume") >= 2 * F.col("pv")) & (F.col("pc") >= 5 - 1e-6))
    place = F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc("gap"), "symbol")).cast("long")
    return rows.select("symbol", "session_date", tidy(F.col("gap")).alias("gap"), place.alias("place"))


@query("decision_legs")
def decision_legs(w: World):
    from pyspark.sql import Window

    o = Window.partitionBy("security_id").orderBy("session_date")
    rows = windows.inclusive_atr(resolved(w)).withColumn("pre_close", F.lag("close").over(o)).filter("signal_atr is not null and day(session_date) in (10, 20)")
    made = rows.select(F.abs(F.xxhash64("security_id", "session_date")).alias("decision_id"), "security_id", F.col("session_date").alias("day"), "pre_close", (F.col("signal_atr") / 4).alias("atr"), F.lit(50).cast("long").alias("shares"), F.lit(1e6).alias("budget"))
    return simulation.simulated_decisions(made, resolved(w), simulation.LegRules(max_sessions=20), simulation.ReentryRules())


@query("account_replay")
def account_replay(w: World):
    """Two accounts over the whole history: one buys on the 15th of a month, one on the 5th; exits by the day's and the week's fall."""
    o = Window.partitionBy("security_id").orderBy("session_date")
    bars = cut(resolved(w).select("security_id", "symbol", "session_date", "open", "high", "low", "close", "available_at"))  # looked at six times
    nights = replay.signal_inputs(bars, 14).filter("day(session_date) in (5, 15)")
    rank = F.row_number().over(Window.partitionBy("session_date").orderBy("security_id"))
    signals = nights.withColumn("rank", rank).withColumn("run_id", F.when(F.dayofmonth("session_date") == 15, 1).otherwise(2).cast("long"))
    falls = F.array_compact(F.array(F.when(F.col("close") < F.lag("close").over(o), "daily_red"), F.when(F.col("close") < F.lag("close", 5).over(o), "weekly_down")))
    flags = bars.select("security_id", "session_date", falls.alias("flags"))
    records = pit.spinoffs_as_of(w.spinoffs, AS_OF)
    events = replay.settled_events(spinoffs.events(records, bars), records)
    runs = signals.groupBy("run_id").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    rows = replay.stream(runs, bars.select("session_date").distinct(), signals, bars, pit.splits_as_of(w.splits, AS_OF), events, flags)
    made = replay.replayed(rows, replay.AccountRules(equity=1e6))
    return made.select("run_id", "kind", "day", "security_id", "reason", "shares", "spinoff", *[tidy(F.col(c)).alias(c) for c in ("exit_price", "pnl", "r_multiple", "mae_pct", "mfe_pct", "child_proceeds", "equity", "gross")])
