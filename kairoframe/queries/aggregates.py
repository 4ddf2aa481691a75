"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import aggregates as agg
from ..operators.aggregates import tidy
from ..plans import pit
from .pit import AS_OF, AT, EVENTS, MASKED, PANEL, RESOLVED, panel, resolved

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"
DAYS = f"days as (select distinct session_date from [bars] where available_at <= {AT} order by session_date desc limit 20)"
ADV = f"""{RESOLVED}, {DAYS}, adv as (select security_id, sum(coalesce(vwap, close) * volume) / (select count(*) from days) as adv_usd,
    count(distinct session_date) filter (where volume > 0) as sessions_traded from resolved where session_date in (select session_date from days) group by security_id)"""
FAR = "date '9999-12-31'"
NIGHT = "date '1998-01-30'"
PRIORITY = ("cover", "balance", "average")


@query("adv_tier", f"""with {ADV}, latest as (select * from (select *, row_number() over (partition by security_id order by valid_from desc, symbol) as place from masked) x where place = 1)
    select a.security_id, l.symbol, c.class, {T6.format('a.adv_usd')} as adv_usd, a.sessions_traded from adv a join latest l using (security_id)
    join [classes] c on c.security_id = l.security_id and c.symbol = l.symbol and c.valid_from = l.valid_from where a.adv_usd > 1000 and c.class in ('common', 'etf')""")
def adv_tier(w: World):
    tier = agg.liquid_tier(resolved(w), pit.sessions(w.bars, AS_OF, 20), pit.masked_segments(w.segments, AS_OF), w.classes, 1000.0, ["common", "etf"])
    return tier.withColumn("adv_usd", tidy(F.col("adv_usd")))


@query("adv_tier_monthly", f"""with {RESOLVED}, months as (select cast(unnest(generate_series(date '1996-01-01', date '1997-06-01', interval 1 month)) as date) as "month"),
    near as (select * from (select "month", session_date, row_number() over (partition by "month" order by session_date desc) as back from months, (select distinct session_date from resolved) d where session_date < "month") x where back <= 20)
    select n."month", r.security_id, {T6.format('sum(coalesce(r.vwap, r.close) * r.volume) / max(n.many)')} as adv_usd from resolved r join (select *, count(*) over (partition by "month") as many from near) n using (session_date)
    group by n."month", r.security_id having sum(coalesce(r.vwap, r.close) * r.volume) / max(n.many) > 1500""")
def adv_tier_monthly(w: World):
    return agg.monthly_tier(resolved(w), "1996-01-01", "1997-06-01", 20, 1500.0).withColumn("adv_usd", tidy(F.col("adv_usd")))


def _period(period: str) -> str:
    last = "cast(period_start + 4 as date)" if period == "week" else "cast(last_day(period_start) - cast(greatest(0, isodow(last_day(period_start)) - 5) as integer) as date)"
    return f"""with {PANEL}, p as (select security_id, cast(date_trunc('{period}', session_date) as date) as period_start, min(session_date) as first_day, max(session_date) as period_end,
        arg_min(open, session_date) as open, max(high) as high, min(low) as low, arg_max(close, session_date) as close from resolved group by 1, 2),
        q as (select *, lead(first_day) over (partition by security_id order by period_start) as later from p)
        select security_id, period_start, period_end, open, high, low, close, case when period_end = {last} then period_end else later end as complete_on from q
        where case when period_end = {last} then period_end else later end is not null"""


@query("period_ohlc_week", _period("week"))
def period_ohlc_week(w: World):
    return agg.period_bars(panel(w), "week")


@query("period_ohlc_month", _period("month"))
def period_ohlc_month(w: World):
    return agg.period_bars(panel(w), "month")


@query("adjusted_for_splits", f"""with {PANEL}, {EVENTS}, own as (select distinct e.symbol, e.ex_date, e.factor, r.security_id from events_known e join resolved r on r.symbol = e.symbol),
    around as (select o.security_id, o.symbol, o.ex_date, o.factor, arg_max(r.symbol, r.session_date) filter (where r.session_date < o.ex_date) as before_symbol,
        arg_min(r.symbol, r.session_date) filter (where r.session_date >= o.ex_date) as after_symbol, max(r.session_date) as last_day from own o join resolved r using (security_id) group by 1, 2, 3, 4),
    true_splits as (select * from around where ((after_symbol is not null or date_diff('day', last_day, ex_date) <= 7) and before_symbol = symbol) or after_symbol = symbol)
    select r.security_id, r.symbol, r.session_date, r.close, coalesce(product(t.factor), 1) as divisor from resolved r left join true_splits t on t.security_id = r.security_id and r.session_date < t.ex_date group by 1, 2, 3, 4""")
def adjusted_for_splits(w: World):
    return agg.split_divisors(panel(w).select("security_id", "symbol", "session_date", "close"), pit.splits_as_of(w.splits, AS_OF))


CHOSEN = f"""chosen as (select * from (select *, row_number() over (partition by cik order by case concept when 'cover' then 1 when 'balance' then 2 else 3 end, end_date desc, filed desc, start_date desc nulls last, accn desc) as place
    from [facts] where available_at <= {AT} and date_diff('day', end_date, {NIGHT}) <= 400) x where place = 1)"""


@query("latest_fact_choice", f"with {CHOSEN} select cik, concept, accn, form, end_date, filed, shares from chosen")
def latest_fact_choice(w: World):
    return agg.chosen_fact(w.facts, F.lit("1998-01-30").cast("date"), pit.instant(AS_OF), 400, PRIORITY).select("cik", "concept", "accn", "form", "end_date", "filed", "shares")


SHARES = f"""{MASKED}, {EVENTS}, {CHOSEN}, annual as (select cik, arg_max(form, (filed, accn)) = '20-F' as is_foreign from [facts] where available_at <= {AT} and form in ('10-K', '20-F') group by cik),
    held as (select s.security_id, s.symbol, s.cik, c.concept, c.form, c.end_date, c.filed, c.shares, case when c.concept = 'cover' then c.end_date else c.filed end as unit_day from masked s join chosen c on c.cik = s.cik
        where s.valid_from <= {NIGHT} and {NIGHT} < coalesce(s.valid_to, {FAR})),
    ratios as (select distinct s.security_id, e.ex_date, e.new_rate / e.old_rate as ratio from events_known e join masked s on s.symbol = e.symbol and e.ex_date >= s.valid_from and e.ex_date < coalesce(s.valid_to, {FAR})),
    counted as (select h.*, coalesce((select product(ratio) from ratios r where r.security_id = h.security_id and r.ex_date > h.unit_day and r.ex_date <= {NIGHT}), 1) as split_factor from held h),
    visible_counts as (select security_id, symbol, c.cik, concept, form, end_date, filed, shares * split_factor as shares, split_factor, date_diff('day', end_date, {NIGHT}) as age_days, coalesce(a.is_foreign, form in ('20-F', '6-K')) as ratio_unknown
        from counted c left join annual a on a.cik = c.cik)"""


def shares(w: World):
    return agg.visible_shares(w.facts, pit.masked_segments(w.segments, AS_OF), pit.splits_as_of(w.splits, AS_OF), "1998-01-30", pit.instant(AS_OF), 400, PRIORITY)


@query("visible_shares", f"with {SHARES} select * from visible_counts")
def visible_shares(w: World):
    return shares(w)


LAST_BARS = "last_bars as (select symbol, arg_max(close, session_date) as close from [bars] where volume > 0 and session_date <= date '1998-01-30' group by symbol)"


def caps(w: World):
    last = w.bars.filter("volume > 0 and session_date <= date '1998-01-30'").groupBy("symbol").agg(F.max_by("close", "session_date").alias("close"))
    return shares(w).join(last, "symbol").withColumn("raw_cap", F.col("shares") * F.col("close"))


@query("market_caps", f"with {SHARES}, {LAST_BARS} select security_id, symbol, shares, close, shares * close as raw_cap from visible_counts join last_bars using (symbol)")
def market_caps(w: World):
    return caps(w).select("security_id", "symbol", "shares", "close", "raw_cap")


@query("cap_passes", f"""with {SHARES}, {LAST_BARS}, caps as (select security_id, ratio_unknown, shares * close as raw_cap from visible_counts join last_bars using (symbol)),
    candidates as (select security_id, sum(cast(right(symbol, 1) as integer) + 1) * 1e6 as adv_usd from masked group by security_id)
    select security_id, adv_usd, raw_cap, ratio_unknown, case when raw_cap is not null and not (adv_usd > 0.5 * raw_cap or raw_cap > 5e11) then raw_cap >= case when ratio_unknown then 2e11 else 1e11 end else adv_usd >= 0.5 * 1e11 end as passes
    from candidates left join caps using (security_id)""")
def cap_passes(w: World):
    score = F.sum(F.expr("right(symbol, 1)").cast("int") + 1) * F.lit(1e6)
    return agg.cap_passes(pit.masked_segments(w.segments, AS_OF).groupBy("security_id").agg(score.alias("adv_usd")), caps(w), 1e11, 2e11, 0.5, 5e11)


@query("split_factor_product", "select symbol, ex_date, count(*) as events, product(factor) as net_factor from [splits] group by symbol, ex_date")
def split_factor_product(w: World):
    return w.splits.groupBy("symbol", "ex_date").agg(F.count(F.lit(1)).alias("events"), F.product("factor").alias("net_factor"))


@query("runs_islands", "with d as (select symbol, date_diff('day', date '1992-01-01', session_date) as n from [bars] where volume > 0), g as (select *, case when n - lag(n) over (partition by symbol order by n) <= 3 then 0 else 1 end as s from d), r as (select *, sum(s) over (partition by symbol order by n) as run from g) select symbol, min(n) as first, max(n) as last, count(*) as length from r group by symbol, run")
def runs_islands(w: World):
    days = w.bars.filter("volume > 0").select("symbol", F.datediff("session_date", F.lit("1992-01-01").cast("date")).cast("long").alias("n"))
    return agg.islands(days, ["symbol"], "n", 3)


@query("bars_status", "select year, count(*) as bars, count(distinct symbol) as symbols, min(t) as first_t, max(t) as last_t from [bars] group by year")
def bars_status(w: World):
    return w.bars.groupBy("year").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("name_mode", "select cik, name from (select cik, name, row_number() over (partition by cik order by n desc, seen, name) as place from (select cik, concat(name, snapshot_date) as name, count(*) as n, min(snapshot_date) as seen from [snapshots] group by 1, 2) x) y where place = 1")
def name_mode(w: World):
    return agg.most_common(w.snapshots.withColumn("name", F.concat("name", F.col("snapshot_date").cast("string"))), "cik", "name", "snapshot_date")


@query("copy_share", "with a as (select symbol, count(*) as days from [bars] group by symbol), s as (select a.symbol, count(distinct a.session_date) as same from [bars] a join [bars] b on a.session_date = b.session_date and a.volume = b.volume and a.symbol <> b.symbol group by a.symbol) select symbol, days, coalesce(same, 0) as same, coalesce(same, 0) / days as share from a left join s using (symbol)")
def copy_share(w: World):
    twins = w.bars.groupBy("session_date", "volume").agg(F.collect_set("symbol").alias("all")).filter(F.size("all") > 1)
    same = twins.select("session_date", F.explode("all").alias("symbol")).groupBy("symbol").agg(F.count_distinct("session_date").alias("same"))
    days = w.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"))
    return days.join(same, "symbol", "left").select("symbol", "days", F.coalesce("same", F.lit(0)).cast("long").alias("same"), (F.coalesce("same", F.lit(0)) / F.col("days")).alias("share"))


@query("lists_joined", "select symbol, string_agg(concat(kind, ' ', cast(cast(factor * 10 as bigint) as varchar)), ', ' order by factor, kind) as records, array_to_string(list_sort(list_distinct(list(kind))), '/') as kinds from [splits] group by symbol")
def lists_joined(w: World):
    label = F.concat("kind", F.lit(" "), (F.col("factor") * 10).cast("long").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("factor", "kind", label.alias("s")))), lambda x: x["s"])
    return w.splits.groupBy("symbol").agg(F.array_join(ordered, ", ").alias("records"), F.array_join(F.array_sort(F.collect_set("kind")), "/").alias("kinds"))


@query("median_counts", "select quantile_cont(n, 0.5) as median, count(*) as sessions from (select session_date, count(distinct symbol) as n from [bars] where volume > 0 group by session_date) x")
def median_counts(w: World):
    return w.bars.filter("volume > 0").groupBy("session_date").agg(F.count_distinct("symbol").alias("n")).agg(F.percentile("n", 0.5).alias("median"), F.count(F.lit(1)).alias("sessions"))


@query("closes_around", "select symbol, arg_max(close, session_date) filter (where session_date < date '1996-01-01') as before, arg_min(close, session_date) filter (where session_date >= date '1996-01-01') as after, max(session_date) filter (where session_date < date '1996-01-01') as before_day from [bars] where volume > 0 group by symbol")
def closes_around(w: World):
    cut = F.col("session_date") < F.lit("1996-01-01").cast("date")
    return w.bars.filter("volume > 0").groupBy("symbol").agg(F.max_by("close", F.when(cut, F.col("session_date"))).alias("before"), F.min_by("close", F.when(~cut, F.col("session_date"))).alias("after"), F.max(F.when(cut, F.col("session_date"))).alias("before_day"))


@query("replay_metrics", f"""select run_id, count(*) as trades, count(*) filter (where pnl > 0) as wins, count(*) filter (where pnl > 0) / count(*) as win_rate, {T6.format('avg(r_multiple)')} as mean_r, {T6.format('max(pnl) / nullif(sum(pnl) filter (where pnl > 0), 0)')} as top_share,
    count(*) filter (where exit_reason = 'purchase') as purchases from [trades] group by run_id""")
def replay_metrics(w: World):
    won = F.col("pnl") > 0
    return w.trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(won).alias("wins"), (F.count_if(won) / F.count(F.lit(1))).alias("win_rate"), tidy(F.avg("r_multiple")).alias("mean_r"),
        tidy(F.when(F.sum(F.when(won, F.col("pnl"))) != 0, F.max("pnl") / F.sum(F.when(won, F.col("pnl"))))).alias("top_share"), F.count_if(F.col("exit_reason") == "purchase").alias("purchases"),
    )


@query("calibration_bins", "select case when v < 0.25 then '[0, 0.25)' when v < 0.5 then '[0.25, 0.5)' when v < 0.75 then '[0.5, 0.75)' else '[0.75, 1]' end as bin, count(*) as n, sum(quality)::bigint as correct from (select l.quality, least(d.n_chars / 8000.0, 1.0) as v from documents d join labels l using (doc_id)) x group by 1")
def calibration_bins(w: World):
    v = F.least(F.col("n_chars") / 8000, F.lit(1.0))
    bins = F.when(v < 0.25, "[0, 0.25)").when(v < 0.5, "[0.25, 0.5)").when(v < 0.75, "[0.5, 0.75)").otherwise("[0.75, 1]")
    return w.documents.join(w.labels, "doc_id").groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("correct"))


@query("flip_stats", f"""with c as (select symbol, session_date, close > open as up, lag(close > open) over (partition by symbol order by session_date) as was from [bars] where volume > 0),
    g as (select symbol, session_date, sum(case when was is null or up <> was then 1 else 0 end) over (partition by symbol order by session_date) as spell, case when was is not null and up <> was then 1 else 0 end as flip from c)
    select symbol, sum(flip)::bigint as flips, count(distinct spell) as spells, {T6.format('count(*) / count(distinct spell)')} as mean_spell from g group by symbol""")
def flip_stats(w: World):
    from pyspark.sql import Window

    order = Window.partitionBy("symbol").orderBy("session_date")
    up = F.col("close") > F.col("open")
    rows = w.bars.filter("volume > 0").select("symbol", "session_date", up.alias("up")).withColumn("was", F.lag("up").over(order))
    rows = rows.withColumn("starts", (F.col("was").isNull() | (F.col("up") != F.col("was"))).cast("int")).withColumn("spell", F.sum("starts").over(order))
    flips = F.count_if(F.col("was").isNotNull() & (F.col("up") != F.col("was")))
    return rows.groupBy("symbol").agg(flips.alias("flips"), F.count_distinct("spell").alias("spells"), tidy(F.count(F.lit(1)) / F.count_distinct("spell")).alias("mean_spell"))


@query("top_by_month", f"""with {RESOLVED}, m as (select cast(date_trunc('month', session_date) as date) as "month", security_id, sum(volume)::bigint as volume from resolved group by 1, 2)
    select "month", security_id, volume, place from (select *, row_number() over (partition by "month" order by volume desc, security_id) as place from m) x where place <= 3""")
def top_by_month(w: World):
    from pyspark.sql import Window

    month = F.to_date(F.date_trunc("month", "session_date")).alias("month")
    rows = resolved(w).groupBy(month, "security_id").agg(F.sum("volume").alias("volume"))
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("volume"), "security_id")).cast("long")
    return rows.withColumn("place", place).filter("place <= 3")


@query("attribution", "select run_id, leg, count(*) as trades, floor(sum(cast(pnl * 100 as decimal(20,4))))::bigint as cents, sum(cast(pnl * 100 as decimal(20,4))) > 0 as correct from [trades] group by run_id, leg")
def attribution(w: World):
    cents = F.sum((F.col("pnl") * 100).cast("decimal(20,4)"))
    return w.trades.groupBy("run_id", "leg").agg(F.count(F.lit(1)).alias("trades"), F.floor(cents).cast("long").alias("cents"), (cents > 0).alias("correct"))


@query("realized_curve", f"""with d as (select run_id, session_date, sum(cast(pnl as decimal(20,6))) as pnl from [trades] group by 1, 2), c as (select *, 100000 + sum(pnl) over (partition by run_id order by session_date) as equity from d)
    select run_id, session_date, cast(equity as double) as equity, {T6.format('cast(equity as double) / cast(max(equity) over (partition by run_id order by session_date) as double) - 1')} as drawdown from c""")
def realized_curve(w: World):
    from pyspark.sql import Window

    past = Window.partitionBy("run_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    daily = w.trades.groupBy("run_id", "session_date").agg(F.sum(F.col("pnl").cast("decimal(20,6)")).alias("pnl"))
    rows = daily.withColumn("equity", (F.sum("pnl").over(past) + 100000).cast("double"))
    return rows.select("run_id", "session_date", "equity", tidy(F.col("equity") / F.max("equity").over(past) - 1).alias("drawdown"))
