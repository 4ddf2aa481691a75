"""Evaluation of runs: pools, null families, entry tests, re-entries, curves and benchmarks.

Spans (variant, key, security_id, entry_session, exit_session, exit_at, ret) meet the pool of the evening before their
entry. A member's return depends on the sessions alone, so pools are priced once for each window (entry, exit), by joins,
and all spans of a window draw from the one pool, whatever their variant; pairs of spans and members are never laid out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, statistics, windows
from ..session import cut

SPAN = ("variant", "key", "entry_session", "exit_session", "exit_at")
WINDOW = SPAN[2:]


def numbered(calendar: DataFrame) -> DataFrame:
    """session_date, idx (from 1): a calendar."""
    return calendar.select("session_date").distinct().select("session_date", F.row_number().over(Window.orderBy("session_date")).cast("long").alias("idx"))


def spans_of_trades(trades: DataFrame, variant: str = "run_id") -> DataFrame:
    """Closed legs as spans: a fill at 09:30 in New York is at the open, others at the close. ret is pnl over cost."""
    entry, exit_ = (F.from_utc_timestamp(c, "America/New_York") for c in ("entry_at", "exit_at"))
    key = F.concat_ws(":", "security_id", F.to_date(entry).cast("string"), F.col("leg").cast("string"))
    at = F.when(F.date_format(exit_, "HH:mm:ss") == "09:30:00", "open").otherwise("close")
    return trades.select(F.col(variant).cast("string").alias("variant"), key.alias("key"), "security_id", F.to_date(entry).alias("entry_session"), F.to_date(exit_).alias("exit_session"), at.alias("exit_at"), (F.col("pnl") / (F.col("shares") * F.col("entry_price"))).alias("ret"))


def entries_of_run(decisions: DataFrame, calendar: DataFrame) -> DataFrame:
    """run_id, security_id, session_date: filled long decisions enter the first session after their evening; one on the last session has none yet."""
    rows = decisions.filter("direction = 'long' and security_id is not null and not cancelled")
    evening = F.to_date(F.from_utc_timestamp("as_of", "America/New_York")).cast("timestamp_ntz")
    days = calendar.select("session_date").distinct().withColumn("_opens", F.col("session_date").cast("timestamp_ntz"))
    found = joins.first_after(rows.select("run_id", "security_id", evening.alias("_evening")), "_evening", days, "_opens", "session_date")
    return found.filter("session_date is not null").select("run_id", "security_id", "session_date").distinct()


def undecided(trades: DataFrame, entries: DataFrame) -> DataFrame:
    """Legs that were entered without a decision the evening before: a replay's record is broken."""
    day = F.to_date(F.from_utc_timestamp("entry_at", "America/New_York")).alias("session_date")
    return trades.select("run_id", "security_id", day).distinct().join(entries, ["run_id", "security_id", "session_date"], "left_anti")


def pools_for(spans: DataFrame, calendar: DataFrame, members: DataFrame) -> DataFrame:
    """spans, or windows alone, with each member (session_date, member) of the pool of the session before the entry."""
    days = numbered(calendar)
    evening = days.select(F.col("session_date").alias("entry_session"), (F.col("idx") - 1).alias("idx")).join(days.withColumnRenamed("session_date", "_evening"), "idx").drop("idx")
    pool = members.select(F.col("session_date").alias("_evening"), "member")
    return spans.select(*[c for c in SPAN if c in spans.columns]).distinct().join(evening, "entry_session").join(pool, "_evening").drop("_evening")


def held_through(entry: Column, exit_: Column, ex_date: Column) -> Column:
    """Bought before an ex-date and sold at or after its open."""
    return (entry < ex_date) & (ex_date <= exit_)


def priced(pools: DataFrame, prices: DataFrame, splits: DataFrame, children: DataFrame, restarts: DataFrame, bps: float) -> DataFrame:
    """pools (of spans or of windows) with ret (null: no price at one end) and crossed: the return of each member over each.

    prices: security_id, session_date, open, close; splits: security_id, ex_date, factor; children: security_id, ex_date,
    paid (for a share held then); restarts: security_id, ex_date of spin-offs that could not be priced.
    """
    a = prices.select(F.col("security_id").alias("member"), F.col("session_date").alias("entry_session"), F.col("open").alias("_in"))
    z = prices.select(F.col("security_id").alias("member"), F.col("session_date").alias("exit_session"), F.col("open").alias("_o"), F.col("close").alias("_c"))
    rows = pools.join(a, ["member", "entry_session"], "left").join(z, ["member", "exit_session"], "left").withColumn("_out", F.when(F.col("exit_at") == "open", F.col("_o")).otherwise(F.col("_c")))
    spans = rows.select("member", "entry_session", "exit_session").distinct()
    through = held_through(F.col("entry_session"), F.col("exit_session"), F.col("ex_date"))
    crossed = lambda events, *more: spans.join(events.select(F.col("security_id").alias("member"), "ex_date", *more), "member").filter(through)
    key = ["member", "entry_session", "exit_session"]
    cut = crossed(splits, "factor").groupBy(*key, "ex_date").agg(F.product("factor").alias("factor"))
    factor = cut.groupBy(*key).agg(F.product("factor").alias("_factor"))
    # A child's ratio is for a share held at its ex-date, after the splits up to it.
    kids = crossed(children, "paid").alias("k").join(cut.select(*key, F.col("ex_date").alias("_split"), "factor"), key, "left")
    kids = kids.groupBy(*key, "ex_date", "paid").agg(F.coalesce(F.product(F.when(F.col("_split") <= F.col("ex_date"), F.col("factor")).otherwise(1.0)), F.lit(1.0)).alias("_f"))
    kids = kids.groupBy(*key).agg(F.sum(F.col("paid") * F.col("_f")).alias("_child"))
    lost = crossed(restarts).select(*key).distinct().withColumn("crossed", F.lit(True))
    rows = rows.join(factor, key, "left").join(kids, key, "left").join(lost, key, "left")
    ret = statistics.leg_return(F.col("_in"), F.col("_out"), F.coalesce("_factor", F.lit(1.0)), F.coalesce("_child", F.lit(0.0)), bps)
    return rows.select(*[c for c in SPAN if c in pools.columns], "member", ret.alias("ret"), F.coalesce("crossed", F.lit(False)).alias("crossed"))


def family_nulls(panel: DataFrame, permutations: int, seed: int) -> DataFrame:
    """perm, variant, key, ret, crossed: for every span, a drawn member's return in each permutation."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        at = statistics.picks(pdf["key"].iloc[0], (~pdf["ret"].isna()).tolist(), permutations, seed)
        return pd.DataFrame({"perm": range(permutations), "variant": pdf["variant"].iloc[0], "key": pdf["key"].iloc[0], "ret": pdf["ret"].to_numpy()[at], "crossed": pdf["crossed"].to_numpy()[at]})

    return panel.groupBy("variant", "key").applyInPandas(draw, "perm long, variant string, key string, ret double, crossed boolean")


def restart_crossings(null: DataFrame) -> DataFrame:
    """variant, crossings: draws that held a member through a spin-off on raw prices."""
    return null.groupBy("variant").agg(F.count_if("crossed").alias("crossings"))


def null_sums(spans: DataFrame, panel: DataFrame, permutations: int, seed: int) -> DataFrame:
    """variant, key, perm, n, s, q: number, sum and sum of squares of the draws of family_nulls, by span (perm is null) and,
    for each part of a window's spans, by permutation (key is null). The draws themselves never leave their task.

    panel: priced pools of windows, or of spans.
    """
    on = [c for c in SPAN if c in panel.columns]

    def draw(made: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        made, members = made.drop_duplicates(["variant", "key"]), members.sort_values("member")
        if not len(members):
            made = made[:0]
        values = members["ret"].to_numpy(float)
        at = statistics.all_picks(made["key"], ~np.isnan(values), permutations, seed)
        rets, variants = values[at], made["variant"].to_numpy(object)
        out = [pd.DataFrame({"variant": variants, "key": made["key"].to_numpy(object), "perm": pd.array([None] * len(made), "Int64"), "n": permutations, "s": rets.sum(axis=1), "q": (rets**2).sum(axis=1)})]
        for v in sorted(set(variants)):
            own = rets[variants == v]
            out.append(pd.DataFrame({"variant": v, "key": None, "perm": pd.array(range(permutations), "Int64"), "n": len(own), "s": own.sum(axis=0), "q": (own**2).sum(axis=0)}))
        return pd.concat([x for x in out if len(x)] or out)

    both = statistics.with_pools(spans.select(*SPAN), panel.select(*on, "member", "ret"), on)
    return both.applyInPandas(draw, "variant string, key string, perm long, n long, s double, q double")


def null_means(sums: DataFrame) -> DataFrame:
    """variant, perm, m: each permutation's mean."""
    return sums.filter("key is null").groupBy("variant", "perm").agg((F.sum("s") / F.sum("n")).alias("m"))


def null_test(spans: DataFrame, panel: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Each variant's trades against random members of its pools, corrected for the best of the family."""
    means = cut(null_means(null_sums(spans, panel, permutations, seed)))
    return statistics.max_of_means(cut(spans.select("variant", "ret")), means)


def entry_spans(entries: DataFrame, prices: DataFrame, calendar: DataFrame, holds: Sequence[int], last: str, bps: float) -> DataFrame:
    """Entries (variant, security_id, session_date) held a fixed number of sessions: spans of the priced ones, a variant a hold."""
    out, days = None, numbered(calendar)
    for h in holds:
        rows = statistics.fixed_hold(entries.select("security_id", "session_date").distinct(), prices, days, h, last, bps).filter("status = 'held'").join(entries, ["security_id", "session_date"])
        key = F.concat_ws(":", "security_id", F.col("session_date").cast("string"), F.lit("fixed"))
        made = rows.select(F.concat_ws(":", "variant", F.lit(str(h))).alias("variant"), key.alias("key"), "security_id", F.col("session_date").alias("entry_session"), F.col("exit_day").alias("exit_session"), F.lit("open").alias("exit_at"), "ret", F.lit(h).alias("hold"))
        out = made if out is None else out.unionByName(made)
    return out


def entry_test(spans: DataFrame, panel: DataFrame, calendar: DataFrame, permutations: int, seed: int, draws: int = 2000) -> DataFrame:
    """null_test of entry spans with the excess over each span's own null mean and its interval over clusters of whole holds."""
    null, spans = cut(null_sums(spans, panel, permutations, seed)), cut(spans)  # each is looked at several times
    own = null.filter("perm is null").select("variant", "key", (F.col("s") / F.col("n")).alias("_null"))
    days = numbered(calendar).select(F.col("session_date").alias("entry_session"), "idx")
    rows = spans.join(own, ["variant", "key"]).join(days, "entry_session").withColumn("excess", F.col("ret") - F.col("_null")).withColumn("cluster", F.floor((F.col("idx") - 1) / F.col("hold")))
    interval = statistics.bootstrap(rows, "variant", "excess", "cluster", draws, seed).select("variant", F.col("low").alias("excess_low"), F.col("high").alias("excess_high"))
    mean = F.sum("s") / F.sum("n")
    spread = null.filter("key is null").groupBy("variant").agg(F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("_b"))
    sd = spans.groupBy("variant").agg(F.stddev_pop("ret").alias("_a")).join(spread, "variant").select("variant", (F.col("_a") / F.col("_b")).alias("sd_ratio"))
    return statistics.max_of_means(spans.select("variant", "ret"), null_means(null)).join(interval, "variant").join(sd, "variant")


def pool_excess(spans: DataFrame, panel: DataFrame) -> DataFrame:
    """spans with excess over the mean of their pool's priced members."""
    mean = panel.groupBy("variant", "key").agg(F.avg("ret").alias("_pool"))
    return spans.join(mean, ["variant", "key"]).withColumn("excess", F.col("ret") - F.col("_pool")).drop("_pool")


def reentry_difference(excess: DataFrame, closes: DataFrame, calendar: DataFrame, within: int, draws: int, seed: int) -> DataFrame:
    """variant, mean, low, high: excess of entries that buy back what was sold 1 to `within` sessions before, less the others'."""
    days = numbered(calendar)
    rows = statistics.reentries(excess.withColumnRenamed("entry_session", "session_date"), closes, days, within).join(days, "session_date")
    both = rows.groupBy("variant").agg(F.count_if("reentry").alias("_a"), F.count_if(~F.col("reentry")).alias("_b")).filter("_a > 0 and _b > 0").select("variant")
    rows = rows.join(both, "variant", "left_semi").withColumn("cluster", F.floor((F.col("idx") - 1) / F.col("hold")))
    return statistics.bootstrap(rows, "variant", "excess", "cluster", draws, seed, flag="reentry")


def tertile_excess(excess: DataFrame, ranked: DataFrame, calendar: DataFrame, draws: int, seed: int) -> DataFrame:
    """tertile (0, 1, 2, or -1: first less last), mean, low, high of the excess by the rank in the night's list.

    ranked: session_date (the night), security_id, rank; entries are on the session after the night.
    """
    days = numbered(calendar)
    nights = days.select(F.col("session_date").alias("_night"), (F.col("idx") + 1).alias("idx")).join(days, "idx").select("_night", F.col("session_date").alias("entry_session"), "idx")
    thirds = windows.rank_tertile(ranked, "session_date", [F.col("rank"), F.col("security_id")]).select(F.col("session_date").alias("_night"), "security_id", "tertile")
    rows = excess.join(nights, "entry_session").join(thirds, ["_night", "security_id"]).withColumn("cluster", F.floor((F.col("idx") - 1) / F.col("hold")))
    each = statistics.bootstrap(rows, "tertile", "excess", "cluster", draws, seed)
    ends = rows.filter("tertile <> 1").withColumn("_first", F.col("tertile") == 0).withColumn("tertile", F.lit(-1).cast("long"))
    return each.unionByName(statistics.bootstrap(ends, "tertile", "excess", "cluster", draws, seed, flag="_first"))


def equity_slice(marks: DataFrame, start: Column, end: Column, initial: Column) -> DataFrame:
    """run_id, session_date, equity within [start, end], and base: the equity just before the first row, else the run's initial one."""
    w = Window.partitionBy("run_id").orderBy("session_date")
    rows = marks.withColumn("_before", F.lag("equity").over(w)).filter((F.col("session_date") >= start) & (F.col("session_date") <= end))
    base = F.first("_before").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("base", F.coalesce(base, initial)).drop("_before")


def basket_curve(members: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """session_date, equity of an equal-weight basket that starts at 1 and is dealt anew at each rebalancing's close.

    members: session_date (of the rebalancing), security_id; bars: security_id, session_date, close (adjusted). Between two
    rebalancings the equity is the mean of the members' closes against the first's; a missing close stands at the last one.
    """
    dates = members.select("session_date").distinct()
    w = Window.orderBy("session_date")  # rebalancings: a row a month
    spans = dates.select(F.col("session_date").alias("_from"), F.lead("session_date").over(w).alias("_to"))
    held = members.select(F.col("session_date").alias("_from"), "security_id").join(spans, "_from")
    days = calendar.select("session_date").distinct()
    grid = held.join(days, (F.col("session_date") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("session_date") <= F.col("_to"))))
    rows = grid.join(bars.select("security_id", "session_date", "close"), ["security_id", "session_date"], "left")
    along = Window.partitionBy("_from", "security_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.last("close", ignorenulls=True).over(along)).withColumn("_ratio", F.col("_c") / F.first("close").over(along))
    growth = rows.groupBy("_from", "_to", "session_date").agg(F.avg("_ratio").alias("g"))
    ends = growth.filter("session_date = _to").select("_from", "g")
    chain = dates.select(F.col("session_date").alias("_from")).join(ends, "_from", "left")
    before = chain.select("_from", F.coalesce(F.product("g").over(Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("_start"))
    made = growth.join(before, "_from").filter("_to is null or session_date < _to")
    return made.select("session_date", (F.col("_start") * F.col("g")).alias("equity"))


def benchmark_curves(singles: DataFrame, basket: DataFrame, label: str) -> DataFrame:
    """label, session_date, equity of single holdings (symbol, session_date, equity) and the basket, one below another."""
    return singles.select(F.col("symbol").alias("label"), "session_date", "equity").unionByName(basket.select(F.lit(label).alias("label"), "session_date", "equity"))
