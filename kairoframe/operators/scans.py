"""Scans: from bars to a night's ranked candidates, by composition of the operators below.

A panel has, for each security and session, the momentum histogram of the daily series and of the latest completed week
and month, with the value before each and how many rows or periods it rests on. All nights come out of one job: the
session is a column, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates, joins, recurrences, windows
from .grouped import scanned
from ..plans.pit import first_of, instant, visible

WARM = {"daily": 40, "weekly": 44, "monthly": 36}


def _histogram(rows: DataFrame, day: str, name: str) -> DataFrame:
    """security_id, day, name, name_prev, name_bars."""
    def start():
        step, before, n = recurrences.histogram(), None, 0

        def run(x: float) -> tuple:
            nonlocal before, n
            n += 1
            value = step(x)
            out, before = (value, before, n), value
            return out

        return run

    return scanned(rows.select("security_id", day, "close"), "security_id", day, ["close"], start, {name: "double", f"{name}_prev": "double", f"{name}_bars": "long"}).drop("close")


def adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars whose prices before a split are divided by its factor."""
    cols = ["security_id", "symbol", "session_date", "open", "high", "low", "close", "volume"]
    d = aggregates.split_divisors(bars.select(*cols), splits)
    return d.select("security_id", "symbol", "session_date", *[(F.col(c) / F.col("divisor")).alias(c) for c in ("open", "high", "low", "close")], "volume")


def rescaled(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars whose prices before an adjusted spin-off are multiplied by its factor, as known at the events' instant; a
    restarted series begins at its last restart."""
    cuts = events.filter("status = 'restart'").groupBy("security_id").agg(F.max("ex_date").alias("_since"))
    kept = bars.join(cuts, "security_id", "left").filter("_since is null or session_date >= _since").drop("_since")
    f = events.filter("status = 'adjust'").select(F.col("security_id").alias("_i"), F.col("ex_date").alias("_e"), "factor")
    rows = kept.join(f, (F.col("_i") == F.col("security_id")) & (F.col("session_date") < F.col("_e")), "left")
    made = rows.groupBy(*kept.columns).agg(F.coalesce(F.product("factor"), F.lit(1.0)).alias("_f"))
    return made.select(*[(F.col(c) * F.col("_f")).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in kept.columns])


def blank_sessions(panel: DataFrame, events: DataFrame) -> DataFrame:
    """panel with `blank`: the session lies between an ex-date and the day the event is decided (for good while pending)."""
    e = events.select(F.col("security_id").alias("_i"), "ex_date", "known_on")
    hit = panel.select("security_id", "session_date").join(e, (F.col("_i") == F.col("security_id")) & (F.col("session_date") >= F.col("ex_date")) & (F.col("known_on").isNull() | (F.col("session_date") < F.col("known_on"))), "left_semi").withColumn("blank", F.lit(True))
    return panel.join(hit.distinct(), ["security_id", "session_date"], "left").withColumn("blank", F.coalesce("blank", F.lit(False)))


def momentum_panel(bars: DataFrame) -> DataFrame:
    """One row for each security and session of bars (already adjusted, one row each)."""
    panel = _histogram(bars, "session_date", "bx_daily")
    for name, period in (("bx_weekly", "week"), ("bx_monthly", "month")):
        done = aggregates.period_bars(bars, period)
        values = _histogram(done, "complete_on", name)
        panel = joins.as_of_backward(panel, values, "security_id", "session_date", "complete_on", [name, f"{name}_prev", f"{name}_bars"])
    return panel


def eligible(panel: DataFrame, tier: DataFrame) -> DataFrame:
    """Rows of the tier's securities with all values defined and enough history behind each."""
    ok = F.col("bx_daily").isNotNull() & F.col("bx_daily_prev").isNotNull() & F.col("bx_weekly").isNotNull() & F.col("bx_monthly").isNotNull()
    for name, least in WARM.items():
        ok = ok & (F.col(f"bx_{name}_bars") >= least)
    return panel.join(tier.select("security_id").distinct(), "security_id", "left_semi").filter(ok)


def rising(panel: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions on which the weekly value rises and the daily one turns up from below zero, ranked by the rise."""
    rise = F.col("bx_daily") - F.col("bx_daily_prev")
    rows = panel.filter((F.col("bx_weekly") > F.col("bx_weekly_prev")) & (rise > 0) & (F.col("bx_daily_prev") < 0))
    rank = F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc("_rise"), "security_id")).cast("long")
    rows = rows.withColumn("_rise", rise).withColumn("place", rank).withColumnRenamed("_rise", "rise")
    return rows.filter(F.col("place") <= limit) if limit else rows


def market_open(index: DataFrame, n: int) -> DataFrame:
    """session_date, above: whether the market's index closed above its mean over n sessions."""
    return windows.above_mean(index, n, "security_id").select("session_date", "above")


def gap_scan(bars: DataFrame, events: DataFrame, splits: DataFrame, gap: float, rvol: float, price: float, money: float) -> DataFrame:
    """Gaps up on an event's reaction session: large enough against the day before and the volume's usual, at a price and
    turnover that can be traded, the day before traded, and no split within the window that the volume's usual rests on."""
    rows = windows.daily_features(bars).join(events.select("security_id", "session_date").distinct(), ["security_id", "session_date"], "left_semi")
    rows = rows.filter((F.col("gap") >= gap - 1e-9) & (F.col("rvol") >= rvol - 1e-9) & (F.col("open") >= price - 1e-9) & (F.col("avg_dollar_volume") >= money - 1e-6))
    s = splits.select(F.col("symbol").alias("_s"), F.col("ex_date").alias("_e")).distinct()
    return rows.join(s, (F.col("_s") == F.col("symbol")) & F.col("_e").between(F.date_sub("session_date", 28), F.col("session_date")), "left_anti")


def reaction_sessions(filings: DataFrame, sessions: DataFrame, opens: Column) -> DataFrame:
    """filings with the first session that opens after they became known."""
    return joins.first_after(filings, "available_at", sessions.select("session_date").withColumn("_opens", opens), "_opens", "session_date")


def latest_filers(filings: DataFrame, segments: DataFrame, as_of: str) -> DataFrame:
    """The latest filing known at the instant of each security that a visible segment links to its filer.

    A security's latest filing is the latest of one of its filers, so filings are cut to one a filer before the join.
    """
    order = [F.desc("available_at"), F.desc("accn")]
    links = segments.filter((F.col("available_at") <= instant(as_of)) & (F.col("cik_available_at") <= instant(as_of))).select("security_id", "cik").distinct()
    return first_of(first_of(visible(filings, as_of), ["cik"], order).join(links, "cik"), ["security_id"], order)


def trend_panel(bars: DataFrame, events: DataFrame, length: int, least: int, last: int | None = None) -> DataFrame:
    """bars (one row a security and session) with fair value, bands and colour over spin-offs: levels before an adjusted one are
    rescaled, a restarted series begins anew, and sessions between an ex-date and its settlement have none."""
    made = windows.sticky_colour(windows.crossing_medians(windows.fair_value(rescaled(bars, events), length), last), least)
    panel = blank_sessions(made, events)
    return panel.select("security_id", "session_date", *[F.when(~F.col("blank"), F.col(c)).alias(c) for c in ("fv", "hu", "ld", "colour")])
