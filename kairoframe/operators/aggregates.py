"""Aggregates over point-in-time rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pit import first_of, within


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded half up by floor, which does not depend on the engine. From 2 ** 52 on a double is whole: Spark's floor, a
    long, would cut it off at the greatest long (and turn NaN into 0)."""
    scale = float(10**digits)
    moved = x * F.lit(scale) + F.lit(0.5)
    return F.when(F.abs(moved) < F.lit(2.0**52), F.floor(moved).cast("double")).otherwise(moved) / F.lit(scale)


def dollar_volume(bars: DataFrame, sessions: DataFrame, key: str = "security_id") -> DataFrame:
    """key, adv_usd, sessions_traded: money traded on the sessions, over their number (not over days traded)."""
    window = F.broadcast(sessions.select("session_date", F.count(F.lit(1)).over(Window.partitionBy()).alias("_n")))  # the caller bounds the sessions
    usd = F.coalesce("vwap", "close") * F.col("volume")
    traded = F.count_distinct(F.when(F.col("volume") > 0, F.col("session_date")))
    return bars.join(window, "session_date").groupBy(key).agg((F.sum(usd) / F.max("_n")).alias("adv_usd"), traded.alias("sessions_traded"))


def latest_segment(segments: DataFrame) -> DataFrame:
    return first_of(segments, ["security_id"], [F.desc("valid_from"), F.col("symbol")])


def liquid_tier(bars: DataFrame, sessions: DataFrame, segments: DataFrame, classes: DataFrame, least: float, kept: Sequence[str] | None) -> DataFrame:
    """Securities that trade more than `least` a session, with the class of their latest segment."""
    named = latest_segment(segments).select("security_id", "symbol", "valid_from").join(classes.select("security_id", "symbol", "valid_from", "class"), ["security_id", "symbol", "valid_from"])
    if kept is not None:
        named = named.filter(F.col("class").isin(list(kept)))
    return dollar_volume(bars, sessions).filter(F.col("adv_usd") > least).join(named, "security_id").select("security_id", "symbol", "class", "adv_usd", "sessions_traded")


def monthly_tier(bars: DataFrame, start: str, end: str, last: int, least: float) -> DataFrame:
    """month, security_id, adv_usd for every month start in one job: each takes the last sessions known before it."""
    months = bars.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    days = bars.select("session_date").distinct()
    known = months.join(days, F.col("session_date") < F.col("month"))  # a calendar against a calendar: both are bounded by days
    near = known.withColumn("_back", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("session_date")))).filter(F.col("_back") <= last)
    near = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("month"))).drop("_back")
    usd = F.coalesce("vwap", "close") * F.col("volume")
    return bars.join(F.broadcast(near), "session_date").groupBy("month", "security_id").agg((F.sum(usd) / F.max("_n")).alias("adv_usd")).filter(F.col("adv_usd") > least)


def period_bars(bars: DataFrame, period: str) -> DataFrame:
    """Calendar weeks ('week') or months ('month') that are over: first open, high, low, last close, and the day from
    which the period is known to be complete: its last weekday if that was traded, else the security's next session."""
    start = F.to_date(F.date_trunc(period, "session_date"))
    made = bars.withColumn("period_start", start).groupBy("security_id", "period_start").agg(
        F.min("session_date").alias("_first"), F.max("session_date").alias("period_end"), F.min_by("open", "session_date").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "session_date").alias("close"),
    )
    last = F.date_add("period_start", 4) if period == "week" else F.last_day("period_start")
    weekday = F.weekday(last)  # Monday is 0
    last = F.date_sub(last, F.greatest(F.lit(0), weekday - 4))
    after = F.lead("_first").over(Window.partitionBy("security_id").orderBy("period_start"))
    made = made.withColumn("complete_on", F.when(F.col("period_end") == last, F.col("period_end")).otherwise(after))
    return made.filter("complete_on is not null").drop("_first")


def split_divisors(bars: DataFrame, splits: DataFrame, stale_days: int = 7) -> DataFrame:
    """bars (security_id, symbol, session_date, prices) with `divisor`, the product of the factors of later splits.

    A split of a symbol belongs to a security whose last bar before the day or first bar from the day on has that
    symbol; a security without a bar from the day on must have traded within stale_days of it.
    """
    events = splits.select(F.col("symbol").alias("_symbol"), F.col("ex_date").alias("_ex"), "factor")
    holders = bars.select("security_id", F.col("symbol").alias("_symbol")).distinct()
    owned = events.join(holders, "_symbol").withColumn("_event", F.xxhash64("_symbol", "_ex", "factor"))
    around = owned.join(bars.select("security_id", "symbol", "session_date"), "security_id").groupBy("security_id", "_symbol", "_ex", "factor").agg(
        F.max_by("symbol", F.when(F.col("session_date") < F.col("_ex"), F.col("session_date"))).alias("_before"),
        F.min_by("symbol", F.when(F.col("session_date") >= F.col("_ex"), F.col("session_date"))).alias("_after"),
        F.max("session_date").alias("_last"),
    )
    alive = F.col("_after").isNotNull() | (F.datediff("_ex", "_last") <= stale_days)
    true = around.filter((alive & (F.col("_before") == F.col("_symbol"))) | (F.col("_after") == F.col("_symbol"))).select(F.col("security_id").alias("_sid"), "_ex", "factor")
    # From the few splits: one interval for each, from the split before it to its own day, with the product from it on.
    days = true.groupBy("_sid", "_ex").agg(F.product("factor").alias("_f"))
    last = Window.partitionBy("_sid").orderBy(F.desc("_ex")).rowsBetween(Window.unboundedPreceding, 0)
    spans = days.select("_sid", "_ex", F.product("_f").over(last).alias("_product"), F.lag("_ex").over(Window.partitionBy("_sid").orderBy("_ex")).alias("_from"))
    inside = (F.col("session_date") < F.col("_ex")) & (F.col("_from").isNull() | (F.col("session_date") >= F.col("_from")))
    joined = bars.join(spans, (bars["security_id"] == F.col("_sid")) & inside, "left")
    return joined.select(*bars.columns, F.coalesce("_product", F.lit(1.0)).alias("divisor"))


def chosen_fact(facts: DataFrame, night: Column, as_of: Column, max_age_days: int, priority: Sequence[str]) -> DataFrame:
    """One fact for each filer: best concept, then latest end, filing and start, then accession."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("concept"))
    rows = facts.filter((F.col("available_at") <= as_of) & (F.datediff(night, "end_date") <= max_age_days) & (rank > 0))
    order = [rank, F.desc("end_date"), F.desc("filed"), F.desc_nulls_last("start_date"), F.desc("accn")]
    return first_of(rows, ["cik"], order)


def foreign_filer(facts: DataFrame, as_of: Column) -> DataFrame:
    """cik, foreign: whether the latest annual report known is one of a foreign private issuer (null: none yet)."""
    annual = facts.filter((F.col("available_at") <= as_of) & F.col("form").isin("10-K", "20-F"))
    return annual.groupBy("cik").agg((F.max_by("form", F.struct("filed", "accn")) == "20-F").alias("foreign"))


def visible_shares(facts: DataFrame, segments: DataFrame, splits: DataFrame, day: str, as_of: Column, max_age_days: int, priority: Sequence[str]) -> DataFrame:
    """A usable share count for each security that a segment names on the day, restated for splits since its unit."""
    night = F.lit(day).cast("date")
    held = segments.filter(within(night, F.col("valid_from"), F.col("valid_to")) & F.col("cik").isNotNull()).select("security_id", "symbol", "cik")
    best = chosen_fact(facts, night, as_of, max_age_days, priority).select("cik", "concept", "form", "end_date", "filed", "shares")
    best = best.withColumn("unit_day", F.when(F.col("concept") == priority[0], F.col("end_date")).otherwise(F.col("filed")))
    rows = held.join(best, "cik").join(foreign_filer(facts, as_of), "cik", "left")
    spl = segments.select("security_id", F.col("symbol").alias("_s"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    ratios = splits.join(spl, (splits["symbol"] == F.col("_s")) & within(splits["ex_date"], F.col("_f"), F.col("_t"))).select(F.col("security_id").alias("_sid"), "ex_date", (F.col("new_rate") / F.col("old_rate")).alias("_ratio")).distinct()
    joined = rows.join(ratios, (rows["security_id"] == F.col("_sid")) & (F.col("ex_date") > F.col("unit_day")) & (F.col("ex_date") <= night), "left")
    made = joined.groupBy(*rows.columns).agg(F.coalesce(F.product("_ratio"), F.lit(1.0)).alias("split_factor"))
    unknown = F.coalesce("foreign", F.col("form").isin("20-F", "6-K"))
    return made.select("security_id", "symbol", "cik", "concept", "form", "end_date", "filed", (F.col("shares") * F.col("split_factor")).alias("shares"), "split_factor", F.datediff(night, "end_date").cast("long").alias("age_days"), unknown.alias("ratio_unknown"))


def market_caps(shares: DataFrame, bars: DataFrame, day: str) -> DataFrame:
    close = bars.filter(F.col("session_date") == F.lit(day).cast("date")).select("security_id", "close")
    return shares.join(close, "security_id").withColumn("raw_cap", F.col("shares") * F.col("close"))


def cap_passes(candidates: DataFrame, caps: DataFrame, least: float, least_unknown: float, turnover: float, most: float) -> DataFrame:
    """candidates (security_id, adv_usd) with `passes`: a plausible cap that is large enough, or without one enough trade."""
    rows = candidates.join(caps.select("security_id", "raw_cap", "ratio_unknown"), "security_id", "left")
    bad = (F.col("adv_usd") > turnover * F.col("raw_cap")) | (F.col("raw_cap") > most)
    usable = F.col("raw_cap").isNotNull() & ~bad
    enough = F.col("raw_cap") >= F.when(F.col("ratio_unknown"), F.lit(least_unknown)).otherwise(F.lit(least))
    return rows.withColumn("passes", F.when(usable, enough).otherwise(F.col("adv_usd") >= turnover * least))


def islands(rows: DataFrame, keys: Sequence[str], index: str, gap: int = 1) -> DataFrame:
    """Runs of consecutive index values: keys, first, last, length; a step over `gap` starts a new run."""
    w = Window.partitionBy(*keys).orderBy(index)
    starts = F.when(F.col(index) - F.lag(index).over(w) <= gap, 0).otherwise(1)
    runs = rows.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def most_common(rows: DataFrame, key: str, value: str, first_seen: str) -> DataFrame:
    """A key's most common value; ties go to the one seen first."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(first_seen).alias("_seen"))
    return first_of(counted, [key], [F.desc("_n"), F.col("_seen"), F.col(value)]).select(key, value)


def curve_metrics(equity: DataFrame, key: str, day: str, value: str, per_year: int = 252) -> DataFrame:
    """Total and annualised return, largest drawdown and Sharpe ratio of each curve."""
    w = Window.partitionBy(key).orderBy(day)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_peak", F.max(value).over(past)).withColumn("_dd", F.col(value) / F.col("_peak") - 1)
    made = rows.groupBy(key).agg(
        F.min_by(value, day).alias("_a"), F.max_by(value, day).alias("_z"), F.count("_r").alias("days"), F.min("_dd").alias("max_drawdown"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s")
    )
    total = F.col("_z") / F.col("_a") - 1
    annual = F.when(F.col("days") > 0, F.pow(F.col("_z") / F.col("_a"), F.lit(float(per_year)) / F.col("days")) - 1)
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(per_year))))
    return made.select(key, "days", total.alias("total_return"), annual.alias("annual_return"), "max_drawdown", sharpe.alias("sharpe"))
