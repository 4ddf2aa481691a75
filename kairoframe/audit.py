"""Data-quality audits: one DataFrame for each check, with the key of every offending row and whether it is liquid.

A check is a plain relational query over a `Store` of relations that are already cut at the audit's instant. `run`
adds the exceptions that people have granted and the gate: a check fails if any row (gate 'all') or any liquid row
(gate 'liquid') is not excepted; the others are listed only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import joins, spinoffs, windows
from .operators.aggregates import visible_shares
from .plans import pit

# The checks' thresholds.
GAP_SESSIONS, JUMP, CONTINUOUS, CONTINUOUS_DAYS = 10, 3.0, (0.8, 1.25), 10
SPLIT_TOLERANCE, SPLIT_LATE, SPLIT_TRADED, NEAR = 0.35, 2, 3, 3
COPY_DAYS, COPY_SHARE, DUP_DAYS, DUP_VOLUME, SPARSE = 3, 0.10, 2, 10, 0.10
BACK, THIN, STALE, LAG_DAYS, LIQUID_DAYS = (0.5, 2.0), 100, 10, 30, 92
TWIN, TWIN_ABS, SHELF, MIN_SNAPSHOTS, RELABEL = 1e-6, 1e-6, 20, 1, (0.10, 0.90)
COMPANY_FORMS, EXCHANGES = ("10-K", "10-Q", "20-F", "40-F"), ("NYSE", "Nasdaq")
SHARE_AGE, TURNOVER, MAX_CAP, PRIORITY = 400, 0.5, 5e11, ("cover", "balance", "average")

GATES = {
    "P1": "all", "P2": "all", "P3": "all", "P4": "all", "P5": "all", "P6": "all", "M1": "all", "M2": "liquid", "M3": None, "M4": "all", "M5": "liquid", "M6": "liquid", "M7": "liquid",
    "M8": None, "M9": "liquid", "I1": None, "I2": "liquid", "I3": "liquid", "I4": None, "I5": None, "I6": None, "I7": "all", "I8": None, "I9": None, "I10": None, "I12": "all",
    "S1": "liquid", "S2": "liquid", "S3": "liquid", "S4": None, "S5": "all", "S6": None, "D1": None, "N1": None, "N2": None, "N3": None, "C1": None, "C2": "all", "F1": None, "F2": None,
}


@dataclass
class Store:
    """Relations as of the instant. raw: all bars, imports in place; resolved: traded bars with their security."""

    as_of: str
    raw: DataFrame
    resolved: DataFrame
    master: DataFrame
    master_file: DataFrame
    classes: DataFrame
    splits: DataFrame
    dividends: DataFrame
    renames: DataFrame
    listings: DataFrame
    spinoffs: DataFrame
    facts: DataFrame
    conflicts: DataFrame
    listed: DataFrame
    calendar: DataFrame
    vendor_keys: DataFrame
    tier: DataFrame
    liquid: DataFrame

    @cached_property
    def sessions(self) -> DataFrame:
        return windows.session_index(self.raw, NEAR)

    @cached_property
    def traded(self) -> DataFrame:
        return windows.neighbours(self.raw, self.sessions)

    @cached_property
    def liquid_symbols(self) -> DataFrame:
        return self.master.join(self.liquid, "security_id", "left_semi").select("symbol").distinct()

    @cached_property
    def split_events(self) -> DataFrame:
        return self.splits.select("symbol", "ex_date", "kind", "factor").distinct()

    @cached_property
    def split_owners(self) -> DataFrame:
        """symbol, ex_date, security_id (the segment of the day, else the one that ends that day), ex_idx."""
        days = self.splits.select(F.col("symbol").alias("_s"), "ex_date").distinct()
        far = F.lit(pit.FAR).cast("date")
        rows = days.join(self.master, (F.col("symbol") == F.col("_s")) & (F.col("valid_from") <= F.col("ex_date")) & (F.coalesce("valid_to", far) >= F.col("ex_date")), "left")
        owner = pit.first_of(rows, ["_s", "ex_date"], [(F.col("valid_to") == F.col("ex_date")).asc_nulls_first(), F.desc("valid_from")]).select(F.col("_s").alias("symbol"), "ex_date", "security_id")
        numbered = self.sessions.select("session_date", F.col("idx").alias("ex_idx"), F.lit(1).alias("_all"))
        at = joins.as_of_forward(owner.select("ex_date").distinct().withColumn("_all", F.lit(1)), numbered, "_all", "ex_date", "session_date", ["session_date", "ex_idx"]).select("ex_date", "ex_idx")
        return owner.join(at, "ex_date")


def day(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def by_symbol(store: Store, rows: DataFrame, *symbols: str) -> DataFrame:
    """rows with in_liquid: any of the symbol columns belongs to a liquid security."""
    flag, kept = F.lit(False), list(rows.columns)
    for i, s in enumerate(symbols):
        marks = store.liquid_symbols.select(F.col("symbol").alias(f"_l{i}"))
        rows = rows.join(marks, rows[s] == F.col(f"_l{i}"), "left")
        flag = flag | F.col(f"_l{i}").isNotNull()
    return rows.select(*kept, flag.alias("in_liquid"))


def by_security(store: Store, rows: DataFrame) -> DataFrame:
    marks = store.liquid.select(F.col("security_id").alias("_l")).distinct()
    kept = list(rows.columns)
    return rows.join(marks, rows["security_id"] == F.col("_l"), "left").select(*kept, F.col("_l").isNotNull().alias("in_liquid"))


def by_tier(store: Store, rows: DataFrame, security: str = "security_id", on: str = "ex_date") -> DataFrame:
    """in_liquid: the security was in the monthly tier within LIQUID_DAYS of the day."""
    t = store.tier.select(F.col("security_id").alias("_tier_id"), F.col("day").alias("_tier_day"))
    asked = rows.select(F.col(security).alias("_asked"), F.col(on).alias("_on")).distinct()
    yes = asked.join(t, (F.col("_asked") == F.col("_tier_id")) & (F.abs(F.datediff(F.col("_tier_day"), F.col("_on"))) <= LIQUID_DAYS), "left_semi").withColumn("_yes", F.lit(True))
    kept = list(rows.columns)
    return rows.join(yes, (rows[security] == F.col("_asked")) & (rows[on] == F.col("_on")), "left").select(*kept, F.coalesce("_yes", F.lit(False)).alias("in_liquid"))


def _bar_rows(store: Store, rows: DataFrame, *columns: str) -> DataFrame:
    made = rows.select(F.concat_ws(":", "symbol", day("session_date")).alias("key"), "symbol", "session_date", *columns)
    return by_symbol(store, made, "symbol")


def p1(s: Store) -> DataFrame:
    rows = s.raw.groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("copies"), F.min("session_date").alias("session_date")).filter("copies > 1")
    return _bar_rows(s, rows, "copies")


def price_fault() -> Column:
    """The first rule that a bar breaks; not finite before any comparison, as NaN compares as greater."""
    c = F.col
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < float("inf"))
    sound = finite("open") & finite("high") & finite("low") & finite("close") & c("volume").isNotNull() & (c("vwap").isNull() | finite("vwap"))
    return (
        F.when(~sound, "not_finite").when(c("volume") < 0, "negative_volume").when(F.least("open", "high", "low", "close") <= 0, "nonpositive")
        .when(c("high") < c("low"), "high_below_low").when(c("low") > F.least("open", "close"), "low_above_body").when(c("high") < F.greatest("open", "close"), "high_below_body")
    )


def p2(s: Store) -> DataFrame:
    return _bar_rows(s, s.raw.withColumn("reason", price_fault()).filter("reason is not null"), "open", "high", "low", "close", "reason")


def p3(s: Store) -> DataFrame:
    return _bar_rows(s, s.raw.filter("available_at > fetched_at"), "available_at", "fetched_at")


def p4(s: Store) -> DataFrame:
    return _bar_rows(s, s.raw.filter("year <> year(session_date)"), "year")


def p5(s: Store) -> DataFrame:
    return _bar_rows(s, s.raw.filter("volume = 0 and not (open = high and high = low and low = close)"), "open", "high", "low", "close")


def p6(s: Store) -> DataFrame:
    expected = F.col("session_date").cast("timestamp_ntz") + F.expr("interval 20 hour")
    rows = s.raw.withColumn("expected", expected).filter((F.col("available_at") != F.col("expected")) | (F.to_date("t") != F.col("session_date")))
    return _bar_rows(s, rows, "available_at", "expected")


def m1(s: Store) -> DataFrame:
    a = s.master.select("symbol", F.col("security_id").alias("old_security"), F.col("valid_to").alias("old_to"), F.col("end_available_at").alias("end_known"))
    b = s.master.select("symbol", F.col("security_id").alias("new_security"), "valid_from", "available_at")
    rows = a.join(b, "symbol").filter("old_to <= valid_from and available_at < end_known")
    return by_symbol(s, rows.select(F.concat_ws(":", "symbol", day("valid_from")).alias("key"), "symbol", "old_security", "new_security", "valid_from"), "symbol")


def pairs(s: Store) -> DataFrame:
    """Consecutive segments of a security."""
    rows = s.master.select("security_id", F.col("symbol").alias("old_symbol"), F.col("valid_from").alias("old_from"), F.col("valid_to").alias("old_to"))
    w = Window.partitionBy("security_id").orderBy("old_from", "old_symbol")
    return rows.withColumn("new_symbol", F.lead("old_symbol").over(w)).withColumn("new_from", F.lead("old_from").over(w)).withColumn("new_to", F.lead("old_to").over(w)).filter("new_from is not null")


def _pair_key() -> Column:
    return F.concat_ws(":", "security_id", day("new_from")).alias("key")


def m2(s: Store) -> DataFrame:
    rows = pairs(s).filter("new_symbol <> old_symbol and (old_to is null or new_from < old_to)")
    return by_security(s, rows.select(_pair_key(), "security_id", "old_symbol", "new_symbol", "old_to", "new_from"))


def m3(s: Store) -> DataFrame:
    gaps = pairs(s).filter("new_symbol <> old_symbol and new_from > old_to")
    names = gaps.select("security_id", "new_from", "old_to", F.explode(F.array("old_symbol", "new_symbol")).alias("symbol"))
    b = s.raw.filter("volume > 0").select("symbol", "session_date")
    held = names.join(b, "symbol").filter("session_date >= old_to and session_date < new_from").groupBy("security_id", "new_from").agg(F.count(F.lit(1)).alias("bars"))
    rows = gaps.join(held, ["security_id", "new_from"], "left")
    return by_security(s, rows.select(_pair_key(), "security_id", "old_symbol", "new_symbol", F.datediff("new_from", "old_to").cast("long").alias("gap_days"), F.coalesce("bars", F.lit(0)).cast("long").alias("traded_bars_in_gap")))


def m4(s: Store) -> DataFrame:
    keys = ["security_id", "symbol", "valid_from"]
    a = s.master.select(*keys).join(s.classes.select(*keys), keys, "left_anti").withColumn("side", F.lit("master"))
    b = s.classes.select(*keys).join(s.master_file.select(*keys), keys, "left_anti").withColumn("side", F.lit("class"))
    return by_symbol(s, a.unionByName(b).select(F.concat_ws(":", "symbol", day("valid_from")).alias("key"), *keys, "side"), "symbol")


def _seen_classes(s: Store) -> DataFrame:
    keys = ["security_id", "symbol", "valid_from"]
    return s.classes.join(s.master.select(*keys), keys, "left_semi")


def m5(s: Store) -> DataFrame:
    rows = _seen_classes(s).filter("class = 'unknown'")
    return by_security(s, rows.select(F.concat_ws(":", "symbol", day("valid_from")).alias("key"), "security_id", "symbol", "valid_from", "name", "rule"))


def _conflicts(s: Store, waiting: bool) -> DataFrame:
    """A conflict waits for a person if it is unresolved or relabelled; its dates make the key unique."""
    resolution = F.coalesce("resolution", F.lit("unresolved"))
    rows = s.conflicts.withColumn("resolution", resolution).filter(resolution.isin("unresolved", "relabelled") == F.lit(waiting))
    dates = F.array_join(F.transform("dates", lambda x: x.cast("string")), ",")
    rows = rows.withColumn("key", F.concat_ws(":", F.array_join("symbols", "/"), "kind", dates))
    rows = rows.select("key", "kind", "symbols", "detail", "resolution")
    named = rows.select("key", F.explode("symbols").alias("symbol")).join(s.liquid_symbols.select("symbol"), "symbol", "left_semi")
    made = rows.join(named.select("key").distinct().withColumn("_liquid", F.lit(True)), "key", "left")
    return made.select("key", "kind", F.array_join("symbols", "/").alias("symbols"), "detail", "resolution", F.coalesce("_liquid", F.lit(False)).alias("in_liquid"))


def m6(s: Store) -> DataFrame:
    return _conflicts(s, True).drop("resolution")


def m8(s: Store) -> DataFrame:
    return _conflicts(s, False)


def m7(s: Store) -> DataFrame:
    """Old holders of a label whose bars are copies of the latest holder's chain under another name."""
    m = s.master.select("security_id", "symbol", "valid_from", "valid_to")
    latest = m.groupBy("symbol").agg(F.max_by("security_id", "valid_from").alias("latest"), F.count_distinct("security_id").alias("_n")).filter("_n > 1").drop("_n")
    old = m.join(latest, "symbol").filter("security_id <> latest")
    price = ["session_date", "open", "high", "low", "close"]
    raw = s.raw.filter("volume > 0").select("symbol", *price)
    chain = raw.join(m.select("security_id", "symbol").distinct(), "symbol").select(F.col("security_id").alias("latest"), F.col("symbol").alias("other"), *price)
    held = old.join(raw, "symbol").filter(pit.within(F.col("session_date"), F.col("valid_from"), F.col("valid_to")))
    copied = held.join(chain, ["latest", *price]).filter("other <> symbol").select("security_id", "symbol", "valid_from", "session_date").distinct().withColumn("_c", F.lit(1))
    rows = held.join(copied, ["security_id", "symbol", "valid_from", "session_date"], "left").groupBy("security_id", "symbol", "valid_from", "latest").agg(F.count(F.lit(1)).alias("traded_days"), F.count("_c").alias("copied_days"))
    rows = rows.withColumn("share", F.col("copied_days") / F.col("traded_days")).filter((F.col("copied_days") >= COPY_DAYS) & (F.col("share") >= COPY_SHARE))
    return by_symbol(s, rows.select(F.concat_ws(":", "security_id", "symbol", day("valid_from")).alias("key"), "security_id", "symbol", "traded_days", "copied_days", "share"), "symbol")


def m9(s: Store) -> DataFrame:
    """Fund-class segments whose filer reports as a company; shelves of many tickers and overrides are exempt."""
    filers = s.facts.filter(F.col("form").isin(*COMPANY_FORMS)).select("cik").distinct()
    shelves = s.listings.groupBy("cik").agg(F.count_distinct("ticker").alias("_n")).filter(F.col("_n") >= SHELF).select("cik")
    named = s.master.filter("cik is not null").select("security_id", "symbol", "valid_from", "cik")
    rows = s.classes.filter("class in ('etf', 'leveraged_etf') and rule <> 'override'").join(named, ["security_id", "symbol", "valid_from"]).join(filers, "cik", "left_semi").join(shelves, "cik", "left_anti")
    return by_security(s, rows.select(F.concat_ws(":", "symbol", day("valid_from")).alias("key"), "security_id", "symbol", "name", "rule", "cik"))


def i1(s: Store) -> DataFrame:
    """Traded bars that nobody owns and that are no copy of an owned bar under another symbol."""
    price = ["open", "high", "low", "close", "volume"]
    v = s.resolved.select(F.col("symbol").alias("_s"), "session_date", *price)
    raw = s.raw.filter("volume > 0").join(s.resolved.select("symbol", "t"), ["symbol", "t"], "left_anti")
    same = (raw["session_date"] == v["session_date"]) & (raw["symbol"] != v["_s"])
    for c in price:
        same = same & (raw[c] == v[c])
    rows = raw.join(v, same, "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    return by_symbol(s, rows.select(F.col("symbol").alias("key"), "symbol", "bars", "first", "last"), "symbol")


def i2(s: Store) -> DataFrame:
    rows = s.resolved.filter((F.col("volume") > DUP_VOLUME) & ~F.col("symbol").rlike(r"^[A-Z]+\.WI$"))
    found = joins.identical_pairs(rows.withColumn("who", F.struct("symbol", "security_id")), "who", ["session_date", "open", "high", "low", "close", "volume"])
    found = found.filter("first.symbol < second.symbol and first.security_id <> second.security_id")
    made = found.groupBy(F.col("first.symbol").alias("symbol_a"), F.col("second.symbol").alias("symbol_b")).agg(F.count(F.lit(1)).alias("days"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    return by_symbol(s, made.filter(F.col("days") >= DUP_DAYS).select(F.concat_ws("/", "symbol_a", "symbol_b").alias("key"), "symbol_a", "symbol_b", "days", "first", "last"), "symbol_a", "symbol_b")


def i3(s: Store) -> DataFrame:
    price = ("open", "high", "low", "close", "volume")
    flat = F.lit(True)
    for c in price:
        flat = flat & (F.min(c) == F.max(c))
    days = s.resolved.groupBy("security_id", "session_date").agg(F.collect_set("symbol").alias("names"), flat.alias("same")).filter(F.size("names") > 1)
    rows = days.groupBy("security_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), "/").alias("symbols"), F.count(F.lit(1)).alias("days"), F.count_if("same").alias("identical_days"))
    return by_security(s, rows.select(F.col("security_id").alias("key"), "security_id", "symbols", "days", "identical_days"))


def i4(s: Store) -> DataFrame:
    """Bars that a reader between an end and its filing would have given to the old security."""
    ended = s.master.filter("valid_to is not null").select("symbol", F.col("security_id").alias("old"), "valid_to", F.to_date("end_available_at").alias("end_known"))
    bars = s.raw.filter("volume > 0").select("symbol", "t", "session_date")
    late = ended.join(bars, "symbol").filter("session_date >= valid_to and session_date < end_known")
    now = late.join(s.resolved.select("symbol", "t", "security_id"), ["symbol", "t"], "left").filter(~F.col("security_id").eqNullSafe(F.col("old")))
    rows = now.groupBy("symbol", "old", "valid_to", "end_known").agg(F.count(F.lit(1)).alias("bars"))
    return by_symbol(s, rows.select(F.col("symbol").alias("key"), "symbol", F.col("old").alias("security_id"), "valid_to", "end_known", "bars"), "symbol")


def i5(s: Store) -> DataFrame:
    spans = joins.intervals(s.listings, "snapshot_date")
    filed = s.listings.select("ticker", F.col("cik").alias("sec_cik"), F.col("snapshot_date").alias("lo")).distinct().join(F.broadcast(spans), "lo")
    named = s.master.filter("cik is not null").select(F.col("security_id").alias("_i"), F.col("symbol").alias("_s"), "valid_from", "valid_to", "cik")
    r = s.resolved.select("security_id", "symbol", "session_date")
    bars = r.join(named, (F.col("_i") == F.col("security_id")) & (F.col("_s") == F.col("symbol")) & pit.within(F.col("session_date"), F.col("valid_from"), F.col("valid_to"))).drop("_i", "_s")
    rows = bars.join(filed, (F.col("ticker") == F.col("symbol")) & pit.within(F.col("session_date"), F.col("lo"), F.col("hi"))).filter("sec_cik <> cik")
    rows = rows.groupBy("security_id", "symbol", "valid_from", "cik", "sec_cik").agg(F.count(F.lit(1)).alias("bars"))
    return by_symbol(s, rows.select(F.concat_ws(":", "symbol", day("valid_from")).alias("key"), "security_id", "symbol", F.col("cik").alias("segment_cik"), "sec_cik", "bars"), "symbol")


def i6(s: Store) -> DataFrame:
    rows = s.raw.groupBy(F.year("session_date").cast("long").alias("year")).agg(F.count_if(F.col("volume") == 0).alias("untraded"), F.count(F.lit(1)).alias("bars"))
    return rows.select(F.col("year").cast("string").alias("key"), "year", "untraded", "bars", (F.col("untraded") / F.col("bars")).alias("share"), F.lit(False).alias("in_liquid"))


def i7(s: Store) -> DataFrame:
    counts = s.raw.groupBy("session_date").agg(F.count_distinct(F.when(F.col("volume") > 0, F.col("symbol"))).alias("traded_symbols"))
    middle = counts.agg(F.percentile("traded_symbols", 0.5).alias("_m"))
    rows = counts.crossJoin(F.broadcast(middle)).filter(F.col("traded_symbols") < SPARSE * F.col("_m"))
    return rows.select(day("session_date").alias("key"), "session_date", "traded_symbols", F.lit(False).alias("in_liquid"))


def i8(s: Store) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("session_date")
    days = s.resolved.groupBy("security_id", "session_date").agg(F.min("symbol").alias("symbol")).join(F.broadcast(s.sessions.select("session_date", "idx")), "session_date")
    rows = days.withColumn("sessions_missing", F.col("idx") - F.lag("idx").over(w) - 1).withColumn("gap_from", F.lag("session_date").over(w)).filter(F.col("sessions_missing") > GAP_SESSIONS)
    return by_security(s, rows.select(F.concat_ws(":", "security_id", day("session_date")).alias("key"), "security_id", "symbol", "gap_from", F.col("session_date").alias("gap_to"), "sessions_missing"))


def i9(s: Store) -> DataFrame:
    closed = pairs(s).filter("old_to is not null")
    v = s.resolved.select(F.col("security_id").alias("_i"), F.col("symbol").alias("_s"), "session_date", "t", "close")
    keys = ["security_id", "new_from"]
    last = closed.join(v, (F.col("_i") == F.col("security_id")) & (F.col("_s") == F.col("old_symbol")) & pit.within(F.col("session_date"), F.col("old_from"), F.col("old_to"))).groupBy(*keys).agg(F.max_by("close", "t").alias("last_close"), F.max("session_date").alias("last_date"))
    first = closed.join(v, (F.col("_i") == F.col("security_id")) & (F.col("_s") == F.col("new_symbol")) & pit.within(F.col("session_date"), F.col("new_from"), F.col("new_to"))).groupBy(*keys).agg(F.min_by("close", "t").alias("first_close"), F.min("session_date").alias("first_date"))
    rows = closed.join(last, keys, "left").join(first, keys, "left")
    moves = s.splits.select(F.col("symbol").alias("_s"), "ex_date", "factor")
    between = rows.select(*keys, "last_date", "first_date", F.explode(F.array("old_symbol", "new_symbol")).alias("_s")).join(moves, "_s").filter("ex_date > last_date and ex_date <= first_date").select(*keys, "ex_date", "factor").distinct().groupBy(*keys).agg(F.product("factor").alias("factor"))
    rows = rows.join(between, keys, "left").withColumn("ratio", F.col("first_close") * F.coalesce("factor", F.lit(1.0)) / F.col("last_close")).withColumn("gap_days", F.datediff("first_date", "last_date").cast("long"))
    lo, hi = CONTINUOUS
    rows = rows.filter(F.col("last_close").isNull() | F.col("first_close").isNull() | (F.col("ratio") <= lo) | (F.col("ratio") >= hi) | (F.col("gap_days") > CONTINUOUS_DAYS))
    return by_security(s, rows.select(_pair_key(), "security_id", "old_symbol", "new_symbol", "last_close", "first_close", "ratio", "gap_days"))


def i10(s: Store) -> DataFrame:
    """Tickers listed on an exchange that own no traded bar in their listed span."""
    fund = F.col("ticker").rlike("^[A-Z]{4}X$")
    span = s.listings.filter(F.col("exchange").isin(*EXCHANGES) & ~fund).groupBy("ticker", "cik").agg(F.min("snapshot_date").alias("first_listed"), F.max("snapshot_date").alias("last_listed"), F.count_distinct("snapshot_date").alias("snapshots"))
    span = span.filter(F.col("snapshots") >= MIN_SNAPSHOTS)
    owned = pit.owned(s.raw.filter("volume > 0").select("symbol", "session_date"), s.master, columns=("cik",)).select(F.col("symbol").alias("_s"), F.col("cik").alias("_c"), "session_date")
    none = span.join(owned, (F.col("_s") == F.col("ticker")) & (F.col("_c") == F.col("cik")) & F.col("session_date").between(F.col("first_listed"), F.col("last_listed")), "left_anti")
    return none.select(F.concat_ws(":", "ticker", F.col("cik").cast("string")).alias("key"), "ticker", "cik", "first_listed", "last_listed", "snapshots", F.lit(False).alias("in_liquid"))


def i12(s: Store) -> DataFrame:
    ends = s.sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("z"))
    cal = s.calendar.crossJoin(F.broadcast(ends)).filter("day between a and z").select("day")
    held = s.sessions.select(F.col("session_date").alias("day"))
    missing = cal.join(held, "day", "left_anti").withColumn("reason", F.lit("missing_session"))
    extra = held.join(cal, "day", "left_anti").withColumn("reason", F.lit("session_on_holiday"))
    return missing.unionByName(extra).select(day("day").alias("key"), "day", "reason", F.lit(False).alias("in_liquid"))


def s1(s: Store) -> DataFrame:
    """Splits without a bar on their day, and why."""
    n = SPLIT_TRADED
    newest = s.sessions.agg(F.max("session_date").alias("_z"), F.max("idx").alias("_zi"))
    own = s.split_events.join(s.split_owners, ["symbol", "ex_date"]).crossJoin(F.broadcast(newest)).filter("ex_date <= _z")
    bars = s.raw.select(F.col("symbol").alias("_b"), "session_date", "volume").join(F.broadcast(s.sessions.select("session_date", "idx")), "session_date")
    names = s.master.select(F.col("security_id").alias("_i"), F.col("symbol").alias("_n"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    keys = own.select("symbol", "ex_date", "security_id", "ex_idx").distinct()
    known = keys.join(names, F.col("_i") == F.col("security_id")).select("symbol", "ex_date", "ex_idx", "_n", "_f", "_t")
    alone = keys.filter("security_id is null").select("symbol", "ex_date", "ex_idx", F.col("symbol").alias("_n"), F.lit("0001-01-01").cast("date").alias("_f"), F.lit(None).cast("date").alias("_t"))
    near = known.unionByName(alone).join(bars, (F.col("_b") == F.col("_n")) & pit.within(F.col("session_date"), F.col("_f"), F.col("_t"))).filter(F.abs(F.col("idx") - F.col("ex_idx")) <= n)
    seen = near.groupBy("symbol", "ex_date").agg(
        F.max(F.col("session_date") == F.col("ex_date")).alias("_bar"), F.max((F.col("volume") > 0) & (F.col("idx") < F.col("ex_idx"))).alias("_before"), F.max((F.col("volume") > 0) & (F.col("idx") > F.col("ex_idx"))).alias("_after")
    )
    ends = s.sessions.select(F.col("idx").alias("_k"), F.col("session_date").alias("_at"))
    open_after = keys.join(ends, F.col("_k") == F.col("ex_idx") + n).join(names, F.col("_i") == F.col("security_id")).filter("_t is null or _t > _at").select("symbol", "ex_date").distinct().withColumn("_open", F.lit(True))
    stored = s.raw.select("symbol").distinct().withColumn("_stored", F.lit(True))
    rows = own.join(seen, ["symbol", "ex_date"], "left").join(open_after, ["symbol", "ex_date"], "left").join(stored, "symbol", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    silent = ((F.col("ex_idx") > n) & no("_before")) | ((F.col("ex_idx") + n <= F.col("_zi")) & no("_after") & no("_open"))
    reason = F.when(F.col("_stored").isNull(), "symbol_never_stored").when(silent, "not_traded_around").otherwise("no_bar_that_day")
    rows = by_tier(s, rows.filter(no("_bar")).withColumn("reason", reason))
    return rows.select(F.concat_ws(":", "symbol", day("ex_date")).alias("key"), "symbol", "ex_date", "kind", "factor", "reason", (F.col("in_liquid") & (F.col("reason") != "not_traded_around")).alias("in_liquid"))


def _has_prev() -> Column:
    return (F.col("prev_close") > 0) & (F.col("idx") - F.col("prev_idx") <= NEAR)


def _away_from_splits(s: Store, rows: DataFrame) -> DataFrame:
    days = s.splits.select(F.col("symbol").alias("_s"), F.col("ex_date").alias("_e")).distinct()
    return rows.join(days, (F.col("_s") == F.col("symbol")) & F.col("_e").between(F.col("lo"), F.col("hi")), "left_anti")


def s2(s: Store) -> DataFrame:
    """Splits whose day, or the two sessions after it, shows no such move of the price."""
    w = Window.partitionBy("symbol").orderBy("t")
    ahead = s.traded
    for k in (1, 2):
        ahead = ahead.withColumn(f"open{k}", F.lead("open", k).over(w)).withColumn(f"idx{k}", F.lead("idx", k).over(w))
    ev = s.split_events.filter("kind <> 'unit_split' and factor > 0").withColumnRenamed("ex_date", "session_date")
    rows = ev.join(ahead, ["symbol", "session_date"]).join(s.split_owners.select("symbol", F.col("ex_date").alias("session_date"), "security_id"), ["symbol", "session_date"], "left").filter(_has_prev())
    before = s.sessions.select(F.col("idx").alias("prev_idx"), F.col("session_date").alias("_pd"))
    m = s.master.select(F.col("symbol").alias("_s"), F.col("security_id").alias("_held"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    rows = rows.join(F.broadcast(before), "prev_idx").join(m, (F.col("_s") == F.col("symbol")) & pit.within(F.col("_pd"), F.col("_f"), F.col("_t")), "left").filter(F.col("_held").eqNullSafe(F.col("security_id")))
    off = lambda c: F.abs(F.col(c) / F.col("prev_close") * F.col("factor") - 1) > SPLIT_TOLERANCE
    late = lambda k: F.col(f"open{k}").isNull() | (F.col(f"idx{k}") - F.col("idx") > SPLIT_LATE) | off(f"open{k}")
    rows = by_tier(s, rows.filter(off("open") & late(1) & late(2)).withColumnRenamed("session_date", "ex_date"))
    return rows.select(F.concat_ws(":", "symbol", day("ex_date")).alias("key"), "symbol", "ex_date", "kind", "factor", "prev_close", "open", "in_liquid")


def s3(s: Store) -> DataFrame:
    c, p = F.col, F.col("prev_any_close")
    spike = (F.greatest("open", "high", "close") / p >= JUMP) | (F.least("open", "high", "close") / p <= 1.0 / JUMP)
    back = (c("next_close") / p).between(*BACK)
    rows = s.traded.filter((p >= 1) & (c("idx") - c("prev_any_idx") <= NEAR) & c("next_close").isNotNull() & (c("next_idx") - c("idx") <= NEAR) & spike & back & (c("volume") < THIN))
    return _bar_rows(s, _away_from_splits(s, rows), "prev_any_close", "close", "next_close", "volume")


def s4(s: Store) -> DataFrame:
    ratio = F.col("close") / F.col("prev_close")
    rows = _away_from_splits(s, s.traded.filter(_has_prev() & ((ratio >= JUMP / 2) | (ratio <= 2 / JUMP))))
    bucket = F.when(F.col("prev_close") < 1, "lt1").when(F.col("prev_close") <= 10, "1to10").otherwise("gt10")
    return _bar_rows(s, rows.withColumn("ratio", ratio).withColumn("bucket", bucket), "prev_close", "close", "ratio", "bucket")


def s5(s: Store) -> DataFrame:
    rows = s.splits.groupBy("symbol", "ex_date").agg(F.count(F.lit(1)).alias("events"), F.product("factor").alias("net_factor")).filter("events > 1")
    return by_symbol(s, rows.select(F.concat_ws(":", "symbol", day("ex_date")).alias("key"), "symbol", "ex_date", "events", "net_factor"), "symbol")


def s6(s: Store) -> DataFrame:
    rows = spinoffs.events(s.spinoffs, s.resolved).filter("status = 'restart' and reason = 'factor_disproved'")
    made = by_tier(s, rows)
    return made.select(F.concat_ws(":", "parent_symbol", day("ex_date")).alias("key"), "parent_symbol", "ex_date", F.array_join("child_symbols", ",").alias("children"), "in_liquid")


def d1(s: Store) -> DataFrame:
    """Payouts stored twice with rates that differ by rounding or under another flag."""
    rows = s.dividends.withColumn("_id", F.xxhash64(*s.dividends.columns))
    o = rows.select(F.col("symbol").alias("_s"), F.col("ex_date").alias("_e"), F.col("rate").alias("_r"), F.col("_id").alias("_j"))
    apart = F.abs(F.col("rate") - F.col("_r"))
    twins = rows.join(o, (F.col("symbol") == F.col("_s")) & (F.col("ex_date") == F.col("_e")) & (F.col("_id") < F.col("_j")) & ((apart <= TWIN * F.greatest("rate", "_r")) | (apart <= TWIN_ABS))).select("symbol", "ex_date").distinct()
    made = rows.join(twins, ["symbol", "ex_date"]).groupBy("symbol", "ex_date").agg(F.count(F.lit(1)).alias("records"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"))
    return by_symbol(s, made.select(F.concat_ws(":", "symbol", day("ex_date")).alias("key"), "symbol", "ex_date", "records", "lowest", "highest"), "symbol")


def _rename_key() -> Column:
    return F.concat(F.concat_ws("/", "old_symbol", "new_symbol"), F.lit(":"), day("process_date")).alias("key")


def rename_lags(s: Store) -> DataFrame:
    last = s.raw.filter("volume > 0").groupBy(F.col("symbol").alias("old_symbol")).agg(F.max("session_date").alias("last_traded"))
    names = s.renames.select("old_symbol", "new_symbol", "process_date").distinct()
    return names.join(last, "old_symbol", "left").withColumn("lag_days", F.datediff("process_date", "last_traded").cast("long"))


def lag_bucket() -> Column:
    lag = F.col("lag_days")
    return F.when(lag.isNull(), "no_old_bars").when(lag <= 0, "le0").when(lag <= 10, "d1_10").when(lag <= 30, "d11_30").when(lag <= 180, "d31_180").otherwise("gt180")


def n1(s: Store) -> DataFrame:
    rows = rename_lags(s).filter(F.col("lag_days") > LAG_DAYS)
    return by_symbol(s, rows.select(_rename_key(), "old_symbol", "new_symbol", "process_date", "last_traded", "lag_days"), "old_symbol", "new_symbol")


def n2(s: Store) -> DataFrame:
    traded = s.raw.filter("volume > 0").groupBy("symbol").agg(F.min("session_date").alias("a"), F.max("session_date").alias("z"))
    rows = s.renames.select("old_symbol", "new_symbol", "process_date").distinct()
    rows = rows.join(traded.select(F.col("symbol").alias("old_symbol"), F.col("z").alias("old_last_traded")), "old_symbol").join(traded.select(F.col("symbol").alias("new_symbol"), F.col("a").alias("new_first_traded")), "new_symbol")
    rows = rows.filter("old_last_traded > process_date and new_first_traded > process_date")
    return by_symbol(s, rows.select(_rename_key(), "old_symbol", "new_symbol", "process_date", "old_last_traded", "new_first_traded"), "old_symbol", "new_symbol")


def n3(s: Store) -> DataFrame:
    same = ["session_date", "trade_count", "volume"]
    # a row a symbol: its days and its bars come from one table, so the bars are made and moved once
    bars = s.raw.filter("volume > 0 and symbol is not null").groupBy("symbol").agg(F.collect_list(F.struct(*same)).alias("bars"))
    days = bars.select("symbol", F.size(F.array_compact(F.array_distinct(F.transform("bars", lambda b: b["session_date"])))).cast("long").alias("days"))
    found = joins.identical_counts(bars.select("symbol", F.inline("bars")).filter(F.col("volume") > DUP_VOLUME), by_symbol(s, days, "symbol"), "symbol", same)
    rows = found.select(F.col("first_symbol").alias("symbol_a"), F.col("second_symbol").alias("symbol_b"), F.col("identical").alias("identical_days"), F.least("first_days", "second_days").alias("shorter_days"), (F.col("first_in_liquid") | F.col("second_in_liquid")).alias("in_liquid"))
    rows = rows.withColumn("ratio", F.col("identical_days") / F.col("shorter_days")).filter((F.col("ratio") >= RELABEL[0] / 100) & (F.col("ratio") < RELABEL[1]))
    return rows.select(F.concat_ws("/", "symbol_a", "symbol_b").alias("key"), "symbol_a", "symbol_b", "identical_days", "shorter_days", "ratio", "in_liquid")


def c1(s: Store) -> DataFrame:
    b = s.raw.groupBy(F.year("session_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"))
    m = s.master.select("security_id", "symbol").distinct()
    linked = m.select("security_id", F.col("symbol").alias("old_symbol")).join(m.select("security_id", F.col("symbol").alias("new_symbol")), "security_id").select("old_symbol", "new_symbol").distinct().withColumn("_l", F.lit(1))
    nc = s.renames.join(linked, ["old_symbol", "new_symbol"], "left").groupBy(F.year("process_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("name_changes"), F.count("_l").alias("name_changes_linked"))
    keys = s.vendor_keys.select("symbol", "t").distinct().withColumn("_v", F.lit(1))
    ext = s.raw.filter("source <> 'vendor'").join(keys, ["symbol", "t"], "left").groupBy(F.year("session_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("ext_bars"), F.count("_v").alias("ext_overrides"))
    years = b.select("year").union(nc.select("year")).distinct()
    held = s.master.join(s.liquid, "security_id", "left_semi").select("symbol", F.year("valid_from").alias("_f"), "valid_to")
    liq = years.join(held, (F.col("_f") <= F.col("year")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.make_date("year", F.lit(1), F.lit(1))))).groupBy("year").agg(F.count_distinct("symbol").alias("liquid_symbols"))
    rows = years.join(b, "year", "left").join(nc, "year", "left").join(ext, "year", "left").join(liq, "year", "left")
    counts = ("bars", "symbols", "liquid_symbols", "name_changes", "name_changes_linked", "ext_bars", "ext_overrides")
    return rows.select(F.col("year").cast("string").alias("key"), "year", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.lit(False).alias("in_liquid"))


def c2(s: Store) -> DataFrame:
    last = s.raw.groupBy("symbol").agg(F.max("session_date").alias("last_bar"))
    newest = s.sessions.agg(F.max("idx").alias("_z"))
    rows = s.listed.join(last, "symbol").join(F.broadcast(s.sessions.select(F.col("session_date").alias("last_bar"), "idx")), "last_bar").crossJoin(F.broadcast(newest)).withColumn("sessions_behind", F.col("_z") - F.col("idx")).filter(F.col("sessions_behind") > STALE)
    return by_symbol(s, rows.select(F.col("symbol").alias("key"), "symbol", "exchange", "last_bar", "sessions_behind"), "symbol")


def _nightly_shares(s: Store) -> DataFrame:
    """Counts usable on the audit's own night."""
    return visible_shares(s.facts, s.master, s.splits, s.as_of[:10], pit.instant(s.as_of), SHARE_AGE, PRIORITY)


def f1(s: Store) -> DataFrame:
    """Tier securities without a usable share count on the audit's night."""
    held = s.tier.select("security_id").distinct()
    none = held.join(_nightly_shares(s).select("security_id"), "security_id", "left_anti")
    return none.select(F.col("security_id").alias("key"), "security_id", F.lit(True).alias("in_liquid"))


def f2(s: Store) -> DataFrame:
    """Tier securities whose count gives a cap that no count could."""
    tier = s.tier.groupBy("security_id").agg(F.max("adv_usd").alias("adv_usd"))
    close = s.resolved.groupBy("security_id").agg(F.max_by("close", F.struct("session_date", "symbol")).alias("close"))
    rows = _nightly_shares(s).join(close, "security_id").join(tier, "security_id").withColumn("raw_cap", F.col("shares") * F.col("close"))
    rows = rows.filter((F.col("adv_usd") > TURNOVER * F.col("raw_cap")) | (F.col("raw_cap") > MAX_CAP))
    return rows.select(F.concat_ws(":", "symbol", day("end_date")).alias("key"), "security_id", "concept", "shares", "raw_cap", "adv_usd", F.lit(True).alias("in_liquid"))


CHECKS: dict[str, Callable[[Store], DataFrame]] = {name: globals()[name.lower()] for name in GATES}


def run(store: Store, checks: Iterable[str] | None = None, exceptions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each check's rows with `excepted` (exceptions: check, key)."""
    wanted = list(GATES) if checks is None else list(checks)
    if unknown := [c for c in wanted if c not in CHECKS]:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    out = {}
    for name in wanted:
        rows = CHECKS[name](store)
        if exceptions is None:
            out[name] = rows.withColumn("excepted", F.lit(False))
        else:
            own = exceptions.filter(F.col("check") == name).select("key").distinct().withColumn("_x", F.lit(True))
            out[name] = rows.join(own, "key", "left").withColumn("excepted", F.coalesce("_x", F.lit(False))).drop("_x")
    return out


def failures(check: str, rows: DataFrame, tier: str = "liquid") -> DataFrame:
    """The rows that fail a check's gate; none if it is only listed."""
    gate = GATES[check]
    if gate is None:
        return rows.limit(0)
    rows = rows.filter("not excepted")
    return rows.filter("in_liquid") if gate == "liquid" and tier != "all" else rows


def stale_exceptions(exceptions: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """Granted exceptions whose check no longer reports the key."""
    seen = None
    for name, rows in results.items():
        part = rows.select(F.lit(name).alias("check"), "key")
        seen = part if seen is None else seen.unionByName(part)
    return exceptions.filter(F.col("check").isin(*results)).join(seen.distinct(), ["check", "key"], "left_anti")
