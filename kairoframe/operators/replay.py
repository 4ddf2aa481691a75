"""Replay of one account: tranche positions through splits, spin-offs, missing bars and jumps.

Everything that a session's bar needs is joined to it before (splits since the security's bar before, exit flags), and
signals, spin-offs and bars become one stream of rows by run and day. A task sweeps a run's days in order and holds a
day's rows and the open positions, never the run. One run is sequential by nature, as its positions share one account.

An evening: positions step through the day's bar, the account is marked, the night's signals are bought in rank order at
the next open, until the account has no room.

Excursions are kept as returns against the entry in its own units, so a split changes nothing, and bars after a spin-off's
ex-date wait until its factor is known. Shares sold while children are owed are booked when those are paid or never will be.
"""

from __future__ import annotations

import datetime
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simulation import BPS, EPS


@dataclass(frozen=True)
class AccountRules:
    equity: float = 100_000.0
    risk_pct: float = 0.5
    atr_mult: float = 2.0
    position_pct: float = 10.0
    gross_pct: float = 100.0
    bps: float = BPS
    exits: tuple[str, ...] = ("daily_red", "weekly_down")
    max_missing: int = 5
    max_jump: float = 1.8
    spinoff_wait: int = 5

    def shares(self, equity: float, close: float, atr: float, gross: float) -> int:
        """Shares that lose risk_pct of equity over atr_mult ranges, within a position's and the account's share of it."""
        risk = self.atr_mult * atr
        if not atr > 0 or close <= 0 or equity <= 0:
            return 0
        room = equity * self.gross_pct / 100 - gross
        limits = (equity * self.risk_pct / 100 / risk, equity * self.position_pct / 100 / close, room / close if room > 0 else 0.0)
        return max(0, min(math.floor(x + EPS) for x in limits))


@dataclass(frozen=True)
class Seen:
    """Extremes as returns on the entry, and raw ones since an ex-date whose factor is not known yet."""

    low: float | None = None
    high: float | None = None
    raw_low: float | None = None
    raw_high: float | None = None
    spin: float = 1.0  # product of the factors of priced spin-offs: the entry's unit now

    def bar(self, low: float, high: float, entry: float, waiting: bool) -> Seen:
        if waiting:
            return replace(self, raw_low=low if self.raw_low is None else min(self.raw_low, low), raw_high=high if self.raw_high is None else max(self.raw_high, high))
        low, high = low / (entry * self.spin), high / (entry * self.spin)
        return replace(self, low=low if self.low is None else min(self.low, low), high=high if self.high is None else max(self.high, high))

    def split(self, ratio: float) -> Seen:
        return self if self.raw_low is None else replace(self, raw_low=self.raw_low / ratio, raw_high=self.raw_high / ratio)

    def settled(self, factor: float, entry: float) -> Seen:
        """The factor is known (1: never will be): the bars that waited count in its unit."""
        now = replace(self, spin=self.spin * factor, raw_low=None, raw_high=None)
        return now if self.raw_low is None else now.bar(self.raw_low, self.raw_high, entry, False)

    def excursions(self, price: float, entry: float) -> tuple[float, float]:
        """The exit's own bar adds its price only."""
        at = price / (entry * self.spin)
        return 100 * (min(1.0 if self.low is None else self.low, at) - 1), 100 * (max(1.0 if self.high is None else self.high, at) - 1)


@dataclass
class Sold:
    """A tranche at its sale; child: what earlier children paid to its shares; at_ex: its shares counted as at the ex-date."""

    shares: int
    day: datetime.date
    price: float
    reason: str
    entry: float
    hard: float
    held: int
    child: float
    seen: Seen
    at_ex: float
    spinoff: str | None


@dataclass
class Position:
    """One decision: an order for the next open, then shares that leave in as many tranches as there are exits."""

    rules: AccountRules
    security_id: str
    symbol: str
    signal_day: datetime.date
    atr: float
    order: int
    close: float
    last_day: datetime.date
    shares: int = 0
    entry: float = 0.0
    entry_day: datetime.date | None = None
    held: int = 0
    tranches: int = 0
    fired: set[str] = field(default_factory=set)
    pending: list[str] = field(default_factory=list)
    seen: Seen = field(default_factory=Seen)
    child: float = 0.0  # children paid to the shares still held
    cancelled: str | None = None
    missing: int = 0
    # A spin-off between its ex-date and its settlement.
    event: dict | None = None
    frozen: bool = False
    owed_on: int = 0  # shares that children are owed on, as at the ex-date
    since_ex: float = 1.0  # splits since the ex-date
    selling: bool = False
    sales: dict[str, float] = field(default_factory=dict)
    absent: dict[str, int] = field(default_factory=dict)
    back: list[Sold] = field(default_factory=list)
    spinoff: str | None = None

    @property
    def entered(self) -> bool:
        return self.entry_day is not None

    @property
    def finished(self) -> bool:
        return self.cancelled is not None or (self.entered and not self.shares and not self.back)

    def exposure(self) -> float:
        return (self.shares + self.order) * self.close

    def unrealized(self) -> float:
        return self.shares * (self.close - self.entry) + self.child + sum(s.shares * (s.price - s.entry) + s.child for s in self.back)

    def cancel(self, reason: str) -> None:
        if self.order:
            self.order, self.cancelled = 0, reason

    def booked(self, s: Sold) -> dict:
        low, high = s.seen.excursions(s.price, s.entry)
        r = (s.price - s.entry + s.child / s.shares) / (s.entry - s.hard)
        return {
            "security_id": self.security_id, "signal_day": self.signal_day, "entry_day": self.entry_day, "entry_price": s.entry, "exit_day": s.day, "exit_price": s.price, "reason": s.reason, "shares": s.shares,
            "pnl": s.shares * (s.price - s.entry) + s.child, "r_multiple": r, "held": s.held, "mae_pct": low, "mfe_pct": high, "child_proceeds": s.child, "spinoff": s.spinoff,
        }

    def sell(self, count: int, day: datetime.date, price: float, reason: str) -> list[dict]:
        child = self.child * count / self.shares
        hard = self.entry - self.rules.atr_mult * self.atr
        sold = Sold(count, day, price, reason, self.entry, hard, self.held, child, self.seen, count / self.since_ex, self.spinoff)
        self.child, self.shares, self.tranches = self.child - child, self.shares - count, self.tranches + 1
        if self.owed_on:
            self.back.append(sold)
            return []
        return [self.booked(sold)]

    def split(self, ratio: float) -> None:
        self.atr, self.close, self.seen = self.atr / ratio, self.close / ratio, self.seen.split(ratio)
        if self.order:
            self.order = math.floor(self.order * ratio + EPS)
            if not self.order:
                self.cancelled = "no_size"
        if self.shares:
            self.shares, self.entry = math.floor(self.shares * ratio + EPS), self.entry / ratio
            if self.owed_on:
                self.since_ex *= ratio

    def forced(self, day: datetime.date, reason: str) -> list[dict]:
        """Out at the last close, or the waiting order goes."""
        if self.order:
            self.cancel(reason)
            return []
        self.pending = []
        return self.sell(self.shares, day, self.close * (1 - self.rules.bps / 1e4), reason) if self.shares else []

    def step(self, day: datetime.date, o: float, high: float, low: float, flags: Sequence[str]) -> list[dict]:
        if self.order:
            if self.frozen:  # sized on prices from before the ex-date
                self.cancel("spinoff_ex")
                return []
            self.entry_day, self.entry, self.shares, self.order = day, o * (1 + self.rules.bps / 1e4), self.order, 0
        if not self.shares:
            return []
        self.held += 1
        out, price = [], o * (1 - self.rules.bps / 1e4)
        for reason in self.pending:
            if self.shares:
                left = len(self.rules.exits) - self.tranches
                out += self.sell(self.shares if left <= 1 else math.floor(self.shares / left + EPS) or self.shares, day, price, reason)
        self.pending = []
        if self.shares:  # who left at the open did not hold the rest of the bar
            self.seen = self.seen.bar(low, high, self.entry, bool(self.owed_on) and not self.selling)
            if not self.frozen:
                self.pending = [x for x in self.rules.exits if x in flags and x not in self.fired]
                self.fired.update(self.pending)
        return out

    # ---- spin-offs: a parent's shares held at the ex-date are owed children until they are sold or cannot be priced

    def begins(self, event: dict) -> None:
        if self.event is not None:  # another one goes ex while one is being settled: it is not priced
            self.cancel("spinoff_ex")
            self.spinoff = "restart" if self.shares else self.spinoff
            return
        self.event, self.frozen, self.selling, self.sales, self.absent = event, True, False, {}, {}
        if self.shares:
            self.owed_on, self.since_ex = self.shares, 1.0

    def settle(self, factor: float, kind: str) -> None:
        self.frozen = False
        if self.owed_on:
            if self.shares:
                self.seen, self.spinoff = self.seen.settled(factor, self.entry), kind
            for s in self.back:
                s.seen, s.spinoff = s.seen.settled(factor, s.entry), kind

    def release(self, proceeds: float) -> list[dict]:
        """Books what was held back; children are shared by shares as at the ex-date."""
        out = []
        for s in self.back:
            paid = proceeds * s.at_ex / self.owed_on
            s.child += paid
            self.child -= paid
            out.append(self.booked(s))
        self.child = self.child + proceeds if self.shares else 0.0
        self.event, self.owed_on, self.since_ex, self.selling, self.back = None, 0, 1.0, False, []
        return out

    def unpriced(self) -> list[dict]:
        self.settle(1.0, "restart")
        return self.release(0.0)

    def evening(self, day: datetime.date, waited: int, bars: dict[str, tuple], last: dict[str, float]) -> list[dict]:
        """What an open spin-off does after the day's bars, `waited` sessions after its first. bars: symbol -> (open, close) of
        the day; last: last close since the ex-date."""
        event = self.event
        if self.selling:
            return self._sell_children(day, bars, last)
        known = event["known_on"] is not None and event["known_on"] <= day
        if known and event["status"] == "adjust":
            self.settle(event["factor"], "adjust")
            self.selling = bool(self.owed_on) and bool(self.shares or self.back)
            if not self.selling:
                self.event, self.owed_on = None, 0
            return []
        if (known and event["status"] == "restart") or waited >= self.rules.spinoff_wait:
            return self.unpriced()
        return []

    def _sell_children(self, day: datetime.date, bars: dict[str, tuple], last: dict[str, float]) -> list[dict]:
        """Each child at its first open after the event was known; one that stays away at its last close."""
        if day <= self.event["known_on"]:
            return []
        for child, _ in self.event["children"]:
            if child in self.sales:
                continue
            if child in bars:
                self.sales[child] = bars[child][0]
                continue
            self.absent[child] = self.absent.get(child, 0) + 1
            if self.absent[child] >= self.rules.max_missing:
                if child not in last:  # nothing to sell it at
                    return self.unpriced()
                self.sales[child] = last[child]
        if len(self.sales) < len(self.event["children"]):
            return []
        return self.release(sum(self.owed_on * ratio * self.sales[c] * (1 - self.rules.bps / 1e4) for c, ratio in self.event["children"]))


class Account:
    """One run, day by day."""

    def __init__(self, rules: AccountRules) -> None:
        self.rules, self.realized, self.open, self.sessions = rules, 0.0, [], []
        self.events: dict[str, list[dict]] = {}
        self.child_close: dict[str, tuple[datetime.date, float]] = {}

    def equity(self) -> float:
        return self.rules.equity + self.realized + sum(p.unrealized() for p in self.open)

    def day(self, day: datetime.date, rows: list[dict]) -> list[dict]:
        """Rows of a day: kind 'session', 'event', 'bar', 'signal'. Returns rows of sales, cancelled orders and the day's mark."""
        for r in rows:
            if r["kind"] == "event":
                self.events.setdefault(r["security_id"], []).append(r)
        if not any(r["kind"] == "session" for r in rows):
            return []
        self.sessions.append(day)
        bars = [r for r in rows if r["kind"] == "bar"]
        own = {r["security_id"]: r for r in bars if r["security_id"] is not None}
        by_symbol = {r["symbol"]: (r["open"], r["close"]) for r in bars}
        sales = []
        for p in self.open:
            sales += self._stepped(p, day, own.get(p.security_id))
        for symbol, (_, close) in by_symbol.items():
            self.child_close[symbol] = (day, close)
        for p in self.open:
            if p.event is not None:
                waited = len(self.sessions) - 1 - bisect_left(self.sessions, p.event["ex_date"])
                last = {s: c for s, (d, c) in self.child_close.items() if d >= p.event["ex_date"]}
                sales += p.evening(day, waited, by_symbol, last)
        self.realized += sum(s["pnl"] for s in sales)
        held = [p for p in self.open if p.shares]
        mark = {"kind": "mark", "day": day, "equity": self.equity(), "realized": self.realized, "gross": sum(p.shares * p.close for p in held), "positions": len(held)}
        gone = [{"kind": "cancelled", "day": day, "security_id": p.security_id, "signal_day": p.signal_day, "reason": p.cancelled} for p in self.open if p.cancelled]
        self.open = [p for p in self.open if not p.finished]
        self._decide(day, sorted((r for r in rows if r["kind"] == "signal"), key=lambda r: r["rank"]))
        return [{"kind": "sale", "day": day} | s for s in sales] + gone + [mark]

    def _stepped(self, p: Position, day: datetime.date, bar: dict | None) -> list[dict]:
        if p.finished:
            return []
        if bar is None:
            p.missing += 1
            p.cancel("no_bar")
            return p.forced(day, "data_gap") if p.missing >= self.rules.max_missing and p.shares else []
        p.missing, p.symbol = 0, bar["symbol"]
        for e in self.events.get(p.security_id, ()):
            if p.last_day < e["ex_date"] <= day and e["first_day"] <= day:
                p.begins(e)
        ratio = bar["ratio"] if bar["ratio"] is not None else 1.0
        if ratio != 1.0:
            p.split(ratio)
        elif bar["open"] > self.rules.max_jump * p.close:  # a reverse split that nobody recorded would read as a windfall
            out = p.forced(day, "price_jump")
            p.last_day = day
            return out
        out = [] if p.cancelled else p.step(day, bar["open"], bar["high"], bar["low"], bar["flags"] or ())
        p.close, p.last_day = bar["close"], day
        return out

    def _decide(self, day: datetime.date, signals: list[dict]) -> None:
        held = {p.security_id for p in self.open}
        for s in signals:
            if s["security_id"] in held or s["close"] is None or not (s["atr"] or 0) > 0:
                continue
            equity = self.equity()
            if not self.rules.shares(equity, s["close"], s["atr"], 0.0):
                continue  # not one share even in an empty account
            n = self.rules.shares(equity, s["close"], s["atr"], sum(p.exposure() for p in self.open))
            if not n:
                return  # no room: the rest of the night waits
            self.open.append(Position(self.rules, s["security_id"], s["symbol"], day, s["atr"], n, s["close"], day))
            held.add(s["security_id"])


SCHEMA = (
    "run_id long, kind string, day date, security_id string, signal_day date, entry_day date, entry_price double, exit_day date, exit_price double, reason string, shares long, pnl double, r_multiple double, "
    "held long, mae_pct double, mfe_pct double, child_proceeds double, spinoff string, equity double, realized double, gross double, positions long"
)
CHILDREN = "array<struct<symbol:string,ratio:double>>"


def first_day_of(first_known: Column) -> Column:
    """The first day whose 09:30 open in New York comes at or after an instant (UTC)."""
    local = F.from_utc_timestamp(first_known, "America/New_York")
    return F.date_add(F.to_date(local), F.when(F.date_format(local, "HH:mm:ss.SSSSSS") > "09:30:00.000000", 1).otherwise(0))


def settled_events(events: DataFrame, records: DataFrame) -> DataFrame:
    """Spin-off events (spinoffs.events) as the stream takes them: with the instant of the first record and children as pairs."""
    first = records.groupBy("parent_symbol", "ex_date").agg(F.min("available_at").alias("first_known"))
    pairs = F.arrays_zip(F.col("child_symbols").alias("symbol"), F.col("ratio").alias("ratio")).cast(CHILDREN)
    rows = events.filter("security_id is not null").join(first, ["parent_symbol", "ex_date"])
    return rows.select("security_id", "ex_date", "first_known", "status", "factor", "known_on", pairs.alias("children"))


def stream(runs: DataFrame, sessions: DataFrame, signals: DataFrame, bars: DataFrame, splits: DataFrame, events: DataFrame, flags: DataFrame) -> DataFrame:
    """One row for each session, bar, signal and spin-off that a run needs, by run and day.

    runs: run_id, first, last; sessions: session_date; signals: run_id, session_date, security_id, symbol, close, atr, rank; bars: security_id, symbol,
    session_date, open, high, low, close; splits: symbol, ex_date, factor; events: security_id, ex_date, first_known, status,
    factor, known_on, children; flags: security_id, session_date, flags (names of the exits that are up).
    """
    w = Window.partitionBy("security_id").orderBy("session_date")
    b = bars.select("security_id", "symbol", "session_date", "open", "high", "low", "close").withColumn("_prev", F.lag("session_date").over(w)).withColumn("_was", F.lag("symbol").over(w))
    # The few splits are laid against the bars they fall between; a symbol's splits count for it and for the one before it.
    s = splits.select(F.col("symbol").alias("_s"), F.col("ex_date").alias("_e"), "factor")
    pairs = b.join(s, (F.col("_s") == F.col("symbol")) & (F.col("_e") > F.col("_prev")) & (F.col("_e") <= F.col("session_date")))
    late = b.filter("_was <> symbol").join(s, (F.col("_s") == F.col("_was")) & (F.col("_e") > F.col("_prev")) & (F.col("_e") <= F.col("session_date")))
    ratios = pairs.unionByName(late).groupBy("security_id", "session_date").agg(F.product("factor").alias("ratio"))
    b = b.drop("_prev", "_was").join(ratios, ["security_id", "session_date"], "left").join(flags.select("security_id", "session_date", "flags"), ["security_id", "session_date"], "left")
    chosen = signals.select("run_id", F.col("security_id").alias("_i")).distinct()
    span = runs.select(F.col("run_id").alias("_r"), "first", "last")
    own = chosen.join(b, F.col("_i") == F.col("security_id"))
    e = chosen.join(events, F.col("_i") == F.col("security_id"))
    children = e.select("run_id", F.explode("children").alias("_c")).select("run_id", F.col("_c.symbol").alias("_y")).distinct()
    kids = children.join(bars.select("symbol", "session_date", "open", "high", "low", "close"), F.col("_y") == F.col("symbol"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    shape = ["run_id", "day", "kind", "security_id", "symbol", "open", "high", "low", "close", "ratio", "flags", "atr", "rank", "ex_date", "first_day", "status", "factor", "known_on", "children"]
    no_event = [*none("date", "ex_date", "first_day"), *none("string", "status"), *none("double", "factor"), *none("date", "known_on"), *none(CHILDREN, "children")]
    no_signal = [*none("double", "atr"), *none("long", "rank")]
    bar_rows = own.select("run_id", F.col("session_date").alias("day"), F.lit("bar").alias("kind"), "security_id", "symbol", "open", "high", "low", "close", "ratio", "flags", *no_signal, *no_event)
    kid_rows = kids.select("run_id", F.col("session_date").alias("day"), F.lit("bar").alias("kind"), *none("string", "security_id"), "symbol", "open", "high", "low", "close", *none("double", "ratio"), *none("array<string>", "flags"), *no_signal, *no_event)
    signal_rows = signals.select("run_id", F.col("session_date").alias("day"), F.lit("signal").alias("kind"), "security_id", "symbol", *none("double", "open", "high", "low"), "close", *none("double", "ratio"), *none("array<string>", "flags"), "atr", F.col("rank").cast("long").alias("rank"), *no_event)
    event_rows = e.select(
        "run_id", F.col("ex_date").alias("day"), F.lit("event").alias("kind"), "security_id", *none("string", "symbol"), *none("double", "open", "high", "low", "close", "ratio"), *none("array<string>", "flags"), *no_signal,
        "ex_date", first_day_of(F.col("first_known")).alias("first_day"), "status", "factor", "known_on", F.col("children").cast(CHILDREN).alias("children"),
    )
    days = runs.join(sessions.select(F.col("session_date").alias("day")).distinct(), F.col("day").between(F.col("first"), F.col("last")))  # a calendar for each run
    day_rows = days.select("run_id", "day", F.lit("session").alias("kind"), *none("string", "security_id", "symbol"), *none("double", "open", "high", "low", "close", "ratio"), *none("array<string>", "flags"), *no_signal, *no_event)
    rows = bar_rows.unionByName(day_rows).unionByName(kid_rows).unionByName(signal_rows).unionByName(event_rows).select(shape)
    return rows.join(span, F.col("run_id") == F.col("_r")).filter("day >= first and day <= last").select(shape)


def replayed(rows: DataFrame, rules: AccountRules) -> DataFrame:
    """Sales, cancelled orders and daily marks (kind) of every run of a stream."""
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32()}
    types = [kinds[c.strip().split(" ")[1]] for c in SCHEMA.split(",")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, day, today, account = None, None, [], Account(rules)

        def made(run_id: int, out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([run_id if n == "run_id" else r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["run_id"], r["day"]) != (run, day):
                    if today and (out := account.day(day, today)):
                        yield made(run, out)
                    if r["run_id"] != run:
                        account = Account(rules)
                    run, day, today = r["run_id"], r["day"], []
                if r["children"] is not None:
                    r["children"] = [(c["symbol"], c["ratio"]) for c in r["children"]]
                today.append(r)
        if today and (out := account.day(day, today)):
            yield made(run, out)

    return rows.repartition("run_id").sortWithinPartitions("run_id", "day", "kind", "security_id", "symbol").mapInArrow(sweep, SCHEMA)


def signal_inputs(bars: DataFrame, atr_days: int) -> DataFrame:
    """security_id, session_date, close, atr: mean of the last atr_days true ranges, the night's own included (null: too few rows).

    bars are adjusted for the splits known that night, so a night's own bar is in its own unit.
    """
    w = Window.partitionBy("security_id").orderBy("session_date")
    before = F.lag("close").over(w)
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = bars.withColumn("_tr", F.when(before.isNotNull(), wide))
    last = w.rowsBetween(-(atr_days - 1), 0)
    return rows.select("security_id", "symbol", "session_date", "close", F.when(F.count("_tr").over(last) == atr_days, F.sum("_tr").over(last) / atr_days).alias("atr"))
