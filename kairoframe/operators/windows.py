"""Window features over one entity's ordered rows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import scanned

ENTITY, DAY = "security_id", "session_date"


def _order(key: str = ENTITY, day: str = DAY):
    return Window.partitionBy(key).orderBy(day)


def full_mean(value: Column, window, n: int) -> Column:
    """Mean over a frame that holds n values; null where it holds fewer."""
    return F.when(F.count(value).over(window) == n, F.avg(value).over(window))


def true_range(previous: Column) -> Column:
    return F.when(previous.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)))


def daily_features(bars: DataFrame, atr: int = 14, rvol: int = 20, money: int = 20, key: str = ENTITY) -> DataFrame:
    """Gap to the previous close, and over full windows that end the day before: true range, relative volume, money."""
    w = _order(key)
    rows = bars.withColumn("prev_close", F.lag("close").over(w))
    rows = rows.withColumn("gap", F.col("open") / F.col("prev_close") - 1).withColumn("_tr", true_range(F.col("prev_close"))).withColumn("_usd", F.col("close") * F.col("volume"))
    past = lambda n: w.rowsBetween(-n, -1)
    return (
        rows.withColumn("atr", full_mean(F.col("_tr"), past(atr), atr))
        .withColumn("rvol", F.col("volume") / full_mean(F.col("volume"), past(rvol), rvol))
        .withColumn("avg_dollar_volume", full_mean(F.col("_usd"), past(money), money))
        .drop("_tr", "_usd")
    )


def inclusive_atr(bars: DataFrame, n: int = 14, key: str = ENTITY) -> DataFrame:
    w = _order(key)
    rows = bars.withColumn("_tr", F.coalesce(true_range(F.lag("close").over(w)), F.col("high") - F.col("low")))
    return rows.withColumn("signal_atr", full_mean(F.col("_tr"), w.rowsBetween(-(n - 1), 0), n)).drop("_tr")


def above_mean(bars: DataFrame, n: int, key: str = ENTITY) -> DataFrame:
    """Whether a close is above its mean over n rows, the current one included (null: too few rows)."""
    w = _order(key)
    return bars.withColumn("above", F.col("close") > full_mean(F.col("close"), w.rowsBetween(-(n - 1), 0), n))


def session_index(bars: DataFrame, reach: int = 3) -> DataFrame:
    """Numbered sessions with the ones `reach` before and after (far dates at the ends)."""
    days = bars.select(DAY).distinct()
    w = Window.orderBy(DAY)  # a calendar: as many rows as days
    far = lambda d: F.lit(d).cast("date")
    return days.select(DAY, F.row_number().over(w).cast("long").alias("idx"), F.coalesce(F.lag(DAY, reach).over(w), far("1900-01-01")).alias("lo"), F.coalesce(F.lead(DAY, reach).over(w), far("2999-12-31")).alias("hi"))


def neighbours(bars: DataFrame, numbered: DataFrame, key: str = "symbol") -> DataFrame:
    """Traded bars with the close and session number of the previous bar of any kind and of the traded ones beside."""
    w = _order(key)
    rows = bars.join(F.broadcast(numbered), DAY)
    rows = rows.withColumn("prev_any_close", F.lag("close").over(w)).withColumn("prev_any_idx", F.lag("idx").over(w)).filter("volume > 0")
    return (
        rows.withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_idx", F.lag("idx").over(w))
        .withColumn("next_close", F.lead("close").over(w)).withColumn("next_idx", F.lead("idx").over(w))
    )


def suffix_sum(rows: DataFrame, key: str, day: str, value: str, out: str) -> DataFrame:
    """Sum of a value from each row to its key's last one."""
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)))


def rank_tertile(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """0, 1 or 2: a third of a group's ranking; the remainder goes to the first thirds."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).withColumn("tertile", F.floor(3 * (F.col("_rank") - 1) / F.col("_n")).cast("long")).drop("_rank", "_n")


def fair_value(bars: DataFrame, length: int = 33, key: str = ENTITY) -> DataFrame:
    """Mean of the bars' mid prices over `length` rows, whether the bar straddles it, and how often that was so far."""
    w = _order(key)
    mid = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    rows = bars.withColumn("fv", full_mean(mid, w.rowsBetween(-(length - 1), 0), length))
    rows = rows.withColumn("crossing", F.coalesce((F.col("low") < F.col("fv")) & (F.col("fv") < F.col("high")), F.lit(False)))
    return rows.withColumn("crossings", F.sum(F.col("crossing").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


class RunningMedian:
    """Median of all values so far, or of the last few: a sorted list, kept by bisection."""

    def __init__(self, last: int | None) -> None:
        self.sorted: list[float] = []
        self.recent: deque[float] | None = deque() if last else None
        self.last = last

    def add(self, x: float) -> None:
        insort(self.sorted, x)
        if self.recent is not None:
            self.recent.append(x)
            if len(self.recent) > self.last:
                del self.sorted[bisect_left(self.sorted, self.recent.popleft())]

    def value(self) -> float | None:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2 if n else None


def crossing_medians(rows: DataFrame, last: int | None, key: str = ENTITY) -> DataFrame:
    """Medians of high / fv and low / fv over the crossings so far, or the last of them: one pass along each entity."""

    def start():
        high, low = RunningMedian(last), RunningMedian(last)

        def step(crossing: bool, h: float, lo: float, fv: float) -> tuple:
            if crossing is True:
                high.add(h / fv)
                low.add(lo / fv)
            return high.value(), low.value()

        return step

    return scanned(rows, key, DAY, ["crossing", "high", "low", "fv"], start, {"hu": "double", "ld": "double"})


def sticky_colour(rows: DataFrame, least: int, key: str = ENTITY) -> DataFrame:
    """red below the lower band, green above the upper one, else the colour before; none while the bands are undefined."""
    w = _order(key).rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("fv").isNull() | (F.col("crossings") < least)
    flag = F.when(~off & (F.col("high") < F.col("fv") * F.col("ld")), "red").when(~off & (F.col("low") > F.col("fv") * F.col("hu")), "green")
    rows = rows.withColumn("_flag", flag).withColumn("_reset", F.sum(off.cast("int")).over(w))
    within = Window.partitionBy(key, "_reset").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("colour", F.when(~off, F.last("_flag", ignorenulls=True).over(within))).drop("_flag", "_reset")
