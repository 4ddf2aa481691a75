"""Reads bound to an instant.

A row is visible from its `available_at` on. A validity segment's start, end and filer are separate facts, each
with an instant of its own, so masking hides each by itself. Every function takes and returns lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def visible(df: DataFrame, as_of: str, known: str = "available_at") -> DataFrame:
    return df.filter(F.col(known) <= instant(as_of))


class PitTable:
    """A table that can be read only as of an instant."""

    def __init__(self, df: DataFrame, known: str = "available_at") -> None:
        if known not in df.columns:
            raise ValueError(f"no column {known}: a point-in-time table needs its knowledge instant")
        self._df, self._known = df, known

    def as_of(self, as_of: str) -> DataFrame:
        if not as_of:
            raise ValueError("a read needs an instant")
        return visible(self._df, as_of, self._known)


def overridden(vendor: DataFrame, imported: DataFrame, keys: Sequence[str], as_of: str | None = None) -> DataFrame:
    """Vendor rows whose key no imported row has, and the imported rows. Both sides are cut at the instant first,
    so an import that is not knowable yet hides nothing."""
    if as_of is not None:
        vendor, imported = visible(vendor, as_of), visible(imported, as_of)
    return vendor.join(imported.select(*keys).distinct(), list(keys), "left_anti").select(vendor.columns).unionByName(imported.select(vendor.columns))


def masked_segments(segments: DataFrame, as_of: str) -> DataFrame:
    """Segments known at the instant; an end or a filer that is not known yet is null."""
    at = instant(as_of)
    end_known, filer_known = F.col("end_available_at") <= at, F.col("cik_available_at") <= at
    return (
        visible(segments, as_of)
        .withColumn("valid_to", F.when(end_known, F.col("valid_to")))
        .withColumn("cik", F.when(filer_known, F.col("cik")))
        .withColumn("cik_available_at", F.when(filer_known, F.col("cik_available_at")))
        .withColumn("end_available_at", F.when(end_known, F.col("end_available_at")))
    )


def within(day: Column, start: Column, end: Column) -> Column:
    """Half-open validity; an open end counts as the far future, which keeps the join on its equal keys."""
    return (day >= start) & (day < F.coalesce(end, F.lit(FAR).cast("date")))


def segment_faults(segments: DataFrame, as_of: str) -> DataFrame:
    """fault, n: rows that no reader should trust, one row per rule. Row rules first, then keys among visible rows."""
    c = F.col
    rules = {
        "no_instant": c("available_at").isNull(),
        "end_without_instant": c("valid_to").isNull() != c("end_available_at").isNull(),
        "empty_interval": F.coalesce(c("valid_to") <= c("valid_from"), F.lit(False)),
        "end_known_early": F.coalesce(c("end_available_at") < c("valid_to").cast("timestamp_ntz"), F.lit(False)),
        "filer_without_instant": c("cik").isNull() != c("cik_available_at").isNull(),
    }
    counted = segments.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    rows = counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("fault"), c(n).alias("n")) for n in rules])))
    shown = masked_segments(segments, as_of)
    again = shown.groupBy("security_id", "symbol", "valid_from").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    double = overlapping(shown, "symbol", "valid_from", "valid_to", "security_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(again.select(F.lit("duplicate_key").alias("fault"), "n")).unionByName(double.select(F.lit("overlap").alias("fault"), "n"))


def checked_segments(segments: DataFrame, as_of: str) -> DataFrame:
    """masked_segments, or an error that names the rules that are broken."""
    broken = [f"{r['fault']} ({r['n']})" for r in segment_faults(segments, as_of).filter("n > 0").collect()]
    if broken:
        raise ValueError("segments cannot be read: " + ", ".join(sorted(broken)))
    return masked_segments(segments, as_of)


def overlapping(segments: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Pairs of intervals of one key that share a day: a equal join on the key with the order as residual."""
    a, b = segments.alias("a"), segments.alias("b")
    earlier = (F.col(f"a.{start}") < F.col(f"b.{start}")) | ((F.col(f"a.{start}") == F.col(f"b.{start}")) & (F.col(f"a.{tie}") < F.col(f"b.{tie}")))
    meet = F.col(f"b.{start}") < F.coalesce(F.col(f"a.{end}"), F.lit(FAR).cast("date"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & earlier & meet).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{tie}").alias("first"), F.col(f"b.{tie}").alias("second"), F.col(f"a.{start}").alias("first_from"), F.col(f"b.{start}").alias("second_from")
    )


def owned(rows: DataFrame, segments: DataFrame, key: str = "symbol", day: str = "session_date", columns: Sequence[str] = ("security_id",)) -> DataFrame:
    """rows with the columns of the segment that owns their key on their day; rows nobody owns are left out."""
    s = segments.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(s, (rows[key] == F.col("_key")) & within(rows[day], F.col("_from"), F.col("_to")))
    return joined.select(*rows.columns, *[F.col(f"_{c}").alias(c) for c in columns])


def first_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def day_key(symbol: str, day: str) -> Column:
    return F.concat_ws(":", F.col(symbol), F.date_format(F.col(day), "yyyy-MM-dd"))


def not_rejected(df: DataFrame, rejected: Sequence[str], symbol: str, day: str) -> DataFrame:
    """rejected: keys SYMBOL:YYYY-MM-DD of records that prices disprove; they are left out at every instant."""
    return df.filter(~day_key(symbol, day).isin(list(rejected))) if rejected else df


def splits_as_of(splits: DataFrame, as_of: str, rejected: Sequence[str] = ()) -> DataFrame:
    """One row for each event: equal symbol, day, factor to nine digits and cusips; the earliest known copy stays,
    one that is no unit split first."""
    rows = not_rejected(visible(splits, as_of), rejected, "symbol", "ex_date")
    keys = ["symbol", "ex_date", F.round("factor", 9), "old_cusip", "new_cusip"]
    return first_of(rows, keys, [F.col("available_at"), F.col("kind") == "unit_split", F.col("kind"), F.col("old_rate"), F.col("new_rate")])


def dividends_as_of(dividends: DataFrame, as_of: str) -> DataFrame:
    return visible(dividends, as_of).dropDuplicates()


def spinoffs_as_of(records: DataFrame, as_of: str, rejected: Sequence[str] = ()) -> DataFrame:
    rows = not_rejected(visible(records, as_of), rejected, "parent_symbol", "ex_date")
    return first_of(rows, ["parent_symbol", "child_symbol", "ex_date", F.round("ratio", 9)], [F.col("available_at")])


def sessions(bars: DataFrame, as_of: str, last: int | None = None) -> DataFrame:
    """Days with a visible bar; the newest `last` of them."""
    days = visible(bars, as_of).select("session_date").distinct()
    return days.orderBy(F.desc("session_date")).limit(last) if last else days


def visible_bars(
    vendor: DataFrame,
    imported: DataFrame | None,
    as_of: str,
    segments: DataFrame | None = None,
    splits: DataFrame | None = None,
    symbols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    untraded: bool = False,
) -> DataFrame:
    """Bars known at the instant, imports replacing vendor rows; with segments, the bars that a visible segment owns,
    with its security and whether a known split takes effect that day. [start, end) cuts the bars' own time."""
    wanted = []
    if symbols is not None:
        wanted.append(F.col("symbol").isin(list(symbols)))
    if start is not None:
        wanted.append(F.col("t") >= instant(start))
    if end is not None:
        wanted.append(F.col("t") < instant(end))
    for cut in wanted:  # before the union, so that the scans of both sides are pruned
        vendor, imported = vendor.filter(cut), imported.filter(cut) if imported is not None else None
    bars = visible(vendor, as_of) if imported is None else overridden(vendor, imported, ["symbol", "t"], as_of)
    bars = bars.withColumn("traded", F.col("volume") > 0)
    if not untraded:
        bars = bars.filter("volume > 0")
    if segments is None:
        return bars
    bars = owned(bars, masked_segments(segments, as_of))
    if splits is None:
        return bars
    days = splits_as_of(splits, as_of).select("symbol", F.col("ex_date").alias("session_date"), F.lit(True).alias("_split")).distinct()
    return bars.join(days, ["symbol", "session_date"], "left").withColumn("split_day", F.coalesce("_split", F.lit(False))).drop("_split")


def visible_documents(docs: DataFrame, as_of: str) -> DataFrame:
    """Documents known at the instant that no revision known by then replaces."""
    known = visible(docs, as_of)
    return known.join(known.select(F.col("supersedes_id").alias("id")).filter("id is not null").distinct(), "id", "left_anti")


def truncated(tables: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """Every table cut to what was knowable, for a rebuild as of the instant."""
    return {name: visible(df, as_of) if "available_at" in df.columns else df for name, df in tables.items()}


def overlaps_window(start: str, end: str, sealed_start: str, sealed_end: str) -> bool:
    """Whether a read window touches a sealed one (both half-open)."""
    return start < sealed_end and sealed_start < end
