"""Spin-offs: what a parent's history before the ex-date is multiplied by, and from when that is known.

An event is a (parent security, ex-date) with the children paid that day. It is decided by a ladder, whose order
matters: records that cannot be priced restart the series at once; children that trade in time give a factor, which
the parent's own first session may disprove; an event whose inputs are not there yet is pending until the parent has
had `delay` sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pit import first_of

STALE_DAYS, DELAY, MAX_RETURN = 7, 20, 0.15


def parents(records: DataFrame, bars: DataFrame) -> DataFrame:
    """records with the security that carries the parent symbol at the ex-date (null: none).

    Its last bar before the day has the symbol (and it trades on, or stopped within a week), the latest such; else
    its first bar from the day on has it, the first such by id.
    """
    keys = records.select(F.col("parent_symbol").alias("_sym"), F.col("ex_date").alias("_ex")).distinct()
    holders = keys.join(bars.select("security_id", F.col("symbol").alias("_sym")).distinct(), "_sym")
    around = holders.join(bars.select("security_id", "symbol", "session_date"), "security_id").groupBy("_sym", "_ex", "security_id").agg(
        F.max(F.when(F.col("session_date") < F.col("_ex"), F.struct("session_date", "symbol"))).alias("_last"),
        F.min(F.when(F.col("session_date") >= F.col("_ex"), F.struct("session_date", "symbol"))).alias("_next"),
    )
    before = (F.col("_last.symbol") == F.col("_sym")) & (F.col("_next").isNotNull() | (F.datediff("_ex", "_last.session_date") <= STALE_DAYS))
    after = ~F.coalesce(F.col("_last.symbol") == F.col("_sym"), F.lit(False)) & (F.col("_next.symbol") == F.col("_sym"))
    ranked = around.withColumn("_kind", F.when(before, 0).when(after, 1)).filter("_kind is not null")
    latest = F.when(F.col("_kind") == 0, F.datediff(F.col("_last.session_date"), F.lit("1970-01-01").cast("date")))
    best = first_of(ranked, ["_sym", "_ex"], [F.col("_kind"), F.desc_nulls_last(latest), F.when(F.col("_kind") == 0, F.col("security_id")).desc_nulls_last(), F.col("security_id")])
    best = best.select(F.col("_sym").alias("parent_symbol"), F.col("_ex").alias("ex_date"), "security_id")
    return records.join(best, ["parent_symbol", "ex_date"], "left")


def events(records: DataFrame, bars: DataFrame, delay: int = DELAY, most: float = MAX_RETURN) -> DataFrame:
    """One row for each (parent security, ex-date): status adjust, restart or pending, reason, factor, total return, known_on.

    records: parent_symbol, child_symbol, ex_date, ratio, available_at; bars: resolved bars known at the instant.
    """
    known = F.to_date("available_at")
    owned = parents(records, bars).withColumn("owner", F.coalesce("security_id", F.concat(F.lit("symbol:"), "parent_symbol")))
    grouped = owned.groupBy("owner", "ex_date").agg(
        F.min("security_id").alias("security_id"), F.min("parent_symbol").alias("parent_symbol"), F.collect_set("parent_symbol").alias("_parents"),
        F.array_sort(F.collect_set(F.struct("child_symbol", "ratio"))).alias("_children"), F.max(known).alias("_records_known"),
    )
    own = bars.select("security_id", "session_date", "close", known.alias("_k"))
    day = F.col("session_date")
    price = grouped.filter("security_id is not null").select("owner", "ex_date", "security_id").join(own, "security_id")
    rank = Window.partitionBy("owner", "ex_date", F.col("session_date") < F.col("ex_date")).orderBy("session_date")
    price = price.withColumn("_n", F.row_number().over(rank)).groupBy("owner", "ex_date").agg(
        F.max(F.when(day < F.col("ex_date"), F.struct("session_date", "close", "_k"))).alias("_prev"),
        F.min(F.when(day >= F.col("ex_date"), F.struct("session_date", "close", "_k"))).alias("_next"),
        F.min(F.when((day >= F.col("ex_date")) & (F.col("_n") == delay + 1), day)).alias("_window"),
    )
    kids = grouped.select("owner", "ex_date", F.explode("_children").alias("c")).select("owner", "ex_date", F.col("c.child_symbol").alias("child"), F.col("c.ratio").alias("ratio"))
    child_bars = bars.select(F.col("symbol").alias("child"), "session_date", "close", known.alias("_k"))
    first = kids.join(child_bars, "child", "left").groupBy("owner", "ex_date", "child", "ratio").agg(F.min(F.when(day >= F.col("ex_date"), F.struct("session_date", "close", "_k"))).alias("_first"))
    paid = first.groupBy("owner", "ex_date").agg(
        F.count_if(F.col("_first").isNull()).alias("_missing"), F.sum(F.col("_first.close") * F.col("ratio")).alias("_paid"),
        F.max(F.greatest("_first.session_date", "_first._k")).alias("_kids_known"), F.max("_first.session_date").alias("_child_session"),
    )
    rows = grouped.join(price, ["owner", "ex_date"], "left").join(paid, ["owner", "ex_date"], "left")
    names = F.transform("_children", lambda x: x["child_symbol"])
    prev, after = F.col("_prev.close"), F.col("_next.close")
    rows = rows.withColumn("_known", F.greatest("_kids_known", "_records_known", F.coalesce("_prev._k", "ex_date"), "ex_date"))
    rows = rows.withColumn("_factor", (prev - F.col("_paid")) / prev).withColumn("_total", (after + F.col("_paid")) / prev - 1)
    priced = F.col("_missing") == 0
    in_time = priced & (F.col("_window").isNull() | (F.col("_known") <= F.col("_window")))
    reason = (
        F.when(F.arrays_overlap("_parents", names), "same_symbol").when(prev.isNull(), "no_parent_price")
        .when(F.exists("_children", lambda x: x["ratio"].isNull()), "no_ratio").when(F.size(F.array_distinct(names)) < F.size(names), "conflicting_ratio")
        .when(in_time & ~((F.col("_factor") > 0) & (F.col("_factor") < 1)), "factor_out_of_range").when(in_time & after.isNull(), "waiting")
        .when(in_time & (F.abs("_total") > most), "factor_disproved").when(in_time, "adjusted")
        .when(F.col("_window").isNotNull(), F.when(priced, "child_too_late").otherwise("no_child_price")).otherwise("waiting")
    )
    rows = rows.withColumn("_reason", reason)
    status = F.when(F.col("_reason") == "adjusted", "adjust").when(F.col("_reason") == "waiting", "pending").otherwise("restart")
    decided_on = (
        F.when(F.col("_reason") == "waiting", None).when(F.col("_reason").isin("child_too_late", "no_child_price"), F.col("_window"))
        .when(F.col("_reason") == "factor_out_of_range", F.col("_known")).when(F.col("_reason").isin("adjusted", "factor_disproved"), F.greatest("_known", "_next._k")).otherwise(F.col("ex_date"))
    )
    return rows.select(
        "parent_symbol", "security_id", "ex_date", F.transform("_children", lambda x: x["child_symbol"]).alias("child_symbols"), F.transform("_children", lambda x: x["ratio"]).alias("ratio"),
        prev.alias("parent_prev_close"), F.when(F.col("_reason") == "adjusted", F.col("_factor")).alias("factor"),
        F.when(F.col("_reason").isin("adjusted", "factor_disproved"), F.col("_total")).alias("total_return"), status.alias("status"),
        F.when(~F.col("_reason").isin("adjusted", "waiting"), F.col("_reason")).alias("reason"), decided_on.alias("known_on"),
    )
