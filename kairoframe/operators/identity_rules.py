"""Rules that turn rename edges, listings and bars into validity segments.

Bars prove or disprove what records say: days on which two labels have the same prices are copies, days on which they
differ are two securities. Each rule is one join of the candidates with the days, counted by candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pit import FAR, first_of, within
from .identity import components
from .joins import identical_pairs

# Thresholds of the rules.
COPY_DAYS, COPY_SHARE, RESUME_DAYS, LAST_BAR_DAYS, PARALLEL, RECENT, HAND_OVER, NEAR = 3, 0.9, 14, 10, 5, 10, 5, (0.8, 1.25)
PRICE = ("open", "high", "low", "close")


def identical_days(bars: DataFrame, same: tuple[str, ...] = PRICE) -> DataFrame:
    """first, second (first < second), session_date: traded days on which two labels have the same prices."""
    return identical_pairs(bars.filter("volume > 0"), "symbol", ["session_date", *same]).select("first", "second", "session_date")


def is_copy(traded: Column, identical: Column) -> Column:
    return (identical >= COPY_DAYS) & (identical >= COPY_SHARE * traded)


def copy_shares(candidates: DataFrame, bars: DataFrame, same: DataFrame) -> DataFrame:
    """candidates (key, symbol, other, lo, hi): key, traded days of the symbol in [lo, hi), days identical to any other."""
    span = candidates.select("key", F.col("symbol").alias("_s"), "lo", "hi").distinct()
    days = bars.filter("volume > 0").select("symbol", "session_date")
    traded = span.join(days, (F.col("_s") == F.col("symbol")) & within(F.col("session_date"), F.col("lo"), F.col("hi"))).groupBy("key").agg(F.count(F.lit(1)).alias("traded"))
    pairs = candidates.select("key", F.least("symbol", "other").alias("first"), F.greatest("symbol", "other").alias("second"), "lo", "hi")
    hits = pairs.join(same, ["first", "second"]).filter(within(F.col("session_date"), F.col("lo"), F.col("hi"))).groupBy("key").agg(F.count_distinct("session_date").alias("identical"))
    every = candidates.select("key").distinct().join(traded, "key", "left").join(hits, "key", "left")
    return every.select("key", F.coalesce("traded", F.lit(0)).cast("long").alias("traded"), F.coalesce("identical", F.lit(0)).cast("long").alias("identical"))


def piece_stats(pieces: DataFrame, bars: DataFrame) -> DataFrame:
    """pieces (key, symbol, valid_from, valid_to) with their first and last traded day and how many there are."""
    days = bars.filter("volume > 0").select(F.col("symbol").alias("_s"), "session_date")
    held = pieces.join(days, (F.col("_s") == F.col("symbol")) & within(F.col("session_date"), F.col("valid_from"), F.col("valid_to")), "left")
    return held.groupBy("key", "symbol").agg(F.min("session_date").alias("first_bar"), F.max("session_date").alias("last_bar"), F.count("session_date").alias("bars"))


def resumed(pieces: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, start: bars of a label that go on more than RESUME_DAYS after its last piece ended and traded."""
    end = pieces.groupBy("symbol").agg(F.max(F.coalesce("valid_to", F.lit(FAR).cast("date"))).alias("_end"))
    days = bars.filter("volume > 0").select("symbol", "session_date")
    w = Window.partitionBy("symbol").orderBy("session_date")
    gaps = days.withColumn("_gap", F.datediff("session_date", F.lag("session_date").over(w)))
    return gaps.join(end, "symbol").filter((F.col("session_date") >= F.col("_end")) & (F.coalesce("_gap", F.lit(RESUME_DAYS + 1)) > RESUME_DAYS)).groupBy("symbol").agg(F.min("session_date").alias("start"))


def refined(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """edges (old_symbol, new_symbol, date, date_lower): a listing's date moves to the day after the old label's last
    traded bar within (date_lower, date], since the switch was then; others stay."""
    days = bars.filter("volume > 0").select(F.col("symbol").alias("_s"), "session_date")
    seen = edges.filter("date_lower is not null").join(days, (F.col("_s") == F.col("old_symbol")) & (F.col("session_date") > F.col("date_lower")) & (F.col("session_date") < F.col("date"))).groupBy("old_symbol", "new_symbol").agg(F.max("session_date").alias("_last"))
    rows = edges.join(seen, ["old_symbol", "new_symbol"], "left")
    return rows.select("old_symbol", "new_symbol", F.coalesce(F.date_add("_last", 1), F.col("date")).alias("date"), F.when(F.col("_last").isNull(), F.col("date_lower")).alias("date_lower"))


def conversions(edges: DataFrame, bars: DataFrame, same: DataFrame) -> DataFrame:
    """old_symbol, new_symbol, differing, recent: both names traded side by side, with different prices, right up to the
    record: one security became another's shares, which is no rename."""
    days = bars.filter("volume > 0").select("symbol", "session_date")
    numbered = days.select("session_date").distinct().select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("_no"))
    o = days.select(F.col("symbol").alias("old_symbol"), "session_date")
    n = days.select(F.col("symbol").alias("new_symbol"), "session_date")
    side = edges.select("old_symbol", "new_symbol", "date").join(o, "old_symbol").join(n, ["new_symbol", "session_date"]).filter("session_date < date")
    equal = same.select(F.col("first").alias("_a"), F.col("second").alias("_b"), F.col("session_date").alias("_d"))
    side = side.join(equal, (F.least("old_symbol", "new_symbol") == F.col("_a")) & (F.greatest("old_symbol", "new_symbol") == F.col("_b")) & (F.col("session_date") == F.col("_d")), "left_anti")
    at = edges.select("date").distinct().join(F.broadcast(numbered), F.col("session_date") < F.col("date")).groupBy("date").agg(F.max("_no").alias("_end"))
    rows = side.join(F.broadcast(numbered), "session_date").join(at, "date")
    made = rows.groupBy("old_symbol", "new_symbol", "date").agg(F.count(F.lit(1)).alias("differing"), F.count_if(F.col("_no") > F.col("_end") - RECENT).alias("recent"))
    return made.filter((F.col("differing") >= PARALLEL) & (F.col("recent") > 0))


def clipped(pieces: DataFrame, bars: DataFrame, same: DataFrame) -> DataFrame:
    """pieces (key, chain, symbol, valid_from, valid_to): an earlier piece ends where a later one of its chain begins, if its
    bars in the overlap are copies of the later one's. Overlaps that really differ are left."""
    a = pieces.select("chain", F.col("key").alias("_a"), "symbol", F.col("valid_from").alias("_af"), F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("_at"))
    b = pieces.select("chain", F.col("symbol").alias("other"), F.col("valid_from").alias("lo"), F.coalesce("valid_to", F.lit(FAR).cast("date")).alias("_bt"))
    over = a.join(b, "chain").filter("symbol <> other and _af < lo and lo < _at").withColumn("hi", F.least("_at", "_bt")).withColumn("key", F.xxhash64("_a", "other", "lo"))
    judged = copy_shares(over.select("key", "symbol", "other", "lo", "hi"), bars, same).filter(is_copy(F.col("traded"), F.col("identical"))).select("key")
    cut = over.join(judged, "key").groupBy("_a").agg(F.min("lo").alias("_cut"))
    rows = pieces.join(cut, pieces["key"] == F.col("_a"), "left")
    return rows.withColumn("valid_to", F.coalesce("_cut", "valid_to")).withColumn("clipped", F.col("_cut").isNotNull()).drop("_a", "_cut")


def copied_pieces(pieces: DataFrame, bars: DataFrame, same: DataFrame) -> DataFrame:
    """Keys of pieces whose bars are copies of the chain that holds their label last: a past that was rewritten."""
    last = first_of(pieces, ["symbol"], [F.desc("valid_from"), F.desc("chain")]).select("symbol", F.col("chain").alias("_latest"))
    old = pieces.join(last, "symbol").filter("chain <> _latest")
    names = pieces.select(F.col("chain").alias("_latest"), F.col("symbol").alias("other")).distinct()
    candidates = old.join(names, "_latest").filter("other <> symbol").select("key", "symbol", "other", F.col("valid_from").alias("lo"), F.col("valid_to").alias("hi"))
    return copy_shares(candidates, bars, same).filter(is_copy(F.col("traded"), F.col("identical"))).select("key")


def copied_tails(pieces: DataFrame, bars: DataFrame, same: DataFrame) -> DataFrame:
    """key, cut: from this day on at least COPY_SHARE of a piece's traded days are copies of another label's (the earliest
    such day that begins a run of COPY_DAYS or more); nothing if the whole piece would go."""
    days = bars.filter("volume > 0").select(F.col("symbol").alias("_s"), "session_date")
    held = pieces.join(days, (F.col("_s") == F.col("symbol")) & within(F.col("session_date"), F.col("valid_from"), F.col("valid_to"))).select("key", "symbol", "session_date")
    either = same.select(F.col("first").alias("symbol"), "session_date").unionByName(same.select(F.col("second").alias("symbol"), "session_date")).distinct().withColumn("_c", F.lit(1))
    rows = held.join(either, ["symbol", "session_date"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    after = Window.partitionBy("key").orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(after)).withColumn("_k", F.sum("_c").over(after)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return rows.filter((F.col("_c") == 1) & (F.col("_k") >= COPY_DAYS) & (F.col("_k") >= COPY_SHARE * F.col("_n")) & (F.col("_n") < F.col("_all"))).groupBy("key").agg(F.min("session_date").alias("cut"))


def continuous(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """edges with the last close of the old label before the date, the first of the new from it on, and whether the price
    runs on: a ratio within NEAR and at most LAST_BAR_DAYS between."""
    b = bars.filter("volume > 0").select("symbol", "session_date", "close")
    o = edges.join(b, (F.col("symbol") == F.col("old_symbol")) & (F.col("session_date") < F.col("date"))).groupBy("old_symbol", "new_symbol", "date").agg(F.max_by("close", "session_date").alias("last_close"), F.max("session_date").alias("last_day"))
    n = edges.join(b, (F.col("symbol") == F.col("new_symbol")) & (F.col("session_date") >= F.col("date"))).groupBy("old_symbol", "new_symbol", "date").agg(F.min_by("close", "session_date").alias("first_close"), F.min("session_date").alias("first_day"))
    rows = edges.select("old_symbol", "new_symbol", "date").distinct().join(o, ["old_symbol", "new_symbol", "date"], "left").join(n, ["old_symbol", "new_symbol", "date"], "left")
    ratio = F.col("first_close") / F.col("last_close")
    ok = ratio.between(*NEAR) & (F.datediff("first_day", "last_day") <= LAST_BAR_DAYS)
    return rows.withColumn("continuous", F.coalesce(ok, F.lit(False)))


def segment_filer(segments: DataFrame, listings: DataFrame) -> DataFrame:
    """segments with the filer that most snapshots in their span list for their label (a tie: the latest, then the least)."""
    s = segments.select("security_id", F.col("symbol").alias("ticker"), "valid_from", "valid_to")
    seen = s.join(listings.select("ticker", "cik", "snapshot_date").distinct(), "ticker").filter(within(F.col("snapshot_date"), F.col("valid_from"), F.col("valid_to")))
    counted = seen.groupBy("security_id", "ticker", "valid_from", "cik").agg(F.count(F.lit(1)).alias("_n"), F.max("snapshot_date").alias("_z"), F.min("snapshot_date").alias("known_day"))
    return first_of(counted, ["security_id", "ticker", "valid_from"], [F.desc("_n"), F.desc("_z"), F.col("cik")]).select("security_id", F.col("ticker").alias("symbol"), "valid_from", "cik", "known_day")


def built_segments(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """security_id, symbol, valid_from, valid_to: each label's timeline cut where an edge starts or ends it, pieces of one
    chain of edges one security, ids by first day. edges: old_symbol, new_symbol, date."""
    labels = bars.filter("volume > 0").groupBy("symbol").agg(F.min("session_date").alias("_first"))
    starts = edges.select(F.col("new_symbol").alias("symbol"), F.col("date").alias("cut"), F.concat_ws(":", "old_symbol", F.lit("to"), F.col("date").cast("string")).alias("_from"))
    ends = edges.select(F.col("old_symbol").alias("symbol"), F.col("date").alias("cut")).withColumn("_ends", F.lit(True))
    cuts = labels.select("symbol", F.col("_first").alias("cut")).unionByName(starts.select("symbol", "cut")).unionByName(ends.select("symbol", "cut")).distinct()
    w = Window.partitionBy("symbol").orderBy("cut")
    pieces = cuts.withColumn("valid_to", F.lead("cut").over(w)).withColumnRenamed("cut", "valid_from").withColumn("node", F.concat_ws("@", "symbol", F.col("valid_from").cast("string")))
    # the piece that ends on an edge's day is joined to the new label's piece that begins on it
    e = edges.select("old_symbol", "new_symbol", "date").distinct()
    before = pieces.select(F.col("symbol").alias("old_symbol"), F.col("valid_to").alias("date"), F.col("node").alias("a"))
    after = pieces.select(F.col("symbol").alias("new_symbol"), F.col("valid_from").alias("date"), F.col("node").alias("b"))
    links = e.join(before, ["old_symbol", "date"]).join(after, ["new_symbol", "date"]).select("a", "b")
    chains = components(links, "a", "b")
    rows = pieces.join(chains, "node", "left").withColumn("chain", F.coalesce("component", "node"))
    firsts = rows.groupBy("chain").agg(F.min(F.struct("valid_from", "symbol")).alias("_f"))
    ids = firsts.select("chain", F.concat(F.lit("S"), F.lpad(F.row_number().over(Window.orderBy("_f", "chain")).cast("string"), 6, "0")).alias("security_id"))
    return rows.join(ids, "chain").select("security_id", "symbol", "valid_from", "valid_to")
