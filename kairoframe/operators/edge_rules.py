"""Rules on rename edges: when-issued labels, records without a taker, dates from bars, renames that nobody filed, takeovers.

An edge has old_symbol, new_symbol, date, date_lower, evidence ('exact', 'listing', 'both', 'bars'), available_at and,
after the first rule, links (it joins a chain) and starts (it begins its new label). Every rule is a few joins of the
edges with bars or with themselves; bars are reduced to a row a symbol or a symbol and edge before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import components
from .identity_rules import PRICE, identical_days

# Shapes of labels, and thresholds of the rules in days, sessions and shares.
WHEN_ISSUED, BANKRUPT = r"^(.*\.(WI|RTWI)|[A-Z]{4}V)$", r"^[A-Z]{4}Q$"
MAX_GAP_DAYS, HANDOVER_MAX_DAYS, LAG_MAX_DAYS = 10, 5, 183
RUN_MIN_DAYS, RUN_NEAR_SESSIONS, RUN_TOLERANCE = 3, 10, (3, 0.05)
PAIR = ("old_symbol", "new_symbol")


def when_issued(symbol: Column) -> Column:
    return symbol.rlike(WHEN_ISSUED)


def through_when_issued(edges: DataFrame) -> DataFrame:
    """Edges with when-issued labels made transparent.

    An edge into such a label goes. One out of it is replaced by an edge from what led in last, dated as the edge out
    (none if that leads back to itself), and stays as one that neither links nor starts; with nothing leading in it
    starts its label but links nothing. A replacement that listings saw too becomes that edge, with both as evidence.
    """
    old, new = when_issued(F.col("old_symbol")), when_issued(F.col("new_symbol"))
    plain = edges.filter(~old & ~new).withColumn("links", F.lit(True)).withColumn("starts", F.lit(True))
    into = edges.filter(new).select(F.col("old_symbol").alias("_source"), F.col("new_symbol").alias("_wi"), F.col("date").alias("_in"))
    out = edges.filter(old & ~new)
    led = out.join(into, (F.col("old_symbol") == F.col("_wi")) & (F.col("_in") <= F.col("date")), "left")
    source = F.max_by("_source", F.struct("_in", "_source")).alias("_source")
    led = led.groupBy(*edges.columns).agg(source)
    kept = led.withColumn("links", F.lit(False)).withColumn("starts", F.col("_source").isNull()).drop("_source")
    direct = led.filter("_source <> new_symbol").withColumn("old_symbol", F.col("_source")).withColumn("links", F.lit(True)).withColumn("starts", F.lit(True)).drop("_source")
    seen = plain.filter("evidence = 'listing'").select(*PAIR, F.lit(True).alias("_seen")).distinct()
    direct = direct.join(seen, list(PAIR), "left").withColumn("evidence", F.when(F.col("_seen"), "both").otherwise(F.col("evidence")))
    direct = direct.withColumn("date_lower", F.when(~F.coalesce("_seen", F.lit(False)), F.col("date_lower")))
    replaced = direct.filter("_seen").select(*PAIR).distinct().withColumn("_gone", F.lit(True))
    plain = plain.join(replaced, list(PAIR), "left").filter("not (coalesce(_gone, false) and evidence = 'listing')").drop("_gone")
    return plain.unionByName(kept).unionByName(direct.drop("_seen"))


def without_taker(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """old_symbol, new_symbol of records to drop: the old label never had a bar and no other edge, the new one traded before.

    The reverse of a dropped edge goes with it. When-issued and bankrupt labels are kept: the record is all there is.
    """
    known = bars.select(F.col("symbol").alias("old_symbol")).distinct()
    first = bars.filter("volume > 0").groupBy(F.col("symbol").alias("new_symbol")).agg(F.min("session_date").alias("_first"))
    both = F.array_join(F.array_sort(F.array(*PAIR)), "\0")
    touch = edges.select(F.explode(F.array(*PAIR)).alias("old_symbol"), both.alias("_pair")).distinct().groupBy("old_symbol").agg(F.count(F.lit(1)).alias("_others"))
    name = F.col("old_symbol")
    rows = edges.filter(~when_issued(name) & ~name.rlike(BANKRUPT)).join(known, "old_symbol", "left_anti")
    rows = rows.join(first, "new_symbol").filter("_first < date").join(touch, "old_symbol").filter("_others = 1").select(*PAIR)
    back = rows.select(F.col("new_symbol").alias("old_symbol"), F.col("old_symbol").alias("new_symbol"))
    return rows.unionByName(back).distinct().join(edges.select(*PAIR).distinct(), list(PAIR), "left_semi")


def refined_by_handover(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """Edges of records moved to the day after the old label's last traded bar, where the new one has bars in between.

    The record trails that bar by MAX_GAP_DAYS at most; or by LAG_MAX_DAYS, if the new label's first traded bar comes
    within HANDOVER_MAX_DAYS after it.
    """
    traded = bars.filter("volume > 0").select("symbol", "session_date")
    todo = edges.filter("evidence <> 'listing'").select(*PAIR, "date").distinct()
    last = todo.join(traded, (F.col("symbol") == F.col("old_symbol")) & (F.col("session_date") < F.col("date"))).groupBy(*PAIR, "date").agg(F.max("session_date").alias("_last"))
    first = traded.groupBy(F.col("symbol").alias("new_symbol")).agg(F.min("session_date").alias("_first"))
    rows = last.join(first, "new_symbol")
    trails, takes = F.datediff("date", "_last") - 1, F.datediff("_first", "_last")
    rows = rows.filter(trails.between(1, MAX_GAP_DAYS) | (trails.between(1, LAG_MAX_DAYS) & takes.between(1, HANDOVER_MAX_DAYS)))
    any_bar = bars.select(F.col("symbol").alias("_n"), F.col("session_date").alias("_d"))
    rows = rows.join(any_bar, (F.col("_n") == F.col("new_symbol")) & (F.col("_d") > F.col("_last")) & (F.col("_d") < F.col("date")), "left_semi")
    moved = rows.select(*PAIR, "date", F.date_add("_last", 1).alias("_to"))
    joined = edges.join(moved, [*PAIR, "date"], "left")
    day = F.when(F.col("evidence") != "listing", F.coalesce("_to", "date")).otherwise(F.col("date"))
    return joined.withColumn("date", day).select(edges.columns)


def renames_from_bars(bars: DataFrame, edges: DataFrame) -> DataFrame:
    """old_symbol, new_symbol, date, available_at: a label whose bars became another's for a run of days and then stopped,
    while the other traded on: a rename that nobody filed.

    Bars are reduced to one row for each identical pair first; what follows looks at those pairs' own days only.
    """
    traded = bars.filter("volume > 0")
    days = traded.select("session_date").distinct()
    numbered = days.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("n"))  # a calendar
    t = traded.select("symbol", "session_date", "available_at").join(numbered, "session_date")
    same = identical_days(bars, PRICE)
    pairs = same.groupBy("first", "second").agg(F.max("session_date").alias("run_end"), F.count(F.lit(1)).alias("_days")).filter(F.col("_days") >= RUN_MIN_DAYS).select("first", "second", "run_end")
    sides = pairs.select(F.col("first").alias("symbol"), F.col("second").alias("other"), "run_end").unionByName(pairs.select(F.col("second").alias("symbol"), F.col("first").alias("other"), "run_end"))
    ends = sides.join(numbered.select(F.col("session_date").alias("run_end"), F.col("n").alias("end_n")), "run_end")
    after = ends.join(t.withColumnRenamed("symbol", "_s"), (F.col("_s") == F.col("symbol")) & (F.col("session_date") > F.col("run_end")), "left")
    after = after.groupBy("symbol", "other", "run_end", "end_n").agg(F.min("n").alias("next_n"), F.min_by("session_date", "n").alias("cut"), F.min_by("available_at", "n").alias("cut_available"))
    near = F.col("next_n") - F.col("end_n") <= RUN_NEAR_SESSIONS
    stops, goes_on = F.col("next_n").isNull() | ~near, F.col("next_n").isNotNull() & near
    enders = after.filter(stops).select(F.col("symbol").alias("ender"), F.col("other").alias("continuer"), "run_end")
    goers = after.filter(goes_on).select(F.col("symbol").alias("continuer"), F.col("other").alias("ender"), "run_end", "cut", "cut_available")
    cands = enders.join(goers, ["ender", "continuer", "run_end"])
    low, high = F.least("ender", "continuer"), F.greatest("ender", "continuer")
    pair_days = cands.select("ender", "continuer", low.alias("first"), high.alias("second")).join(same, ["first", "second"]).select("ender", "continuer", "session_date", F.lit(True).alias("_same"))
    copied = same.select(F.col("first").alias("ender"), "session_date").unionByName(same.select(F.col("second").alias("ender"), "session_date")).distinct().withColumn("_copied", F.lit(True))
    own = cands.join(t.select(F.col("symbol").alias("ender"), "session_date", "n"), "ender").filter("session_date <= run_end")
    own = own.join(pair_days, ["ender", "continuer", "session_date"], "left").join(copied, ["ender", "session_date"], "left")
    key = ["ender", "continuer", "run_end", "cut", "cut_available"]
    broken = own.groupBy(*key).agg(F.max(F.when(F.col("_same").isNull(), F.col("n"))).alias("_break_n"), F.min("n").alias("ender_first_n"))
    own = own.join(broken, key)
    in_run = F.col("n") > F.coalesce("_break_n", F.lit(0))
    run = own.groupBy(*key, "ender_first_n").agg(F.min(F.when(in_run, F.col("n"))).alias("start_n"), F.count_if(in_run).alias("run_len"))
    alone = own.join(run.select(*key, "start_n"), key).filter("n < start_n and _copied is null").groupBy(*key).agg(F.max("n").alias("last_own_n"))
    theirs = cands.join(t.select(F.col("symbol").alias("continuer"), "session_date", "n"), "continuer").join(pair_days, ["ender", "continuer", "session_date"], "left")
    theirs = theirs.groupBy(*key).agg(F.min("n").alias("cont_first_n"), F.count_if((F.col("session_date") <= F.col("run_end")) & F.col("_same").isNull()).alias("differing"))
    rows = run.join(alone, key, "left").join(theirs, key)
    rows = rows.filter((F.col("run_len") >= RUN_MIN_DAYS) & ~when_issued(F.col("ender")) & ~when_issued(F.col("continuer")))
    rows = rows.filter(F.when(F.col("last_own_n").isNull(), F.col("start_n") == F.col("ender_first_n")).otherwise(F.col("start_n") - F.col("last_own_n") <= RUN_NEAR_SESSIONS))
    rows = rows.filter((F.abs(F.col("cont_first_n") - F.col("start_n")) <= RUN_NEAR_SESSIONS) & (F.col("differing") <= F.greatest(F.lit(RUN_TOLERANCE[0]), RUN_TOLERANCE[1] * F.col("run_len"))))
    linked = components(edges.filter("links") if "links" in edges.columns else edges, *PAIR)
    label = lambda side: linked.select(F.col("node").alias(side), F.col("component").alias(f"_c_{side}"))
    rows = rows.join(label("ender"), "ender", "left").join(label("continuer"), "continuer", "left")
    rows = rows.filter(F.coalesce("_c_ender", "ender") != F.coalesce("_c_continuer", "continuer"))
    known = edges.select(F.least(*PAIR).alias("_x"), F.greatest(*PAIR).alias("_y")).distinct()
    rows = rows.join(known, (low == F.col("_x")) & (high == F.col("_y")), "left_anti")
    many = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    rows = rows.withColumn("_e", many("ender")).withColumn("_k", many("continuer")).filter("_e = 1 and _k = 1")
    return rows.select(F.col("ender").alias("old_symbol"), F.col("continuer").alias("new_symbol"), F.col("cut").alias("date"), F.col("cut_available").alias("available_at"))


def taker_days(takeovers: DataFrame, members: DataFrame, bars: DataFrame) -> DataFrame:
    """key, own_days: days on which a piece of the taker's chain traded inside the holder's span with other prices than it.

    takeovers: key, symbol (the label), valid_from, cut; members: key, member (symbol), lo, hi (null: open).
    """
    span = takeovers.join(members, "key").select("key", F.col("symbol").alias("_label"), "member", F.greatest("lo", "valid_from").alias("_lo"), F.least(F.coalesce("hi", "cut"), "cut").alias("_hi")).filter("_lo < _hi")
    t = bars.filter("volume > 0").select(F.col("symbol").alias("member"), "session_date", *PRICE)
    p = bars.select(F.col("symbol").alias("_label"), "session_date", *[F.col(c).alias(f"_{c}") for c in PRICE], F.lit(True).alias("_has"))
    rows = span.join(t, "member").filter("session_date >= _lo and session_date < _hi").join(p, ["_label", "session_date"], "left")
    differs = F.col("_has").isNull()
    for c in PRICE:
        differs = differs | (F.col(c) != F.col(f"_{c}"))
    return rows.filter(differs).groupBy("key").agg(F.count_distinct("session_date").alias("own_days"))


def settled_takeovers(takeovers: DataFrame, members: DataFrame, pieces: DataFrame, bars: DataFrame) -> DataFrame:
    """takeovers with resolution: what became of a label that another filer took at a continuous price.

    takeovers: key, symbol, valid_from, cut, chain (of the holder's piece), taker (chain of the taker); pieces: symbol, chain,
    valid_from, valid_to. 'bridged': one chain already; 'new_security': the taker had bars of its own in the span;
    'unresolved': the holder's piece belongs to a longer chain, a taker's piece runs past the cut, or the label had an
    earlier piece that ends where this one starts; else 'relabelled': the span is the taker's own history.
    """
    own = taker_days(takeovers, members, bars)
    sizes = pieces.groupBy("chain").agg(F.count(F.lit(1)).alias("_pieces"))
    past = takeovers.join(members, "key").filter("member <> symbol and lo < cut and (hi is null or hi > valid_from) and (hi is null or hi > cut)").select("key").distinct().withColumn("_past", F.lit(True))
    before = pieces.select("symbol", F.col("valid_to").alias("valid_from")).filter("valid_from is not null").distinct().withColumn("_follows", F.lit(True))
    rows = takeovers.join(own, "key", "left").join(sizes, "chain", "left").join(past, "key", "left").join(before, ["symbol", "valid_from"], "left")
    odd = (F.col("_pieces") > 1) | F.coalesce("_past", F.lit(False)) | F.coalesce("_follows", F.lit(False))
    resolution = F.when(F.col("chain") == F.col("taker"), "bridged").when(F.col("own_days") > 0, "new_security").when(odd, "unresolved").otherwise("relabelled")
    return rows.select(*takeovers.columns, resolution.alias("resolution"))
