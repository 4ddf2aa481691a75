"""Identity: which symbols name one security, from renames, listings and bars.

Edges say that one symbol became another; components of edges are securities. Everything is a DataFrame; the one loop
is the components', whose rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pit import first_of, masked_segments, within
from ..session import cut

LAG_DAYS, GAP_SNAPSHOTS = 183, 2




def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the least node of its component, for every node of an edge.

    Each round takes the least label of the neighbours, then that label's own label (pointer jumping), so labels
    travel twice as far each round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    both, labels = cut(both), cut(labels)
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("component", "m").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = cut(step.join(up, "component").select("node", F.least("component", "higher").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def normal_spelling(listings: DataFrame, stored: DataFrame) -> DataFrame:
    """listings (ticker, cik) with one spelling for each filer and run of letters: the only one that the store uses,
    else the dotted one that is first in order."""
    letters = F.regexp_replace("ticker", r"\.", "")
    forms = listings.select("cik", letters.alias("_l"), "ticker").distinct().join(stored.select(F.col("symbol").alias("ticker"), F.lit(True).alias("_in")).distinct(), "ticker", "left")
    many = Window.partitionBy("cik", "_l")
    forms = forms.withColumn("_stored", F.count("_in").over(many))
    order = [F.when((F.col("_stored") == 1) & F.col("_in"), 0).otherwise(1), ~F.col("ticker").contains("."), F.col("ticker")]
    best = first_of(forms, ["cik", "_l"], order).select("cik", "_l", F.col("ticker").alias("_best"))
    return listings.withColumn("_l", letters).join(best, ["cik", "_l"]).withColumn("ticker", F.col("_best")).drop("_l", "_best")


def listing_edges(listings: DataFrame) -> DataFrame:
    """Renames seen in listings (snapshot_date, ticker, cik): from one snapshot of a filer to its next, one ticker gone and
    one new. Not if the old one returns later, the new one was there before, or the filer was away for long."""
    rows = listings.select("cik", "snapshot_date", "ticker").distinct()
    snaps = rows.select("snapshot_date").distinct().select("snapshot_date", F.row_number().over(Window.orderBy("snapshot_date")).alias("_no"))
    sets = rows.groupBy("cik", "snapshot_date").agg(F.array_sort(F.collect_set("ticker")).alias("now")).join(F.broadcast(snaps), "snapshot_date")
    w = Window.partitionBy("cik").orderBy("snapshot_date")
    sets = sets.withColumn("was", F.lag("now").over(w)).withColumn("date_lower", F.lag("snapshot_date").over(w)).withColumn("_away", F.col("_no") - F.lag("_no").over(w) - 1).filter("was is not null")
    step = sets.withColumn("gone", F.array_except("was", "now")).withColumn("came", F.array_except("now", "was")).filter((F.size("gone") == 1) & (F.size("came") == 1) & (F.col("_away") <= GAP_SNAPSHOTS))
    step = step.select("cik", F.col("snapshot_date").alias("date"), "date_lower", F.get("gone", F.lit(0)).alias("old_symbol"), F.get("came", F.lit(0)).alias("new_symbol"))
    span = rows.groupBy("cik", "ticker").agg(F.min("snapshot_date").alias("_a"), F.max("snapshot_date").alias("_z"))
    step = step.join(span.select("cik", F.col("ticker").alias("old_symbol"), F.col("_z").alias("_old_last")), ["cik", "old_symbol"]).join(span.select("cik", F.col("ticker").alias("new_symbol"), F.col("_a").alias("_new_first")), ["cik", "new_symbol"])
    return step.filter("_old_last <= date and _new_first >= date_lower").select("old_symbol", "new_symbol", "date", "date_lower")


def merged_edges(exact: DataFrame, seen: DataFrame) -> DataFrame:
    """One edge for each (old, new): the earliest exact date; else the listing's, moved to the latest exact start of either
    label within LAG_DAYS before it, which is the same event seen late."""
    keys = ["old_symbol", "new_symbol"]
    e = exact.filter("old_symbol <> new_symbol").groupBy(*keys).agg(F.min("date").alias("exact"))
    s = seen.groupBy(*keys).agg(F.max("date").alias("seen"), F.max("date_lower").alias("date_lower"))
    both = e.join(s, keys, "full_outer")
    starts = e.select(F.col("new_symbol").alias("label"), F.col("exact").alias("start")).distinct()
    late = both.filter("exact is null").select(*keys, "seen", F.explode(F.array("old_symbol", "new_symbol")).alias("label")).join(starts, "label").filter((F.col("start") <= F.col("seen")) & (F.datediff("seen", "start") <= LAG_DAYS)).groupBy(*keys).agg(F.max("start").alias("moved"))
    rows = both.join(late, keys, "left")
    evidence = F.when(F.col("exact").isNull(), "listing").when(F.col("seen").isNull(), "exact").otherwise("both")
    return rows.select(*keys, F.coalesce("exact", "moved", "seen").alias("date"), F.when(F.col("exact").isNull() & F.col("moved").isNull(), F.col("date_lower")).alias("date_lower"), evidence.alias("evidence"))


def switches(listings: DataFrame) -> DataFrame:
    """ticker, day, lower: a ticker's filers at one snapshot and at its next share nobody."""
    sets = listings.groupBy("ticker", "snapshot_date").agg(F.collect_set("cik").alias("now"))
    w = Window.partitionBy("ticker").orderBy("snapshot_date")
    rows = sets.withColumn("was", F.lag("now").over(w)).withColumn("lower", F.lag("snapshot_date").over(w))
    return rows.filter(F.col("was").isNotNull() & ~F.arrays_overlap("was", "now")).select("ticker", F.col("snapshot_date").alias("day"), "lower")


def mass_corrections(found: DataFrame, least: int) -> DataFrame:
    """Days on which so many tickers switch that the table was corrected."""
    return found.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def symbol_windows(listings: DataFrame) -> DataFrame:
    """ticker, start, end: from the snapshot after the last without it to the one after its last (null: still listed)."""
    snaps = listings.select("snapshot_date").distinct()
    o = Window.orderBy("snapshot_date")
    beside = snaps.select("snapshot_date", F.lag("snapshot_date").over(o).alias("before"), F.lead("snapshot_date").over(o).alias("after"))
    ends = listings.groupBy("ticker").agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("z"))
    rows = ends.join(F.broadcast(beside.select(F.col("snapshot_date").alias("a"), "before")), "a").join(F.broadcast(beside.select(F.col("snapshot_date").alias("z"), "after")), "z")
    return rows.select("ticker", F.col("before").alias("start"), F.col("after").alias("end"))


def only_over_the_counter(listings: DataFrame) -> DataFrame:
    """Tickers that no snapshot lists on an exchange."""
    return listings.groupBy("ticker").agg(F.array_except(F.collect_set("exchange"), F.array(F.lit("OTC"))).alias("x")).filter(F.size("x") == 0).select("ticker")


def stable_ids(segments: DataFrame, group: str) -> DataFrame:
    """segments with security_no: S000001 and on, by a group's first day, then its first symbol."""
    firsts = segments.groupBy(group).agg(F.min(F.struct("valid_from", "symbol")).alias("_f"))
    numbered = firsts.withColumn("security_no", F.concat(F.lit("S"), F.lpad(F.row_number().over(Window.orderBy("_f", group)).cast("string"), 6, "0"))).drop("_f")
    return segments.join(numbered, group)


def canonical_names(segments: DataFrame) -> DataFrame:
    """security_id, name: its earliest segment's symbol and day."""
    first = segments.groupBy("security_id").agg(F.min(F.struct("valid_from", "symbol")).alias("f"))
    return first.select("security_id", F.concat_ws("@", "f.symbol", F.col("f.valid_from").cast("string")).alias("name"))


def first_match(rows: DataFrame, rules: Sequence[tuple[str, str, Column]], out: str = "class") -> DataFrame:
    """rows with the class and id of the first rule (id, class, condition) that holds; unknown and none otherwise."""
    cls, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, value, when in reversed(rules):
        cls, rule = F.when(when, value).otherwise(cls), F.when(when, name).otherwise(rule)
    return rows.withColumn(out, F.coalesce(cls, F.lit("unknown"))).withColumn("rule", F.coalesce(rule, F.lit("none")))


def inherited(classes: DataFrame) -> DataFrame:
    """An unknown segment takes the class of its security's later segments if they agree; never from earlier ones."""
    later = classes.filter("class <> 'unknown'").select(F.col("security_id").alias("_i"), F.col("valid_from").alias("_f"), F.col("class").alias("_c"))
    seen = classes.filter("class = 'unknown'").select("security_id", "symbol", "valid_from").join(later, (F.col("_i") == F.col("security_id")) & (F.col("_f") > F.col("valid_from")))
    one = seen.groupBy("security_id", "symbol", "valid_from").agg(F.collect_set("_c").alias("_all")).filter(F.size("_all") == 1)
    rows = classes.join(one, ["security_id", "symbol", "valid_from"], "left")
    got = F.col("_all").isNotNull() & (F.col("class") == "unknown")
    return rows.withColumn("rule", F.when(got, "inherited").otherwise(F.col("rule"))).withColumn("class", F.when(got, F.get("_all", F.lit(0))).otherwise(F.col("class"))).drop("_all")


def chain_filer(segments: DataFrame) -> DataFrame:
    """segments with the filer of the nearest segment of the security that has one and was known no later."""
    given = segments.filter("cik is not null").select(F.col("security_id").alias("_i"), F.col("cik").alias("_c"), F.col("valid_from").alias("_f"), F.col("cik_available_at").alias("_k"))
    rows = segments.filter("cik is null").join(given, (F.col("_i") == F.col("security_id")) & (F.col("_k") <= F.col("available_at")), "left")
    best = first_of(rows, ["security_id", "symbol", "valid_from"], [F.abs(F.datediff("_f", "valid_from")).asc_nulls_last(), F.col("_f"), F.col("_c")])
    return segments.filter("cik is not null").withColumn("filled", F.lit(False)).unionByName(best.withColumn("cik", F.col("_c")).select(*segments.columns, F.col("cik").isNotNull().alias("filled")))


def truncation_diff(full: DataFrame, rebuilt: DataFrame, as_of: str) -> DataFrame:
    """How a table differs from its rebuild from what was knowable, both as a reader at the instant sees them.

    leak: the full table says what could not be known; delay: it says it later, or not yet.
    """
    keys = ["symbol", "valid_from"]
    side = lambda df, p: masked_segments(df, as_of).select(*keys, F.lit(True).alias(f"{p}_has"), *[F.col(c).alias(f"{p}_{c}") for c in ("security_id", "valid_to", "cik", "cik_available_at")])
    both = side(full, "f").join(side(rebuilt, "t"), keys, "full_outer")
    fields = [F.when(~F.col(f"f_{c}").eqNullSafe(F.col(f"t_{c}")), F.lit(c)) for c in ("cik", "cik_available_at", "security_id", "valid_to")]
    both = both.withColumn("fields", F.concat_ws("+", *fields))
    withheld = F.col("f_cik").isNull() | ((F.col("f_cik") == F.col("t_cik")) & (F.col("f_cik_available_at") > F.col("t_cik_available_at")))
    only_filer = F.col("f_security_id").eqNullSafe(F.col("t_security_id")) & F.col("f_valid_to").eqNullSafe(F.col("t_valid_to"))
    taken = masked_segments(full, as_of).select(F.col("symbol").alias("_s"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    lone = both.filter("f_has is null").select(*keys, "t_valid_to")
    far = F.lit("9999-12-31").cast("date")
    replaced = lone.join(taken, (F.col("_s") == F.col("symbol")) & (F.col("_f") < F.coalesce("t_valid_to", far)) & (F.col("valid_from") < F.coalesce("_t", far)), "left_semi").select(*keys, F.lit(True).alias("_replaced"))
    both = both.join(replaced, keys, "left")
    kind = (
        F.when(F.col("t_has").isNull(), "leak").when(F.col("f_has").isNull(), F.when(F.col("_replaced"), "leak").otherwise("delay"))
        .when(F.col("fields") == "", None).when(only_filer & withheld, "delay").otherwise("leak")
    )
    reason = (
        F.when(F.col("t_has").isNull(), "only_in_full").when(F.col("f_has").isNull(), F.when(F.col("_replaced"), "replaced").otherwise("only_in_rebuild"))
        .when(only_filer & withheld, "cik_withheld").otherwise("fields_differ")
    )
    return both.select(*keys, kind.alias("kind"), reason.alias("reason"), F.when(F.col("f_has") & F.col("t_has"), F.col("fields")).otherwise("").alias("fields")).filter("kind is not null")


def cell_impact(bars: DataFrame, full: DataFrame, rebuilt: DataFrame, as_of: str) -> DataFrame:
    """symbol, full_owner, rebuilt_owner, first, last, days: bars whose owner differs. Only symbols whose segments differ are
    read; the others cannot."""
    cols = ["symbol", "valid_from", "valid_to", "security_id"]
    a, b = masked_segments(full, as_of).select(*cols), masked_segments(rebuilt, as_of).select(*cols)
    scope = a.exceptAll(b).unionByName(b.exceptAll(a)).select("symbol").distinct()
    cells = bars.select("symbol", "session_date").join(scope, "symbol", "left_semi")

    def owner(segments: DataFrame, name: str) -> DataFrame:
        s = segments.select(F.col("symbol").alias("_s"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"), F.col("security_id").alias("_i"))
        held = cells.join(s, (F.col("_s") == F.col("symbol")) & within(F.col("session_date"), F.col("_f"), F.col("_t")), "left")
        return held.groupBy("symbol", "session_date").agg(F.array_join(F.array_sort(F.collect_set("_i")), "+").alias(name))

    both = owner(a, "full_owner").join(owner(b, "rebuilt_owner"), ["symbol", "session_date"]).filter("full_owner <> rebuilt_owner")
    return both.groupBy("symbol", "full_owner", "rebuilt_owner").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count(F.lit(1)).alias("days"))


def reachable_without(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, without, symbol: symbols that linking edges (old, new) reach from start when the node `without` is taken out.

    Each question's frontier grows by one edge a round; what was reached before is not looked at again.
    """
    both = edges.select(F.col("old").alias("_a"), F.col("new").alias("_b")).unionByName(edges.select(F.col("new").alias("_a"), F.col("old").alias("_b"))).distinct()
    seen = starts.select("start", "without").distinct().withColumn("symbol", F.col("start"))
    front = seen
    while front.take(1):
        step = front.join(both, F.col("symbol") == F.col("_a")).select("start", "without", F.col("_b").alias("symbol")).filter("symbol <> without").distinct()
        front = cut(step.join(seen, ["start", "without", "symbol"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def round_trips(edges: DataFrame) -> DataFrame:
    """Labels taken back from where their holder had just gone: pairs of edges old -> new -> old in order of the day."""
    a, b = edges.alias("a"), edges.alias("b")
    same = (F.col("a.old") == F.col("b.new")) & (F.col("a.new") == F.col("b.old")) & (F.col("b.day") > F.col("a.day"))
    return a.join(b, same).select(F.col("a.old").alias("symbol"), F.col("a.new").alias("other"), F.col("a.day").alias("left_on"), F.col("b.day").alias("back_on"))


def presence(snapshots: DataFrame) -> DataFrame:
    """ticker, seen: the snapshots that list it, as sorted (day, filer)."""
    return snapshots.groupBy("ticker").agg(F.array_sort(F.collect_set(F.struct("snapshot_date", "cik"))).alias("seen"))


def class_lookups(snapshots: DataFrame) -> DataFrame:
    """ticker, cik, filers (of the ticker), tickers (of the filer): what the classifier looks up."""
    pairs = snapshots.select("ticker", "cik").distinct()
    filers, names = pairs.groupBy("ticker").agg(F.count(F.lit(1)).alias("filers")), pairs.groupBy("cik").agg(F.count(F.lit(1)).alias("tickers"))
    return pairs.join(filers, "ticker").join(names, "cik")


def diff_key(symbol: Column, valid_from: Column, reason: Column, names: Column) -> Column:
    """SYMBOL:day:reason, and the fields that differ: a row that differs in one more is another one."""
    return F.concat_ws(":", symbol, valid_from.cast("string"), reason, F.nullif(names, F.lit("")))
