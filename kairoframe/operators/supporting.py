"""Smaller operators that the larger ones and their tests rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pit import first_of, instant, within
from ..session import cut


def weekday_index(bars: DataFrame) -> DataFrame:
    """All weekdays from the first to the last traded bar, numbered."""
    ends = bars.filter("volume > 0").agg(F.explode(F.sequence(F.min("session_date"), F.max("session_date"))).alias("session_date"))
    days = ends.filter(F.weekday("session_date") < 5)
    return days.select("session_date", F.row_number().over(Window.orderBy("session_date")).cast("long").alias("idx"))


def masked_at(segments: DataFrame, instants: Sequence[str]) -> DataFrame:
    """The masked segments at every instant in one job: a stated, small set of instants, one column."""
    rows = segments.withColumn("as_of", F.explode(F.array(*[instant(x) for x in instants]))).filter("available_at <= as_of")
    return rows.withColumn("valid_to", F.when(F.col("end_available_at") <= F.col("as_of"), F.col("valid_to"))).withColumn("cik", F.when(F.col("cik_available_at") <= F.col("as_of"), F.col("cik"))).select("as_of", "security_id", "symbol", "valid_from", "valid_to", "cik")


def default_instants(rows: DataFrame, group: str, known: str = "available_at") -> DataFrame:
    """The first, lower median and last instant of each group, each a microsecond earlier: just before something was known."""
    w = Window.partitionBy(group).orderBy(known)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    ranked = rows.select(group, known).withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    kept = ranked.filter((F.col("_r") == 1) | (F.col("_r") == F.col("_n")) | (F.col("_r") == F.floor((F.col("_n") + 1) / 2)))
    return kept.select((F.col(known) - F.expr("interval 1 microsecond")).alias("instant")).distinct()


def fingerprint(values: Column, n: int = 16) -> Column:
    """A short hash of an array of strings, whatever its order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), ","), 256), 1, n)


def ratchet(baseline: DataFrame, found: DataFrame, key: str, count: str) -> DataFrame:
    """key, was, now, verdict: a count may fall but not rise, and nothing new may appear."""
    both = baseline.select(key, F.col(count).alias("was")).join(found.select(key, F.col(count).alias("now")), key, "full_outer")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") > F.col("was"), "worse").when(F.col("now") < F.col("was"), "better").otherwise("same")
    return both.withColumn("verdict", verdict)


def merged_ids(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """segments with securities that people declared one (first, second) under the lesser id, one step."""
    to = overrides.select(F.greatest("first", "second").alias("security_id"), F.least("first", "second").alias("_to")).groupBy("security_id").agg(F.min("_to").alias("_to"))
    return segments.join(to, "security_id", "left").withColumn("security_id", F.coalesce("_to", "security_id")).drop("_to")


def overridden_classes(classes: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with overrides (symbol, valid_from, class, expected) applied, overrides that are stale: no such segment, or its
    class is no longer the expected one)."""
    keys = ["symbol", "valid_from"]
    o = overrides.select(*keys, F.col("class").alias("_new"), F.col("expected").alias("_old"))
    joined = classes.join(o, keys, "left")
    hit = F.col("_new").isNotNull() & (F.col("class") == F.col("_old"))
    made = joined.withColumn("rule", F.when(hit, "override").otherwise(F.col("rule"))).withColumn("class", F.when(hit, F.col("_new")).otherwise(F.col("class"))).drop("_new", "_old")
    good = classes.select(*keys, F.col("class").alias("expected")).distinct()
    return made, overrides.join(good, [*keys, "expected"], "left_anti")


def era_names(segments: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """segments with a name and where it is from: of the sources in order (symbol, name, day) the first that has a name
    within the segment's span, its latest one; else the latest at any time; else none."""
    out = segments.select("security_id", "symbol", "valid_from", "valid_to")
    picked = []
    for rank, (label, names) in enumerate(sources):
        n = names.select(F.col("symbol").alias("_s"), "name", "day")
        hit = out.join(n, F.col("_s") == F.col("symbol")).withColumn("_in", within(F.col("day"), F.col("valid_from"), F.col("valid_to")))
        picked.append(hit.select("security_id", "symbol", "valid_from", "name", "day", "_in", F.lit(rank).alias("_rank"), F.lit(label).alias("name_source")))
    every = picked[0]
    for p in picked[1:]:
        every = every.unionByName(p)
    best = first_of(every, ["security_id", "symbol", "valid_from"], [F.desc("_in"), F.col("_rank"), F.desc("day"), F.col("name")]).select("security_id", "symbol", "valid_from", "name", "name_source")
    rows = out.join(best, ["security_id", "symbol", "valid_from"], "left")
    return rows.withColumn("name_source", F.coalesce("name_source", F.lit("none")))


def spelling_since(raw: DataFrame, spelled: DataFrame) -> DataFrame:
    """ticker, cik, since: for spellings that took rows from another one, the first snapshot that writes them."""
    letters = F.regexp_replace("ticker", r"\.", "")
    forms = raw.select("cik", letters.alias("_l"), F.col("ticker").alias("_was"), "snapshot_date").join(spelled.select("cik", letters.alias("_l"), "ticker").distinct(), ["cik", "_l"])
    moved = forms.filter("_was <> ticker").select("ticker", "cik").distinct()
    return forms.filter("_was = ticker").groupBy("ticker", "cik").agg(F.min("snapshot_date").alias("since")).join(moved, ["ticker", "cik"])


def known_with(facts: DataFrame, needs: DataFrame) -> DataFrame:
    """facts (id, known) no earlier than any fact they rest on (needs: id, on), through chains of any length: each round
    joins the links with themselves, so they reach twice as far."""
    far = needs.select("id", "on").distinct()
    while True:
        more = far.join(far.select(F.col("id").alias("on"), F.col("on").alias("_next")), "on").select("id", F.col("_next").alias("on"))
        new = cut(far.union(more).distinct())
        grown = new.count() > far.count()
        far = new
        if not grown:
            break
    late = far.join(facts.select(F.col("id").alias("on"), F.col("known").alias("_k")), "on").groupBy("id").agg(F.max("_k").alias("_k"))
    return facts.join(late, "id", "left").select("id", F.greatest("known", "_k").alias("known"))


def issuer_shelves(listings: DataFrame, least: int) -> DataFrame:
    return listings.groupBy("cik").agg(F.count_distinct("ticker").alias("tickers")).filter(F.col("tickers") >= least)


def fifth_letter(listings: DataFrame) -> DataFrame:
    """Tickers of a filer that are another of its tickers plus one letter, and that letter."""
    t = listings.select("cik", "ticker").distinct()
    base = t.select("cik", F.col("ticker").alias("base"))
    return t.join(base, "cik").filter((F.length("ticker") == F.length("base") + 1) & F.col("ticker").startswith(F.col("base"))).select("cik", "ticker", "base", F.expr("right(ticker, 1)").alias("letter"))


def registry_overlaps(ranges: DataFrame) -> DataFrame:
    """Registered imports (symbol, start, end) that share a day with the next of their symbol."""
    w = Window.partitionBy("symbol").orderBy("start", "end")
    return ranges.withColumn("next_start", F.lead("start").over(w)).filter("next_start <= `end`")


def child_sale(children: DataFrame, bars: DataFrame) -> DataFrame:
    """children (symbol, known_on) with the price they are sold at: the open of the first bar after they were known, else the
    last close up to then."""
    b = bars.filter("volume > 0").select(F.col("symbol").alias("_s"), "session_date", "open", "close")
    after = F.col("session_date") > F.col("known_on")
    rows = children.join(b, F.col("_s") == F.col("symbol"), "left").groupBy("symbol", "known_on").agg(F.min_by("open", F.when(after, F.col("session_date"))).alias("_o"), F.max_by("close", F.when(~after, F.col("session_date"))).alias("_c"))
    return rows.select("symbol", "known_on", F.coalesce("_o", "_c").alias("price"))


def parameter_grid(axes: dict[str, Sequence[float]], spark) -> DataFrame:
    """Every combination of the axes' values: a stated, small grid."""
    out = spark.range(1).select(F.lit(0).alias("_"))
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out.drop("_")


def repeated_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often: series need one row for each security and session."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def splits_after(splits: DataFrame, imports: DataFrame) -> DataFrame:
    """symbol, ex_date of splits after the start of a symbol's imported bars (symbol, start), which an adjusted source would have rewritten."""
    starts = imports.select("symbol", "start")
    return splits.select("symbol", "ex_date").join(starts, "symbol").filter("ex_date > start").select("symbol", "ex_date").distinct()


def request_windows(windows: DataFrame, active: DataFrame) -> DataFrame:
    """Windows that may limit requests: those of symbols that are no longer listed. Listed ones are asked for in every period."""
    return windows.join(active.select("symbol").distinct(), "symbol", "left_anti")
