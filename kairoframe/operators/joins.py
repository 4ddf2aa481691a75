"""Joins that the engine adds to Spark's: validity, as-of in either direction, differences of keyed tables.

Each is an equal join on its key with the order as residual, or one sort by key; none is a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entities are dealt to SIDES sides, each two of which are a tile; pairs that a task counts at once, rows of a batch.
SIDES, COUNTED, BATCH = 16, 1 << 20, 1 << 16


def as_of_backward(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the right row of its key that is latest at or before it (null: none).

    Union and last value: one exchange by key and one sort, whatever the number of matches. Of right rows with equal
    time the one that is greatest in its columns is taken.
    """
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns]
    a = left.select(F.col(key).alias("_key"), F.col(left_on).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("boolean").alias("_has"), *empty)
    row = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    b = right.select(F.col(key).alias("_key"), F.col(right_on).alias("_time"), F.lit(0).alias("_side"), row, F.lit(True).alias("_has"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    w = Window.partitionBy("_key").orderBy("_time", "_side", *[f"_r_{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_has"), F.struct(*[f"_r_{c}" for c in columns]))
    both = a.unionByName(b).withColumn("_match", F.last(packed, ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_match._r_{c}").alias(c) for c in columns])


def as_of_forward(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the columns of the right row of its key that is first at or after it (strict: after it)."""
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns]
    a = left.select(F.col(key).alias("_key"), F.col(left_on).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("boolean").alias("_has"), *empty)
    row = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    b = right.select(F.col(key).alias("_key"), F.col(right_on).alias("_time"), F.lit(1 if strict else 0).alias("_side"), row, F.lit(True).alias("_has"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    order = [F.desc("_time"), F.asc("_side"), *[F.desc(f"_r_{c}") for c in columns]]  # latest first; a strict left row comes before its equals
    w = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_has"), F.struct(*[f"_r_{c}" for c in columns]))
    both = a.unionByName(b).withColumn("_match", F.last(packed, ignorenulls=True).over(w)).filter(F.col("_row").isNotNull())
    return both.select("_row.*", *[F.col(f"_match._r_{c}").alias(c) for c in columns])


def first_after(left: DataFrame, moment: str, calendar: DataFrame, opens: str, column: str) -> DataFrame:
    """left with the column of the first calendar row that opens after a moment (null: none).

    The calendar (a row a session) is laid out by day: each day has the first opening on that day or later and the
    one after it, so the join is an equal join on the day, whatever the number of left rows.
    """
    rows = calendar.select(F.col(opens).alias("_o"), F.col(column).alias("_c")).distinct().withColumn("_d", F.to_date("_o"))
    first = rows.groupBy("_d").agg(F.min(F.struct("_o", "_c")).alias("_one"), F.max(F.struct("_o", "_c")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    if first.filter("_n > 1").take(1):
        raise ValueError("two sessions open on one day")
    ordered = Window.orderBy("_d")  # a calendar: as many rows as sessions
    first = first.select("_d", "_one", F.lead("_one").over(ordered).alias("_two"), F.lag("_d").over(ordered).alias("_before"))
    by_day = first.select(F.explode(F.when(F.col("_before").isNull(), F.array("_d")).otherwise(F.sequence(F.date_add("_before", 1), F.col("_d")))).alias("_day"), "_one", "_two")
    least = rows.agg(F.min("_d").alias("_least"))
    dated = left.crossJoin(F.broadcast(least)).withColumn("_day", F.greatest(F.to_date(moment), F.col("_least"))).drop("_least")
    joined = dated.join(by_day, "_day", "left")
    found = F.when(F.col("_one._o") > F.col(moment), F.col("_one._c")).otherwise(F.col("_two._c"))
    return joined.select(*left.columns, F.when(F.col(moment).isNotNull(), found).alias(column))


def identical_pairs(rows: DataFrame, entity: str, same: Sequence[str]) -> DataFrame:
    """Pairs of different entities (first < second) with equal values on one row each.

    Rows are grouped by their values before they are paired, so only real twins meet.
    """
    groups = rows.groupBy(*same).agg(F.array_sort(F.collect_set(entity)).alias("_all")).filter(F.size("_all") > 1)
    pairs = F.flatten(F.transform("_all", lambda a: F.transform(F.filter("_all", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return groups.select(*same, F.inline(pairs))


def identical_counts(rows: DataFrame, about: DataFrame, entity: str, same: Sequence[str]) -> DataFrame:
    """first_*, second_* (the columns of about), identical: how many equal values of `same` two entities (first < second) share; nulls are equal to none.

    about: a row an entity (not null), with what is to stand at both ends, as a pair is never joined again. Pairs are not
    moved: each two of SIDES sides of the entities are a tile, to which groups of equal rows go as two short lists of
    numbers, and a tile's pairs are counted where they are made. So each row moves up to SIDES times, however many pairs it is in.
    """
    numbered = about.withColumn("_side", F.pmod(F.xxhash64(entity), F.lit(SIDES)).cast("int"))
    numbered = numbered.withColumn("_at", F.row_number().over(Window.partitionBy("_side").orderBy(entity)) - 1)
    marked = rows.dropna(subset=list(same)).select(entity, *same).join(numbered.select(entity, "_side", "_at"), entity)
    sided = marked.select(*same, "_side", "_at").repartition(*same).groupBy(*same, "_side").agg(F.collect_set("_at").alias("_list"))
    groups = sided.groupBy(*same).agg(F.collect_list(F.struct("_side", "_list")).alias("_all"))
    tile = lambda a, b: a * SIDES + b
    met = F.flatten(F.transform("_all", lambda a: F.transform(
        F.filter("_all", lambda b: (b["_side"] > a["_side"]) | ((b["_side"] == a["_side"]) & (F.size(a["_list"]) > 1))),
        lambda b: F.struct(tile(a["_side"], b["_side"]).alias("_tile"), a["_list"].alias("_a"), b["_list"].alias("_b")),
    )))
    lists = groups.select(F.inline(met))
    ends = F.transform(F.sequence(F.lit(0), F.lit(SIDES - 1)), lambda k: tile(F.least(k, "_side"), F.greatest(k, "_side")))
    named = numbered.select(F.explode(ends).alias("_tile"), "_side", "_at", F.struct(*about.columns).alias("_about"))
    # a tile takes long for its few bytes, so tiles stay in as many parts as they are dealt to
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.unionByName(named, allowMissingColumns=True).repartition(parts, "_tile")
    schema = ", ".join(f"`{end}_{f.name}` {f.dataType.simpleString()}" for end in ("first", "second") for f in about.schema) + ", identical long"
    columns = list(about.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tile_counts(pa.Table.from_batches(batches), entity, columns)

    return dealt.groupBy("_tile").applyInArrow(count, schema)


def _tile_counts(table: pa.Table, entity: str, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The pairs of one tile with their counts, COUNTED pairs of bars at a time (or all those of one entity, added up)."""
    tile = table["_tile"][0].as_py()
    named = pc.is_valid(table["_side"])
    names, lists = table.filter(named).sort_by([("_side", "ascending"), ("_at", "ascending")]), table.filter(pc.invert(named))
    if not len(lists):
        return
    one = tile // SIDES == tile % SIDES
    about = names["_about"].combine_chunks()
    about = pa.table([about.field(c) for c in columns], names=list(columns))
    shift = 0 if one else int(pc.sum(pc.equal(names["_side"], tile // SIDES)).as_py())
    wide = len(about) - shift
    rank = np.empty(len(about), np.int64)
    rank[pc.sort_indices(about[entity]).to_numpy()] = np.arange(len(about))

    def flat(c: str) -> tuple[np.ndarray, np.ndarray]:
        made = lists[c].combine_chunks()
        return made.flatten().to_numpy(), made.value_lengths().to_numpy().astype(np.int64)

    (a, sizes), (b, many) = flat("_a"), flat("_b")
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(a, kind="stable")
    a, group = a[order].astype(np.int64), group[order]
    begins, ahead = (np.cumsum(many) - many)[group], np.concatenate([[0], np.cumsum(many[group])])
    cuts = np.concatenate([np.nonzero(np.diff(a, prepend=-1))[0], [len(a)]])  # where another entity begins

    def codes(lo: int, hi: int, least: int) -> np.ndarray:
        n = ahead[lo + 1 : hi + 1] - ahead[lo:hi]
        other = b[np.repeat(begins[lo:hi] - ahead[lo:hi], n) + np.arange(ahead[lo], ahead[hi])]
        mine = np.repeat(a[lo:hi], n)
        made = (mine - least) * wide + other
        return made[other > mine] if one else made

    at = 0
    while at < len(cuts) - 1:
        then = max(at + 1, int(np.searchsorted(ahead[cuts], ahead[cuts[at]] + COUNTED, "right")) - 1)
        lo, hi = int(cuts[at]), int(cuts[then])
        least, cells = int(a[lo]), int(a[hi - 1] - a[lo] + 1) * wide
        if then == at + 1:  # one entity, whose pairs may be too many at once
            sums = np.zeros(cells, np.int64)
            while lo < hi:
                upto = min(hi, max(lo + 1, int(np.searchsorted(ahead, ahead[lo] + COUNTED, "right")) - 1))
                sums += np.bincount(codes(lo, upto, least), minlength=cells)
                lo = upto
            found = np.nonzero(sums)[0]
            counts = sums[found]
        elif cells <= 4 * COUNTED:
            sums = np.bincount(codes(lo, hi, least), minlength=cells)
            found = np.nonzero(sums)[0]
            counts = sums[found]
        else:
            found, counts = np.unique(codes(lo, hi, least), return_counts=True)
        at = then
        for k in range(0, len(found), BATCH):
            x, y = found[k : k + BATCH] // wide + least, found[k : k + BATCH] % wide + shift
            turned = rank[x] > rank[y]
            ends = (about.take(pa.array(np.where(turned, y, x))), about.take(pa.array(np.where(turned, x, y))))
            arrays = [end[c].combine_chunks() for end in ends for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts[k : k + BATCH])], [*(f"{e}_{c}" for e in ("first", "second") for c in columns), "identical"])


def keyed_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, change: 'gone', 'new' or the changed columns, comma-joined; null-safe; equal rows are left out."""
    a = left.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    differ = [F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), F.lit(v)) for v in values]
    change = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").otherwise(F.concat_ws(",", *differ))
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change")).filter("change <> ''")


def intervals(rows: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct days with the next one: half-open [lo, hi), the last one open."""
    w = Window.partitionBy(*keys).orderBy(day)
    return rows.select(*keys, day).distinct().withColumn("hi", F.lead(day).over(w)).withColumnRenamed(day, "lo")


def near_in_days(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, days: int) -> DataFrame:
    """Rows of left with a right row of their key within so many days."""
    r = right.select(F.col(key).alias("_k"), F.col(right_day).alias("_d"))
    return left.join(r, (left[key] == F.col("_k")) & (F.abs(F.datediff(left[left_day], F.col("_d"))) <= days), "left_semi")


def only_match(rows: DataFrame, key: str, value: str, tie: Column) -> DataFrame:
    """key, value: a key's only value, or where it has several the only one for which tie holds; else none."""
    one = rows.groupBy(key).agg(F.collect_set(value).alias("_all"), F.collect_set(F.when(tie, F.col(value))).alias("_tied"))
    pick = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).when(F.size("_tied") == 1, F.get("_tied", F.lit(0)))
    return one.select(key, pick.alias(value)).filter(F.col(value).isNotNull())
