"""Mixing sources to target weights: temperature, bisection, block permutations (native: DataFrame functions only).

A source's share p is its part of all tokens (words). Its weight is p ** a / sum(p ** a), 0 <= a <= 1: a = 1
keeps the shares, a = 0 makes the sources equal. The least a that meets the target is found by bisection:

* `max_repetition`: no source is repeated more than so many times as often as the least repeated one, or
* `entropy`: the weights' entropy is at most this share of the way from the sources' own to the equal one.

The weights are realised by block permutations. A block of a source is a permutation of all its documents, by
md5 of (seed, source, number of the block, id). The budget of tokens gives a source budget * weight tokens: as
many whole blocks as fit, and of one more block the documents, in its order, whose running sum of tokens stays
within the rest. Without a budget it is the least one with which every document is used at least once.

No group is sorted as a whole: a block's order is cut into 4096 ranges of the key, whose token sums show in which
range the budget ends, and only that range is summed document by document. Documents take part with id, source
and number of tokens only; a document's copies follow from one comparison with its source's limit.

The bisection looks at 255 exponents at a time (8 halvings), each an aggregate over the table of sources.

Edge cases: a null source counts as the source named '', a null text has no tokens, and documents without tokens
are in every whole block and in the rest of the last one up to its limit; sources without any token have one
block; repeated ids of a source are taken together; an empty table gives an empty result; in `mixed` the columns
of docs stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table, whole

GRID, ROUNDS, DIGITS = 256, 5, 9
RANGES = 3  # hexadecimal digits of the key


@dataclass(frozen=True)
class Target:
    max_repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None
    seed: int = 17


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))).cast("long")


def block_key(seed: int, source: Column, block: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), source, block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def least_exponent(shares: DataFrame, meets: Callable[[DataFrame], DataFrame]) -> float:
    """The least exponent in [0, 1], to DIGITS digits, for which meets(shares with column a) -> a, ok says yes; 1 if none does."""
    low, high = 0.0, 1.0
    for k in range(ROUNDS + 1):
        step = (high - low) / (GRID - 1)
        grid = [0.0] if k == 0 else [low + i * step for i in range(1, GRID)]
        some = F.explode(F.array(*[F.lit(x) for x in grid]))
        ok = sorted(r["a"] for r in meets(shares.withColumn("a", some)).filter("ok").collect())
        if k == 0 and ok:
            return 0.0
        if ok:
            high = min(high, ok[0])
            low = max(low, high - step) if k else low
        elif k:
            break
    return float(f"{high:.{DIGITS}f}")


def _repetition(limit: float) -> Callable[[DataFrame], DataFrame]:
    def meets(rows: DataFrame) -> DataFrame:
        ratio = F.pow("p", F.col("a") - 1)
        return rows.groupBy("a").agg((F.max(ratio) <= F.min(ratio) * (1 + 1e-12) * limit).alias("ok"))

    return meets


def _entropy(limit: float) -> Callable[[DataFrame], DataFrame]:
    def meets(rows: DataFrame) -> DataFrame:
        w = F.pow("p", "a")
        z, own = F.sum(w), -F.sum(F.col("p") * F.log("p"))
        equal = F.log(F.count(F.lit(1)).cast("double"))
        entropy = F.log(z) - F.sum(w * F.log(w)) / z
        return rows.groupBy("a").agg((entropy <= own + limit * (equal - own) + 1e-12).alias("ok"))

    return meets


def weights(counted: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """(source, total, weight, quota for every source; the exponent). counted: doc_id, source, tokens."""
    sums = stored(counted.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    every = sums.agg(F.sum("total").alias("t")).first()["t"] or 0
    shares = sums.filter("total > 0").select("source", "total", (F.col("total") / F.lit(float(max(every, 1)))).alias("p"))
    meets = _entropy(target.entropy) if target.max_repetition is None else _repetition(target.max_repetition)
    a = least_exponent(shares, meets) if every else 1.0
    powered = shares.withColumn("w", F.pow("p", F.lit(a)))
    norm = powered.agg(F.sum("w").alias("z"), F.max(F.col("p") / F.col("w")).alias("most")).first()
    z, most = norm["z"] or 1.0, norm["most"] or 1.0
    # weight = w / z; the least budget with budget * weight >= total for all is every * max(p z / w)
    budget = F.lit(float(every * most * z)) if target.budget is None else F.lit(float(target.budget))
    made = powered.select("source", "total", (F.col("w") / F.lit(z)).alias("weight"))
    quota = F.floor(made["weight"] * budget + F.lit(1e-6)).cast("long")
    quota = F.greatest(quota, F.col("total")) if target.budget is None else quota
    return sums.select("source").join(made, "source", "left").select("source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.when(F.col("total") > 0, quota).otherwise(0).alias("quota")), a


def plan(counted: DataFrame, target: Target) -> DataFrame:
    """source, total, weight, whole, limit_key: whole blocks, and the last key taken of one more (null: none).

    The tables of sources are read from storage, so Spark knows their size and broadcasts them only if they are small.
    """
    sources, _ = weights(counted, target)
    sources = stored(sources.select("*", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(1).cast("long").alias("whole")).withColumn("rest", F.when(F.col("total") > 0, F.col("quota") - F.col("whole") * F.col("total")).otherwise(0)), "quotas")
    keyed = counted.join(sources.filter("rest > 0").select("source", "whole", "rest"), "source").withColumn("key", block_key(target.seed, F.col("source"), F.col("whole"), F.col("doc_id"))).withColumn("range", F.substring("key", 1, RANGES))
    ranges = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("range")
    before = ranges.withColumn("before", F.sum("t").over(order) - F.col("t"))
    last = before.filter("before <= rest").groupBy("source").agg(F.max_by(F.struct("range", "before"), "range").alias("x")).select("source", "x.range", "x.before")
    inside = keyed.join(stored(last, "last"), ["source", "range"])
    by_key = Window.partitionBy("source").orderBy("key")
    summed = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(by_key))
    limit = summed.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key"), F.first("range").alias("range"))
    # All keys of earlier ranges are taken: without a key of the last range, the limit is that range's own start.
    limit = limit.select("source", F.coalesce("key", "range").alias("limit_key"))
    return stored(sources.join(limit, "source", "left").select("source", "total", "weight", "whole", "limit_key"), "plan")


def _counted(docs: DataFrame, source: str) -> DataFrame:
    """doc_id, source, tokens of every row, written once: no later step reads a text for its tokens."""
    return stored(docs.select("doc_id", F.coalesce(F.col(source), F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens")), "counted")


def _used(rows: DataFrame, planned: DataFrame, target: Target) -> DataFrame:
    """rows (doc_id, _mix_source) with _mix_whole and _mix_copies."""
    planned = planned.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), "limit_key")
    joined = rows.join(planned, "_mix_source")
    more = block_key(target.seed, F.col("_mix_source"), F.col("_mix_whole"), F.col("doc_id")) <= F.col("limit_key")
    return joined.withColumn("_mix_copies", F.col("_mix_whole") + F.coalesce(more, F.lit(False)).cast("long")).drop("limit_key")


def copies(docs: DataFrame, target: Target, source: str = "source") -> DataFrame:
    """docs with columns _mix_source, _mix_whole, _mix_copies: how often each row is used."""
    planned = plan(_counted(docs, source), target)
    return _used(docs.withColumn("_mix_source", F.coalesce(F.col(source), F.lit(""))), planned, target)


def mixed(docs: DataFrame, target: Target, source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as it is used."""
    used = copies(docs, target, source).filter("_mix_copies > 0")
    return used.withColumn("_mix_block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, block_key, tokens: every use of every document; a block is read in order of its keys."""
    target = Target(max_repetition=1.25)
    counted = _counted(table(spark, sf_dir, "documents"), "source")
    used = _used(counted.withColumnRenamed("source", "_mix_source"), plan(counted, target), target).filter("_mix_copies > 0")
    rows = used.select("doc_id", F.col("_mix_source").alias("source"), "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_copies") - 1)).alias("block"))
    return rows.select("doc_id", "source", "block", block_key(target.seed, F.col("source"), F.col("block"), F.col("doc_id")).alias("block_key"), "tokens")
