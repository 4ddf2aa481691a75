"""Reading and writing the engine's tables.

Writes are by partition: a partition is merged with what it holds, existing rows win, and it is replaced as a whole by
Spark's dynamic overwrite, so a lost executor or a repeated run leaves no half-written partition.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pit import first_of


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """Files of all years together, by name; the year is the partition's."""
    return spark.read.option("mergeSchema", True).parquet(root)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table whose columns and types must be exactly these."""
    df = spark.read.parquet(path)
    found, wanted = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if found != wanted:
        raise ValueError(f"{path}: columns {[(n, t.simpleString()) for n, t in found]}, not {[(n, t.simpleString()) for n, t in wanted]}")
    return df


def newest(rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """One row for each key, the last to arrive."""
    return first_of(rows, list(keys), [F.desc(arrival)])


def final_only(bars: DataFrame) -> DataFrame:
    """Bars that were over when they were fetched."""
    return bars.filter("available_at <= fetched_at")


def merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows, and incoming ones with new keys."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti").select(existing.columns))


def write_merged(incoming: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str]) -> None:
    """Adds rows to the partitions they belong to; other partitions are not touched."""
    spark = incoming.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        incoming.write.partitionBy(*partition).parquet(path)
        return
    touched = incoming.select(*partition).distinct()
    held = existing.join(F.broadcast(touched), list(partition), "left_semi").select(incoming.columns)
    staged = f"{path.rstrip('/')}-staged"
    merged(held, incoming, keys).write.mode("overwrite").parquet(staged)  # read and overwritten paths must differ
    spark.read.schema(incoming.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """A dated snapshot; one that is there is never replaced."""
    df.write.mode("errorifexists").parquet(f"{path}/snapshot_date={day}")


def write_checked(segments: DataFrame, path: str, faults: DataFrame) -> None:
    """Writes only if no rule of faults (fault, n) is broken."""
    broken = [r["fault"] for r in faults.filter("n > 0").collect()]
    if broken:
        raise ValueError(f"not written: {', '.join(sorted(broken))}")
    segments.write.mode("overwrite").parquet(path)


def status(bars: DataFrame) -> DataFrame:
    return bars.groupBy("year").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def upserted(existing: DataFrame, incoming: DataFrame, key: str, checked: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts): incoming values fill nulls; a different value in a checked column is a conflict and is not taken."""
    names = [c for c in existing.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_new"))
    both = existing.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    clash = F.lit(False)
    for c in checked:
        clash = clash | (F.col(c).isNotNull() & F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}")))
    made = both.select(key, *[F.when(clash, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in names])
    return made, both.filter(F.col("_old") & F.col("_new") & clash).select(key, *[F.col(c) for c in checked], *[F.col(f"_{c}").alias(f"new_{c}") for c in checked])


ACTION = "symbol string, old_symbol string, new_symbol string, ex_date string, process_date string, old_rate string, new_rate string, source_rate string, rate string, special boolean, sub_type string, acquiree_symbol string, acquirer_symbol string, effective_date string, cash_rate string, stock_rate string, source_symbol string"


def parse_actions(raw: DataFrame) -> dict[str, DataFrame]:
    """raw (kind, json) -> splits, name_changes, mergers, dividends, others and rejects (kind, json, reason)."""
    r = raw.withColumn("j", F.from_json("json", ACTION))
    num = lambda c: F.expr(f"try_cast(j.{c} as double)")
    day = lambda c: F.expr(f"try_cast(j.{c} as date)")
    kind = F.col("kind")
    is_split, is_name, is_merger, is_dividend = kind.isin("forward_split", "reverse_split", "unit_split"), kind == "name_change", kind.isin("cash_merger", "stock_merger", "stock_and_cash_merger"), kind == "cash_dividend"
    reason = (
        F.when(F.col("j").isNull(), "not_json")
        .when(is_split, F.when(F.col("j.symbol").isNull() | day("ex_date").isNull(), "missing_key").when(~F.coalesce((num("old_rate") > 0) & (num("new_rate") > 0), F.lit(False)), "bad_rate"))
        .when(is_name, F.when(F.col("j.old_symbol").isNull() | F.col("j.new_symbol").isNull() | day("process_date").isNull(), "missing_key"))
        .when(is_merger, F.when(F.col("j.acquiree_symbol").isNull() | day("effective_date").isNull(), "missing_key"))
        .when(is_dividend, F.when(F.col("j.symbol").isNull() | day("ex_date").isNull(), "missing_key").when(~F.coalesce(num("rate") > 0, F.lit(False)), "bad_rate"))
    )
    r = r.withColumn("reason", reason)
    good = r.filter("reason is null")
    at = lambda c: (day(c).cast("timestamp_ntz")).alias("available_at")
    return {
        "splits": good.filter(is_split).select(F.col("j.symbol").alias("symbol"), day("ex_date").alias("ex_date"), num("old_rate").alias("old_rate"), num("new_rate").alias("new_rate"), (num("new_rate") / num("old_rate")).alias("factor"), "kind", at("ex_date")),
        "name_changes": good.filter(is_name).select(F.col("j.old_symbol").alias("old_symbol"), F.col("j.new_symbol").alias("new_symbol"), day("process_date").alias("process_date"), at("process_date")),
        "mergers": good.filter(is_merger).select(F.col("j.acquiree_symbol").alias("acquiree_symbol"), F.col("j.acquirer_symbol").alias("acquirer_symbol"), "kind", day("effective_date").alias("effective_date"), num("stock_rate").alias("stock_rate"), num("cash_rate").alias("cash_rate"), at("effective_date")),
        "dividends": good.filter(is_dividend).select(F.col("j.symbol").alias("symbol"), day("ex_date").alias("ex_date"), num("rate").alias("rate"), F.coalesce("j.special", F.lit(False)).alias("special"), F.col("j.sub_type").alias("sub_type"), at("ex_date")),
        "others": good.filter(~(is_split | is_name | is_merger | is_dividend)).select("kind", F.coalesce("j.symbol", "j.new_symbol").alias("symbol"), F.col("j.source_symbol").alias("source_symbol"), F.col("j.new_symbol").alias("new_symbol"), day("ex_date").alias("ex_date"), F.coalesce(num("rate"), F.try_divide(num("new_rate"), num("source_rate"))).alias("rate"), F.col("json").alias("raw_json"), at("ex_date")),
        "rejects": r.filter("reason is not null").select("kind", F.col("json").alias("raw_json"), "reason"),
    }


def parse_share_facts(raw: DataFrame) -> DataFrame:
    """raw (cik, concept, json with units.shares[]) -> valid facts, one for each (accn, end, start, value)."""
    item = "accn string, form string, end string, start string, filed string, val double"
    rows = raw.select("cik", "concept", F.inline(F.from_json("json", f"units struct<shares: array<struct<{', '.join(x.replace(' ', ': ') for x in item.split(', '))}>>>")["units"]["shares"]))
    day = lambda c: F.expr(f"try_cast({c} as date)")
    rows = rows.select("cik", "concept", "accn", "form", day("`end`").alias("end_date"), day("filed").alias("filed"), F.col("val").alias("shares"), day("start").alias("start_date"))
    rows = rows.filter("shares > 0 and end_date is not null and filed is not null and accn is not null")
    return rows.dropDuplicates(["cik", "concept", "accn", "end_date", "start_date", "shares"]).withColumn("available_at", (F.date_add("filed", 1)).cast("timestamp_ntz"))


def parse_listing(raw: DataFrame) -> DataFrame:
    """raw (cik, json of parallel arrays) -> a row for each filing."""
    names = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "primaryDocument")
    j = F.from_json("json", ", ".join(f"{n} array<string>" for n in names))
    return raw.select("cik", j.alias("j")).select("cik", F.inline(F.arrays_zip(*[F.coalesce(F.col(f"j.{n}"), F.array().cast("array<string>")).alias(n) for n in names])))


def parse_table(raw: DataFrame) -> DataFrame:
    """raw (json with fields and data): rows as maps, whatever the order of the columns."""
    j = F.from_json("json", "fields array<string>, data array<array<string>>")
    return raw.select(j.alias("j")).select(F.explode("j.data").alias("_d"), F.col("j.fields").alias("_f")).select(F.map_from_arrays("_f", "_d").alias("row"))


def parse_tickers(raw: DataFrame) -> DataFrame:
    """raw (snapshot_date, json object of entries) -> snapshot_date, ticker, cik, name."""
    j = F.map_values(F.from_json("json", "map<string, struct<cik_str: long, ticker: string, title: string>>"))
    rows = raw.select("snapshot_date", F.inline(j))
    return rows.select("snapshot_date", F.upper("ticker").alias("ticker"), F.col("cik_str").alias("cik"), F.col("title").alias("name")).filter("ticker is not null and cik is not null").distinct()


def plan_partitions(start: str, end: str, buckets: Sequence[str]) -> list[tuple[int, str]]:
    return [(y, b) for y in range(int(start[:4]), int(end[:4]) + 1) for b in buckets]


def missing_partitions(planned: Sequence[tuple[int, str]], done: DataFrame) -> list[tuple[int, str]]:
    """Planned partitions that the metadata (year, bucket, complete) does not call complete."""
    have = {(r["year"], r["bucket"]) for r in done.filter("complete").select("year", "bucket").distinct().collect()}
    return [p for p in planned if tuple(p) not in have]


def bucket_of(symbol: Column) -> Column:
    return F.substring(symbol, 1, 1)


def request_key(request: dict) -> str:
    """SHA-256 of a request's canonical JSON; the key of its cached answer."""
    import hashlib

    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
