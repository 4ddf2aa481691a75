"""Sources: parsers and merges over rows built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..sources import tables


def raw_actions(w: World):
    """Raw records of every kind, some of them broken."""
    s = w.splits.select("kind", F.to_json(F.struct("symbol", F.col("ex_date").cast("string").alias("ex_date"), F.col("old_rate").cast("string").alias("old_rate"), F.when(F.col("new_rate") != 4, F.col("new_rate").cast("string")).otherwise("x").alias("new_rate"))).alias("json"))
    n = w.renames.select(F.lit("name_change").alias("kind"), F.to_json(F.struct("old_symbol", "new_symbol", F.col("process_date").cast("string").alias("process_date"))).alias("json"))
    d = w.dividends.select(F.lit("cash_dividend").alias("kind"), F.to_json(F.struct("symbol", F.col("ex_date").cast("string").alias("ex_date"), F.col("rate").cast("string").alias("rate"), "special", "sub_type")).alias("json"))
    o = w.spinoffs.select(F.lit("spin_off").alias("kind"), F.to_json(F.struct(F.col("parent_symbol").alias("source_symbol"), F.col("child_symbol").alias("new_symbol"), F.col("ex_date").cast("string").alias("ex_date"), F.lit("20").alias("source_rate"), (F.col("ratio") * 20).cast("string").alias("new_rate"))).alias("json"))
    return s.unionByName(n).unionByName(d).unionByName(o)


@query("parse_splits", "select symbol, ex_date, old_rate, new_rate, new_rate / old_rate as factor, kind from [splits] where new_rate <> 4")
def parse_splits(w: World):
    return tables.parse_actions(raw_actions(w))["splits"].drop("available_at")


@query("parse_name_changes", "select old_symbol, new_symbol, process_date from [renames]")
def parse_name_changes(w: World):
    return tables.parse_actions(raw_actions(w))["name_changes"].drop("available_at")


@query("parse_dividends", "select symbol, ex_date, rate, special, sub_type from [dividends]")
def parse_dividends(w: World):
    return tables.parse_actions(raw_actions(w))["dividends"].drop("available_at")


@query("parse_others", "select 'spin_off' as kind, parent_symbol as source_symbol, child_symbol as new_symbol, ex_date, floor(ratio * 20 + 0.5) / 20 as rate from [spinoffs]")
def parse_others(w: World):
    rows = tables.parse_actions(raw_actions(w))["others"]
    return rows.select("kind", "source_symbol", "new_symbol", "ex_date", (F.floor(F.col("rate") * 20 + 0.5) / 20).alias("rate"))


@query("parse_rejects", "select kind, 'bad_rate' as reason, count(*) as n from [splits] where new_rate = 4 group by kind")
def parse_rejects(w: World):
    return tables.parse_actions(raw_actions(w))["rejects"].groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("parse_share_facts", "select distinct cik, concept, accn, form, end_date, filed, shares, start_date from [facts] where shares > 0")
def parse_share_facts(w: World):
    item = F.struct("accn", "form", F.col("end_date").cast("string").alias("end"), F.col("start_date").cast("string").alias("start"), F.col("filed").cast("string").alias("filed"), F.col("shares").cast("double").alias("val"))
    raw = w.facts.groupBy("cik", "concept").agg(F.collect_list(item).alias("shares")).select("cik", "concept", F.to_json(F.struct(F.struct("shares").alias("units"))).alias("json"))
    return tables.parse_share_facts(raw).drop("available_at").withColumn("shares", F.col("shares").cast("long"))


@query("parse_listing", "select cik, accn as \"accessionNumber\", form, cast(filed as varchar) as \"filingDate\" from [facts]")
def parse_listing(w: World):
    raw = w.facts.groupBy("cik").agg(F.collect_list("accn").alias("accessionNumber"), F.collect_list("form").alias("form"), F.collect_list(F.col("filed").cast("string")).alias("filingDate"))
    raw = raw.select("cik", F.to_json(F.struct("accessionNumber", "form", "filingDate")).alias("json"))
    return tables.parse_listing(raw).select("cik", "accessionNumber", "form", "filingDate")


@query("parse_tickers", "select distinct snapshot_date, ticker, cik, name from [snapshots]")
def parse_tickers(w: World):
    entry = F.struct(F.col("cik").alias("cik_str"), F.lower("ticker").alias("ticker"), F.col("name").alias("title"))
    raw = w.snapshots.groupBy("snapshot_date").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("ticker", F.col("cik").cast("string"), "exchange").alias("k"), entry.alias("v")))).alias("m")).select("snapshot_date", F.to_json("m").alias("json"))
    return tables.parse_tickers(raw)


@query("newest_arrival", "select symbol, session_date, source from (select *, row_number() over (partition by symbol, session_date order by available_at desc) as place from (select symbol, session_date, source, available_at from [bars] union all select symbol, session_date, source, available_at from [imported]) x) y where place = 1")
def newest_arrival(w: World):
    both = w.bars.unionByName(w.imported.select(*[c for c in w.imported.columns]), allowMissingColumns=True)
    return tables.newest(both, ["symbol", "session_date"], "available_at").select("symbol", "session_date", "source")


@query("final_only", "select symbol, session_date from [bars] where available_at <= fetched_at")
def final_only(w: World):
    return tables.final_only(w.bars).select("symbol", "session_date")


@query("merge_append", "select symbol, session_date, close from [bars] where k % 2 = 0 union all select symbol, session_date, close from [imported] where k % 2 = 1 or (symbol, session_date) not in (select (symbol, session_date) from [bars] where k % 2 = 0)")
def merge_append(w: World):
    cols = ["symbol", "session_date", "close"]
    return tables.merged(w.bars.filter("k % 2 = 0").select(*cols), w.imported.select(*cols), ["symbol", "session_date"])


@query("entity_conflicts", "select c_custkey as id, c_nationkey as kind, (c_nationkey + 1) % 25 as new_kind from customer where c_custkey % 50 = 0")
def entity_conflicts(w: World):
    old = w.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("kind"))
    new = old.filter("id % 10 = 0").withColumn("kind", F.when(F.col("id") % 50 == 0, (F.col("kind") + 1) % 25).otherwise(F.col("kind")))
    return tables.upserted(old, new, "id", ["kind"])[1]


@query("universe", "select symbol from (select concat('S', s_suppkey) as symbol from supplier union select distinct ticker from [snapshots] union select new_symbol from [renames]) u where symbol not in (select symbol from [splits] where ex_date < date '1994-06-01')")
def universe(w: World):
    listed = w.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    every = listed.union(w.snapshots.select("ticker")).union(w.renames.select("new_symbol")).distinct()
    return every.join(w.splits.filter("ex_date < date'1994-06-01'").select("symbol"), "symbol", "left_anti")
