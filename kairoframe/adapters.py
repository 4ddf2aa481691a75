"""The engine's relations, shaped from the generic star schema.

Each relation is one SELECT, written for both dialects (Spark and the SQL twin) by a small set of functions, so that
a query and its twin start from the same rows. Faults for the audits are planted by arithmetic on keys and days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def ts(self, x: str) -> str:
        return f"cast({x} as {'timestamp_ntz' if self.spark else 'timestamp'})"

    def text(self, x: str) -> str:
        return f"cast({x} as {'string' if self.spark else 'varchar'})"

    def days(self, start: str, end: str) -> str:
        """Days from start to end."""
        return f"cast(datediff({end}, {start}) as bigint)" if self.spark else f"date_diff('day', {start}, {end})"

    def first(self, value: str, order: str) -> str:
        """The value of the row that is first in order."""
        return f"min_by({value}, struct({order}))" if self.spark else f"arg_min({value}, ({order}))"

    def last(self, value: str, order: str) -> str:
        return f"max_by({value}, struct({order}))" if self.spark else f"arg_max({value}, ({order}))"

    def plus(self, day: str, n: str) -> str:
        return f"date_add({day}, cast({n} as int))" if self.spark else f"cast({day} + cast({n} as integer) as date)"


EPOCH = "date '1992-01-01'"


def _bars(d: Dialect) -> str:
    key = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
    price = "l_extendedprice / l_quantity"
    return f"""
    select concat('S', k) as symbol, k, {d.ts('session_date')} as t, session_date, open,
           case when k % 11 = 3 and n % 97 = 0 then low * 0.9 else high end as high, low, close,
           cast(case when n % 13 = 0 then 0 else volume end as bigint) as volume, trade_count,
           case when n % 10 = 0 then null else (high + low + close) / 3 end as vwap,
           {d.ts('session_date')} + interval 20 hour as available_at,
           {d.ts('session_date')} + case when n % 101 = 0 then interval 19 hour else interval 22 hour end as fetched_at,
           cast(case when n % 211 = 0 then 1991 else year(session_date) end as bigint) as year, 'vendor' as source
    from (select l_suppkey as k, cast(l_shipdate as date) as session_date, {d.first(price, key)} as open, max({price}) as high, min({price}) as low,
                 {d.last(price, key)} as close, sum(cast(l_quantity as bigint)) as volume, count(*) as trade_count,
                 {d.days(EPOCH, 'cast(l_shipdate as date)')} + l_suppkey as n
          from {{lineitem}} where l_quantity > 0
          group by l_suppkey, cast(l_shipdate as date)) y"""


def _imported(d: Dialect) -> str:
    return f"""
    select symbol, k, t, session_date, open * 1.5 as open, high * 1.5 as high, low * 1.5 as low, close * 1.5 as close, volume, trade_count,
           cast(null as double) as vwap, available_at + interval 10 day as available_at, fetched_at + interval 11 day as fetched_at, year, 'second' as source
    from [bars] where k % 7 = 0 and trade_count > 1"""


def _segments(d: Dialect) -> str:
    cut = d.plus("date '1997-12-15'", "s_suppkey % 60")
    known = f"{d.ts('cut')} + interval 30 day"
    return f"""
    select concat('X', k) as security_id, concat('S', k) as symbol, date '1991-01-01' as valid_from, cut as valid_to,
           case when k % 5 > 0 then k % 40 end as cik, case when k % 5 > 0 then {d.ts("date '1996-06-01'")} + interval 5 hour end as cik_available_at,
           {d.ts("date '1991-01-01'")} as available_at, {known} as end_available_at, k
    from (select s_suppkey as k, {cut} as cut from {{supplier}}) a
    union all
    select concat(case when k % 3 = 0 then 'X' else 'Y' end, case when k % 3 = 0 then k + 1 else k end) as security_id, concat('S', k) as symbol, cut as valid_from, cast(null as date) as valid_to,
           case when k % 5 > 0 then k % 40 + 1 end as cik, case when k % 5 > 0 then {known} + interval 1 day end as cik_available_at,
           {known} as available_at, cast(null as {'timestamp_ntz' if d.spark else 'timestamp'}) as end_available_at, k
    from (select s_suppkey as k, {cut} as cut from {{supplier}}) b"""


def _splits(d: Dialect) -> str:
    ex = d.plus("date '1994-01-01'", "p_size * 37 + p_partkey % 300")
    return f"""
    select symbol, ex_date, cast(1 as double) as old_rate, new_rate, new_rate as factor, kind, concat('C', symbol) as old_cusip, concat('C', symbol) as new_cusip,
           {d.ts('ex_date')} + interval 5 hour + case when kind = 'unit_split' then interval 1 day else interval 0 day end as available_at
    from (select concat('S', p_partkey % 100 + 1) as symbol, {ex} as ex_date, case when p_partkey % 4 = 0 then 0.5 else cast(p_partkey % 3 + 2 as double) end as new_rate,
                 'forward_split' as kind from {{part}} where p_partkey % 5 = 0
          union all
          select concat('S', p_partkey % 100 + 1) as symbol, {ex} as ex_date, case when p_partkey % 4 = 0 then 0.5 else cast(p_partkey % 3 + 2 as double) end as new_rate,
                 'unit_split' as kind from {{part}} where p_partkey % 15 = 0
          union all
          select concat('S', p_partkey % 100 + 1) as symbol, {ex} as ex_date, cast(5 as double) as new_rate,
                 'forward_split' as kind from {{part}} where p_partkey % 25 = 0) s"""


def _dividends(d: Dialect) -> str:
    ex = d.plus("date '1993-01-01'", "p_size * 30 + p_partkey % 30")
    cols = f"concat('S', p_partkey % 100 + 1) as symbol, {ex} as ex_date"
    return f"""
    select symbol, ex_date, rate, special, sub_type, {d.ts('ex_date')} + interval 5 hour as available_at
    from (select {cols}, cast(p_size as double) / 8 as rate, p_partkey % 9 = 0 as special, case when p_partkey % 4 = 0 then 'return_of_capital' end as sub_type from {{part}} where p_partkey % 2 = 0
          union all
          select {cols}, cast(p_size as double) / 8 as rate, p_partkey % 9 = 0 as special, case when p_partkey % 4 = 0 then 'return_of_capital' end as sub_type from {{part}} where p_partkey % 6 = 0
          union all
          select {cols}, cast(p_size as double) / 8 + cast(0.0000001 as double) as rate, p_partkey % 9 = 0 as special, cast(null as {'string' if d.spark else 'varchar'}) as sub_type from {{part}} where p_partkey % 10 = 0) x"""


def _renames(d: Dialect) -> str:
    day = d.plus("date '1995-01-01'", "p_size * 25")
    return f"""
    select concat('S', a) as old_symbol, concat('S', b) as new_symbol, process_date, concat('C', a) as old_cusip, concat('C', b) as new_cusip,
           {d.ts('process_date')} + interval 5 hour as available_at
    from (select p_partkey % 100 + 1 as a, (p_partkey * 7) % 100 + 1 as b, {day} as process_date from {{part}} where p_partkey % 8 = 0) x where a <> b"""


def _classes(d: Dialect) -> str:
    return """
    select security_id, symbol, valid_from, concat('Name ', k) as name, case when k % 3 = 0 then 'sec' when k % 3 = 1 then 'assets' else 'none' end as name_source,
           case k % 6 when 0 then 'etf' when 1 then 'unknown' when 2 then 'leveraged_etf' else 'common' end as class,
           case when k % 10 = 0 then 'override' when k % 4 = 0 then 'lookup_sec_companies' else 'pattern' end as rule
    from [segments] where k % 23 > 0
    union all
    select concat('Q', k) as security_id, symbol, valid_from, 'Orphan' as name, 'none' as name_source, 'common' as class, 'pattern' as rule from [segments] where k % 29 = 1"""


def _facts(d: Dialect) -> str:
    filed = "cast(o_orderdate as date)"
    return f"""
    select o_custkey % 40 as cik, case o_orderkey % 3 when 0 then 'cover' when 1 then 'balance' else 'average' end as concept, concat('A', o_orderkey) as accn,
           case o_orderkey % 5 when 0 then '10-K' when 1 then '20-F' when 2 then '6-K' else '10-Q' end as form,
           {d.plus(filed, '-(o_orderkey % 90)')} as end_date, {filed} as filed, floor(o_totalprice) * 1000 as shares,
           {d.ts(d.plus(filed, '1'))} + interval 5 hour as available_at,
           case when o_orderkey % 7 > 0 then {d.plus(filed, '-(o_orderkey % 90) - 91')} end as start_date
    from {{orders}}"""


def _snapshots(d: Dialect) -> str:
    return f"""
    select distinct {d.plus("date '1996-01-01'", "(c_custkey % 24) * 30")} as snapshot_date, concat('S', c_custkey % 100 + 1) as ticker,
           case when c_custkey % 9 = 0 then (c_custkey % 100 + 2) % 40 else (c_custkey % 100 + 1) % 40 end as cik,
           case c_nationkey % 4 when 0 then 'NYSE' when 1 then 'Nasdaq' when 2 then 'OTC' else 'CBOE' end as exchange, concat('Filer ', c_custkey % 40) as name
    from {{customer}}"""


def _listings(d: Dialect) -> str:
    """Snapshots in which filers rename their tickers every five months, and some tickers change their filer."""
    no = f"cast(floor({d.days("date '1996-01-01'", 'snapshot_date')} / 30) as bigint)"
    return f"""
    select distinct snapshot_date, concat('T', filer % 40, case when filer % 4 = 0 then '' else concat('_', cast(floor(no / 5) as bigint)) end) as ticker,
           filer + case when filer % 7 = 0 and no > 12 then 100 else 0 end as cik, exchange
    from (select snapshot_date, cik as filer, exchange, {no} as no from [snapshots]) x"""


def _spinoffs(d: Dialect) -> str:
    ex = d.plus("date '1994-06-01'", "p_size * 40")
    rows = f"concat('S', p_partkey % 100 + 1) as parent_symbol, concat('S', (p_partkey * 3) % 100 + 1) as child_symbol, {ex} as ex_date, case when p_partkey % 11 = 0 then null else cast(p_partkey % 5 + 1 as double) / 20 end as ratio, {d.ts(ex)} + interval 5 hour as available_at"
    return f"select {rows} from {{part}} where p_partkey % 12 = 0 union all select {rows} from {{part}} where p_partkey % 36 = 0"


def _docs(d: Dialect) -> str:
    return f"""
    select doc_id as id, doc_id % 50 as entity_id, case doc_id % 4 when 0 then '10-K' when 1 then '10-Q/A' when 2 then '8-K' else '6-K' end as doc_type,
           source, text, n_chars, {d.ts("date '2024-01-01'")} + doc_id * interval 1 hour as available_at,
           case when doc_id % 10 = 3 then doc_id - 1 end as supersedes_id,
           concat('https://host/Archives/edgar/data/', doc_id % 50 + 1000, '/', doc_id, '/a.htm') as url
    from {{documents}}"""


def _trades(d: Dialect) -> str:
    return f"""
    select event_id as id, user_id as run_id, concat('S', event_id % 100 + 1) as security_id, cast(ts as {'timestamp_ntz' if d.spark else 'timestamp'}) as exit_at,
           cast(ts as date) as session_date, value - 50 as pnl, (value - 50) / 25 as r_multiple, event_type as exit_reason, event_id % 2 + 1 as leg, event_id % 17 as hold_days
    from {{events}}"""


RELATIONS = {
    "bars": _bars, "imported": _imported, "segments": _segments, "splits": _splits, "dividends": _dividends, "renames": _renames, "classes": _classes,
    "facts": _facts, "snapshots": _snapshots, "listings": _listings, "spinoffs": _spinoffs, "docs": _docs, "trades": _trades,
}


def _text(name: str, dialect: Dialect) -> str:
    """The relation's SELECT; [other] stands for other relations, {table} for base tables."""
    text = RELATIONS[name](dialect)
    for other in RELATIONS:
        if f"[{other}]" in text:
            text = text.replace(f"[{other}]", f"({_text(other, dialect)}) {other}")
    return text


class World:
    """The relations of one directory of tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in RELATIONS:
            raise AttributeError(name)
        if name not in self._made:
            text = _text(name, Dialect(True))
            used = {t: self.base(t) for t in BASE if f"{{{t}}}" in text}
            self._made[name] = self.spark.sql(text, **used)
        return self._made[name]


def oracle(text: str) -> str:
    """SQL of a twin: every [relation] in it becomes a named subquery at the start."""
    d = Dialect(False)
    order: list[str] = []

    def need(sql: str) -> None:
        for name in RELATIONS:
            if f"[{name}]" in sql and name not in order:
                need(RELATIONS[name](d))
                order.append(name)

    need(text)
    parts = [f"{name} as ({RELATIONS[name](d)})" for name in order]
    for name in order:
        text = text.replace(f"[{name}]", name)
        parts = [p.replace(f"[{name}]", name) for p in parts]
    for t in BASE:
        parts = [p.replace(f"{{{t}}}", t) for p in parts]
    text = text.strip()
    if not parts:
        return text
    if text.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(parts) + ", " + text[14:].strip()
    if text.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + text[5:].strip()
    return "with " + ", ".join(parts) + " " + text
