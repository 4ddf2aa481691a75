"""Point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..plans import pit

AS_OF = "1998-02-01 00:00:00"
AT = f"timestamp '{AS_OF}'"
BAR = "symbol, t, session_date, open, high, low, close, volume, vwap, available_at"
COLUMNS = BAR.split(", ")
#: Masked segments and the bars of both sources, for the twins.
MASKED = f"""masked as (select security_id, symbol, valid_from, case when end_available_at <= {AT} then valid_to end as valid_to,
    case when cik_available_at <= {AT} then cik end as cik, available_at from [segments] where available_at <= {AT})"""
MERGED = f"""merged as (select {BAR}, source from [bars] b where available_at <= {AT}
    and not exists (select 1 from [imported] i where i.available_at <= {AT} and i.symbol = b.symbol and i.t = b.t)
    union all select {BAR}, source from [imported] where available_at <= {AT})"""
RESOLVED = f"""{MASKED}, {MERGED}, resolved as (select m.*, s.security_id from merged m join masked s on s.symbol = m.symbol and m.session_date >= s.valid_from
    and m.session_date < coalesce(s.valid_to, date '9999-12-31') where m.volume > 0)"""
EVENTS = f"""events_known as (select * from (select *, row_number() over (partition by symbol, ex_date, round(factor, 9), old_cusip, new_cusip
    order by available_at, kind = 'unit_split', kind, old_rate, new_rate) as place from [splits] where available_at <= {AT}) x where place = 1)"""


def resolved(w: World):
    return pit.visible_bars(w.bars, w.imported, AS_OF, w.segments)


@query("pit_bars_resolved", f"""with {RESOLVED}, {EVENTS} select r.*, true as traded, e.symbol is not null as split_day from resolved r
    left join (select distinct symbol, ex_date from events_known) e on e.symbol = r.symbol and e.ex_date = r.session_date""")
def bars_resolved(w: World):
    return pit.visible_bars(w.bars, w.imported, AS_OF, w.segments, w.splits).select(*COLUMNS, "source", "security_id", "traded", "split_day")


@query("pit_bars_unresolved", f"with {MERGED} select *, volume > 0 as traded from merged")
def bars_unresolved(w: World):
    return pit.visible_bars(w.bars, w.imported, AS_OF, untraded=True).select(*COLUMNS, "source", "traded")


@query("pit_bars_window", f"with {MERGED} select {BAR}, source from merged where volume > 0 and symbol in ('S1', 'S7', 'S14') and t >= timestamp '1995-01-01' and t < timestamp '1996-07-01'")
def bars_window(w: World):
    return pit.visible_bars(w.bars, w.imported, AS_OF, symbols=["S1", "S7", "S14"], start="1995-01-01 00:00:00", end="1996-07-01 00:00:00").select(*COLUMNS, "source")


@query("pit_bars_override", "select symbol, t, close, source from [imported] union all select symbol, t, close, source from [bars] b where not exists (select 1 from [imported] i where i.symbol = b.symbol and i.t = b.t)")
def bars_override(w: World):
    return pit.overridden(w.bars, w.imported, ["symbol", "t"]).select("symbol", "t", "close", "source")


@query("pit_master_masked", f"with {MASKED} select * from masked")
def master_masked(w: World):
    return pit.masked_segments(w.segments, AS_OF).select("security_id", "symbol", "valid_from", "valid_to", "cik", "available_at")


@query("pit_master_faults", f"""with {MASKED} select 'no_instant' as fault, count(*) filter (where available_at is null) as n from [segments]
    union all select 'end_without_instant', count(*) filter (where (valid_to is null) <> (end_available_at is null)) from [segments]
    union all select 'empty_interval', count(*) filter (where valid_to <= valid_from) from [segments]
    union all select 'end_known_early', count(*) filter (where end_available_at < cast(valid_to as timestamp)) from [segments]
    union all select 'filer_without_instant', count(*) filter (where (cik is null) <> (cik_available_at is null)) from [segments]
    union all select 'duplicate_key', count(*) from (select security_id from masked group by security_id, symbol, valid_from having count(*) > 1) x
    union all select 'overlap', count(*) from masked a join masked b on a.symbol = b.symbol and (a.valid_from < b.valid_from or (a.valid_from = b.valid_from and a.security_id < b.security_id))
        and (a.valid_to is null or b.valid_from < a.valid_to)""")
def master_faults(w: World):
    return pit.segment_faults(w.segments, AS_OF)


@query("pit_sessions_last_n", f"select distinct session_date from [bars] where available_at <= {AT} order by session_date desc limit 20")
def sessions_last_n(w: World):
    return pit.sessions(w.bars, AS_OF, 20)


@query("pit_splits_dedup", f"with {EVENTS} select symbol, ex_date, factor, kind, available_at from events_known where concat(symbol, ':', strftime(ex_date, '%Y-%m-%d')) <> 'S6:1994-09-20'")
def splits_dedup(w: World):
    return pit.splits_as_of(w.splits, AS_OF, ["S6:1994-09-20"]).select("symbol", "ex_date", "factor", "kind", "available_at")


@query("pit_dividends_distinct", f"select distinct * from [dividends] where available_at <= {AT}")
def dividends_distinct(w: World):
    return pit.dividends_as_of(w.dividends, AS_OF)


@query("pit_spinoffs_dedup", f"select parent_symbol, child_symbol, ex_date, ratio, min(available_at) as available_at from [spinoffs] where available_at <= {AT} group by parent_symbol, child_symbol, ex_date, ratio")
def spinoffs_dedup(w: World):
    return pit.spinoffs_as_of(w.spinoffs, AS_OF)


DOC_AT = "2024-01-05 12:00:00"
VISIBLE_DOCS = f"shown as (select * from [docs] d where available_at <= timestamp '{DOC_AT}' and not exists (select 1 from [docs] r where r.supersedes_id = d.id and r.available_at <= timestamp '{DOC_AT}'))"


@query("pit_documents_visible", f"with {VISIBLE_DOCS} select id, entity_id, doc_type, available_at, supersedes_id from shown")
def documents_visible(w: World):
    return pit.visible_documents(w.docs, DOC_AT).select("id", "entity_id", "doc_type", "available_at", "supersedes_id")


@query("pit_documents_since", f"with {VISIBLE_DOCS} select id, available_at from shown where entity_id = 7 and available_at >= timestamp '2024-01-02'")
def documents_since(w: World):
    return pit.visible_documents(w.docs, DOC_AT).filter((F.col("entity_id") == 7) & (F.col("available_at") >= pit.instant("2024-01-02 00:00:00"))).select("id", "available_at")


@query("pit_chunks_visible", f"with {VISIBLE_DOCS} select id, cast(ordinal as bigint) as ordinal, lines[ordinal] as line from (select id, lines, unnest(range(1, len(lines) + 1)) as ordinal from (select id, string_split(text, chr(10)) as lines from shown) x) y")
def chunks_visible(w: World):
    shown = pit.visible_documents(w.docs, DOC_AT)
    return shown.select("id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line")).select("id", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "line")


@query("pit_events_since", "select event_id, user_id, event_type from events where ts > timestamp '2024-01-10' and ts <= timestamp '2024-01-20'")
def events_since(w: World):
    return w.events.filter((F.col("ts") > pit.instant("2024-01-10 00:00:00")) & (F.col("ts") <= pit.instant("2024-01-20 00:00:00"))).select("event_id", "user_id", "event_type")


@query("pit_trades_visible", "select id, run_id, pnl from [trades] where exit_at <= timestamp '2024-01-15' and run_id = 11")
def trades_visible(w: World):
    return pit.visible(w.trades, "2024-01-15 00:00:00", "exit_at").filter("run_id = 11").select("id", "run_id", "pnl")


@query("pit_equity_visible", "select run_id, session_date, count(*) as trades from [trades] where exit_at <= timestamp '2024-01-15' group by run_id, session_date")
def equity_visible(w: World):
    return pit.visible(w.trades, "2024-01-15 00:00:00", "exit_at").groupBy("run_id", "session_date").agg(F.count(F.lit(1)).alias("trades"))


@query("pit_truncated_inputs", f"select 'bars' as input, count(*) as n from [bars] where available_at <= {AT} union all select 'facts', count(*) from [facts] where available_at <= {AT} union all select 'renames', count(*) from [renames] where available_at <= {AT} union all select 'splits', count(*) from [splits] where available_at <= {AT}")
def truncated_inputs(w: World):
    parts = pit.truncated({n: getattr(w, n) for n in ("bars", "facts", "renames", "splits")}, AS_OF)
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("input"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


#: One row for each security and session: where a security has two names on a day, the first in order.
PANEL = RESOLVED.replace("resolved as (", "owned as (") + ", resolved as (select * from (select *, row_number() over (partition by security_id, session_date order by symbol) as pick from owned) x where pick = 1)"


def panel(w: World):
    return pit.first_of(resolved(w), ["security_id", "session_date"], [F.col("symbol")])
