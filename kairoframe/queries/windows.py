"""Windows and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import aggregates, joins, recurrences, windows
from ..operators.aggregates import tidy
from ..plans import pit
from .pit import AS_OF, MASKED
from .pit import PANEL as RESOLVED
from .pit import panel as resolved

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _t(x: str, name: str) -> str:
    return f"{T6.format(x)} as {name}"


@query("latest_segment", f"with {MASKED} select security_id, symbol, valid_from from (select *, row_number() over (partition by security_id order by valid_from desc, symbol) as place from masked) x where place = 1")
def latest_segment(w: World):
    return aggregates.latest_segment(pit.masked_segments(w.segments, AS_OF)).select("security_id", "symbol", "valid_from")


SESSIONS = "numbered as (select session_date, row_number() over (order by session_date) as idx, coalesce(lag(session_date, 3) over (order by session_date), date '1900-01-01') as lo, coalesce(lead(session_date, 3) over (order by session_date), date '2999-12-31') as hi from (select distinct session_date from [bars]) d)"


@query("session_index_window", f"with {SESSIONS} select * from numbered")
def session_index_window(w: World):
    return windows.session_index(w.bars)


@query("neighbour_bars", f"""with {SESSIONS}, a as (select b.symbol, b.session_date, b.close, b.volume, n.idx, lag(b.close) over (partition by b.symbol order by b.session_date) as prev_any_close, lag(n.idx) over (partition by b.symbol order by b.session_date) as prev_any_idx
    from [bars] b join numbered n using (session_date)) select symbol, session_date, idx, prev_any_close, prev_any_idx, lag(close) over (partition by symbol order by session_date) as prev_close, lag(idx) over (partition by symbol order by session_date) as prev_idx,
    lead(close) over (partition by symbol order by session_date) as next_close, lead(idx) over (partition by symbol order by session_date) as next_idx from a where volume > 0""")
def neighbour_bars(w: World):
    return windows.neighbours(w.bars, windows.session_index(w.bars)).select("symbol", "session_date", "idx", "prev_any_close", "prev_any_idx", "prev_close", "prev_idx", "next_close", "next_idx")


@query("segment_pairs", f"with {MASKED} select * from (select security_id, symbol as old_symbol, lead(symbol) over (partition by security_id order by valid_from, symbol) as new_symbol, lead(valid_from) over (partition by security_id order by valid_from, symbol) as new_from from masked) x where new_from is not null")
def segment_pairs(w: World):
    from pyspark.sql import Window

    o = Window.partitionBy("security_id").orderBy("valid_from", "symbol")
    rows = pit.masked_segments(w.segments, AS_OF)
    return rows.select("security_id", F.col("symbol").alias("old_symbol"), F.lead("symbol").over(o).alias("new_symbol"), F.lead("valid_from").over(o).alias("new_from")).filter("new_from is not null")


@query("suffix_share", "select symbol, session_date, sum(volume) over (partition by symbol order by session_date desc rows between unbounded preceding and current row)::bigint as left_volume from [bars]")
def suffix_share(w: World):
    return windows.suffix_sum(w.bars.select("symbol", "session_date", "volume"), "symbol", "session_date", "volume", "left_volume").drop("volume")


@query("open_ahead", "select symbol, session_date, lead(open, 1) over (partition by symbol order by session_date) as open1, lead(open, 2) over (partition by symbol order by session_date) as open2 from [bars]")
def open_ahead(w: World):
    from pyspark.sql import Window

    o = Window.partitionBy("symbol").orderBy("session_date")
    return w.bars.select("symbol", "session_date", F.lead("open", 1).over(o).alias("open1"), F.lead("open", 2).over(o).alias("open2"))


@query("nth_previous_session", f"with {SESSIONS} select a.session_date, b.session_date as before from numbered a left join numbered b on b.idx = a.idx - 10")
def nth_previous_session(w: World):
    n = windows.session_index(w.bars).select("session_date", "idx")
    return n.join(n.select((F.col("idx") + 10).alias("idx"), F.col("session_date").alias("before")), "idx", "left").select("session_date", "before")


ONE = "r as (select * from resolved)"
FEATURES = f"""with {RESOLVED}, d as (select *, lag(close) over w as prev_close from resolved window w as (partition by security_id order by session_date)),
    e as (select *, case when prev_close is not null then greatest(high - low, abs(high - prev_close), abs(low - prev_close)) end as tr, close * volume as usd from d)"""


def _mean(x: str, n: int, back: str) -> str:
    frame = f"over (partition by security_id order by session_date rows between {back})"
    return f"case when count({x}) {frame} = {n} then avg({x}) {frame} end"


@query("daily_features", f"""{FEATURES} select security_id, session_date, prev_close, open / prev_close - 1 as gap, {_t(_mean('tr', 14, '14 preceding and 1 preceding'), 'atr')},
    {_t('volume / ' + _mean('volume', 20, '20 preceding and 1 preceding'), 'rvol')}, {_t(_mean('usd', 20, '20 preceding and 1 preceding'), 'avg_dollar_volume')} from e""")
def daily_features(w: World):
    rows = windows.daily_features(resolved(w))
    return rows.select("security_id", "session_date", "prev_close", "gap", *[tidy(F.col(c)).alias(c) for c in ("atr", "rvol", "avg_dollar_volume")])


@query("atr_inclusive", f"{FEATURES}, f as (select security_id, session_date, coalesce(tr, high - low) as r from e) select security_id, session_date, {_t(_mean('r', 14, '13 preceding and current row'), 'signal_atr')} from f")
def atr_inclusive(w: World):
    return windows.inclusive_atr(resolved(w)).select("security_id", "session_date", tidy(F.col("signal_atr")).alias("signal_atr"))


@query("sma_filter", f"with {RESOLVED} select security_id, session_date, floor(close * 1e6) > floor(({_mean('close', 50, '49 preceding and current row')}) * 1e6) as above from resolved")
def sma_filter(w: World):
    rows = resolved(w)
    from pyspark.sql import Window

    o = Window.partitionBy("security_id").orderBy("session_date").rowsBetween(-49, 0)
    return rows.select("security_id", "session_date", (F.floor(F.col("close") * 1e6) > F.floor(windows.full_mean(F.col("close"), o, 50) * 1e6)).alias("above"))


@query("rank_tertiles", "select symbol, session_date, cast(floor(3.0 * (row_number() over (partition by session_date order by volume desc, symbol) - 1) / count(*) over (partition by session_date)) as bigint) as tertile from [bars]")
def rank_tertiles(w: World):
    return windows.rank_tertile(w.bars.select("symbol", "session_date", "volume"), "session_date", [F.desc("volume"), F.col("symbol")]).drop("volume")


FV = f"""with {RESOLVED}, m as (select *, {_mean('(open + high + low + close) / 4', 10, '9 preceding and current row')} as fv from resolved),
    c as (select *, coalesce(low < fv and fv < high, false) as crossing from m), n as (select *, sum(case when crossing then 1 else 0 end) over (partition by security_id order by session_date) as crossings from c)"""


@query("fair_value", f"{FV} select security_id, session_date, {_t('fv', 'fv')}, crossings::bigint as crossings from n")
def fair_value(w: World):
    return windows.fair_value(resolved(w), 10).select("security_id", "session_date", tidy(F.col("fv")).alias("fv"), "crossings")


MEDIANS = f"""{FV}, g as (select *, median(case when crossing then high / fv end) over (partition by security_id order by session_date) as hu, median(case when crossing then low / fv end) over (partition by security_id order by session_date) as ld from n)"""


@query("expanding_median", f"{MEDIANS} select security_id, session_date, {_t('hu', 'hu')}, {_t('ld', 'ld')} from g")
def expanding_median(w: World):
    rows = windows.crossing_medians(windows.fair_value(resolved(w), 10), None)
    return rows.select("security_id", "session_date", tidy(F.col("hu")).alias("hu"), tidy(F.col("ld")).alias("ld"))


@query("sticky_colour", f"""{MEDIANS}, f as (select *, fv is null or crossings < 5 as off, case when fv is null or crossings < 5 then null when high < fv * ld then 'red' when low > fv * hu then 'green' end as flag from g),
    h as (select *, sum(case when off then 1 else 0 end) over (partition by security_id order by session_date) as reset from f)
    select security_id, session_date, case when not off then last_value(flag ignore nulls) over (partition by security_id, reset order by session_date rows between unbounded preceding and current row) end as colour from h""")
def sticky_colour(w: World):
    rows = windows.crossing_medians(windows.fair_value(resolved(w), 10), None)
    return windows.sticky_colour(rows, 5).select("security_id", "session_date", "colour")


SERIES = f"""{RESOLVED}, x as (select security_id, session_date, close as v, row_number() over (partition by security_id order by session_date) as i from resolved)"""


def _ema_sql(source: str, name: str, a: float) -> str:
    return f"""{name} as (select security_id, session_date, i, v as e from {source} where i = 1 union all
        select s.security_id, s.session_date, s.i, p.e * {1 - a!r} + s.v * {a!r} from {name} p join {source} s on s.security_id = p.security_id and s.i = p.i + 1)"""


def _rma_sql(source: str, name: str, n: int) -> str:
    a = 1.0 / n
    seed = " + ".join(["0.0"] + [f"max(case when i = {k} then v end)" for k in range(1, n + 1)])
    return f"""{name} as (select security_id, {n}::bigint as i, ({seed}) / {float(n)} as e from {source} where i <= {n} group by security_id having count(*) = {n} union all
        select s.security_id, s.i, p.e * {1 - a!r} + s.v * {a!r} from {name} p join {source} s on s.security_id = p.security_id and s.i = p.i + 1)"""


def closes(w: World):
    return resolved(w).select("security_id", "session_date", "close")


def along(w: World, **made):
    return recurrences.along(closes(w), "security_id", "session_date", "close", **made).drop("close")


@query("ema", f"with recursive {SERIES}, {_ema_sql('x', 'f', 2 / 21)} select security_id, session_date, e as ema from f")
def ema(w: World):
    return along(w, ema=lambda: recurrences.ema(20))


@query("rma", f"with recursive {SERIES}, {_rma_sql('x', 'f', 5)} select x.security_id, x.session_date, f.e as rma from x left join f using (security_id, i)")
def rma(w: World):
    return along(w, rma=lambda: recurrences.rma(5))


def _rsi_sql(source: str, tail: str) -> str:
    return f"""ch as (select security_id, session_date, i - 1 as i, v - lag(v) over (partition by security_id order by i) as d from {source}),
        gain as (select security_id, i, greatest(d, 0.0) as v from ch where i > 0), loss as (select security_id, i, greatest(-d, 0.0) as v from ch where i > 0),
        {_rma_sql('gain', 'gu', 5)}, {_rma_sql('loss', 'lo', 5)}
        select ch.security_id, ch.session_date, (case when gu.e is null or lo.e is null then null when lo.e = 0 then 100.0 when gu.e = 0 then 0.0 else 100 - 100 / (1 + gu.e / lo.e) end){tail} from ch left join gu using (security_id, i) left join lo using (security_id, i)"""


@query("rsi", f"with recursive {SERIES}, {_rsi_sql('x', ' as rsi')}")
def rsi(w: World):
    return along(w, rsi=lambda: recurrences.rsi(5))


@query("bx_histogram", f"with recursive {SERIES}, {_ema_sql('x', 'fast', 2 / 6)}, {_ema_sql('x', 'slow', 2 / 21)}, diff as (select f.security_id, f.session_date, f.i, f.e - s.e as v from fast f join slow s using (security_id, i)), {_rsi_sql('diff', ' - 50 as bx')}")
def bx_histogram(w: World):
    return along(w, bx=recurrences.histogram)


@query("period_as_of", f"""with recursive {RESOLVED}, p as (select security_id, cast(date_trunc('month', session_date) as date) as period_start, min(session_date) as first_day, max(session_date) as period_end, arg_max(close, session_date) as close from resolved group by 1, 2),
    q as (select *, lead(first_day) over (partition by security_id order by period_start) as later, cast(last_day(period_start) - cast(greatest(0, isodow(last_day(period_start)) - 5) as integer) as date) as last_weekday from p),
    c as (select security_id, case when period_end = last_weekday then period_end else later end as complete_on, close from q where period_end = last_weekday or later is not null),
    m as (select r.security_id, r.session_date, (select max(complete_on) from c where c.security_id = r.security_id and c.complete_on <= r.session_date) as complete_on from (select distinct security_id, session_date from resolved) r)
    select m.*, (select max(close) from c where c.security_id = m.security_id and c.complete_on = m.complete_on) as month_close from m""")
def period_as_of(w: World):
    bars = resolved(w)
    months = aggregates.period_bars(bars, "month").select("security_id", "complete_on", F.col("close").alias("month_close"))
    return joins.as_of_backward(bars.select("security_id", "session_date").distinct(), months, "security_id", "session_date", "complete_on", ["complete_on", "month_close"])


@query("reaction_session", "select e.event_id, min(d.session_date) as session_date from events e left join (select distinct cast(ts as date) as session_date from events) d on cast(d.session_date as timestamp) + interval 570 minute > e.ts group by e.event_id")
def reaction_session(w: World):
    days = w.events.select(F.to_date("ts").alias("session_date")).distinct().withColumn("opens", F.col("session_date").cast("timestamp_ntz") + F.expr("interval 570 minute"))
    return joins.first_after(w.events.select("event_id", "ts"), "ts", days, "opens", "session_date").select("event_id", "session_date")
