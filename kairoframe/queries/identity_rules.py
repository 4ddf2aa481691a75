"""Rules of identity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import identity_rules as rules

#: Labels S1..S9 whose bars in part repeat another label's, so that copies occur.
COPIED = """cb as (select symbol, session_date, open, high, low, close, volume from [bars] where not (symbol = 'S2' and session_date >= date '1996-01-01') and not (symbol = 'S4' and session_date < date '1995-01-01')
    union all select 'S2', session_date, open, high, low, close, volume from [bars] where symbol = 'S1' and session_date >= date '1996-01-01' union all select 'S4', session_date, open, high, low, close, volume from [bars] where symbol = 'S3' and session_date < date '1995-01-01')"""
SAME = f"{COPIED}, same as (select a.symbol as first, b.symbol as second, a.session_date from cb a join cb b on a.session_date = b.session_date and a.open = b.open and a.high = b.high and a.low = b.low and a.close = b.close and a.symbol < b.symbol where a.volume > 0 and b.volume > 0)"
PIECES = "pc as (select k * 10 as key, k // 2 as chain, concat('S', k) as symbol, date '1993-01-01' as valid_from, case when k % 2 = 0 then date '1997-06-01' end as valid_to from (select distinct k from [bars]) x union all select k * 10 + 1, k // 2 - 1, concat('S', k), date '1997-06-01', null from (select distinct k from [bars] where k % 2 = 0) y)"


def bars(w: World):
    cols = ["symbol", "session_date", "open", "high", "low", "close", "volume"]
    b = w.bars.select(*cols)
    kept = b.filter("not (symbol = 'S2' and session_date >= date'1996-01-01') and not (symbol = 'S4' and session_date < date'1995-01-01')")
    two = b.filter("symbol = 'S1' and session_date >= date'1996-01-01'").withColumn("symbol", F.lit("S2"))
    four = b.filter("symbol = 'S3' and session_date < date'1995-01-01'").withColumn("symbol", F.lit("S4"))
    return kept.unionByName(two).unionByName(four)


def pieces(w: World):
    k = w.bars.select("k").distinct()
    first = k.select((F.col("k") * 10).alias("key"), F.floor(F.col("k") / 2).alias("chain"), F.concat(F.lit("S"), "k").alias("symbol"), F.lit("1993-01-01").cast("date").alias("valid_from"), F.when(F.col("k") % 2 == 0, F.lit("1997-06-01").cast("date")).alias("valid_to"))
    second = k.filter("k % 2 = 0").select((F.col("k") * 10 + 1).alias("key"), (F.floor(F.col("k") / 2) - 1).alias("chain"), F.concat(F.lit("S"), "k").alias("symbol"), F.lit("1997-06-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return first.unionByName(second)


def same(w: World):
    return rules.identical_days(bars(w))


@query("identical_days", f"with {SAME} select * from same")
def identical_days(w: World):
    return same(w)


CAND = "cand as (select p.key, p.symbol, concat('S', o) as other, p.valid_from as lo, p.valid_to as hi from pc p, (select unnest([1, 3, 5]) as o) x where concat('S', o) <> p.symbol)"


def candidates(w: World):
    other = F.explode(F.array(F.lit("S1"), F.lit("S3"), F.lit("S5"))).alias("other")
    return pieces(w).select("key", "symbol", other, F.col("valid_from").alias("lo"), F.col("valid_to").alias("hi")).filter("other <> symbol")


@query("copy_shares", f"with {SAME}, {PIECES}, {CAND} select key, (select count(*) from cb join (select distinct key, symbol, lo, hi from cand) d on d.symbol = cb.symbol and cb.session_date >= d.lo and cb.session_date < coalesce(d.hi, date '9999-12-31') where d.key = c.key and cb.volume > 0) as traded, (select count(distinct s.session_date) from same s join cand d on s.first = least(d.symbol, d.other) and s.second = greatest(d.symbol, d.other) and s.session_date >= d.lo and s.session_date < coalesce(d.hi, date '9999-12-31') where d.key = c.key) as identical from (select distinct key from cand) c")
def copy_shares(w: World):
    return rules.copy_shares(candidates(w), bars(w), same(w))


@query("piece_stats", f"with {COPIED}, {PIECES} select key, p.symbol, min(session_date) as first_bar, max(session_date) as last_bar, count(session_date) as bars from pc p left join cb on cb.symbol = p.symbol and cb.volume > 0 and session_date >= valid_from and session_date < coalesce(valid_to, date '9999-12-31') group by 1, 2")
def piece_stats(w: World):
    return rules.piece_stats(pieces(w), bars(w))


@query("resumed_pieces", f"with {COPIED}, g as (select symbol, session_date, date_diff('day', lag(session_date) over (partition by symbol order by session_date), session_date) as gap from cb where volume > 0) select symbol, min(session_date) as start from g where session_date >= date '1995-06-01' and coalesce(gap, 15) > 14 group by symbol")
def resumed_pieces(w: World):
    return rules.resumed(pieces(w).filter("key % 10 = 0").withColumn("valid_to", F.lit("1995-06-01").cast("date")), bars(w))


EDGES = "ed as (select distinct old_symbol, new_symbol, process_date as \"date\", cast(process_date - 90 as date) as date_lower from [renames])"


def edges(w: World):
    return w.renames.select("old_symbol", "new_symbol", F.col("process_date").alias("date"), F.date_sub("process_date", 90).alias("date_lower")).distinct()


@query("refined_edges", f"with {EDGES}, l as (select old_symbol, new_symbol, max(b.session_date) as last from ed join [bars] b on b.symbol = old_symbol and b.volume > 0 and b.session_date > date_lower and b.session_date < \"date\" group by 1, 2) select old_symbol, new_symbol, coalesce(cast(last + 1 as date), \"date\") as \"date\", case when last is null then date_lower end as date_lower from ed left join l using (old_symbol, new_symbol)")
def refined_edges(w: World):
    return rules.refined(edges(w), w.bars)


@query("conversions", f"""with {EDGES}, d as (select symbol, session_date, open, high, low, close from [bars] where volume > 0), n as (select session_date, row_number() over (order by session_date) as no from (select distinct session_date from d) x),
    s as (select e.old_symbol, e.new_symbol, e."date", a.session_date from ed e join d a on a.symbol = e.old_symbol and a.session_date < e."date" join d b on b.symbol = e.new_symbol and b.session_date = a.session_date where not (a.open = b.open and a.high = b.high and a.low = b.low and a.close = b.close))
    select old_symbol, new_symbol, "date", count(*) as differing, count(*) filter (where n.no > (select max(no) from n m where m.session_date < s."date") - 10) as recent from s join n using (session_date) group by 1, 2, 3 having count(*) >= 5 and count(*) filter (where n.no > (select max(no) from n m where m.session_date < s."date") - 10) > 0""")
def conversions(w: World):
    return rules.conversions(edges(w), w.bars, rules.identical_days(w.bars))


@query("copied_pieces", f"""with {SAME}, {PIECES}, l as (select symbol, arg_max(chain, (valid_from, chain)) as latest from pc group by symbol), c as (select distinct p.key, p.symbol, o.symbol as other, case when p.key = 20 then date '1996-02-01' else p.valid_from end as lo, p.valid_to as hi from pc p join l using (symbol) join pc o on o.chain = l.latest where p.chain <> l.latest and o.symbol <> p.symbol),
    t as (select key, (select count(*) from cb where cb.volume > 0 and cb.symbol = c.symbol and session_date >= lo and session_date < coalesce(hi, date '9999-12-31')) as traded, count(distinct s.session_date) as identical from c left join same s on s.first = least(c.symbol, c.other) and s.second = greatest(c.symbol, c.other) and s.session_date >= lo and s.session_date < coalesce(hi, date '9999-12-31') group by key, c.symbol, lo, hi)
    select key from t where identical >= 3 and identical >= 0.9 * traded""")
def copied_pieces(w: World):
    late = F.when(F.col("key") == 20, F.lit("1996-02-01").cast("date")).otherwise(F.col("valid_from"))
    return rules.copied_pieces(pieces(w).withColumn("valid_from", late), bars(w), same(w))


@query("copied_tails", f"""with {SAME}, {PIECES}, e as (select distinct symbol, session_date from (select first as symbol, session_date from same union all select second, session_date from same) x), h as (select p.key, cb.session_date, case when e.symbol is null then 0 else 1 end as c from pc p join cb on cb.symbol = p.symbol and cb.volume > 0 and cb.session_date >= p.valid_from and cb.session_date < coalesce(p.valid_to, date '9999-12-31') left join e on e.symbol = p.symbol and e.session_date = cb.session_date),
    r as (select *, count(*) over w as n, sum(c) over w as s, count(*) over (partition by key) as total from h window w as (partition by key order by session_date desc rows between unbounded preceding and current row)) select key, min(session_date) as cut from r where c = 1 and s >= 3 and s >= 0.9 * n and n < total group by key""")
def copied_tails(w: World):
    return rules.copied_tails(pieces(w), bars(w), same(w))


@query("clipped_pieces", f"""with {SAME}, {PIECES}, q as (select key, chain // 2 as chain, symbol, case when key % 20 = 0 then date '1995-10-01' else valid_from end as valid_from, valid_to from pc where key % 10 = 0),
    o as (select a.key, a.symbol, b.symbol as other, b.valid_from as lo, least(coalesce(a.valid_to, date '9999-12-31'), coalesce(b.valid_to, date '9999-12-31')) as hi from q a join q b on a.chain = b.chain and a.symbol <> b.symbol and a.valid_from < b.valid_from and b.valid_from < coalesce(a.valid_to, date '9999-12-31')),
    j as (select key, lo, (select count(*) from cb where cb.symbol = o.symbol and cb.volume > 0 and session_date >= lo and session_date < hi) as traded, (select count(distinct session_date) from same s where s.first = least(o.symbol, o.other) and s.second = greatest(o.symbol, o.other) and s.session_date >= lo and s.session_date < hi) as identical from o),
    c as (select key, min(lo) as cut from j where identical >= 3 and identical >= 0.9 * traded group by key) select q.key, q.symbol, q.valid_from, coalesce(c.cut, q.valid_to) as valid_to, c.cut is not null as clipped from q left join c using (key)""")
def clipped_pieces(w: World):
    q = pieces(w).filter("key % 10 = 0").withColumn("chain", F.floor(F.col("chain") / 2)).withColumn("valid_from", F.when(F.col("key") % 20 == 0, F.lit("1995-10-01").cast("date")).otherwise(F.col("valid_from")))
    return rules.clipped(q, bars(w), same(w)).select("key", "symbol", "valid_from", "valid_to", "clipped")


@query("price_continuity", f"""with {EDGES}, o as (select old_symbol, new_symbol, "date", arg_max(close, session_date) as last_close, max(session_date) as last_day from ed join [bars] b on b.symbol = old_symbol and b.volume > 0 and session_date < "date" group by 1, 2, 3),
    n as (select old_symbol, new_symbol, "date", arg_min(close, session_date) as first_close, min(session_date) as first_day from ed join [bars] b on b.symbol = new_symbol and b.volume > 0 and session_date >= "date" group by 1, 2, 3)
    select e.old_symbol, e.new_symbol, e."date", last_close, last_day, first_close, first_day, coalesce(first_close / last_close between 0.8 and 1.25 and date_diff('day', last_day, first_day) <= 10, false) as continuous from (select distinct old_symbol, new_symbol, "date" from ed) e left join o using (old_symbol, new_symbol, "date") left join n using (old_symbol, new_symbol, "date")""")
def price_continuity(w: World):
    return rules.continuous(edges(w), w.bars)


@query("segment_filer", "select security_id, symbol, valid_from, cik, known_day from (select s.security_id, s.symbol, s.valid_from, l.cik, min(l.snapshot_date) as known_day, row_number() over (partition by s.security_id, s.symbol, s.valid_from order by count(*) desc, max(l.snapshot_date) desc, l.cik) as place from [segments] s join (select distinct ticker, cik, snapshot_date from [snapshots]) l on l.ticker = s.symbol and l.snapshot_date >= s.valid_from and l.snapshot_date < coalesce(s.valid_to, date '9999-12-31') group by s.security_id, s.symbol, s.valid_from, l.cik) x where place = 1")
def segment_filer(w: World):
    return rules.segment_filer(w.segments, w.snapshots)


@query("built_segments")
def built_segments(w: World):
    return rules.built_segments(w.renames.select("old_symbol", "new_symbol", F.col("process_date").alias("date")), w.bars)
