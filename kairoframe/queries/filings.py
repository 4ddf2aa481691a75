"""Filings, exports and edge rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..operators import edge_rules, exports, filings, identity

TITLES = "t as (select id, concat(case when id % 5 = 0 then '6-K' else '8-K' end, ' ', case id % 4 when 0 then '2.02,9.01' when 1 then '7.01' when 2 then 'EX-99.1' else '8.01' end, ' note') as title from [docs])"


def titles(w: World):
    k = F.col("id")
    form = F.when(k % 5 == 0, "6-K").otherwise("8-K")
    items = F.when(k % 4 == 0, "2.02,9.01").when(k % 4 == 1, "7.01").when(k % 4 == 2, "EX-99.1").otherwise("8.01")
    return w.docs.select("id", form.alias("form"), F.concat_ws(" ", form, items, F.lit("note")).alias("title"))


@query("filing_items", f"with {TITLES} select id, case when starts_with(title, '8-K') and regexp_full_match(string_split(title, ' ')[2], '\\d+\\.\\d+(,\\d+\\.\\d+)*') then string_split(title, ' ')[2] else '' end as items from t")
def filing_items(w: World):
    return titles(w).select("id", F.array_join(filings.filing_items(F.col("title")), ",").alias("items"))


@query("wanted_filings", "select id, case when id % 5 = 0 then true else id % 4 in (0, 1) end as wanted from [docs]")
def wanted_filings(w: World):
    return titles(w).select("id", filings.wanted(F.col("form"), filings.filing_items(F.col("title"))).alias("wanted"))


@query("public_times", "select id, timezone('UTC', greatest(timezone('America/New_York', available_at), timezone('America/New_York', date_trunc('day', available_at) + interval 1 day * (id % 2) + interval 6 hour))) as public_at from [docs]")
def public_times(w: World):
    page = F.concat(F.lit('<div class="infoHead">Accepted</div>\n <div class="info">'), F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"), F.lit("</div>"))
    day = F.date_add(F.to_date("available_at"), (F.col("id") % 2).cast("int"))
    return w.docs.select("id", filings.public_at(filings.accepted_at(page), day).cast("timestamp_ntz").alias("public_at"))


ENTRIES = """e as (select l_orderkey as accn, case l_orderkey % 4 when 0 then '10-K' when 1 then '10-Q/A' when 2 then '8-K' else '6-K' end as form, concat('f', l_orderkey % 3 + 1, '.htm') as primary_document, l_linenumber as seq,
    concat('f', l_linenumber, case when l_partkey % 6 = 0 then '.pdf' else '.htm' end) as filename, case l_suppkey % 4 when 0 then 'EX-99.1' when 1 then 'EX-13' else '10-K' end as doc_type from (select distinct l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber) l)"""


@query("selected_files", f"""with {ENTRIES}, r as (select * from e where not ends_with(filename, '.pdf')), x as (select *, filename = primary_document as own, starts_with(doc_type, 'EX-99') as exhibit, bool_or(starts_with(doc_type, 'EX-99')) over (partition by accn) as any_exhibit from r)
    select accn, filename from x where case when form in ('10-K', '10-Q/A') then own or (form = '10-K' and starts_with(doc_type, 'EX-13')) when any_exhibit then exhibit else own end""")
def selected_files(w: World):
    k = F.col("accn")
    rows = w.lineitem.groupBy(F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = rows.select(
        "accn", F.when(k % 4 == 0, "10-K").when(k % 4 == 1, "10-Q/A").when(k % 4 == 2, "8-K").otherwise("6-K").alias("form"), F.concat(F.lit("f"), (k % 3 + 1).cast("string"), F.lit(".htm")).alias("primary_document"), "seq",
        F.concat(F.lit("f"), F.col("seq").cast("string"), F.when(F.col("p") % 6 == 0, ".pdf").otherwise(".htm")).alias("filename"), F.when(F.col("s") % 4 == 0, "EX-99.1").when(F.col("s") % 4 == 1, "EX-13").otherwise("10-K").alias("doc_type"),
    )
    return filings.selected_files(rows).select("accn", "filename")


WINDOWS = """o as (select security_id, min(cik) as cik from [segments] where cik is not null group by security_id), w as (select security_id as entity_id, cik, cast(null as date) as a, cast(null as date) as z from o
    union select o.security_id, s.cik, s.valid_from, s.valid_to from o join [segments] s on s.security_id = o.security_id where s.cik is not null and s.cik <> o.cik)"""


def own_filers(w: World):
    return w.segments.filter("cik is not null").groupBy("security_id").agg(F.min("cik").alias("cik")).withColumn("entity_id", F.col("security_id"))


@query("filer_windows", f"with {WINDOWS} select entity_id, cik, a as start, z as \"end\" from w")
def filer_windows(w: World):
    return filings.filer_windows(own_filers(w), w.segments)


@query("belonging_filings", f"with {WINDOWS} select distinct f.accn, w.entity_id from [facts] f join w on w.cik = f.cik and (w.a is null or w.a <= f.filed) and (w.z is null or f.filed < w.z)")
def belonging_filings(w: World):
    return filings.belonging(w.facts.select("accn", "cik", "filed"), filings.filer_windows(own_filers(w), w.segments), "filed").select("accn", "entity_id")


@query("trading_segments", """with o as (select security_id, min(cik) as own from [segments] where cik is not null group by security_id), s as (select s.*, o.own from [segments] s left join o using (security_id))
    select security_id, symbol, valid_from, valid_to, cik from s where cik is null or cik = own union all
    select s.security_id, s.symbol, min(b.session_date), max(b.session_date) + 1, s.cik from s join [bars] b on b.symbol = s.symbol and b.volume > 0 and b.session_date >= s.valid_from and (s.valid_to is null or b.session_date < s.valid_to) where s.cik <> s.own group by s.security_id, s.symbol, s.valid_from, s.valid_to, s.cik""")
def trading_segments(w: World):
    own = own_filers(w).select("security_id", F.col("cik").alias("own"))
    made = filings.traded_segments(w.segments.join(own, "security_id", "left"), w.bars, F.col("own"))
    return made.select("security_id", "symbol", "valid_from", "valid_to", "cik")


@query("ticker_segments", "select symbol, valid_from, valid_to from [segments] where security_id in (select security_id from [segments] where symbol = 'S4' and valid_to is null)")
def ticker_segments(w: World):
    return filings.segments_of_ticker(w.segments, "S4").select("symbol", "valid_from", "valid_to")


@query("entry_order", "select id, row_number() over (partition by session_date order by coalesce(c, 0) desc, security_id, id) as place from (select id, session_date, concat(security_id, '-', id) as security_id, case when id % 7 > 0 then (id % 11) / 10.0 end as c from [trades] where id % 3 > 0) x")
def entry_order(w: World):
    k = F.col("id")
    rows = w.trades.select("id", "session_date", F.concat_ws("-", "security_id", k.cast("string")).alias("security_id"), F.when(k % 7 > 0, (k % 11) / 10.0).alias("conviction"), F.when(k % 3 > 0, "take").otherwise("pass").alias("verdict"))
    return exports.entry_order(rows).select("id", "place")


@query("take_all", "select id, row_number() over (partition by session_date order by security_id, id) as place from [trades]")
def take_all(w: World):
    return exports.take_all(w.trades.select("id", "session_date", "security_id", F.col("id").alias("entity_id"))).select("id", "place")


@query("first_of_key", "select run_id, session_date, min(id) as id from [trades] group by run_id, session_date")
def first_of_key(w: World):
    return exports.one_per(w.trades.select("run_id", "session_date", "id"), ["run_id", "session_date"], ["id"])


@query("conviction_bins", "select c, case when c = 1 then 4 when c >= 0 and c < 1 then cast(floor(c / 0.2 + 1e-9) as bigint) end as bin from (select distinct (id % 13) / 10.0 as c from [trades]) x")
def conviction_bins(w: World):
    return w.trades.select(((F.col("id") % 13) / 10.0).alias("c")).distinct().select("c", exports.conviction_bin(F.col("c")).alias("bin"))


@query("fill_times", "select id, timezone('UTC', timezone('America/New_York', cast(session_date as timestamp) + interval 1 minute * case when id % 4 < 2 then 570 when id % 4 = 2 then 960 else 1200 end)) as filled_at from [trades]")
def fill_times(w: World):
    k = F.col("id") % 4
    reason = F.when(k == 0, "break").when(k == 1, "hard_gap").when(k == 2, "hard").otherwise("data_gap")
    return w.trades.select("id", exports.fill_time(F.col("session_date"), reason).cast("timestamp_ntz").alias("filled_at"))


@query("spinoff_legs", "select run_id, count(*) filter (where id % 4 = 1) as adjusted, count(*) filter (where id % 4 = 2) as restarted, sum(case when id % 8 = 1 then floor(pnl) else 0 end) as child_proceeds from [trades] where id % 4 in (1, 2) group by run_id")
def spinoff_legs(w: World):
    k = F.col("id")
    rows = w.trades.select("run_id", F.when(k % 4 == 1, "adjust").when(k % 4 == 2, "restart").alias("spinoff"), F.when(k % 8 == 1, F.floor("pnl").cast("double")).alias("child_proceeds"))
    return exports.spinoff_legs(rows, "run_id")


@query("document_timeline", "select id, entity_id, row_number() over (partition by entity_id order by available_at, id) as place from [docs] where entity_id < 20 and available_at >= timestamp '2024-01-03 05:00:00' and available_at <= timestamp '2024-02-03 05:00:00'")
def document_timeline(w: World):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    some = w.docs.select("entity_id").filter("entity_id < 20")  # the watched entities
    return exports.timeline(w.docs, some, at("2024-01-03 05:00:00"), at("2024-02-03 05:00:00")).select("id", "entity_id", "place")


@query("cited_spans", "select conv_id, turn, strpos(text, regexp_extract(text, '\\S+ \\S+')) - 1 as a from conversations where regexp_matches(text, '\\S+ \\S+')")
def cited_spans(w: World):
    quote = F.regexp_extract("text", r"\S+ \S+", 0)
    return w.conversations.filter(F.col("text").rlike(r"\S+ \S+")).select("conv_id", "turn", exports.quote_span(F.col("text"), quote)["a"].alias("a"))


@query("beside_base", "select a.id, b.r_multiple as base_r from [trades] a left join [trades] b on b.run_id = a.run_id + 1 and b.security_id = a.security_id and b.session_date = a.session_date and b.id % 3 = 0 where a.id % 2 = 0")
def beside_base(w: World):
    key = lambda run: F.concat_ws("|", run.cast("string"), "security_id")
    mine = w.trades.filter("id % 2 = 0").select("id", key(F.col("run_id") + 1).alias("security_id"), F.col("session_date").alias("as_of"), F.col("r_multiple").alias("r"))
    base = w.trades.filter("id % 3 = 0").select(key(F.col("run_id")).alias("security_id"), F.col("session_date").alias("as_of"), F.col("r_multiple").alias("r"))
    return exports.beside_base(mine, base).select("id", "base_r")


@query("ticker_presence", "select ticker, count(*) as seen, min(snapshot_date) as first_seen from (select distinct ticker, snapshot_date, cik from [snapshots]) x group by ticker")
def ticker_presence(w: World):
    return identity.presence(w.snapshots).select("ticker", F.size("seen").cast("long").alias("seen"), F.col("seen")[0]["snapshot_date"].alias("first_seen"))


@query("class_lookups", "with p as (select distinct ticker, cik from [snapshots]) select ticker, cik, count(*) over (partition by ticker) as filers, count(*) over (partition by cik) as tickers from p")
def class_lookups(w: World):
    return identity.class_lookups(w.snapshots)


@query("diff_keys", "select concat(symbol, ':', valid_from, ':', case when k % 2 = 0 then 'replaced' else 'fields_differ' end, case when k % 3 = 0 then ':cik+name' else '' end) as key from [segments]")
def diff_keys(w: World):
    k = F.col("k")
    return w.segments.select(identity.diff_key(F.col("symbol"), F.col("valid_from"), F.when(k % 2 == 0, "replaced").otherwise("fields_differ"), F.when(k % 3 == 0, "cik+name").otherwise("")).alias("key"))


EDGES = """ed as (select concat(old_symbol, case when hash_o % 9 = 0 then '.WI' else '' end) as old_symbol, concat(new_symbol, case when hash_n % 9 = 0 then '.WI' else '' end) as new_symbol, process_date as date, process_date - 40 as date_lower, case when hash_o % 2 = 0 then 'listing' else 'exact' end as evidence
    from (select *, cast(substr(old_symbol, 2) as integer) as hash_o, cast(substr(new_symbol, 2) as integer) as hash_n from (select distinct old_symbol, new_symbol, process_date from [renames]) r) x)"""


def edges(w: World):
    rows = w.renames.select("old_symbol", "new_symbol", "process_date").distinct()
    number = lambda c: F.substring(c, 2, 9).cast("int")
    wi = lambda c: F.concat(F.col(c), F.when(number(c) % 9 == 0, ".WI").otherwise(""))
    return rows.select(wi("old_symbol").alias("old_symbol"), wi("new_symbol").alias("new_symbol"), F.col("process_date").alias("date"), F.date_sub("process_date", 40).alias("date_lower"), F.when(number("old_symbol") % 2 == 0, "listing").otherwise("exact").alias("evidence"))


@query("through_when_issued", f"""with {EDGES}, i as (select * from ed where ends_with(new_symbol, '.WI')), p as (select * from ed where not ends_with(new_symbol, '.WI') and not ends_with(old_symbol, '.WI')),
    o as (select e.*, (select arg_max(i.old_symbol, (i.date, i.old_symbol)) from i where i.new_symbol = e.old_symbol and i.date <= e.date) as source from ed e where ends_with(old_symbol, '.WI') and not ends_with(new_symbol, '.WI')),
    d as (select o.*, exists (select 1 from p where p.evidence = 'listing' and p.old_symbol = o.source and p.new_symbol = o.new_symbol) as seen from o where source <> new_symbol)
    select old_symbol, new_symbol, date, evidence, true as links, true as starts from p where not (evidence = 'listing' and exists (select 1 from d where d.seen and d.source = p.old_symbol and d.new_symbol = p.new_symbol))
    union all select old_symbol, new_symbol, date, evidence, false, source is null from o union all select source, new_symbol, date, case when seen then 'both' else evidence end, true, true from d""")
def through_when_issued(w: World):
    return edge_rules.through_when_issued(edges(w)).select("old_symbol", "new_symbol", "date", "evidence", "links", "starts")


PHANTOMS = f"{EDGES}, ph as (select distinct case when contains(old_symbol, '3') then concat('P', old_symbol, '_', new_symbol) else old_symbol end as old_symbol, new_symbol, date from ed)"


@query("without_taker", f"""with {PHANTOMS}, k as (select distinct symbol from [bars]), f as (select symbol, min(session_date) as first from [bars] where volume > 0 group by symbol),
    t as (select s, count(distinct concat(least(a, b), '|', greatest(a, b))) as n from (select old_symbol as s, old_symbol as a, new_symbol as b from ph union all select new_symbol, old_symbol, new_symbol from ph) y group by s),
    g as (select distinct old_symbol, new_symbol from ph join f on f.symbol = new_symbol and f.first < date join t on t.s = old_symbol and t.n = 1 where not ends_with(old_symbol, '.WI') and old_symbol not in (select symbol from k))
    select old_symbol, new_symbol from g union select distinct ph.old_symbol, ph.new_symbol from ph join g on g.old_symbol = ph.new_symbol and g.new_symbol = ph.old_symbol""")
def without_taker(w: World):
    """Some old labels are made up, so they never had a bar."""
    made_up = F.when(F.col("old_symbol").contains("3"), F.concat(F.lit("P"), "old_symbol", F.lit("_"), "new_symbol")).otherwise(F.col("old_symbol"))
    return edge_rules.without_taker(edges(w).withColumn("old_symbol", made_up), w.bars)


@query("handover_dates", f"""with {EDGES}, t as (select symbol, session_date from [bars] where volume > 0), l as (select distinct e.old_symbol, e.new_symbol, e.date, (select max(session_date) from t where t.symbol = e.old_symbol and t.session_date < e.date) as last, (select min(session_date) from t where t.symbol = e.new_symbol) as first from ed e where evidence <> 'listing'),
    m as (select *, last + 1 as moved from l where (date - last - 1 between 1 and 10 or (date - last - 1 between 1 and 183 and first - last between 1 and 5)) and exists (select 1 from [bars] n where n.symbol = l.new_symbol and n.session_date > l.last and n.session_date < l.date))
    select e.old_symbol, e.new_symbol, e.evidence, coalesce(m.moved, e.date) as date from ed e left join m on m.old_symbol = e.old_symbol and m.new_symbol = e.new_symbol and m.date = e.date and e.evidence <> 'listing'""")
def handover_dates(w: World):
    return edge_rules.refined_by_handover(edges(w), w.bars).select("old_symbol", "new_symbol", "evidence", "date")
