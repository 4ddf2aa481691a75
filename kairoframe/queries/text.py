"""Text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import World
from ..catalog import query
from ..functions import text
from ..operators.aggregates import tidy
from ..plans import pit
from .pit import DOC_AT, VISIBLE_DOCS

QUERY, WORDS = "The onand thnd", "'the', 'onand', 'thnd'"
CHUNKS = f"""{VISIBLE_DOCS}, chunks as (select id * 10000 + ordinal as chunk_id, entity_id, line, length(line) as len from (select id, entity_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ordinal from shown) x)"""


def chunks(w: World):
    rows = pit.visible_documents(w.docs, DOC_AT).select("id", "entity_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return rows.select((F.col("id") * 10000 + F.col("at") + 1).alias("chunk_id"), "entity_id", "text", F.length("text").cast("long").alias("length"))


@query("bm25_topk", f"""with {CHUNKS}, tok as (select chunk_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) as term from chunks), tf as (select chunk_id, term, count(*) as tf from tok where term in ({WORDS}) group by 1, 2),
    df as (select term, count(*) as df from tf group by 1), s as (select chunk_id, sum(ln(1 + ((select count(*) from chunks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select avg(len) from chunks)))) as score from tf join df using (term) join chunks using (chunk_id) group by 1)
    select chunk_id, floor(score * 1e6 + 0.5) / 1e6 as score from s order by round(score, 9) desc, chunk_id limit 10""")
def bm25_topk(w: World):
    return text.bm25(chunks(w), QUERY).withColumn("score", tidy(F.col("score")))


@query("bm25_entity", f"""with {CHUNKS}, tok as (select chunk_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) as term from chunks), tf as (select chunk_id, term, count(*) as tf from tok where term in ({WORDS}) group by 1, 2),
    df as (select term, count(*) as df from tf group by 1), s as (select chunk_id, sum(ln(1 + ((select count(*) from chunks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select avg(len) from chunks)))) as score from tf join df using (term) join chunks using (chunk_id) where entity_id < 5 group by 1)
    select chunk_id, floor(score * 1e6 + 0.5) / 1e6 as score from s order by round(score, 9) desc, chunk_id limit 5""")
def bm25_entity(w: World):
    return text.bm25(chunks(w), QUERY, F.col("entity_id") < 5, 5).withColumn("score", tidy(F.col("score")))


@query("token_counts", "select doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as tokens from documents")
def token_counts(w: World):
    return w.documents.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("document_frequency", f"with {CHUNKS} select term, count(distinct chunk_id) as df from (select chunk_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) as term from chunks) x group by term having count(distinct chunk_id) > 1")
def document_frequency(w: World):
    return text.postings(chunks(w), text.tokens(F.col("text"))).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")


@query("index_mismatch", f"with {CHUNKS} select chunk_id, term, count(*) as tf, 'missing' as what from (select chunk_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) as term from chunks) x group by 1, 2 having chunk_id % 7 = 0")
def index_mismatch(w: World):
    c = chunks(w)
    return text.index_mismatch(c, text.postings(c, text.tokens(F.col("text"))).filter("chunk_id % 7 <> 0"))


@query("doc_audit", f"with {VISIBLE_DOCS} select id, case when entity_id is null then 'no_entity' when text is null or text = '' then 'no_text' when n_chars <> length(text) then 'length_differs' when entity_id = 0 then 'unknown_entity' else 'ok' end as fault from shown")
def doc_audit(w: World):
    c = F.col
    fault = F.when(c("entity_id").isNull(), "no_entity").when(c("text").isNull() | (c("text") == ""), "no_text").when(c("n_chars") != F.length("text"), "length_differs").when(c("entity_id") == 0, "unknown_entity").otherwise("ok")
    return pit.visible_documents(w.docs, DOC_AT).select("id", fault.alias("fault"))


@query("content_hash", "select doc_id, sha256(text) as hash from documents")
def content_hash(w: World):
    return w.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("base_form", "select id, case regexp_replace(doc_type, '/A$', '') when '10-KT' then '10-K' when '10-QT' then '10-Q' else regexp_replace(doc_type, '/A$', '') end as form from [docs]")
def base_form(w: World):
    return w.docs.select("id", text.base_form(F.col("doc_type")).alias("form"))


@query("filing_cik", "select id, cast(regexp_extract(url, '/data/(\\d+)/', 1) as bigint) as cik from [docs]")
def filing_cik(w: World):
    return w.docs.select("id", F.regexp_extract("url", r"/data/(\d+)/", 1).cast("long").alias("cik"))


@query("tickers_normal", "select s_suppkey, regexp_replace(upper(trim(concat(' s', s_suppkey % 7, '-b'))), '[-/ ]+', '.', 'g') as ticker, regexp_full_match(regexp_replace(upper(trim(concat(' s', s_suppkey % 7, '-b'))), '[-/ ]+', '.', 'g'), '[A-Z]+(\\.[A-Z]+)?') as valid from supplier")
def tickers_normal(w: World):
    t = text.normal_ticker(F.concat(F.lit(" s"), (F.col("s_suppkey") % 7).cast("string"), F.lit("-b")))
    return w.supplier.select("s_suppkey", t.alias("ticker"), text.valid_ticker(t).alias("valid"))


def _reports(w: World):
    return w.facts.select("cik", "form", "filed", "end_date").distinct()


@query("periodic_gaps", "with r as (select distinct cik, filed from [facts] where form = '10-Q'), g as (select cik, filed, lead(filed) over (partition by cik order by filed) as nxt from r) select cik, filed, nxt, date_diff('day', filed, nxt) as gap from g where date_diff('day', filed, nxt) > 60")
def periodic_gaps(w: World):
    from pyspark.sql import Window

    rows = _reports(w).filter("form = '10-Q'").select("cik", "filed").distinct()
    rows = rows.withColumn("nxt", F.lead("filed").over(Window.partitionBy("cik").orderBy("filed")))
    return rows.withColumn("gap", F.datediff("nxt", "filed").cast("long")).filter("gap > 60")


@query("stale_reports", "select cik, max(filed) as last_filed, date_diff('day', max(filed), date '2001-09-05') as age from [facts] where form in ('10-K', '20-F') group by cik having date_diff('day', max(filed), date '2001-09-05') > 36")
def stale_reports(w: World):
    rows = w.facts.filter("form in ('10-K', '20-F')").groupBy("cik").agg(F.max("filed").alias("last_filed"))
    return rows.withColumn("age", F.datediff(F.lit("2001-09-05").cast("date"), "last_filed").cast("long")).filter("age > 36")


@query("coverage_gaps", "select cik, kind from (select distinct cik from [facts]) c, (select unnest(['10-K', '20-F', '6-K']) as kind) k where not exists (select 1 from [facts] f where f.cik = c.cik and f.form = k.kind and f.filed >= date '2001-07-20')")
def coverage_gaps(w: World):
    wanted = w.facts.select("cik").distinct().select("cik", F.explode(F.array(*[F.lit(x) for x in ("10-K", "20-F", "6-K")])).alias("kind"))
    have = w.facts.filter("filed >= date'2001-07-20'").select("cik", F.col("form").alias("kind")).distinct()
    return wanted.join(have, ["cik", "kind"], "left_anti")


@query("missing_filings", "select accn from [facts] f where form = '10-K' and not exists (select 1 from [facts] s where s.accn = f.accn and s.filed < date '1996-01-01')")
def missing_filings(w: World):
    saved = w.facts.filter("filed < date'1996-01-01'").select("accn")
    return w.facts.filter("form = '10-K'").select("accn").join(saved, "accn", "left_anti")


@query("prompt_text", f"with {CHUNKS} select entity_id, string_agg(concat('[', chunk_id, '] ', line), chr(10) order by chunk_id) as prompt from chunks group by entity_id")
def prompt_text(w: World):
    piece = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.col("text"))
    rows = chunks(w).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", piece.alias("s")))).alias("all"))
    return rows.select("entity_id", F.array_join(F.transform("all", lambda x: x["s"]), "\n").alias("prompt"))


@query("answer_keys", "select conv_id, sha256(string_agg(concat(role, ':', text), chr(10) order by turn)) as request_key, count(*) as turns from conversations group by conv_id")
def answer_keys(w: World):
    rows = w.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("s")))).alias("all"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("all", lambda x: x["s"]), "\n"), 256).alias("request_key"), F.size("all").cast("long").alias("turns"))


@query("html_text")
def html_text(w: World):
    return w.pages.select("page_id", text.html_to_text("html").alias("text"))


@query("chunk_text")
def chunk_text(w: World):
    return text.chunked(w.docs.withColumn("form", F.lit("10-K")), "id", "text", "form", 1000)


@query("folded_words")
def folded_words(w: World):
    return w.documents.select("doc_id", F.size(text.folded_tokens("text")).cast("long").alias("words"))


@query("citation_validate")
def citation_validate(w: World):
    rows = w.conversations.select("conv_id", "turn", F.col("text").alias("chunk"), F.col("text").alias("claim"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("quote"), (F.col("conv_id") % 7 != 0).alias("visible"), (F.col("conv_id") % 5 != 0).alias("same_entity"))
    return text.checked_citations(rows).select("conv_id", "turn", "fault")
