"""Filings: which forms, files and filers count, and when a filing was public."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_form
from ..plans.pit import FAR

# Periodic reports, forms whose content is in exhibits, items of an 8-K that carry results, readable files.
PERIODIC = ("10-K", "10-Q", "20-F")
EXHIBIT_FORMS = ("6-K", "40-F")
RESULT_ITEMS = ("2.02", "7.01")
READABLE = r"(?i)\.(htm|html|txt)$"
ACCEPTED = r'Accepted</div>\s*<div class="info">\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*<'
ITEM_LIST = r"^\d+\.\d+(,\d+\.\d+)*$"
#: Filings, or entities, to a list when the two are joined; parts of a filer's filings.
TILE, SALTS = 256, 16


def filing_items(title: Column) -> Column:
    """Items of an 8-K's title, '8-K 2.02,9.01 ...' (empty where there are none)."""
    words = F.split(F.trim(title), r"\s+")
    second = F.get(words, F.lit(1))
    listed = F.get(words, F.lit(0)).startswith("8-K") & second.rlike(ITEM_LIST)
    return F.when(listed, F.array_distinct(F.split(second, ","))).otherwise(F.array().cast("array<string>"))


def wanted(form: Column, items: Column) -> Column:
    """Whether a filing's form is read: reports, forms of exhibits, and an 8-K with results or disclosure."""
    base = base_form(form)
    return F.when(base == "8-K", F.arrays_overlap(items, F.array(*map(F.lit, RESULT_ITEMS)))).otherwise(base.isin(*PERIODIC, *EXHIBIT_FORMS))


def accepted_at(index_html: Column) -> Column:
    """The acceptance time of an index page, New York, as UTC (null: the page has none)."""
    found = F.regexp_extract(index_html, ACCEPTED, 1)
    return F.to_utc_timestamp(F.to_timestamp(F.nullif(found, F.lit(""))), "America/New_York")


def public_at(accepted: Column, filing_date: Column) -> Column:
    """Acceptance, but not before dissemination opens on the filing's day, 06:00 in New York."""
    opens = F.to_utc_timestamp(filing_date.cast("timestamp") + F.expr("interval 6 hours"), "America/New_York")
    return F.greatest(accepted, opens)


class _IndexRows(HTMLParser):
    """Rows of cells of an index page; a cell with a link is the text of its first link."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: dict[str, str] | None = None
        self.part = "text"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.cell, self.part = {"text": ""}, "text"
        elif tag == "a" and self.cell is not None and "link" not in self.cell:
            self.cell["link"], self.part = "", "link"

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.part = "text"
        elif tag == "td" and self.cell is not None:
            self.rows[-1].append(" ".join(self.cell.get("link", self.cell["text"]).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[self.part] += data


def index_entries(html: str | None) -> list[tuple[int | None, str, str, str]]:
    """(seq, description, file, type) of each row with four cells or more."""
    reader = _IndexRows()
    reader.feed(html or "")
    reader.close()
    return [(int(r[0]) if r[0].isdigit() else None, r[1], r[2], r[3]) for r in reader.rows if len(r) >= 4]


def parsed_index(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, seq, description, filename, doc_type for every row of every index page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *e) for k, page in zip(frame[key], frame[html], strict=True) for e in index_entries(page)]
            yield pd.DataFrame(rows, columns=[key, "seq", "description", "filename", "doc_type"]).astype({"seq": "Int64"})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, seq long, description string, filename string, doc_type string")


def selected_files(entries: DataFrame, key: str = "accn") -> DataFrame:
    """The files whose text is the filing's content. entries: key, form, primary_document, seq, filename, doc_type.

    A periodic report is its primary document, a 10-K also its EX-13; other forms are their EX-99 exhibits, or the primary
    document where there is none. Only readable files count.
    """
    rows = entries.filter(F.col("filename").rlike(READABLE))
    base, is_primary = base_form(F.col("form")), F.col("filename") == F.col("primary_document")
    exhibit = F.col("doc_type").startswith("EX-99")
    of_filing = Window.partitionBy(key)
    rows = rows.withColumn("_exhibits", F.max(exhibit).over(of_filing))
    nth = F.row_number().over(Window.partitionBy(key, is_primary).orderBy(F.col("seq").asc_nulls_last(), "filename"))
    primary = is_primary & (nth == 1)
    periodic = base.isin(*PERIODIC)
    take = F.when(periodic, primary | ((base == "10-K") & F.col("doc_type").startswith("EX-13"))).otherwise(F.when(F.col("_exhibits"), exhibit).otherwise(primary))
    return rows.withColumn("_take", take).filter("_take").drop("_take", "_exhibits")


def filer_windows(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """entity_id, cik, start, end: an entity's own filer at any day, other filers on the days a segment carried them.

    entities: entity_id, security_id, cik; segments: security_id, cik, valid_from, valid_to.
    """
    none = F.lit(None).cast("date")
    own = entities.select("entity_id", "cik", none.alias("start"), none.alias("end"))
    seen = segments.select("security_id", F.col("cik").alias("_c"), "valid_from", "valid_to").filter("_c is not null")
    other = entities.join(seen, "security_id").filter("_c <> cik").select("entity_id", F.col("_c").alias("cik"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    return own.unionByName(other).distinct()


def disjoint_windows(windows: DataFrame) -> DataFrame:
    """entity_id, cik, start, end: the same days, in windows of which no two of an entity and a filer meet."""
    first, far = (F.lit(x).cast("date") for x in ("0001-01-01", FAR))
    rows = windows.select("entity_id", "cik", F.coalesce("start", first).alias("_a"), F.coalesce("end", far).alias("_z"), F.col("start").isNull().alias("_open"), F.col("end").isNull().alias("_ends"))
    rows = rows.filter("_open or _ends or _a < _z")
    along = Window.partitionBy("entity_id", "cik").orderBy(F.desc("_open"), "_a")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # An open end is later than any date, so it is looked at first.
    apart = ~F.coalesce(F.max("_ends").over(before), F.lit(False)) & (F.col("_a") > F.max("_z").over(before)) & ~F.col("_open")
    rows = rows.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_no", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    made = rows.groupBy("entity_id", "cik", "_no").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.max("_open").alias("_open"), F.max("_ends").alias("_ends"))
    return made.select("entity_id", "cik", F.when(~F.col("_open"), F.col("_a")).alias("start"), F.when(~F.col("_ends"), F.col("_z")).alias("end"))


def tiles(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, _tile, name: the other columns of a key's rows as lists of up to TILE structs. Rows that are dealt by the keys do not move."""
    rest = [c for c in rows.columns if c not in keys] or keys
    no = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    return rows.withColumn("_tile", F.floor((no - 1) / TILE)).groupBy(*keys, "_tile").agg(F.collect_list(F.struct(*rest)).alias(name))


def belonging(filings: DataFrame, windows: DataFrame, day: str = "filing_date") -> DataFrame:
    """filings with the entity whose window of the filer covers the day (one row for each entity).

    The result is as large as filings times entities of a filer, so what is joined is lists of both: filings of a filer and
    a day, entities of a filer and a window. A pair of lists becomes rows in the task that joins it, and of them nothing
    moves. Its rows are runs of a filing and repeat the same entities, which a columnar file keeps in a few bits a row; a
    file's dictionary holds some ten thousand filings, so lists are dealt to more parts than a shuffle has, and they are
    not drawn together, however few bytes they are.
    """
    parts = int(filings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cik", day]
    f = tiles(filings.repartition(parts, *keys).distinct(), keys, "_rows").withColumn("_part", F.pmod(F.xxhash64(*keys, "_tile"), F.lit(SALTS)).cast("int"))
    w = tiles(disjoint_windows(windows).select(F.col("cik").alias("_c"), "start", "end", "entity_id"), ["_c", "start", "end"], "_entities").drop("_tile")
    w = w.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = (F.col("start").isNull() | (F.col("start") <= F.col(day))) & (F.col("end").isNull() | (F.col(day) < F.col("end")))
    both = f.repartition(4 * parts, "cik", "_part").join(w.repartition(4 * parts, "_c", "_at"), (F.col("cik") == F.col("_c")) & (F.col("_part") == F.col("_at")) & inside)
    rows = both.select(*keys, "_entities", F.explode("_rows").alias("_f"))
    rows = rows.select(*[F.col(c) if c in keys else F.col("_f")[c].alias(c) for c in filings.columns], "_entities")
    return rows.select(*filings.columns, F.explode("_entities").alias("_e")).select(*filings.columns, F.col("_e")["entity_id"].alias("entity_id"))


def traded_segments(segments: DataFrame, bars: DataFrame, own_cik: Column) -> DataFrame:
    """segments with another filer's days clipped to those on which the symbol traded; untraded ones of it go."""
    keys = ["security_id", "symbol", "valid_from", "valid_to", "cik"]
    b = bars.filter("volume > 0").select(F.col("symbol").alias("_s"), "session_date")
    other = segments.filter(F.col("cik").isNotNull() & (F.col("cik") != own_cik)).select(*keys)
    held = other.join(b, (F.col("_s") == F.col("symbol")) & (F.col("session_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("session_date") < F.col("valid_to"))))
    clipped = held.groupBy(*keys).agg(F.min("session_date").alias("_a"), F.max("session_date").alias("_z"))
    clipped = clipped.select("security_id", "symbol", F.col("_a").alias("valid_from"), F.date_add("_z", 1).alias("valid_to"), "cik")
    return segments.filter(F.col("cik").isNull() | (F.col("cik") == own_cik)).select(*clipped.columns).unionByName(clipped)


def segments_of_ticker(segments: DataFrame, ticker: str) -> DataFrame:
    """Every segment of the securities that now trade under a ticker."""
    now = segments.filter((F.col("symbol") == ticker) & F.col("valid_to").isNull()).select("security_id").distinct()
    return segments.join(now, "security_id", "left_semi")


def lookback_sessions(atr_days: int, rvol_days: int, money_days: int) -> int:
    """Sessions before the reaction day that its features read: the longest window and the close before it."""
    return 1 + max(atr_days, rvol_days, money_days)
