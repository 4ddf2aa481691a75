"""Commands: `python -m kairoframe GROUP COMMAND`, one for each job of the engine.

Most show or write (--out, Parquet) what registered queries give for --tables. Downloads are not among them: where a job
starts with one, its command works on files that are there.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, reports
from .adapters import World
from .functions import text
from .operators import governance
from .sources import tables

Result = DataFrame | str


def queries(*names: str) -> Callable[[SparkSession, argparse.Namespace], dict[str, Result]]:
    return lambda spark, a: {n: catalog.QUERIES[n](spark, a.tables) for n in names}


def db_init(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    """Empty tables of records; tables that are there stay."""
    made = {}
    for name, schema in (("strategy_versions", governance.VERSIONS), ("holdout_openings", governance.OPENINGS), ("watchlist", governance.WATCHLIST)):
        path = f"{_folder(a)}/{name}"
        if not Path(path).exists():
            spark.createDataFrame([], schema).write.parquet(path)
            made[name] = path
    return {"created": ", ".join(made) or "nothing: all tables are there"}


def _folder(a: argparse.Namespace) -> str:
    if not a.out:
        raise SystemExit("--out names the folder")
    return a.out


def entities_sync(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    """A watchlist's items against the tables' last snapshot of each ticker."""
    items = spark.createDataFrame(governance.load_watchlist(Path(_file(a)).read_text()), governance.WATCHLIST)
    listed = World(spark, a.tables).snapshots
    newest = listed.groupBy("ticker").agg(F.max_by(F.struct("cik", "name"), F.struct("snapshot_date", "cik")).alias("x")).select("ticker", "x.cik", "x.name")
    return {"entities": governance.resolved_watchlist(items, newest, newest.withColumn("series_id", F.lit(None).cast("string")).limit(0))}


def _file(a: argparse.Namespace) -> str:
    if not a.file:
        raise SystemExit("--file names the input")
    return a.file


def market_backfill(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    """Partitions (year, first letter) that the bars lack between the first and last year; nothing is downloaded."""
    bars = World(spark, a.tables).bars
    have = bars.select("year", tables.bucket_of(F.col("symbol")).alias("bucket"), F.lit(True).alias("complete")).distinct()
    ends = bars.agg(F.min("session_date").alias("a"), F.max("session_date").alias("z")).first()
    buckets = sorted(r["bucket"] for r in have.select("bucket").distinct().collect())  # letters
    todo = tables.missing_partitions(tables.plan_partitions(str(ends["a"]), str(ends["z"]), buckets), have)
    return {"missing": spark.createDataFrame(todo, "year long, bucket string")}


def import_bars(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    w = World(spark, a.tables)
    if not a.out:
        return {"merged": tables.merged(w.bars, w.imported, ["symbol", "t"]).groupBy("source").count()}
    tables.write_merged(w.imported.unionByName(w.bars.limit(0)), f"{a.out}/bars", ["symbol", "t"], ["year"])
    return {"written": f"{a.out}/bars"}


def market_actions(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    """A file of JSON lines (kind, json) as typed tables, or the queries over the tables."""
    if a.file:
        return dict(tables.parse_actions(spark.read.schema("kind string, json string").json(a.file)))
    return queries("parse_splits", "parse_name_changes", "parse_dividends", "parse_others", "parse_rejects")(spark, a)


def docs_sync(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    """Filings in a folder, HTML or text, as chunks; a file that is there already with another content is an error."""
    raw = spark.read.text(_file(a), wholetext=True).select(F.input_file_name().alias("external_id"), F.col("value").alias("raw"))
    page = F.when(F.col("external_id").rlike(r"(?i)\.html?$"), text.html_to_text("raw")).otherwise(text.plain_to_text(F.col("raw")))
    docs = raw.select("external_id", page.alias("text"), F.lit(a.form).alias("form"))
    return {"documents": docs.select("external_id", F.sha2("text", 256).alias("content_hash")), "chunks": text.chunked(docs, "external_id", "text", "form")}


def evidence_search(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    if not a.query:
        raise SystemExit("--query names the words")
    from .queries.text import chunks

    rows = chunks(World(spark, a.tables)).withColumn("length", F.size(text.tokens(F.col("text"))))
    kept = F.col("entity_id") == a.entity if a.entity is not None else None
    found = text.bm25(rows, a.query, kept, a.rows)
    return {"found": found.join(rows.select("chunk_id", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id")}


def replay_report(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    from .session import cut

    out = cut(catalog.QUERIES["account_replay"](spark, a.tables))
    return {"report": reports.replay_report(out.filter("kind = 'sale'"), out.filter("kind = 'mark'"))}


def gate_report(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    attempts = catalog.QUERIES["versions_tried"](spark, a.tables).agg(F.sum("versions")).first()[0] or 0
    return {"report": reports.gate_report(catalog.QUERIES["entry_test"](spark, a.tables), a.alpha, attempts, a.budget)}


def market_audit(spark: SparkSession, a: argparse.Namespace) -> dict[str, Result]:
    names = [n for n in catalog.QUERIES if n.startswith("audit_") and (not a.only or n.removeprefix("audit_") in a.only.lower().split(","))]
    return queries(*names)(spark, a)


COMMANDS: dict[tuple[str, str], Callable[[SparkSession, argparse.Namespace], dict[str, Result]]] = {
    ("db", "init"): db_init,
    ("entities", "sync"): entities_sync,
    ("market", "universe"): queries("universe"),
    ("market", "backfill"): market_backfill,
    ("market", "import-bars"): import_bars,
    ("market", "status"): queries("bars_status"),
    ("market", "actions"): market_actions,
    ("market", "identity"): queries("built_segments", "edges_merge", "through_when_issued", "without_taker", "handover_dates"),
    ("market", "instruments"): queries("first_match_classify", "inherit_later", "class_overrides"),
    ("market", "liquid"): queries("adv_tier", "adv_tier_monthly"),
    ("market", "audit"): market_audit,
    ("market", "shares"): queries("visible_shares", "market_caps", "cap_passes"),
    ("market", "truncation"): queries("truncation_diff", "cell_impact", "impact_ratchet", "instants_fingerprint"),
    ("docs", "sync"): docs_sync,
    ("docs", "audit"): queries("doc_audit", "coverage_gaps", "periodic_gaps", "stale_reports", "missing_filings"),
    ("evidence", "index"): queries("token_counts", "document_frequency", "index_mismatch"),
    ("evidence", "search"): evidence_search,
    ("evidence", "validate"): queries("citation_validate"),
    ("scan", "bx"): queries("momentum_scan"),
    ("replay", "run"): queries("account_replay"),
    ("replay", "report"): replay_report,
    ("replay", "compare"): queries("pair_runs", "calibration_bins", "beside_base"),
    ("judge", "run"): queries("take_all", "entry_order", "answer_keys"),
    ("benchmark", "curves"): queries("buy_and_hold", "basket_curve", "curve_metrics"),
    ("gate", "null"): queries("null_returns", "max_statistic"),
    ("gate", "entry"): queries("entry_test"),
    ("gate", "diagnose"): queries("flip_stats", "rank_tertiles", "reentry_flags", "pool_excess"),
    ("gate", "report"): gate_report,
    ("gate", "compare"): queries("best_run", "sharpe_error", "equity_slices"),
    ("demo", "build"): queries("cited_spans", "document_timeline", "realized_curve", "parameter_grid"),
}
