"""Decisions in order, and what is shown of them: quotes, chunks, timelines, runs beside their base run."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reasons of exits that fill at the next open, bins of conviction, finish reasons of a refusal.
OPEN_FILLS = ("hard_gap", "break", "observe_timeout", "max_sessions")
BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0))


def one_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def entry_order(outcomes: DataFrame) -> DataFrame:
    """The takes of each session with their place: most convinced first, then by security."""
    takes = outcomes.filter("verdict = 'take'")
    place = F.row_number().over(Window.partitionBy("session_date").orderBy(F.coalesce("conviction", F.lit(0.0)).desc(), "security_id"))
    return takes.withColumn("place", place.cast("long"))


def take_all(candidates: DataFrame) -> DataFrame:
    """Every candidate of each session is taken, by security and entity."""
    place = F.row_number().over(Window.partitionBy("session_date").orderBy("security_id", "entity_id"))
    return candidates.withColumn("verdict", F.lit("take")).withColumn("place", place.cast("long"))


def conviction_bin(conviction: Column) -> Column:
    """Which bin a conviction falls in; bins are half open, the last one closed; outside of all: null."""
    out = F.when(conviction == BINS[-1][1], F.lit(len(BINS) - 1))
    for i, (low, high) in enumerate(BINS):
        out = out.when((conviction >= low) & (conviction < high), F.lit(i))
    return out.cast("long")


def fill_time(day: Column, reason: Column) -> Column:
    """When a daily bar's fill happened, as UTC: at the 09:30 open, at 16:00 for a stop inside the day, else at 20:00."""
    hours = F.when(reason.isin(*OPEN_FILLS), F.expr("interval 570 minutes")).when(reason == "hard", F.expr("interval 960 minutes")).otherwise(F.expr("interval 1200 minutes"))
    return F.to_utc_timestamp(day.cast("timestamp") + hours, "America/New_York")


def spinoff_legs(trades: DataFrame, run: str) -> DataFrame:
    """run, adjusted, restarted, child_proceeds of legs held through a spin-off."""
    held = trades.filter("spinoff is not null")
    return held.groupBy(run).agg(F.count_if(F.col("spinoff") == "adjust").alias("adjusted"), F.count_if(F.col("spinoff") == "restart").alias("restarted"), F.sum(F.coalesce("child_proceeds", F.lit(0.0))).alias("child_proceeds"))


def span_of(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """Where a quote is in a text, as it stands or with any white space for its spaces."""
    words = (quote or "").split()
    if text is None or not words:
        return None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote)
    found = re.search(r"\s+".join(map(re.escape, words)), text)
    return found.span() if found else None


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.LongType())]))
def quote_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [span_of(t, q) or (None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame(found, columns=["a", "z"]).astype("Int64")


def cited_chunks(chunks: DataFrame, quotes: DataFrame) -> DataFrame:
    """chunk_id, document_id, section_path, text, spans of the quotes (chunk_id, quote) in each cited chunk, sorted."""
    q = quotes.select(F.col("chunk_id").alias("_c"), "quote").distinct()
    rows = chunks.join(q, F.col("chunk_id") == F.col("_c")).withColumn("span", quote_span("text", "quote"))
    spans = F.array_sort(F.collect_set(F.when(F.col("span.a").isNotNull(), F.col("span"))))
    return rows.groupBy("chunk_id", "document_id", "section_path", "text").agg(spans.alias("spans"))


def timeline(docs: DataFrame, entities: DataFrame, start: Column, end: Column) -> DataFrame:
    """Documents of the entities that became public between two instants, both included, with their place in that order."""
    own = docs.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").filter((F.col("available_at") >= start) & (F.col("available_at") <= end))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("available_at", "id"))
    return own.select("id", "entity_id", "doc_type", "available_at", place.cast("long").alias("place"))


def beside_base(decisions: DataFrame, base: DataFrame) -> DataFrame:
    """decisions (security_id, as_of, r, ...) with base_r: what the base run made of the same candidate."""
    b = base.select(F.col("security_id").alias("_s"), F.col("as_of").alias("_a"), F.col("r").alias("base_r"))
    return decisions.join(b, (F.col("security_id") == F.col("_s")) & (F.col("as_of") == F.col("_a")), "left").drop("_s", "_a")


def run_export(runs: DataFrame, curve: DataFrame, metrics: DataFrame) -> DataFrame:
    """run_id, its metrics, and its curve as an array of (session_date, equity): a row a run, as long as its sessions."""
    points = curve.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("session_date", "equity"))).alias("curve"))
    return runs.join(metrics, "run_id", "left").join(points, "run_id", "left")


def request_body(model: str, messages: Sequence[dict], schema: dict, effort: str, provider: str, most: int) -> dict:
    """The body of one judgement: a strict answer schema, one provider, no fallbacks."""
    answer = {"type": "json_schema", "json_schema": {"name": "judgement", "strict": True, "schema": schema}}
    only = {"order": [provider], "allow_fallbacks": False, "require_parameters": True}
    return {"model": model, "messages": [dict(m) for m in messages], "response_format": answer, "reasoning": {"effort": effort}, "provider": only, "max_tokens": most, "usage": {"include": True}}
