"""Markdown reports from the small tables that queries end in. A report's rows are as many as its runs, reasons or cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(value: object) -> str:
    if value is None:
        return "n/a"
    return f"{value:,.4g}" if isinstance(value, float) else str(value).replace("|", "\\|")


def as_table(df: DataFrame, order: Sequence[str] = ()) -> str:
    """A Markdown table of all rows, in order."""
    rows = (df.orderBy(*order) if order else df).collect()
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join(map(shown, r)) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines)


def section(title: str, body: str) -> str:
    return f"## {title}\n\n{body}\n"


def replay_report(sales: DataFrame, marks: DataFrame) -> str:
    """Legs by reason, the best and worst of them, excursions and spin-offs of replayed runs (replay.replayed)."""
    won = F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")
    runs = sales.groupBy("run_id").agg(F.count(F.lit(1)).alias("legs"), F.sum("pnl").alias("pnl"), won, F.avg("r_multiple").alias("mean_r"), F.expr("percentile(mae_pct, 0.5)").alias("median_mae"), F.expr("percentile(mfe_pct, 0.5)").alias("median_mfe"))
    reasons = sales.groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("legs"), F.sum("pnl").alias("pnl"))
    largest = sales.orderBy(F.desc(F.abs("pnl")), "security_id", "day").limit(10).select("run_id", "security_id", "day", "reason", "pnl", "r_multiple")
    held = sales.filter("spinoff is not null").groupBy("run_id", "spinoff").agg(F.count(F.lit(1)).alias("legs"), F.sum("child_proceeds").alias("child_proceeds"))
    last = marks.groupBy("run_id").agg(F.count(F.lit(1)).alias("sessions"), F.max_by("equity", "day").alias("equity"), F.max(F.col("gross") / F.col("equity")).alias("most_invested"))
    parts = [("Runs", as_table(runs, ["run_id"])), ("Accounts", as_table(last, ["run_id"])), ("Exits", as_table(reasons, ["run_id", "reason"])), ("Largest legs", as_table(largest)), ("Spin-offs", as_table(held, ["run_id", "spinoff"]))]
    return "# Replay\n\n" + "\n".join(section(*p) for p in parts)


def gate_report(family: DataFrame, alpha: float, attempts: int, budget: int) -> str:
    """What a family of variants proves: each one's excess and corrected p-value, and the verdict at a level."""
    rows = family.withColumn("verdict", F.when(F.col("p_adjusted") <= alpha, "beats random entries").otherwise("not shown"))
    note = f"{attempts} of {budget} attempts are used" + ("; the budget is spent" if attempts >= budget else "")
    return "# Gate\n\n" + section("Variants", as_table(rows, ["variant"])) + section("Attempts", note)
