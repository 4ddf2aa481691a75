"""Strategies, protocols, watchlists and reviewed exceptions: strict readers and append-only records."""

from __future__ import annotations

import copy
import datetime
import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("company", "fund", "index", "crypto")
EXCEPTION_FIELDS = ("key", "reason", "added", "by")
EXCEPTION_KEY = re.compile(r"[A-Z0-9.\-]+:(earnings|periodic|periodic-(gap|stale):\d{4}-\d{2}-\d{2})")


def read_yaml(text: str) -> Any:
    """A YAML document; JSON, which is YAML too, needs no library."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def split_override(override: str) -> tuple[list[str], Any]:
    path, equals, value = override.partition("=")
    keys = path.strip().split(".")
    if not equals or len(keys) < 2 or not all(keys):
        raise ValueError(f"{override!r}: write section.setting=value")
    return keys, read_yaml(value) if value.strip() else None


def overridden(config: Mapping[str, Any], overrides: Sequence[str]) -> dict[str, Any]:
    """A configuration with settings replaced; a setting must exist, and keeps its kind of number."""
    out = copy.deepcopy(dict(config))
    for override in overrides:
        keys, value = split_override(override)
        node = out
        for k in keys[:-1]:
            if not isinstance(node.get(k), dict):
                raise ValueError(f"{override!r}: no section {k!r}")
            node = node[k]
        if keys[-1] not in node:
            raise ValueError(f"{override!r}: no setting {keys[-1]!r}")
        old = node[keys[-1]]
        if isinstance(old, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        node[keys[-1]] = value
    return out


def canonical_overrides(config: Mapping[str, Any], overrides: Sequence[str]) -> list[tuple[str, Any]]:
    """Each overridden path with its typed value, sorted: '=1' and '=1.0' of a real setting are one set."""
    made, out = overridden(config, overrides), {}
    for keys, _ in map(split_override, overrides):
        node: Any = made
        for k in keys:
            node = node[k]
        out[".".join(keys)] = node
    return sorted(out.items())


def summary_of(pairs: Sequence[tuple[str, Any]]) -> str:
    return ", ".join(f"{k}={v}" for k, v in pairs)


def overrides_of_summary(summary: str | None) -> list[str]:
    """The overrides that a summary joins. A comma begins a new one only where a dotted path and '=' follow; None is null."""
    out = []
    for part in re.split(r", (?=[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+=)", summary or ""):
        path, equals, value = part.partition("=")
        if equals:
            out.append(f"{path}={'null' if value == 'None' else re.sub(r'([{\[,:]\s*)None(?=\s*[,}\]])', r'\1null', value)}")
    return out


def strategy_hash(files: Mapping[str, bytes], overrides: Sequence[tuple[str, Any]] = ()) -> str:
    """SHA-256 over names and bytes of a strategy's files, in their order, and the canonical overrides."""
    digest = hashlib.sha256()
    for name, body in files.items():
        digest.update(name.encode() + b"\0" + body + b"\0")
    if overrides:
        digest.update(json.dumps(list(overrides), sort_keys=True).encode())
    return digest.hexdigest()


def strategy_hashes(files: DataFrame) -> DataFrame:
    """strategy_id, content_hash for rows (strategy_id, name, body (binary)), files in order of name."""
    part = F.concat(F.encode("name", "UTF-8"), F.lit(b"\0"), F.col("body"), F.lit(b"\0"))
    rows = files.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("name", part.alias("p")))).alias("all"))
    return rows.select("strategy_id", F.sha2(F.aggregate(F.transform("all", lambda x: x["p"]), F.lit(b""), lambda a, x: F.concat(a, x)), 256).alias("content_hash"))


VERSIONS = "strategy_id string, content_hash string, parent_hash string, status string, proposed_by string, registered_at timestamp, change_kind string, summary string"


def registered(versions: DataFrame, strategy_id: str, base_hash: str, own_hash: str, summary: str | None, proposed_by: str, now: datetime.datetime) -> DataFrame:
    """versions with the rows of a parameter set that are missing: the committed base first, then the set as its child.

    The first version of a strategy is approved by being registered; later ones are proposals.
    """
    own = {(r["content_hash"], r["status"]) for r in versions.filter(F.col("strategy_id") == strategy_id).select("content_hash", "status").collect()}  # one strategy's versions
    known, approved, more = {h for h, _ in own}, [h for h, s in own if s == "approved"], []
    if base_hash not in known:
        first = not approved
        more.append((strategy_id, base_hash, None if first else max(approved), "approved" if first else "proposed", proposed_by, now, "new_strategy" if first else "config", None))
    if own_hash != base_hash and own_hash not in known:
        more.append((strategy_id, own_hash, base_hash, "proposed", proposed_by, now, "config", summary))
    return versions.unionByName(versions.sparkSession.createDataFrame(more, VERSIONS)) if more else versions


def replay_counts(runs: DataFrame) -> DataFrame:
    """strategy_id, replays: replay runs of any parameter set and window."""
    return runs.groupBy("strategy_id").agg(F.count_if(F.col("mode") == "replay").alias("replays"))


def _date(x: Any) -> datetime.date:
    return x if isinstance(x, datetime.date) else datetime.date.fromisoformat(x)


@dataclass(frozen=True)
class Window:
    start: datetime.date
    end: datetime.date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"window ends {self.end} before it starts {self.start}")

    @classmethod
    def of(cls, raw: Mapping) -> Window:
        if set(raw) != {"start", "end"}:
            raise ValueError(f"a window has a start and an end, not {sorted(raw)}")
        return cls(_date(raw["start"]), _date(raw["end"]))


@dataclass(frozen=True)
class Protocol:
    """How variants are judged: development and sealed dates, budgets and levels. Unknown settings are an error."""

    dev: Window
    holdout: Window
    clean_after: datetime.date
    attempt_budget: int
    alpha: float
    permutations: int
    walk_forward: Mapping[str, int]
    thin_edge: Mapping[str, float]
    benchmarks: Mapping[str, Any]
    comparison: Mapping[str, float]
    mde_power: float
    seen_before_protocol: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        rules = {
            "dev ends before the holdout starts": self.dev.end < self.holdout.start,
            "clean_after comes after the holdout": self.clean_after > self.holdout.end,
            "attempt_budget is at least 1": self.attempt_budget >= 1,
            "alpha is inside (0, 1)": 0 < self.alpha < 1,
            "mde_power is inside (0, 1)": 0 < self.mde_power < 1,
            "permutations are at least 100": self.permutations >= 100,
            "benchmarks name a symbol": bool(self.benchmarks.get("symbols")),
            "walk_forward has months and a least number of windows": set(self.walk_forward) == {"train_months", "test_months", "min_positive"} and min(self.walk_forward.values()) >= 1,
        }
        broken = [rule for rule, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))

    def from_date(self, start: datetime.date) -> Protocol:
        """The same with development dates from start on; their end, and so the holdout, never moves."""
        if not self.dev.start <= start <= self.dev.end:
            raise ValueError(f"{start} is outside the development dates")
        return Protocol(**{f.name: getattr(self, f.name) for f in fields(self)} | {"dev": Window(start, self.dev.end)})


def load_protocol(text: str) -> Protocol:
    raw = read_yaml(text)
    names = {f.name for f in fields(Protocol)}
    if not isinstance(raw, dict) or not set(raw) <= names or not names - {"seen_before_protocol"} <= set(raw):
        raise ValueError(f"a protocol has {sorted(names)}")
    return Protocol(**raw | {"dev": Window.of(raw["dev"]), "holdout": Window.of(raw["holdout"]), "clean_after": _date(raw["clean_after"])})


OPENINGS = "strategy_id string, content_hash string, run_id long, window_start date, window_end date, opened_at timestamp"


def may_open(openings: DataFrame, protocol: Protocol, strategy_id: str, start: datetime.date, end: datetime.date, opened: bool) -> bool:
    """Whether dates reach the sealed holdout; an error unless they may (asked for, and not opened before)."""
    if end < protocol.holdout.start or start > protocol.holdout.end:
        return False
    if not opened:
        raise PermissionError(f"{start} .. {end} reaches the sealed holdout; a strategy may open it once")
    if openings.filter(F.col("strategy_id") == strategy_id).take(1):
        raise PermissionError(f"{strategy_id} has opened the holdout already")
    return True


def with_opening(openings: DataFrame, strategy_id: str, content_hash: str, run_id: int | None, window: Window, now: datetime.datetime) -> DataFrame:
    return openings.unionByName(openings.sparkSession.createDataFrame([(strategy_id, content_hash, run_id, window.start, window.end, now)], OPENINGS))


def parallel_map(spark: SparkSession, run: Callable[[Any, Any], Any], context: Any, units: Sequence[Any]) -> list[Any]:
    """run(context, unit) for each unit, in their order, as tasks of the cluster; the context is broadcast once."""
    if not units:
        return []
    shared = spark.sparkContext.broadcast(context)
    try:
        return spark.sparkContext.parallelize(list(units), len(units)).map(lambda u: run(shared.value, u)).collect()
    finally:
        shared.unpersist()


WATCHLIST = "ticker string, kind string, `group` string, added date, name string, note string, cik long"


def load_watchlist(text: str) -> list[tuple]:
    """(ticker, kind, group, added, name, note, cik) in order; kind and added fall back from the item to its group."""
    raw = read_yaml(text)
    groups = raw.get("groups") if isinstance(raw, dict) else None
    if not groups:
        raise ValueError("no groups")
    out: dict[str, tuple] = {}
    for group in groups:
        if not isinstance(group, dict) or not isinstance(group.get("id"), str):
            raise ValueError("every group needs an id")
        for item in group.get("items") or []:
            if not isinstance(item, dict) or not isinstance(item.get("ticker"), str):
                raise ValueError(f"item {item!r} of {group['id']} needs a quoted ticker")
            ticker = item["ticker"].upper()
            kind, added = (item.get(c, group.get(c)) for c in ("kind", "added"))
            if ticker in out:
                raise ValueError(f"duplicate ticker {ticker}")
            if kind not in KINDS or added is None:
                raise ValueError(f"{ticker} needs a known kind and a day")
            out[ticker] = (ticker, kind, group["id"], _date(added), item.get("name"), item.get("note"), item.get("cik"))
    return list(out.values())


def resolved_watchlist(items: DataFrame, companies: DataFrame, funds: DataFrame) -> DataFrame:
    """ticker, kind, name, cik, series_id, outcome ('entity', 'missing', 'unmatched', 'conflict').

    companies: ticker, cik, name (one each); funds: ticker, cik, series_id, name. A coin never takes a fund's identity; a
    company needs its filer; a ticker of several registrants, or of another filer than the item says, is a conflict.
    """
    c = companies.select(F.col("ticker").alias("_t"), F.col("cik").alias("_cc"), F.col("name").alias("_cn"))
    f = funds.select(F.col("ticker").alias("_u"), F.col("cik").alias("_fc"), F.col("series_id").alias("_fs"), F.col("name").alias("_fn")).distinct()
    rows = items.join(c, F.col("ticker") == F.col("_t"), "left")
    said = items.select("ticker", F.col("cik").alias("_said")).join(f, (F.col("ticker") == F.col("_u")) & (F.col("_said").isNull() | (F.col("_said") == F.col("_fc"))), "left")
    one = said.groupBy("ticker").agg(F.count("_u").alias("_many"), F.min(F.struct("_fc", "_fs", "_fn")).alias("_f"))
    other = f.groupBy(F.col("_u").alias("ticker")).agg(F.count(F.lit(1)).alias("_listed"))
    rows = rows.join(one, "ticker", "left").join(other, "ticker", "left")
    company, coin = F.col("kind") == "company", F.col("kind") == "crypto"
    differs = F.col("cik").isNotNull() & (F.col("cik") != F.col("_cc"))
    conflict = F.when(company, differs).otherwise(~coin & ((F.col("_many") > 1) | ((F.col("_many") == 0) & (F.coalesce("_listed", F.lit(0)) > 0))))
    outcome = (
        F.when(coin, "entity").when(company & F.col("_cc").isNull(), "missing").when(F.coalesce(conflict, F.lit(False)), "conflict")
        .when(company | (F.col("_many") == 1), "entity").otherwise("unmatched")
    )
    name = F.when(coin, F.coalesce("name", "ticker")).when(company, F.coalesce("_cn", "name", "ticker")).otherwise(F.coalesce("_f._fn", "name", "note", "ticker"))
    made = rows.withColumn("outcome", outcome)
    ok = F.col("outcome") == "entity"
    return made.select(
        "ticker", "kind", name.alias("name"), F.when(ok & company, F.col("_cc")).when(ok & ~coin, F.col("_f._fc")).alias("cik"),
        F.when(ok & ~coin & ~company, F.col("_f._fs")).alias("series_id"), "outcome",
    )


def load_exceptions(text: str) -> dict[str, str]:
    """Reviewed gaps, key to reason; every entry has exactly the four fields, none of them empty."""
    out: dict[str, str] = {}
    for item in read_yaml(text) or [] if text.strip() else []:
        if not isinstance(item, dict) or set(item) != set(EXCEPTION_FIELDS) or any(not str(item[k] if item[k] is not None else "").strip() for k in EXCEPTION_FIELDS):
            raise ValueError(f"entry {item!r} must have {EXCEPTION_FIELDS}, each filled")
        _date(item["added"])
        if not EXCEPTION_KEY.fullmatch(str(item["key"])):
            raise ValueError(f"entry {item!r}: a key looks like TICKER:earnings")
        out[str(item["key"])] = str(item["reason"])
    return out


def load_instants(text: str) -> list[datetime.datetime]:
    """Instants to check, one a line with its offset, '#' for comments; sorted, in UTC, none twice."""
    out: set[datetime.datetime] = set()
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            at = datetime.datetime.fromisoformat(line)
            if at.tzinfo is None:
                raise ValueError(f"{line!r} has no offset")
            at = at.astimezone(datetime.UTC)
            if at in out:
                raise ValueError(f"{line!r} is there twice")
            out.add(at)
    return sorted(out)
