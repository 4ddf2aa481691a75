"""Secret scans with an incremental blob ledger (native: DataFrame functions only).

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds one row for each
(blob, rule set version) that was scanned, with what was found. A scan

1. lists the distinct blobs of the versions (ids only, pre-aggregated before the shuffle),
2. drops the (blob, rule version) pairs that the ledger has,
3. reads the text of one version of each remaining blob and applies the rules to it,
4. joins the findings of all blobs back to every path and version that holds them.

A text that a third of all paths share is scanned once; joining back is salted, as its paths are many.

Positions are code points, ends exclusive. Spark has no function that returns the positions of all
matches, so they are summed from the lengths of the matches (regexp_extract_all) and of what lies between
them (split by the same pattern): both use the same leftmost non-overlapping search.

Base rules: assign, access and hex. The ledger's rule set adds kinds of its own (key blocks, JSON web
tokens, platform tokens); their spans come after the base ones at the same start.

Edge cases: a null text counts as empty and has no spans; repeated rows and repeated ids each get their
row; a null id is an id like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, whole

# Kind, pattern, group whose length counts (0: the match), least length, cheap test that a text can match.
BASE_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
]
MORE_RULES = [
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ"),
    ("platform", r"(?:ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp)[_-][A-Za-z0-9_-]{20,}", 0, 1, r"(?:ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp)[_-][A-Za-z0-9_-]{20}"),
]
RULES = BASE_RULES + MORE_RULES
VERSION = "rules-1"
SALTS = 16

SPANS = "array<struct<start:int,kind:int,stop:int>>"
SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "kind", "stop")])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("version", T.StringType()), T.StructField("found", T.ArrayType(SPAN))])


def matches(text: Column, kind: int, rule: tuple) -> Column:
    """Array of (start, kind, stop) for one rule, ascending; failing matches are dropped."""
    _, pattern, group, least, guard = rule
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), counted.alias("part"))
    none = F.lit(None).cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast(SPANS)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(guard), spans).otherwise(F.array().cast(SPANS))


def spans_of(text: Column, rules: list[tuple] = RULES) -> Column:
    """All spans, by start, then kind as listed."""
    return F.array_sort(F.concat(*[matches(text, i, r) for i, r in enumerate(rules)]))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame, rules: list[tuple] = RULES, version: str = VERSION, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by path: path, blob, found; new ledger rows: blob, version, found). Only unseen pairs are scanned."""
    texts = versions.select(F.col(path).alias("path"), whole(F.col(text)).alias("text"))
    held = texts.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("blob"))
    known = ledger.filter(F.col("version") == version).select("blob", "found")
    unseen = held.groupBy("blob").agg(F.min("path").alias("rep")).join(known.select("blob"), "blob", "left_anti")
    read = texts.select(F.col("path").alias("rep_path"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("rep_blob"))
    chosen = read.join(unseen, F.col("rep_path").eqNullSafe(F.col("rep")) & (F.col("rep_blob") == F.col("blob")), "inner")
    scanned = chosen.select("blob", spans_of(F.col("text"), rules).alias("found"))
    fresh = scanned.groupBy("blob").agg(F.first("found").alias("found"))  # repeated rows of one version
    known_found = known.unionByName(fresh).filter(F.size("found") > 0)
    salted = known_found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = held.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    findings = paths.join(salted, ["blob", "salt"], "left").select("path", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))
    return findings, fresh.select("blob", F.lit(version).alias("version"), "found")


def span_text(found: Column, rules: list[tuple] = RULES) -> Column:
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), empty_ledger(spark), path="doc_id")
    base = F.filter("found", lambda x: x["kind"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return findings.select(F.col("path").alias("doc_id"), *[count(i).alias(f"n_{r[0]}") for i, r in enumerate(BASE_RULES)], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))
