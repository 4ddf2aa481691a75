import re

from pyspark.sql import functions as F

from kairoframe.llm import secret_scan as ss

BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]
TEXTS = [
    "", None, "token=token: abcdef", 'my "api_key" : "abcDEF123" and SECRET=xx secret=yyyyyy', "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "é\U0001f600 " + "0123456789abcdef" * 2 + " token: aaaaaaaaaaaaaaaaaaaaaaaaa",
    "password = hunter22\n" * 300, "AKIAAKIA" + "Z" * 12, "deadbeef" * 3, "token == abcdefg",
]


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n)
    return ",".join(f"{BASE[k][0]}:{a}:{z}" for a, k, z in spans)


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "path long, text string")
    found, _ = ss.scan(df, ss.empty_ledger(spark))
    got = {r["path"]: r["s"] for r in found.select("path", ss.span_text(F.filter("found", lambda x: x["kind"] < 3)).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_ledger_scans_only_unseen_pairs(spark):
    old = spark.createDataFrame([("a", "token=abcdef"), ("b", "clean")], "path string, text string")
    _, ledger = ss.scan(old, ss.empty_ledger(spark))
    ledger = spark.createDataFrame(ledger.collect(), ss.LEDGER)
    new = old.unionByName(spark.createDataFrame([("c", "token=abcdef"), ("d", "secret: 123456789"), ("a", "clean")], "path string, text string"))
    found, fresh = ss.scan(new, ledger)
    assert fresh.count() == 1  # only the text of d
    got = sorted((r["path"], r["s"]) for r in found.select("path", ss.span_text(F.col("found")).alias("s")).collect())
    assert got == [("a", ""), ("a", "assign:0:12"), ("b", ""), ("c", "assign:0:12"), ("d", "assign:0:17")]
    _, again = ss.scan(new, ledger, version="rules-2")
    assert again.count() == 3  # a new rule version sees every blob


def test_odd_rows(spark, tmp_path, odd, none):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert ss.op6(spark, str(tmp_path)).count() == odd.count()
    none.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert ss.op6(spark, f"{tmp_path}/e").count() == 0
