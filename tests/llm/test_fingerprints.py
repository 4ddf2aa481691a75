import collections
import hashlib

from pyspark.sql import functions as F

from kairoframe.llm import fingerprints as fp


def likeness(a, b):
    return sum(a[4 * i : 4 * i + 4] == b[4 * i : 4 * i + 4] for i in range(fp.K)) / fp.K


def test_collision_rate_is_generalised_jaccard(spark):
    """Many pairs of known similarity: the mean likeness is within four standard errors of it."""
    rows, want = [], []
    for i in range(60):
        a = collections.Counter({f"w{i}_{k}": 1 + k % 4 for k in range(40)})
        b = collections.Counter({f"w{i}_{k}": 1 + k % 3 for k in range(20, 60)})
        want.append(sum((a & b).values()) / sum((a | b).values()))
        rows += [(2 * i, " ".join(a.elements())), (2 * i + 1, " ".join(b.elements()))]
    got = {r["id"]: r["fingerprint"] for r in fp.fingerprints(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    found = [likeness(got[2 * i], got[2 * i + 1]) for i in range(60)]
    assert abs(sum(found) / 60 - sum(want) / 60) < 4 * (0.25 / (60 * fp.K)) ** 0.5


def test_samples_are_64_and_exact(spark):
    """a of a term of weight 1 is c exp(-r (1 - b)) with r and c from Gamma(2, 1): its mean over terms, and as many values as terms."""
    import random

    rng = random.Random(3)
    want = sum((rng.gammavariate(2, 1) * 2.718281828459045 ** (-rng.gammavariate(2, 1) * (1 - rng.random())) for _ in range(200_000))) / 200_000
    terms = spark.range(20_000).select(F.xxhash64("id").alias("term"))
    for k in (0, 63):
        r = terms.select(fp.sample(F.col("term"), F.lit(0.0), k).alias("a")).agg(F.avg("a").alias("mean"), F.countDistinct("a").alias("n")).first()
        assert abs(r["mean"] - want) < 0.05 and r["n"] == 20_000
    got = fp.fingerprints(spark.createDataFrame([(1, "some words")], "id long, text string"), "id", "text").first()["fingerprint"]
    assert fp.K == 64 and len(got) == 4 * 64


def test_shift_is_not_stepped(spark):
    """The ratio of a at two weights is exp(-r (t' - t)): over many terms it takes many values, not those of a table of r."""
    terms = spark.range(5_000).select(F.xxhash64("id").alias("term"))
    ratio = F.round(F.log(fp.sample(F.col("term"), F.lit(0.0), 1) / fp.sample(F.col("term"), F.log(F.lit(50.0)), 1)), 6)
    assert terms.select(ratio.alias("x")).distinct().count() > 3_000


def test_query_matches_brute_force(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.op2(spark, str(tmp_path)).collect()
    assert len(got) == odd.count()
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    want = collections.Counter()
    for i, (doc_id, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_empty_table(spark, tmp_path, none):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert fp.op2(spark, str(tmp_path)).count() == 0


def test_ranges_cover_every_id(spark):
    df = spark.range(-50, 1000).select(F.col("id").alias("doc_id"))
    bounds = list(range(0, 900, 7))
    got = df.select("doc_id", fp._range_of(F.col("doc_id"), bounds).alias("p")).collect()
    assert all(r["p"] == sum(b <= r["doc_id"] for b in bounds) for r in got)


def test_heavier_terms_win_in_proportion(spark):
    """Of two terms with weights w and 1 the first has the least a with probability w / (w + 1)."""
    pairs = spark.range(40_000).select(F.xxhash64("id", F.lit(1)).alias("x"), F.xxhash64("id", F.lit(2)).alias("y"))
    for w in (2.0, 7.0, 30.5):
        share = pairs.select((fp.sample(F.col("x"), F.log(F.lit(w)), 5) < fp.sample(F.col("y"), F.lit(0.0), 5)).cast("double").alias("won")).agg(F.avg("won")).first()[0]
        assert abs(share - w / (w + 1)) < 0.01


def test_same_t_is_the_same_sample(spark):
    """Weights that reach the same t, 1 among them, give the same 16 bits: no rounding comes between them."""
    both = spark.range(20_000).select(F.xxhash64("id").alias("term"))
    one, two = (fp.closeness(F.col("term"), F.log(F.lit(w)), 9) for w in (1.0, 1.25))
    got = both.select((F.abs(one - two) < 1e-12).alias("near"), (fp.signature_text([one]) == fp.signature_text([two])).alias("same")).filter("near")
    assert 14_000 < got.count() and got.filter("not same").count() == 0


def test_plan_is_small(spark):
    """No tables in the plan, which the driver holds many times over."""
    terms = spark.range(5).select("id", F.xxhash64("id").alias("term"), F.lit(2).alias("weight"))
    assert len(fp.signatures(terms, ["id"])._jdf.queryExecution().optimizedPlan().toString()) < 50_000
