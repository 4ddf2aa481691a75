"""Document fingerprints by consistent weighted sampling (native: DataFrame functions only).

A document is a weighted set: its words (ASCII letters lower-cased) with their counts as weights. For a
term of weight w and sample k, with r and c from Gamma(2, 1) and b uniform, all three fixed by (term, k),

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1)

and the k-th sample is the term with the least ln a. Two documents choose the same (term, t) with
probability sum(min weights) / sum(max weights), the generalised Jaccard similarity. ln a identifies
(term, t), so its hash is what the signature keeps: K hashes of 16 bits, as hexadecimal text.

r, b and c come from four uniform numbers by identities of the Gamma distribution: r (1 - b) and r b are independent
Exp(1), and so are c exp(-r (1 - b)) and the rest of c. So with uniform x, y and v, hashed from (term, k),

    u = ln x / (ln x + ln y),    r = -ln(u v),    r b = -ln v,    a = -ln x exp(-r t)

is the same draw, continuous and without tables, and a = -ln x where the weight is 1 (t = 0). Only the order of the a
counts, so exp(-a) is compared: x itself, one hash, for terms that occur once. r t is q - q mod r with q = ln w - ln v.
It all stays in generated code. exp(-a) is kept to 36 bits for the hash, lest rounding tell apart what is equal (x
lies in the middle of a cell of 2 ** -44).

Data flow: the text is shuffled once, by ranges of doc_id. The order (descending doc_id), the term counts
and the K minima are all computed inside those ranges, without another exchange. Range bounds are at most
`MAX_RANGES` numbers on the driver; the first row of each range is joined to the range before it.

Edge cases: a null text counts as empty; texts without words share one fingerprint (all zero samples) and
have likeness 1 with each other; repeated doc_ids are ordered by a hash of the text; a null doc_id comes
last; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, partitions, table, whole

K = 64
#: Bits of x, and of exp(-a) as the signature keeps it.
BITS, KEPT = 44, 36
MAX_RANGES = 1024
#: Characters of text to a partition, and ranges to a partition, so that partitions come out even.
CHARS, RANGES = 3_000_000, 3


def closeness(term: Column, log_weight: Column, k: int) -> Column:
    """exp(-a) of one sample, between 0 and 1; term is a 64-bit hash."""
    middle = lambda x, n: (x.cast("double") + F.lit(0.5)) * F.lit(2.0**-n)  # noqa: E731  of the interval that the bits stand for
    more = F.xxhash64(term, F.lit(-1 - k))
    x = middle(F.shiftrightunsigned(F.xxhash64(term, F.lit(k)), 64 - BITS), BITS)
    y, v = middle(more.bitwiseAND(F.lit(0xFFFFFFFF)), 32), middle(F.shiftrightunsigned(more, 32), 32)
    r = -F.log(v / (F.lit(1.0) + F.log(y) / F.log(x)))
    # exp(-r t) = exp(q mod r) exp(-q), and exp(-q) = v / w; t is 0 where the weight is 1, as b < 1; most terms occur once.
    shrunk = F.exp((log_weight - F.log(v)) % r) * v * F.exp(-log_weight)
    return F.when(log_weight == 0, x).otherwise(F.pow(x, shrunk))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """a of one sample."""
    return -F.log(closeness(term, log_weight, k))


def signatures(terms: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """terms: keys, term (64-bit hash), weight > 0 -> keys, fingerprint. One group by over the keys."""
    log_weight = F.log(F.col("weight").cast("double"))
    samples = terms.select(*keys, F.col("term"), log_weight.alias("lw"))
    least = samples.groupBy(*keys).agg(*[F.max(closeness(F.col("term"), F.col("lw"), i)).alias(f"z{i}") for i in range(k)])
    return least.select(*keys, signature_text([F.col(f"z{i}") for i in range(k)]).alias("fingerprint"))


def signature_text(samples: list[Column]) -> Column:
    kept = lambda z: F.floor(z * F.lit(2.0**KEPT))
    one = lambda z: F.lpad(F.lower(F.hex(F.xxhash64(kept(z)).bitwiseAND(F.lit(0xFFFF).cast("long")))), 4, "0")
    return F.concat(*[F.when(z.isNull(), F.lit("0000")).otherwise(one(z)) for z in samples])


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Share of the samples that agree."""
    agree = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(a, 4 * i + 1, F.lit(4)) == F.substring(b, 4 * i + 1, F.lit(4)))
    return F.size(agree).cast("double") / F.lit(float(k))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def weighted_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, weight: each distinct word of the text with its count. Rows must be one for each key."""
    terms = rows.select(*keys, F.explode(words(F.col(text))).alias("w")).select(*keys, F.xxhash64("w").alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))


def fingerprints(docs: DataFrame, key: str, text: str, k: int = K) -> DataFrame:
    """key, fingerprint for every row of docs; keys must be distinct."""
    rows = docs.select(key, whole(F.col(text)).alias("text"))
    signed = signatures(weighted_terms(rows, [key], "text"), [key], k)
    return rows.select(key).join(signed, key, "left").select(key, F.coalesce("fingerprint", F.lit("0000" * k)).alias("fingerprint"))


def _ranges(docs: DataFrame) -> tuple[list[int], int, int]:
    """Bounds of ranges of doc_id that hold about as many rows each, and numbers of partitions and characters."""
    spark = docs.sparkSession
    size = docs.agg(F.sum("n_chars").alias("chars"), F.percentile_approx("doc_id", [i / MAX_RANGES for i in range(1, MAX_RANGES)], 20000).alias("bounds")).first()
    n = partitions(spark, size["chars"] or 0, CHARS)
    bounds = sorted({int(x) for x in size["bounds"] or ()})
    step = max(1, len(bounds) // min(MAX_RANGES, RANGES * n))
    return bounds[::step], n, size["chars"] or 0


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are <= the id, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every = F.array(*[F.lit(x).cast("long") for x in bounds])
    coarse = F.array(*[F.lit(x).cast("long") for x in bounds[::step]])
    at = F.size(F.filter(coarse, lambda x: x <= doc_id)) - 1
    within = F.size(F.filter(F.slice(every, at * step + 1, F.lit(step)), lambda x: x <= doc_id))
    return F.when(doc_id.isNull() | (at < 0), 0).otherwise(at * step + within)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """part, rn, doc_id, text, next_text, is_last: each row with the text of the row that follows by descending doc_id."""
    slim = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    bounds, n, _ = _ranges(slim)
    part = _range_of(F.col("doc_id"), bounds)
    used = sorted(r["part"] for r in slim.select(part.alias("part")).distinct().collect())
    unplaced = docs.select(part.alias("part"), "doc_id", whole(F.col("text")).alias("text"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    rows = unplaced.repartition(n, "part").select("part", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("lead_text"))
    if not used:
        return rows.select("part", "rn", "doc_id", "text", F.col("lead_text").alias("next_text"), F.lit(True).alias("is_last")), n
    before = {used[i]: used[(i + 1) % len(used)] for i in range(len(used))}  # the head of a range follows the range above it
    target = F.create_map(*[F.lit(x).cast("int") for pair in before.items() for x in pair])
    # Not from the exchange above: here each task keeps one row of a range, before anything is shuffled.
    heads = unplaced.withColumn("at", F.row_number().over(order)).filter("at = 1").select(F.element_at(target, F.col("part")).alias("part"), F.col("text").alias("head_text"))
    both = rows.join(heads.hint("shuffle_hash"), "part", "left")
    return both.select("part", "rn", "doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text"), F.col("lead_text").isNull().alias("is_last")), n


def edited_text(text: Column, following: Column) -> Column:
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, _ = with_next(docs)
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    variant = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("t"))
    kinds = F.when(F.col("is_last"), F.array(variant(0, F.col("text")), variant(1, F.col("edited")), variant(2, F.col("next_text")))).otherwise(F.array(variant(0, F.col("text")), variant(1, F.col("edited"))))
    texts = rows.select("part", "rn", F.inline(kinds))
    signed = signatures(weighted_terms(texts, ["part", "rn", "side"], "t"), ["part", "rn", "side"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("fingerprint")))
    signed = signed.groupBy("part", "rn").agg(*[of(i).alias(f"f{i}") for i in range(3)])
    none = F.lit("0000" * K)
    out = rows.select("part", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "is_last")
    out = out.join(signed, ["part", "rn"], "left").select("part", "rn", "doc_id", "n_chars", "edited_sha256", "is_last", *[F.coalesce(f"f{i}", none).alias(f"f{i}") for i in range(3)])
    after = F.lead("f0").over(Window.partitionBy("part").orderBy("rn"))
    out = out.withColumn("following", F.when(F.col("is_last"), F.col("f2")).otherwise(after))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"), likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("following")).alias("near_next"))
