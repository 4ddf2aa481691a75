"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one on blocks of documents labelled good, one on blocks of documents labelled
bad. A text is cut into blocks of `BLOCK` bytes, each compressed with either dictionary, and

    x = (bytes with the bad dictionary - bytes with the good one) / (their sum)

is the normalised difference of the compressed sizes. Text that repeats itself is small with either dictionary, so

    rate = ln((bytes with the good dictionary + 20) / (bytes of the text + 20))

goes with it. A logistic curve, fitted to labelled documents that the dictionaries have not seen and weighted to
the labels' own proportions, turns both into the score.

Fitting uses bounded samples of labelled rows (the bounds of this module): `DICT_DOCS` rows of each label for the
dictionaries, with their whole texts, and `CAL_DOCS` rows of each label for the curve. Scoring is one pass without a shuffle over whole texts.

Edge cases: a null text counts as empty, has x = rate = 0 and the score that the curve gives to them; labels that are
null are not learned from, several labels of one document count as their majority (a tie as good); without
labels of both kinds every score is the share of good ones (0.5 if there are none); repeated documents each
get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

BLOCK, LEVEL, DICT_BYTES = 512, 3, 65_536
DICT_DOCS, CAL_DOCS = 600, 3000


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty: none could be trained) and the curve 1 / (1 + exp(-(bias + slope x + rate_slope rate)))."""

    good: bytes
    bad: bytes
    bias: float
    slope: float
    rate_slope: float


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Sizer:
    """Compressed sizes of whole texts with either dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        def compressor(data: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=words, level=LEVEL)

        self.good, self.bad = compressor(good).compress, compressor(bad).compress

    def sizes(self, text: str) -> tuple[int, int]:
        parts = blocks(text)
        return sum(map(len, map(self.good, parts))), sum(map(len, map(self.bad, parts)))


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where the samples are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def curve(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Bias and slopes of a logistic curve by Newton's method, with a small ridge on the slopes."""
    middle, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(y)), (features - middle) / scale])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1e-9] + [1e-2] * features.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return [float(beta[0] - slopes @ middle), *map(float, slopes)]


def sizes_of(rows: DataFrame, good: bytes, bad: bytes, keep: list[str]) -> DataFrame:
    """keep, n_good, n_bad, n_bytes: compressed sizes and the size of the column text."""
    words = rows.sparkSession.sparkContext.broadcast((good, bad))
    slim = rows.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(*words.value)
        for batch in batches:
            found = [(*sizer.sizes(t.as_py() or ""), len(t.as_buffer()) if t.is_valid else 0) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], [*keep, "n_good", "n_bad", "n_bytes"])

    return slim.mapInArrow(run, ", ".join([f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep] + ["n_good long", "n_bad long", "n_bytes long"]))


def difference(n_good: Column, n_bad: Column) -> Column:
    return F.when(n_good + n_bad > 0, (n_bad - n_good) / (n_good + n_bad)).otherwise(0.0)


def rate(n_good: Column, n_bytes: Column) -> Column:
    return F.log((n_good + F.lit(20.0)) / (n_bytes + F.lit(20.0)))


def fit(docs: DataFrame, labels: DataFrame, dict_docs: int = DICT_DOCS, cal_docs: int = CAL_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, good (1 or 0), part (0: for the dictionaries, 1: for the curve)."""
    labels = labels.filter("good is not null and doc_id is not null").groupBy("doc_id", "part").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    counts = {(r["part"], r["good"]): r["count"] for r in labels.groupBy("part", "good").count().collect()}
    total = {g: counts.get((0, g), 0) + counts.get((1, g), 0) for g in (0, 1)}
    prior = total[1] / max(1, total[0] + total[1]) if total[0] + total[1] else 0.5
    flat = Model(b"", b"", math.log((prior + 1e-6) / (1 - prior + 1e-6)), 0.0, 0.0)
    if not all(counts.get((p, g)) for p in (0, 1) for g in (0, 1)):
        return flat
    order = [F.xxhash64("doc_id", F.lit("quality")), F.col("doc_id")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def sample(part: int, most: int) -> DataFrame:
        """good, text: at most `most` rows of each label. The ids, as many at most, are broadcast; an id may have any number of rows."""
        some = [labels.filter((F.col("part") == part) & (F.col("good") == g)).orderBy(*order).limit(most) for g in (0, 1)]
        rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
        return reduce(DataFrame.unionByName, [rows.filter(F.col("good") == g).orderBy(*order, F.xxhash64("text"), "text").limit(most).select("good", "text") for g in (0, 1)])

    samples = sorted((r["good"], r["text"]) for r in sample(0, dict_docs).collect())
    good, bad = (trained([b for kind, text in samples if kind == g for b in blocks(text)]) for g in (1, 0))
    if not good or not bad:
        return flat
    sized = sizes_of(sample(1, cal_docs), good, bad, ["good"]).select("good", difference(F.col("n_good"), F.col("n_bad")).alias("x"), rate(F.col("n_good"), F.col("n_bytes")).alias("rate")).toPandas()
    sized = sized.sort_values(["x", "rate", "good"])
    x, y = sized[["x", "rate"]].to_numpy(float), sized["good"].to_numpy(float)
    weight = np.where(y == 1, counts[1, 1] / max(1, (y == 1).sum()), counts[1, 0] / max(1, (y == 0).sum()))
    return Model(good, bad, *curve(x, y, weight / weight.mean()))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, predicted, n_good, n_bad, n_bytes for every row (text)."""
    if model.good:
        rows = sizes_of(docs, model.good, model.bad, list(keep))
    else:
        rows = docs.select(*keep, F.lit(0).cast("long").alias("n_good"), F.lit(0).cast("long").alias("n_bad"), F.lit(0).cast("long").alias("n_bytes"))
    x = F.lit(model.bias) + F.lit(model.slope) * difference(F.col("n_good"), F.col("n_bad")) + F.lit(model.rate_slope) * rate(F.col("n_good"), F.col("n_bytes"))
    x = F.least(F.lit(60.0), F.greatest(F.lit(-60.0), x))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"), (remainder == 2).cast("int").alias("part"), remainder.alias("r")).filter("r <> 1").drop("r")
    model = fit(docs, labels)
    return scored(docs, model).select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted", "n_good", "n_bad", "n_bytes")
