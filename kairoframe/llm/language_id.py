"""Language ID: unigram pieces of a fixed public vocabulary, summed over all segmentations.

For each language a distribution over the vocabulary's pieces is learned; a text's probability under a
language is the product over its words of the sum over all segmentations of the word (lattice.py). The
language of the highest probability is predicted.

Fitting uses a bounded sample: about `PER_LANG` documents of each language, chosen by a hash of id and text
(the one bound on what is learned); the least hash of a language is always in. Their words, of any length, are counted
on the executors and each language's distribution is re-estimated from the expected uses of each piece, starting from
the vocabulary's own order. The model is (pieces x languages) numbers, so its size depends on neither the corpus nor
the sample. Tasks hold the numbers of `LANGS` languages at a time: more languages take more passes, each of which keeps
the best language so far and the sum over all so far.

The score is the best language's share of the sum of all languages' probabilities, where the evidence of a text of
more than `EVIDENCE` words is scaled to that of so many (log probabilities times EVIDENCE / words): otherwise every
score of a longer text is 0 or 1. The scaling doesn't change which language is best.

Scoring is one pass for each block of languages, without a shuffle, over whole texts. A task keeps the scores of words
it has seen, up to `CACHE` numbers.

Edge cases: a null text, an empty one or one without a letter (Unicode category L) is `und` with score 0; a null
language is never learned; if no language can be learned all texts are `und`; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored. Ties go to the language first in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import TOKENIZERS, fold, stored, table

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
PER_LANG, ROUNDS, LANGS, CACHE = 600, 2, 64, 1_600_000
#: A text's evidence counts as that of so many words at most, lest every score be 0 or 1.
EVIDENCE = 12.0
UNKNOWN = "und"
#: A text whose best language scores less is rejected by `recognised`.
LEAST = 0.3
LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[bytes]:
    """ASCII letters lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fit(rows: DataFrame, vocabulary: str = VOCABULARY, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """rows: doc_id, text, lang, all to be learned from -> languages, (pieces, languages) log probabilities."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 11).cast("double") * F.lit(2.0**-53)
    rows = rows.select("lang", "text", chance.alias("_chance"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_chance").alias("_least"))
    counts = stored(counts.select(F.col("lang").alias("_lang"), "_least", (F.lit(float(per_lang)) / F.col("_n")).alias("_rate")), "languages")
    pieces = lattice.Pieces(vocabulary)
    sample = rows.join(counts, F.col("lang") == F.col("_lang")).filter("_chance < _rate or _chance = _least").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text.as_py()))
            flat = [(k, w.decode("utf-8", "replace"), n) for k, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        own = lattice.Pieces(vocabulary)
        logp, words, n = own.initial(), pdf["word"].tolist(), pdf["n"].to_numpy(float)
        for _ in range(ROUNDS):
            logp = lattice.reestimated(lattice.expected_counts(own, logp, words, n))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logp": [logp.tolist()]})

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = {r["lang"]: r["logp"] for r in counted.groupBy("lang").applyInPandas(estimate, "lang string, logp array<double>").collect()}
    langs = sorted(model)
    return langs, np.array([model[k] for k in langs]).T if langs else np.zeros((pieces.size, 0))


class Scorer:
    """Sums of log probabilities of texts, with a bounded memory of words."""

    def __init__(self, vocabulary: str, logp: np.ndarray) -> None:
        self.pieces, self.logp = lattice.Pieces(vocabulary), logp
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((1024, logp.shape[1]))

    def learn(self, words: set[bytes]) -> None:
        if (len(self.known) + len(words)) * self.logp.shape[1] > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        lo, hi = len(self.known), len(self.known) + len(new)
        if hi > len(self.values):
            grown = np.zeros((2 * hi, self.values.shape[1]))
            grown[:lo] = self.values[:lo]
            self.values = grown
        self.values[lo:hi] = lattice.log_likelihood(self.pieces, self.logp, [w.decode("utf-8", "replace") for w in new])
        self.known.update(zip(new, range(lo, hi), strict=True))

    def sums(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """(log probability for each language, number of words) for each text, about a million characters at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1_000_000):
                size += len(texts[hi])
                hi += 1
            split = [words_of(t) for t in texts[lo:hi]]
            self.learn(set().union(*split))
            for words in split:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                yield self.values[at].sum(axis=0), len(words)
            lo = hi


def blocks(langs: list[str], logp: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
    """The model in blocks of LANGS languages."""
    return [(langs[i : i + LANGS], np.ascontiguousarray(logp[:, i : i + LANGS])) for i in range(0, len(langs), LANGS)]


def judged(scorer: Scorer, langs: list[str], texts: list[str | None], best: list[float | None], pred: list[str | None], others: list[float | None]) -> None:
    """Updates, for whole texts: the best scaled log probability, its language, and the sum of exp(scaled - best)."""
    texts = [x if x is not None and LETTER.search(x) else "" for x in texts]
    for i, (total, n) in enumerate(scorer.sums(texts)):
        if n:
            x = total * (min(n, EVIDENCE) / n)
            k = int(np.argmax(x))
            top = float(x[k])
            if best[i] is None:
                best[i], pred[i], others[i] = top, langs[k], float(np.exp(x - top).sum())
            elif top > best[i]:
                best[i], pred[i], others[i] = top, langs[k], float(np.exp(x - top).sum()) + others[i] * float(np.exp(best[i] - top))
            else:
                others[i] += float(np.exp(x - best[i]).sum())


def _judge(rows: DataFrame, langs: list[str], logp: np.ndarray, vocabulary: str, drop: list[str], least: float | None = None) -> DataFrame:
    """rows with _best, _pred, _others, updated by each block of languages in turn; the last pass leaves out the columns drop and rows of a score below least."""
    spark, state = rows.sparkSession, ["_best", "_pred", "_others"]
    kinds = dict(zip(state, ("double", "string", "double"), strict=True))
    parts = blocks(langs, logp)
    rows = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in state])
    for b, (names, numbers) in enumerate(parts):
        model, last = spark.sparkContext.broadcast(numbers), b == len(parts) - 1
        keep = [c for c in rows.columns if c not in state and not (last and c in drop)]

        def run(batches: Iterator[pa.RecordBatch], model=model, names=names, keep=keep, last=last) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(vocabulary, model.value)
            for batch in batches:
                now = [batch.column(c).to_pylist() for c in state]
                judged(scorer, names, batch.column("text").to_pylist(), *now)
                made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(now[0], pa.float64()), pa.array(now[1], pa.string()), pa.array(now[2], pa.float64())], [*keep, *state])
                if last and least is not None:
                    made = made.filter(pa.array([x is not None and 1.0 / x >= least for x in now[2]], pa.bool_()))
                yield made

        schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {k}" for c, k in kinds.items()])
        rows = rows.mapInArrow(run, schema)
        rows = rows if last else stored(rows, "judged")
    return rows if parts else rows.drop(*drop).filter(F.lit(least is None))


def predict(rows: DataFrame, langs: list[str], logp: np.ndarray, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score for every row (text)."""
    made = _judge(rows.select(*keep, "text"), langs, logp, vocabulary, ["text"])
    return made.select(*keep, F.coalesce("_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(F.lit(1.0) / F.col("_others"), F.lit(0.0)).alias("score"))


def recognised(docs: DataFrame, least: float = LEAST, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs, all columns, whose text has letters and a language that scores at least `least`."""
    langs, logp = fit(docs.select("doc_id", "text", "lang"), vocabulary)
    return _judge(docs, langs, logp, vocabulary, [], least).select(docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = fold(F.col("doc_id"), 4)
    langs, logp = fit(docs.filter(remainder != 2))
    return predict(docs, langs, logp).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
