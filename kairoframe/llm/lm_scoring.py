"""LM scoring: words of the training documents, and a subword lattice over a public vocabulary.

Two models learn from the same documents. The base model is a word unigram with additive smoothing: a token
is a word or the end of a text, and its probability (c + 0.1) / (N + 0.1 (V + 1)). The lattice model has one
probability for each piece of a fixed vocabulary and one for the end (the public vocabularies at hand carry merge
ranks, not unigram scores, so these are learned here); a word's probability is the sum over
all segmentations into pieces, found by a forward recursion in log space, and a text's is the product over its
words and the end. The pieces' probabilities start from the vocabulary's own order and are re-estimated from the
expected uses of each piece over all segmentations of all training words.

Both need numbers for every word of every text, and the words of a corpus fit in no broadcast. So

1. tasks count the words of their training texts; the counts are added up and stored, and every stored word is
   scored once by the lattice;
2. the texts are dealt in blocks of about `BLOCK` characters; each block asks for its own distinct words, in
   sorted order, and the answers (number in that order, count, log probability) come back to the block;
3. the block adds up its documents' scores.

So a frequent word costs a row for each block, not for each document, and only the texts are moved whole, once.

Edge cases: a null or empty text is one token, the end; words that training has not seen have c = 0; without any
training text N = V = 0 and the lattice keeps its initial values; repeated rows each get their row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import TOKENIZERS, fold, partitions, stored, table

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
SMOOTHING, BLOCK, FLUSH = 0.1, 16_000_000, 300_000
LN10 = math.log(10)


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    texts: int


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Numbers(dict):
    """Words in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _strings(words) -> pa.Array:
    return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over the column text. A task adds up before it sends, and keeps at most `FLUSH` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([_strings(counts), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def piece_model(counts: DataFrame, texts: int, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end, re-estimated from all counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice.Pieces(vocabulary)
        start, total = pieces.initial(), np.zeros(pieces.size)
        for batch in batches:
            total += lattice.expected_counts(pieces, start, batch.column(0).to_pylist(), np.asarray(batch.column(1), float))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "n"])

    pieces = lattice.Pieces(vocabulary)
    total = np.zeros(pieces.size + 1)
    for r in counts.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        total[r["piece"]] = r["n"]
    if not texts:
        return np.append(pieces.initial(), math.log(0.01))
    total[-1] = texts
    return lattice.reestimated(np.round(total, 6))  # rounded, as the order of a sum over tasks is not fixed


def scored_words(counts: DataFrame, logp: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, c, logp (log10)."""
    model = counts.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice.Pieces(vocabulary)
        for batch in batches:
            value = lattice.log_likelihood(pieces, model.value[:-1, None], batch.column(0).to_pylist())[:, 0] / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], ["word", "c", "logp"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, logp double")


def _requests(placed: DataFrame) -> DataFrame:
    """block, at, word: each block's distinct words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set] = {}
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text"), strict=True):
                sets.setdefault(block, set()).update(words_of(text.as_py()))
        for block in sorted(sets):
            words = sorted(sets.pop(block))
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), _strings(part)], ["block", "at", "word"])

    return placed.mapInArrow(run, "block long, at int, word string")


def score(docs: DataFrame, counts: DataFrame, totals: Totals, logp: np.ndarray, chars: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of docs (doc_id, text)."""
    n = max(1, -(-chars // BLOCK))
    slim = docs.select("doc_id", "text")
    # The input's partition takes part, so that equal rows don't share a block; where a text is scored changes nothing.
    placed = slim.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).alias("block"), "doc_id", "text").repartition(partitions(docs.sparkSession, chars, BLOCK), "block")
    answers = _requests(placed).join(scored_words(counts, logp, vocabulary), "word", "left").select("block", "at", "c", "logp")
    model = docs.sparkSession.sparkContext.broadcast(logp)
    norm = math.log10(totals.tokens + SMOOTHING * (totals.distinct + 1))

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("at")
        count, value = words["c"].fillna(0).to_numpy(float), words["logp"].to_numpy(float, copy=True)
        numbers = Numbers()
        texts_at = [np.fromiter(map(numbers.__getitem__, words_of(t)), np.int32) for t in texts["text"]]
        ordered = sorted(numbers)
        place = np.empty(len(ordered), np.int32)  # from a word's number to its place in order, which the answers go by
        place[[numbers[w] for w in ordered]] = np.arange(len(ordered), dtype=np.int32)
        unknown = np.nonzero(np.isnan(value))[0]
        if len(unknown):
            value[unknown] = lattice.log_likelihood(lattice.Pieces(vocabulary), model.value[:-1, None], [ordered[i].decode("utf-8", "replace") for i in unknown])[:, 0] / LN10
        base, out = np.log10(count + SMOOTHING)[place], []
        known, value = (count > 0)[place], value[place]
        end_base, end_value = math.log10(totals.texts + SMOOTHING), float(model.value[-1]) / LN10
        for at in texts_at:
            n_tokens = len(at) + 1
            out.append((n_tokens, int(known[at].sum()) + (totals.texts > 0), float(base[at].sum()) + end_base - n_tokens * norm, float(value[at].sum()) + end_value))
        made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        made.insert(0, "doc_id", texts["doc_id"].astype("Int64").to_numpy())
        return made

    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 10) == 0
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count_if(~held_out).alias("texts")).first()
    counts = stored(word_counts(docs.filter(~held_out)), "counts")
    sums = counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    texts = size["texts"] or 0
    totals = Totals((sums["tokens"] or 0) + texts, sums["words"] + (texts > 0), texts)
    made = score(docs, counts, totals, piece_model(counts, texts), size["chars"] or 0)
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
