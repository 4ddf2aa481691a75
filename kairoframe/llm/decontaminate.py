"""Benchmark decontamination by spaced seeds.

A mask selects six of up to `SPAN` consecutive words; the others may differ. The selected words of every window of
every benchmark item are hashed, and so are those of every window of every training text: equal hashes are hits.
Around a hit the two word sequences are laid on each other: the overlap is the longest stretch that contains the
hit, begins and ends with equal words, and of whose words at least `SAME` are equal. It is verified if it has at
least `LEAST` words.

The masks are chosen so that whichever fifth of an overlap's words was replaced, some mask meets only words that were
not: this holds for every choice of replaced words in overlaps of 12 to 30 words. An item with fewer than LEAST words
has to be there whole, word by word; with fewer than `SHORT` it has to be the whole text.

A benchmark of at most `BOUND` words and items goes to the tasks as one sorted index: one pass over the texts. A larger
one is joined by hash: windows that pass a bitmap filter of fixed size meet the benchmark's windows in a shuffle, and
the texts of candidates, found by a bitmap again, meet their items' texts for the verification.

Edge cases: null or empty texts and items match nothing; repeated items and ids each count on their own; a null id
is an id like others; empty tables give an empty result; other columns are kept by `clean` and ignored by `overlaps`.
Ties between overlaps of a text and an item go to the first in the text, then in the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, in_filter, stored, table, whole
from .jaccard_join import Hashes, mix

#: The masks; 1 marks a word that is compared.
MASKS = ("11010111", "1110001011", "11000100111", "111111")
SPAN, LEAST, SHORT, BOUND = 11, 12, 5, 250_000
#: Part of an overlap's words that are equal, as a fraction.
SAME = (4, 5)
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(LEAST)]
_TAG_BITS = 22
#: Largest size of the filter of the benchmark's hashes, in bits (32 MB).
FILTER_BITS = 1 << 28


def word_hashes(text: str | None, hashes: Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words of each window."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)))
    for k, bit in enumerate(mask):
        if bit == "1":
            out += h[k : k + n] * _FACTORS[k]
    return mix(out)


def masks_of_item(n: int) -> tuple[str, ...]:
    """Masks that an item of n words is found by."""
    return MASKS if n >= LEAST else ("1" * n,) if n else ()


def masks_of_text(n: int, lengths: list[int]) -> list[str]:
    """Masks that a text of n words is searched with; lengths: those of the items with fewer than LEAST words."""
    return [*MASKS, *("1" * k for k in lengths if k >= SHORT or k == n)]


class Index:
    """Sorted hashes of items."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        hashes = Hashes()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t, hashes) for _, t in items]
        self.lengths = sorted({len(w) for w in self.words if 0 < len(w) < LEAST})
        keys, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            for mask in masks_of_item(len(w)):
                keys.append(windows(w, mask))
                item.append(np.full(len(keys[-1]), i))
                place.append(np.arange(len(keys[-1])))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.tags = np.zeros(1 << _TAG_BITS, bool)
        self.tags[self.keys >> np.uint64(64 - _TAG_BITS)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, place in the text, place in the item, width) of equal windows."""
        for mask in masks_of_text(len(h), self.lengths) if len(self.keys) else ():
            k = windows(h, mask)
            at = np.nonzero(self.tags[k >> np.uint64(64 - _TAG_BITS)])[0]
            lo = np.searchsorted(self.keys, k[at], "left")
            true = self.keys[np.minimum(lo, len(self.keys) - 1)] == k[at]
            at, lo = at[true], lo[true]
            for a, x, y in zip(at.tolist(), lo.tolist(), np.searchsorted(self.keys, k[at], "right").tolist(), strict=True):
                for i, p in zip(self.item[x:y].tolist(), self.place[x:y].tolist(), strict=True):
                    yield i, a, p, len(mask)

    def overlaps(self, h: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """item -> (same words, start in the text, start in the item, length) of its best verified overlap."""
        return verified(h, self.words, self.hits(h))


def verified(h: np.ndarray, words, hits) -> dict[int, tuple[int, int, int, int]]:
    """item -> its best verified overlap, from hits in a text; words[item] are its words."""
    best: dict[int, tuple[int, int, int, int]] = {}
    covered: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (item, alignment) -> verified overlaps in the text
    for i, at, p, width in hits:
        if any(a <= at < z for a, z in covered.get((i, at - p), ())):
            continue
        found = extended(h, words[i], at, p, width)
        if not found:
            continue
        covered.setdefault((i, at - p), []).append((found[1], found[1] + found[3]))
        if i not in best or (found[0], -found[1], -found[2]) > (best[i][0], -best[i][1], -best[i][2]):
            best[i] = found
    return best


def extended(text: np.ndarray, item: np.ndarray, at: int, place: int, width: int) -> tuple[int, int, int, int] | None:
    """The verified overlap around a hit, or None."""
    before, after = min(at, place), min(len(text) - at, len(item) - place)
    same = text[at - before : at + after] == item[place - before : place + after]
    total = np.concatenate([[0], np.cumsum(np.where(same, SAME[1] - SAME[0], -SAME[0]))])  # rises over a stretch that is equal enough
    first = np.nonzero(same[: before + 1])[0]
    end = np.nonzero(same[before + width - 1 :])[0] + before + width
    if not len(first) or not len(end):
        return None
    best_from = np.maximum.accumulate(total[end][::-1])  # best total at one of the last 1, 2, ... ends
    k = np.searchsorted(best_from, total[first], "left")
    reached = k < len(end)
    if not reached.any():
        return None
    first, last = first[reached], end[::-1][k[reached]]
    m = int(np.argmax(last - first))
    lo, hi = int(first[m]), int(last[m])
    if hi - lo < min(LEAST, len(item)):
        return None
    return int(same[lo:hi].sum()), at - before + lo, place - before + lo, hi - lo


def _small(benchmark: DataFrame) -> Index | None:
    """The index of a benchmark of at most BOUND words and items, else None."""
    words = F.size(F.regexp_extract_all(whole(F.col("text")), F.lit(WORD), F.lit(0)))
    size = benchmark.agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("items")).first()
    if (size["words"] or 0) > BOUND or size["items"] > BOUND:
        return None
    return Index([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").collect()])


def _seeds(items: DataFrame) -> DataFrame:
    """hash, item, place, width: the windows of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = word_hashes(text.as_py(), hashes)
                for mask in masks_of_item(len(w)):
                    k = windows(w, mask)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), item)), pa.array(np.arange(len(k))), pa.array(np.full(len(k), len(mask)))], ["hash", "item", "place", "width"])

    return items.select("item", "text").mapInArrow(run, "hash long, item long, place long, width long")


def _probes(docs: DataFrame, seeds: DataFrame, lengths: list[int]) -> DataFrame:
    """hash, key (of the text), at: the texts' windows that pass a filter of the benchmark's."""
    spark, count, bits = docs.sparkSession, seeds.count(), 1 << 15
    while bits < FILTER_BITS and bits < 16 * count:
        bits *= 2
    spot = F.pmod(F.col("hash"), F.lit(bits)) + 1
    made = seeds.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("map")).collect()
    full = np.zeros(bits // 8, np.uint8)
    for r in made:
        full[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    known = spark.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, there, seen = Hashes(), known.value, set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                h = word_hashes(text.as_py(), hashes)
                for mask in masks_of_text(len(h), lengths):
                    k = windows(h, mask)
                    p = k & np.uint64(bits - 1)
                    at = np.nonzero((there[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)[0]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array(np.full(len(at), key)), pa.array(at)], ["hash", "key", "at"])

    return docs.select(text_key().alias("key"), "text").mapInArrow(run, "hash long, key long, at long")


def text_key() -> Column:
    return F.xxhash64("text")


def _joined(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """keep, item_id, doc_start, item_start, n_words, n_same by the join of hashes, for every row of docs (keep, text)."""
    items = stored(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stored(_seeds(items), "seeds")
    lengths = sorted(r["width"] for r in seeds.filter(f"width < {LEAST} and place = 0").select("width").distinct().collect())
    hits = _probes(docs, seeds, lengths).join(seeds, "hash").select("key", "item", F.struct("at", "place", "width").alias("hit")).distinct()
    hits = hits.groupBy("key", "item").agg(F.collect_list("hit").alias("hits"))
    cands = stored(hits.join(items.withColumnRenamed("text", "item_text"), "item").withColumnRenamed("key", "_key"), "candidates")
    slim = docs.select(*keep, "text").withColumn("_key", text_key())
    some = in_filter(cands.select("_key").distinct(), slim, "_key").filter("maybe").drop("maybe")
    rows = some.join(cands.select("_key", "item_id", "item_text", "hits"), "_key").select(*keep, "item_id", "text", "item_text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out, at = [], []
            for k, (text, item, found) in enumerate(zip(batch.column("text"), batch.column("item_text"), batch.column("hits"), strict=True)):
                h, own = word_hashes(text.as_py(), hashes), word_hashes(item.as_py(), hashes)
                # A key may stand for two texts: hits beyond this one's windows are not its own.
                hits = sorted((0, x["at"], x["place"], x["width"]) for x in found.as_py() if x["at"] + x["width"] <= len(h))
                for same, start, place, size in verified(h, [own], hits).values():
                    at.append(k)
                    out.append((start, place, size, same))
            rows = batch.select([*keep, "item_id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([r[k] for r in out], pa.int64()) for k in range(4))], [*keep, "item_id", "doc_start", "item_start", "n_words", "n_same"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, "item_id"]]
    return rows.mapInArrow(run, ", ".join([*kinds, "doc_start long, item_start long, n_words long, n_same long"]))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_same: the best verified overlap of each text and item."""
    index = _small(benchmark)
    if index is None:
        return _joined(docs, benchmark, ["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, doc_start long, item_start long, n_words long, n_same long"
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index = Hashes(), shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, (same, start, place, n) in sorted(index.overlaps(word_hashes(text.as_py(), hashes)).items()):
                    rows.append((doc_id, index.ids[i], start, place, n, same))
            kinds = [batch.schema.field(0).type, pa.array(index.ids).type, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no verified overlap with any item."""
    index = _small(benchmark)
    if index is None:
        digest = F.sha2(F.col("text").cast("binary"), 256)
        keyed = docs.select("text", digest.alias("_sha"))
        bad = stored(_joined(keyed, benchmark, ["_sha"]).select("_sha").distinct(), "contaminated")
        marked = in_filter(bad, docs.withColumn("_sha", digest), "_sha")
        hit = marked.filter("maybe").join(bad, "_sha", "left_anti")
        return marked.filter("not maybe").select(docs.columns).unionByName(hit.select(docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index = Hashes(), shared.value
        for batch in batches:
            keep = [not index.overlaps(word_hashes(text.as_py(), hashes)) for text in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
