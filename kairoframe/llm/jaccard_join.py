"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection of sorted arrays.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two documents link when
|x & y| / |x | y| >= num / den. The join finds every link between different sets and returns the components
of links; documents with equal sets are one class and are never compared.

1. Bands. Sizes fall into bands such that linked sets lie in the same or neighbouring bands. Linked sets of
   a band and the one below differ in at most D elements, D fixed by the band.
2. Tiles. The hash range is cut into D + 1 + z equal parts. At most D parts can differ, so linked sets
   agree in at least 1 + z whole parts. (band, part, contents of the part) is a tile; each set goes to the
   tiles of its own band and the next. Parts without elements count only for sets with more than z of them
   (z is about twice the expected number), which keeps the argument whole without a tile of empty parts.
   Sharing some passages does not bring two documents into a tile: a whole part has to agree.
3. Bitmaps. Bit k of a set's bitmap is the parity of the elements hashed to cell k, so the count of bits in
   which two bitmaps differ is at most |x ^ y|: it bounds the overlap from above. First the tile's members are
   compared with its least member; tiles whose members are then still in different components are compared
   in full, only between components, large ones in blocks.
4. Exact check. Components of what passed hold every link. Their sets are compared by intersection of sorted
   arrays, each set with those that are not yet in its component; large components go in chunks, first
   within chunks, then between the chunks' leaders, then between the chunks that still differ.

Texts are never shuffled: sets are computed anew for the candidates, found by a bitmap filter of fixed
size. The order of comparisons is linear in the size of a group of near copies, however large.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer
words than n are one n-gram; repeated rows and ids each get their row; a null doc_id is a row with a null
component unless its set or a joined one occurs with an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_filter, stored, table
from .components import components

#: Words whose hashes a task remembers; members of a block of a tile; elements of a chunk of a component.
REMEMBERED, BLOCK, CHUNK = 400_000, 2_000, 3_000_000
#: Largest size of the candidate filter, in bits.
FILTER_BITS = 1 << 26

_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(text: str | None, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += h[k : len(h) - width + 1 + k] * np.uint64(pow(_STEP, k + 1, 2**64))
    return np.unique(mix(out + np.uint64(width)))


@dataclass(frozen=True)
class Rule:
    n: int
    num: int
    den: int

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def most_different(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=16)
def _starts(rule: Rule) -> list[int]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * rule.den // rule.num + 1)
    return out


def band_of(rule: Rule, size: int) -> int:
    return int(np.searchsorted(_starts(rule), size, "right")) - 1


@lru_cache(maxsize=4096)
def tile_parts(rule: Rule, band: int) -> tuple[int, int]:
    """(number of parts, z) of a band's tiles."""
    starts = _starts(rule)
    most = starts[band + 1] - 1
    different = int(rule.most_different(most, most))
    least = starts[max(0, band - 1)]
    z = math.ceil(2 * (different + 1) * math.exp(-least / (different + 1))) if different else 0
    return different + 1 + z, z


def signatures(rule: Rule, elems: np.ndarray) -> np.ndarray:
    """Tiles of a set: of its own band and of the next."""
    if not len(elems):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elems ^ np.uint64(_STEP)), dtype=np.uint64)])
    high, out, own = elems >> np.uint64(32), [], band_of(rule, len(elems))
    for band in (own, own + 1):
        parts, z = tile_parts(rule, band)
        cuts = np.searchsorted((high * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        empty = cuts[1:] == cuts[:-1]
        keep = slice(None) if empty.sum() > z else ~empty
        place = mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40))
        out.append(mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ place)[keep])
    return np.concatenate(out)


def bitmap(rule: Rule, elems: np.ndarray) -> bytes:
    """Parity of the elements in each of 2 ** k cells, about 6 for each element by which linked sets may differ."""
    cells = 64
    while cells < 6 * int(rule.most_different(len(elems), len(elems))):
        cells *= 2
    at = (elems >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap with fewer cells: neighbours are added, modulo 2."""
    if len(raw) == size:
        return np.frombuffer(raw, np.uint8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(size * 8, -1)
    return np.packbits(np.bitwise_xor.reduce(bits, axis=1))


def _differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def spread(sizes: np.ndarray, bitmaps: list[bytes], labels: np.ndarray, rule: Rule, check, halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join everything linked: breadth first, each row against rows not yet in its component.

    labels: rows of one label are known to be joined. check(i, candidates) -> those truly linked with i.
    halves: only rows of different halves are compared (the others were, before).
    """
    width = min(map(len, bitmaps))
    bits = np.stack([folded(b, width) for b in bitmaps])
    links, m = [], len(sizes)
    by_label: dict = {}
    for i, x in enumerate(labels.tolist()):
        by_label.setdefault(x, []).append(i)
    waiting = np.ones(m, bool)
    for first in range(m):
        if not waiting[first]:
            continue
        queue = list(by_label[labels[first]])
        waiting[queue] = False
        while queue:
            i = queue.pop()
            others = waiting if halves is None else waiting & (halves != halves[i])
            rest = np.nonzero(others)[0]
            if not len(rest):
                if halves is None or not waiting.any():
                    break
                continue
            rest = rest[_differing(bits[i], bits[rest]) <= rule.most_different(sizes[i], sizes[rest])]
            for j in check(i, rest):
                if waiting[j]:
                    links.append((i, int(j)))
                    group = by_label[labels[j]]
                    waiting[group] = False
                    queue.extend(group)
    return links


def _passes(_: int, rest: np.ndarray) -> np.ndarray:
    return rest


def _exact(rule: Rule, sets: list[np.ndarray]):
    def check(i: int, rest: np.ndarray) -> list[int]:
        x, out = sets[i], []
        for j in rest.tolist():
            y = sets[j]
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if rule.num * len(large) > rule.den * len(small):
                continue
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if rule.linked(len(x), len(y), common):
                out.append(j)
        return out

    return check


def set_key(elems: bytes) -> tuple[int, int]:
    """hi and lo, the 128 bits that identify a set."""
    import xxhash

    key = xxhash.xxh3_128_digest(elems)
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def set_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, hi, lo (128 bits that identify the set), bits for every document, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            n, hi, lo, bits = [], [], [], []
            for text in batch.column(1):
                e = ngram_set(text.as_py(), rule.n, hashes)
                key = set_key(e.tobytes())
                n.append(len(e))
                hi.append(key[0])
                lo.append(key[1])
                bits.append(bitmap(rule, e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n", "hi", "lo", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, bits binary")


def tile_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """tile, lo: the tiles of each distinct set (copies within a task are skipped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, seen = Hashes(), set()
        for batch in batches:
            tiles, los, size = [], [], 0
            for text in batch.column(0):
                e = ngram_set(text.as_py(), rule.n, hashes)
                key = xxhash.xxh3_128_digest(e.tobytes())
                if len(e) and key not in seen:
                    seen.add(key)
                    tiles.append(signatures(rule, e).view(np.int64))
                    los.append(np.full(len(tiles[-1]), int.from_bytes(key[8:], "little", signed=True), np.int64))
                    size += len(tiles[-1])
                if size > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(los))], ["tile", "lo"])
                    tiles, los, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(los))], ["tile", "lo"])

    return docs.select("text").mapInArrow(run, "tile long, lo long")


def _crowded(docs: DataFrame, rule: Rule) -> DataFrame:
    """tile, lo, first: members of the tiles that hold different sets, with the tile's least member."""
    from pyspark.sql import Window

    tile = Window.partitionBy("tile")
    rows = tile_rows(docs, rule).select("tile", "lo", F.min("lo").over(tile).alias("first"), F.max("lo").over(tile).alias("last"))
    return stored(rows.filter("first <> last").select("tile", "lo", "first").distinct(), "tiles")


def _near_first(crowded: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: members that may link with the least member of their tile, by the bitmaps' bound."""
    pairs = crowded.filter("lo <> first").select(F.col("first").alias("a"), F.col("lo").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("lo").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, ba, nb, bb in zip(*(batch.column(c).to_pylist() for c in ("na", "bitsa", "nb", "bitsb")), strict=True):
                w = min(len(ba), len(bb))
                keep.append(int(np.bitwise_count(folded(ba, w) ^ folded(bb, w)).sum()) <= rule.most_different(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """rows with blocks > 1 go to every pair of blocks that holds their own; others stay as they are (i, j: block pair)."""
    own = F.pmod(F.xxhash64(salt, F.lit("block")), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    return rows.withColumn("own", own).select("*", F.inline(pairs)).withColumn("half", (F.col("own") == F.col("i")).cast("int"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, list], list[tuple[int, int]]]]:
    """Columns and the bounds of the groups in them, from rows sorted by keys; a group is never divided."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        if not now.num_rows:
            continue
        columns = [now.column(k).to_numpy() for k in keys]
        change = np.zeros(now.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist()]
        held = now.slice(cuts[-1])
        if len(cuts) > 1:
            yield {n: now.column(n).slice(0, cuts[-1]).to_pylist() for n in now.column_names}, list(zip(cuts, cuts[1:], strict=False))
    if held is not None and held.num_rows:
        yield {n: held.column(n).to_pylist() for n in held.column_names}, [(0, held.num_rows)]


def _rest_of_tiles(crowded: DataFrame, labels: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: pairs that may link in tiles whose members are in different components so far.

    Pairs with a tile's least member were looked at before, so tiles of two are done, and so are tiles whose other
    members are all in one component.
    """
    marked = crowded.join(labels.withColumnRenamed("node", "lo"), "lo", "left").filter("lo <> first").select("tile", "lo", F.coalesce("label", "lo").alias("label"))
    open_tiles = marked.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members")).filter("x <> y")
    rows = marked.join(open_tiles.select("tile", F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks")), "tile")
    rows = _blocks(rows, "tile", "lo").join(sets.select("lo", "n", "bits"), "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, bounds in grouped(batches, ["tile", "i", "j"]):
            a, b, lo = [], [], c["lo"]
            for x, y in bounds:
                if y - x == 2:  # most tiles; the general way gives the same
                    w = min(len(c["bits"][x]), len(c["bits"][x + 1]))
                    if (c["i"][x] == c["j"][x] or c["half"][x] != c["half"][x + 1]) and c["label"][x] != c["label"][x + 1] and (
                        int(np.bitwise_count(folded(c["bits"][x], w) ^ folded(c["bits"][x + 1], w)).sum()) <= rule.most_different(c["n"][x], c["n"][x + 1])
                    ):
                        a.append(lo[x])
                        b.append(lo[x + 1])
                    continue
                halves = np.array(c["half"][x:y]) if c["i"][x] != c["j"][x] else None
                for p, q in spread(np.array(c["n"][x:y], np.int64), c["bits"][x:y], np.array(c["label"][x:y]), rule, _passes, halves):
                    a.append(lo[x + p])
                    b.append(lo[x + q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["tile", "i", "j"]
    dealt = rows.select(*keys, "half", "lo", "label", "n", "bits").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _candidate_sets(docs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """hi, lo, rep, group, n, bits, elems: the sets of the candidates, from the texts with the ids of one document of each."""
    spark = docs.sparkSession
    count = reps.count()
    bits = 1 << 15
    while bits < FILTER_BITS and bits < 16 * count:
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731  bucket k holds 32768 (k - 1) + 1 and on
    at = place("rep")
    made = reps.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    full = np.zeros(bits // 8, np.uint8)
    for r in made:
        full[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    known = spark.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, there, seen = Hashes(), known.value, set()
        for batch in batches:
            k, p = np.asarray(batch.column("bucket")), np.asarray(batch.column("place"))
            hit = (there[(k - 1) * 4096 + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
            some = batch.column("text").filter(pa.array(hit.astype(bool)))
            for lo in range(0, len(some), 500):
                if len(seen) > REMEMBERED:
                    seen.clear()
                rows = []
                for t in some.slice(lo, 500):
                    elems = ngram_set(t.as_py(), rule.n, hashes).tobytes()
                    key = set_key(elems)
                    if key not in seen:
                        seen.add(key)
                        rows.append((*key, elems))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["hi", "lo", "elems"])

    placed = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").withColumn("at", place("rep"))  # a null id has a place too
    found = placed.select("text", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("place")).mapInArrow(run, "hi long, lo long, elems binary")
    return found.join(reps, ["hi", "lo"]).dropDuplicates(["hi", "lo"])


def _verified(cand: DataFrame, rule: Rule) -> DataFrame:
    """a, b (lo): links, checked exactly, that join everything linked within the groups."""

    def links(pdf: pd.DataFrame, halves: np.ndarray | None) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elems"]]
        found = spread(pdf["n"].to_numpy(np.int64), pdf["bits"].tolist(), pdf["label"].to_numpy(), rule, _exact(rule, sets), halves)
        lo = pdf["lo"].to_numpy()
        return pd.DataFrame({"a": [lo[i] for i, _ in found], "b": [lo[j] for _, j in found]}, dtype="int64")

    sizes = cand.groupBy("group").agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("blocks"))
    rows = cand.join(sizes, "group").withColumn("label", F.col("lo")).withColumn("own", F.pmod(F.xxhash64("lo", F.lit("block")), F.col("blocks")))
    first = stored(rows.groupBy("group", "own").applyInPandas(lambda pdf: links(pdf, None), "a long, b long"), "links")
    large = sizes.filter("blocks > 1")
    if not large.take(1):
        return first
    # Groups in several chunks: leaders of the chunks' components meet first, then chunks that still differ.
    some = cand.join(large, "group")

    def labelled(edges: DataFrame) -> DataFrame:
        return some.join(components(edges).withColumnRenamed("node", "lo"), "lo", "left").withColumn("label", F.coalesce("label", "lo"))

    leaders = labelled(first).filter("lo = label")
    few = leaders.groupBy("group").agg(F.sum("n").alias("total")).filter(F.col("total") <= CHUNK).select("group")
    second = stored(leaders.join(few, "group", "left_semi").groupBy("group").applyInPandas(lambda pdf: links(pdf, None), "a long, b long").unionByName(first), "links")
    now = labelled(second)
    still = now.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("group")
    tiles = _blocks(now.join(still, "group", "left_semi"), "group", "lo").filter("i <> j")
    third = tiles.groupBy("group", "i", "j").applyInPandas(lambda pdf: links(pdf, pdf["half"].to_numpy()), "a long, b long")
    return stored(third.unionByName(second), "links")


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    every = stored(set_table(docs, rule), "sets")
    classes = stored(every.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits")), "classes")
    sets = classes.groupBy("lo").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    crowded = _crowded(docs, rule)
    near = stored(_near_first(crowded, sets, rule), "near")
    more = stored(_rest_of_tiles(crowded, components(near), sets, rule), "near")
    groups = components(near.unionByName(more))
    reps = stored(classes.join(groups, F.col("lo") == F.col("node")).select("hi", "lo", "rep", "n", "bits", F.col("label").alias("group")), "candidates")
    linked = components(_verified(_candidate_sets(docs, reps, rule), rule))
    named = classes.join(linked, F.col("lo") == F.col("node"), "left").select("hi", "lo", "rep", F.coalesce("label", "lo").alias("label"), F.col("label").isNotNull().alias("grouped"))
    # Classes that no link joins keep their own least id, so only joined ones are grouped.
    roots = named.filter("grouped").groupBy("label").agg(F.min("rep").alias("root"))
    of_class = named.join(roots, "label", "left").select("hi", "lo", F.coalesce("root", "rep").alias("component_id"))
    return every.join(of_class, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs, all columns, with one document, that of the least id, of each component.

    Ids decide: an id stays if any of its rows is the least of its component, has an empty set or no id; of rows
    with equal id and text one stays. Rows that are not affected are never shuffled.
    """
    from pyspark.sql import Window

    found = stored(join(docs, rule), "components")
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_id"))).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    special = stored(by_id.filter("not _stays or _rows > 1"), "special")
    marked = in_filter(special.select("doc_id"), docs)
    some = marked.filter("maybe").drop("maybe").join(special, "doc_id", "left").filter("coalesce(_stays, true)")
    again = Window.partitionBy("doc_id", "text").orderBy(F.lit(1))
    single = some.filter("coalesce(_rows, 1) = 1").select(docs.columns)
    repeated = some.filter("_rows > 1").withColumn("_nth", F.row_number().over(again)).filter("_nth = 1").select(docs.columns)
    return marked.filter("not maybe").select(docs.columns).unionByName(single).unionByName(repeated)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), Rule(3, 90, 100))
