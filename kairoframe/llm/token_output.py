"""Token-ID output in training order: a keyed Feistel permutation and fixed-stride shards.

1. Whole texts are encoded by a public byte-level BPE; each document's ids, closed by the end id, are cut into
   sequences of `LENGTH` ids. A sequence is known by (doc_id, hash of the text, its number), whose hash deals the
   sequences into `BUCKETS` buckets; they are stored once, packed, sorted inside their bucket.
2. A sequence's index is its place in the order of (bucket, doc_id, hash of the text, number): the counts of the
   buckets before, plus its own place. It depends on the documents alone, not on files, tasks or cores, so a run on
   another cluster resumes the same order.
3. A Feistel network of four rounds over the least even number of bits that holds all N indexes permutes them by a
   key; where the result is N or more it is permuted again (cycle-walking), so indexes map one to one onto the
   slots 0 .. N - 1. No shuffle buffer or sort by random numbers is needed, and slot(i) can be computed anywhere.
4. Range partitions by shard of `SHARD` slots put the sequences in place: a shard is SHARD records of
   2 * LENGTH bytes (little endian, padded with the pad id), so slot s is at a fixed offset of shard s // SHARD:
   reading is sequential, and resumes at any slot.

`shards` returns one row for each shard, `write_files` writes them as files and skips those that hold the same bytes
and belong to the same run (corpus, key, length), `read_slots` reads such a folder from any slot.

Edge cases: a null or empty text is one sequence that holds the end id alone; repeated rows are sequences of their
own; a null id is kept; an empty table gives no shards; other columns are ignored. Strings in a text that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZERS, partitions, stored, table

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, PAD = 50256, 65535
LENGTH, SHARD, KEY, ROUNDS = 512, 256, 20240229, 4
#: Texts above this many characters are encoded in parts that end before a space, where the encoding splits anyway.
PART = 100_000
#: Buckets of the order; their counts are the one thing the driver holds.
BUCKETS = 16_384


def encoder(vocabulary: str = VOCABULARY):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """Pieces of a long text, cut where a space follows a character that is no white space."""
    lo = 0
    while len(text) - lo > PART:
        hi = lo + PART
        while hi < len(text) and not (text[hi] == " " and not text[hi - 1].isspace()):
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def packed(ids: np.ndarray, compress) -> bytes:
    """Ids as compressed bytes: all low bytes, then all high ones, which repeat more."""
    return compress(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def unpacked(raw: bytes, decompress) -> bytes:
    """The ids' little-endian bytes."""
    return np.frombuffer(decompress(raw), np.uint8).reshape(2, -1).T.tobytes()


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """bucket, doc_id, text_hash, seq, n, ids (packed) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, compress = encoder(vocabulary).encode_ordinary, zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows: list[tuple] = []
                some = batch.slice(lo, 1000)
                for k, text in enumerate(some.column(2)):
                    ids = np.array([i for p in parts(text.as_py() or "") for i in encode(p)] + [END], "<u2")
                    rows += [(k, seq, len(x := ids[at : at + length]), packed(x, compress)) for seq, at in enumerate(range(0, len(ids), length))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                at, *made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), *made], ["doc_id", "text_hash", "seq", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, seq long, n int, ids binary")
    return made.select(F.pmod(F.xxhash64("doc_id", "text_hash", "seq"), F.lit(BUCKETS)).cast("int").alias("bucket"), "*")


def _round(half: np.ndarray, key: int, k: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of indexes below n: a permutation of 0 .. n - 1."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> half, x & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def placed(docs: DataFrame, length: int = LENGTH, key: int = KEY, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int, str]:
    """(slot, doc_id, seq, n, ids (packed); number of sequences; the run: what the corpus, the key and the length decide)."""
    order = ["bucket", "doc_id", "text_hash", "seq"]
    dealt = sequences(docs, length, vocabulary).repartition("bucket").sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each row's place in its bucket; a bucket is in one partition, in order."""
        last, upto = -1, 0
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            if not len(bucket):
                continue
            start = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1])
            before = np.zeros(len(start), np.int64)
            before[0] = upto if bucket[0] == last else 0
            run = np.diff(np.append(start, len(bucket)))
            place = np.arange(len(bucket)) - np.repeat(start, run) + np.repeat(before, run)
            last, upto = int(bucket[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(place), *(batch.column(c) for c in ("text_hash", "doc_id", "seq", "n", "ids"))], ["bucket", "place", "text_hash", "doc_id", "seq", "n", "ids"])

    made = stored(dealt.mapInArrow(number, f"bucket int, place long, text_hash long, doc_id {kind}, seq long, n int, ids binary"), "sequences")
    begin, total, digest = np.zeros(BUCKETS, np.int64), 0, 0
    content = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", "seq"), 32)
    for r in made.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(content).alias("h")).orderBy("bucket").collect():
        begin[r["bucket"]] = total
        total += r["n"]
        digest = (digest * 0x9E3779B97F4A7C15 + r["h"]) % 2**64
    shared = docs.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        for batch in batches:
            slot = slots(first[np.asarray(batch.column("bucket"))] + np.asarray(batch.column("place")), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[3:]], ["slot", "doc_id", "seq", "n", "ids"])

    return made.mapInArrow(run, f"slot long, doc_id {kind}, seq long, n int, ids binary"), total, f"{digest:016x}-{key}-{length}-{total}"


def shards(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """shard, first_slot, n_slots, stride, doc_ids, seqs, lengths, payload, payload_sha256, run, n_total: a row for each shard."""
    rows, total, run_id = placed(docs, length, key, vocabulary)
    stride = 2 * length
    n = max(1, min(partitions(docs.sparkSession, total * stride, 16_000_000), -(-total // shard)))
    dealt = rows.withColumn("shard", F.floor(F.col("slot") / shard).cast("long")).repartitionByRange(n, "shard").sortWithinPartitions("slot")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, kept, decompress = None, [], zstandard.ZstdDecompressor().decompress
        pad = np.array([PAD], "<u2").tobytes()

        def out() -> pa.RecordBatch:
            payload = b"".join(unpacked(r[4], decompress) + pad * (length - r[3]) for r in kept)
            doc = pa.array([[r[1] for r in kept]], pa.list_(id_type))
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([now * shard]), pa.array([len(kept)], pa.int64()), pa.array([stride], pa.int64()), doc, pa.array([[r[2] for r in kept]], pa.list_(pa.int64())), pa.array([[r[3] for r in kept]], pa.list_(pa.int32())), pa.array([payload], pa.binary()), pa.array([hashlib.sha256(payload).hexdigest()]), pa.array([run_id]), pa.array([total], pa.int64())],
                ["shard", "first_slot", "n_slots", "stride", "doc_ids", "seqs", "lengths", "payload", "payload_sha256", "run", "n_total"],
            )

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "seq", "n", "ids")), strict=True):
                if now is not None and row[0] != now:
                    yield out()
                    kept = []
                now = row[0]
                kept.append(row)
        if kept:
            yield out()

    return dealt.mapInArrow(run, f"shard long, first_slot long, n_slots long, stride long, doc_ids array<{kind}>, seqs array<long>, lengths array<int>, payload binary, payload_sha256 string, run string, n_total long")


def _replace(path: str, data: bytes) -> None:
    """Writes a file under another name and moves it into place, so that no reader meets half of it."""
    part = f"{path}.{TaskContext.get().taskAttemptId()}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def _read(path: str) -> bytes:
    if not os.path.exists(path):
        return b""
    with open(path, "rb") as f:
        return f.read()


def write_files(made: DataFrame, folder: str) -> int:
    """Writes shards to a folder that all executors share. Returns how many were written.

    A shard is left as it is only if its file holds the same bytes and its description is the same (run, slots, ids).
    The description is written first, so a shard file without one, or with another's, is written anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            written = 0
            for r in batch.to_pylist():
                path = os.path.join(folder, f"shard-{r['shard']:09d}")
                about = json.dumps({k: v for k, v in r.items() if k != "payload"}, sort_keys=True).encode()
                if _read(f"{path}.json") == about and _read(f"{path}.bin") == r["payload"]:
                    continue
                _replace(f"{path}.json", about)
                _replace(f"{path}.bin", r["payload"])
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    return made.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_slots(folder: str, first: int = 0, length: int = LENGTH, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The id sequences of a folder, one after another, from any slot on.

    Ends with the run's last slot, whatever other files the folder holds; a shard of another run is an error.
    """
    stride, run = 2 * length, None
    while run is None or first < run[1]:
        path = os.path.join(folder, f"shard-{first // shard:09d}")
        about = _read(f"{path}.json")
        if not about:
            if run is None:
                return
            raise ValueError(f"no description of {path}.bin")
        about = json.loads(about)
        own = (about["run"], about["n_total"], about["stride"])
        run = run or own
        if own != run or own[2] != stride:
            raise ValueError(f"{path}.bin belongs to another run")
        if first >= run[1]:
            return
        with open(f"{path}.bin", "rb") as f:
            f.seek(first % shard * stride)
            while len(raw := f.read(stride)) == stride:
                ids = np.frombuffer(raw, "<u2")
                yield ids[ids != PAD]
                first += 1
        if first < min(run[1], (first // shard + (first % shard > 0)) * shard):
            raise ValueError(f"{path}.bin is short")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
