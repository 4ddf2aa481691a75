import itertools
import random

import numpy as np

from kairoframe.llm import decontaminate as dec
from kairoframe.llm.jaccard_join import Hashes

SF = "/root/testdata/sf0.001"


def test_masks_meet_unreplaced_words_whatever_was_replaced():
    """Every choice of a fifth of the inner words, in overlaps of 12 to 30 words, leaves a window that some mask accepts."""
    bits = [(len(m), sum(1 << i for i, c in enumerate(m) if c == "1")) for m in dec.MASKS]
    for n in range(dec.LEAST, 31):
        replaced = (np.int64(1) << np.array(list(itertools.combinations(range(1, n - 1), n // 5)))).sum(axis=1)
        hit = np.zeros(len(replaced), bool)
        for span, m in bits:
            for at in range(n - span + 1):
                hit |= (replaced & (m << at)) == 0
        assert hit.all(), n


def exhaustive(text, item):
    """Whether some alignment and some equal word extends to a verified overlap."""
    return any(text[a] == item[p] and dec.extended(text, item, a, p, 1) for a in range(len(text)) for p in range(len(item)))


def planted(rng, length, replaced):
    item = [f"i{rng.randrange(10**6)}" for _ in range(40)]
    start = rng.randrange(40 - length + 1)
    copy = item[start : start + length]
    for k in rng.sample(range(1, length - 1), replaced):
        copy[k] = f"r{rng.randrange(10**6)}"
    return " ".join([f"a{rng.randrange(10**6)}" for _ in range(15)] + copy + [f"z{rng.randrange(10**6)}" for _ in range(15)]), " ".join(item)


def test_recall_against_every_alignment():
    rng, hashes = random.Random(4), Hashes()
    for length in (12, 13, 14, 15, 16, 18, 20, 22, 25, 27, 30):
        found = true = 0
        for share in (0.01, 0.05, 0.1, 0.15, 0.2):
            for _ in range(40):
                text, item = planted(rng, length, int(length * share))
                h, own = dec.word_hashes(text, hashes), dec.word_hashes(item, hashes)
                if exhaustive(h, own):
                    true += 1
                    found += bool(dec.Index([(1, item)]).overlaps(h))
        assert true > 100 and found == true, (length, found, true)


def test_join_by_hash_gives_the_same(spark, odd, monkeypatch):
    """Beyond the bound the windows are joined in a shuffle: same overlaps, same documents left."""
    rng, rows, items = random.Random(9), [], []
    for k in range(60):
        text, item = planted(rng, rng.choice([12, 15, 20, 30, 40]), rng.randrange(0, 4))
        rows.append((k, text))
        items.append((k, item))
    rows += [(60, items[3][1]), (61, items[3][1]), (61, items[3][1]), (None, items[5][1]), (62, None), (63, "only three words"), (64, "not only three words here")]
    items += [(100, "only three words"), (101, None), (102, ""), (103, "a1 a2 a3 a4 a5 a6"), (104, items[7][1]), (104, items[7][1])]
    rows += [(70, "x y a1 a2 a3 a4 a5 a6 z"), (71, "x y a1 a2 a3 b4 a5 a6 z")]
    docs = spark.createDataFrame([(d, t, "keep") for d, t in rows], "doc_id long, text string, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    small, kept = sorted(map(str, dec.overlaps(docs, bench).collect())), sorted(map(str, dec.clean(docs, bench).collect()))
    pairs = {(r["doc_id"], r["item_id"]) for r in dec.overlaps(docs, bench).collect()}
    assert {(63, 100), (70, 103), (61, 3), (None, 5), (7, 104)} <= pairs and not {d for d, _ in pairs} & {62, 64, 71}
    monkeypatch.setattr(dec, "BOUND", 100)
    assert sorted(map(str, dec.overlaps(docs, bench).collect())) == small
    assert sorted(map(str, dec.clean(docs, bench).collect())) == kept
    assert dec.clean(odd, bench).columns == odd.columns and dec.clean(odd, bench).count() == odd.count()


def test_query_against_brute_force(spark, odd, none):
    """Every pair of text and item, every alignment, on the smallest tables."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    hashes = Hashes()
    items = {r["item_id"]: dec.word_hashes(r["text"], hashes) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        h = dec.word_hashes(r["text"], hashes)
        for i, w in items.items():
            both = np.nonzero(np.isin(h, w))[0]
            if len(both) >= 0.8 * min(len(w), dec.LEAST):
                hits = sorted((i, a, p, 1) for a in both.tolist() for p in np.nonzero(w == h[a])[0].tolist())
                if dec.verified(h, items, hits):
                    want.add((r["doc_id"], i))
    found = {(r["doc_id"], r["item_id"]) for r in dec.overlaps(docs, bench).collect()}
    assert found == want and len(want) >= 3
    assert {r["doc_id"] for r in dec.clean(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    assert dec.overlaps(none, bench).count() == 0 and dec.overlaps(docs, bench.limit(0)).count() == 0
    assert dec.clean(odd, bench).columns == odd.columns
