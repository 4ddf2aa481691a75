import collections
import os
import random

import numpy as np
import pytest

from kairoframe.llm import chat_format, components, jaccard_join, mixing, token_output
from kairoframe.llm.common import stored

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    sets = [shingles(t, rule.n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.linked(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return collections.Counter((d, len(sets[i]), min(ids[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def copies(seed, families=12, each=9):
    """Families of near copies at all distances around the threshold, a chain, and texts that share a passage."""
    r, rows = random.Random(seed), []
    shared = [f"s{i}" for i in range(40)]
    for f in range(families):
        base = [f"f{f}_{r.randrange(60)}" for _ in range(r.choice([4, 9, 30, 80, 200]))]
        for _ in range(each):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 9))):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):  # each near the next, the first far from the last
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + k, " ".join(shared + [f"u{k}_{i}" for i in range(r.randrange(1, 60))])) for k in range(30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_components_against_all_pairs(spark, n, num, seed):
    rule, rows = jaccard_join.Rule(n, num, 100), copies(seed)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, rule)


def test_small_blocks_and_chunks_lose_nothing(spark, monkeypatch):
    """Tiles and groups that are divided give the same components."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CHUNK", 60)
    rule, rows = jaccard_join.Rule(2, 60, 100), copies(5, 4, 12)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, rule)


def test_join_odd_rows(spark, odd, none):
    rule = jaccard_join.Rule(3, 90, 100)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert collections.Counter(tuple(r) for r in jaccard_join.join(odd, rule).collect()) == brute(rows, rule)
    assert jaccard_join.join(none, rule).count() == 0
    kept = jaccard_join.deduplicated(odd, rule)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 5, 6, 7, 8]))


def test_join_one_id_with_two_texts_and_no_ids(spark):
    """Sets of equal size under one id are told apart, and chains run through rows without an id."""
    rule, chain, rows = jaccard_join.Rule(3, 90, 100), [f"c{i}" for i in range(100)], []
    for k in range(20):
        one, two = [f"a{k}_{i}" for i in range(60)], [f"b{k}_{i}" for i in range(60)]
        rows += [(10 * k, " ".join(one)), (10 * k, " ".join(two)), (10 * k + 1, " ".join([*one, "x"])), (10 * k + 2, " ".join([*two, "y"]))]
    for k in range(7):
        rows.append((None if k % 2 else 1000 + k, " ".join(chain)))
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, rule)


def test_signature_bound_holds():
    """Linked sets always share a tile, and bitmaps never overstate the difference."""
    r = np.random.default_rng(1)
    for rule in (jaccard_join.Rule(3, 90, 100), jaccard_join.Rule(5, 80, 100)):
        for size in (9, 10, 33, 120, 700):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(30):
                b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.15], r.integers(0, 2**63, r.integers(0, size // 8 + 1), dtype=np.uint64)]))
                if rule.linked(len(a), len(b), len(np.intersect1d(a, b))):
                    assert len(np.intersect1d(jaccard_join.signatures(rule, a), jaccard_join.signatures(rule, b)))
                x, y = jaccard_join.bitmap(rule, a), jaccard_join.bitmap(rule, b)
                w = min(len(x), len(y))
                assert np.bitwise_count(jaccard_join.folded(x, w) ^ jaccard_join.folded(y, w)).sum() <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(5, 5)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            group = {a, b} | {x for x in up if up[x] in (up.get(a), up.get(b))}
            for x in group:
                up[x] = min(group)
    assert got == up


def test_mixing_realises_weights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for target in (mixing.Target(max_repetition=1.3), mixing.Target(max_repetition=None, entropy=0.4), mixing.Target(max_repetition=2.0, budget=40_000)):
        counted = docs.select("doc_id", "source", mixing.tokens(docs["text"]).alias("tokens"))
        weights, a = mixing.weights(counted, target)
        w = {r["source"]: r for r in weights.collect()}
        assert 0 <= a <= 1 and abs(sum(r["weight"] for r in w.values()) - 1) < 1e-9
        used = mixing.copies(docs, target).select("doc_id", "source", "_mix_copies", mixing.tokens(docs["text"]).alias("t")).collect()
        longest = collections.Counter()
        total = collections.Counter()
        for r in used:
            total[r["source"]] += r["_mix_copies"] * r["t"]
            longest[r["source"]] = max(longest[r["source"]], r["t"])
        for s, r in w.items():
            assert total[s] <= r["quota"] and total[s] > r["quota"] - longest[s]
        if target.budget is None:
            assert min(r["_mix_copies"] for r in used) >= 1
        if target.max_repetition and target.budget is None:
            ratio = [r["quota"] / r["total"] for r in w.values()]
            assert max(ratio) / min(ratio) <= target.max_repetition * 1.001


def test_mixing_block_is_a_prefix_of_its_permutation(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    target = mixing.Target(max_repetition=1.5)
    used = mixing.copies(docs, target).withColumn("k", mixing.block_key(target.seed, docs["source"], mixing.F.col("_mix_whole"), docs["doc_id"])).collect()
    for s in "ab":
        own = sorted((r["k"], r["_mix_copies"] - r["_mix_whole"]) for r in used if r["source"] == s)
        flags = [x for _, x in own]
        assert flags == sorted(flags, reverse=True)


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.mixed(odd, mixing.Target(max_repetition=1.0))
    assert got.columns == odd.columns and got.count() >= odd.count()
    assert mixing.mixed(none, mixing.Target()).count() == 0


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(token_output.slots(np.arange(n), n).tolist()) == list(range(n))
    assert token_output.slots(np.arange(1000), 1000, 1).tolist() != token_output.slots(np.arange(1000), 1000, 2).tolist()


def test_output_round_trip_and_resume(spark, tmp_path, odd, none):
    made = stored(token_output.shards(odd, length=64, shard=16), "shards")
    assert token_output.write_files(made, f"{tmp_path}/out") == made.count()
    assert token_output.write_files(made, f"{tmp_path}/out") == 0
    every = list(token_output.read_slots(f"{tmp_path}/out", 0, 64, 16))
    assert [x.tolist() for x in token_output.read_slots(f"{tmp_path}/out", 21, 64, 16)] == [x.tolist() for x in every[21:]]
    place = {}
    for r in made.collect():
        assert len(r["payload"]) == r["n_slots"] * r["stride"]
        for k in range(r["n_slots"]):
            place.setdefault((r["doc_id"] if "doc_id" in r else r["doc_ids"][k], r["seqs"][k]), []).append(every[r["first_slot"] + k].tolist())
    encode = token_output.encoder().encode_ordinary
    for doc_id, text in {(r["doc_id"], r["text"]) for r in odd.collect()}:
        ids = encode(text or "") + [token_output.END]
        parts = [place[(doc_id, k)][0] for k in range(-(-len(ids) // 64))]
        assert sum(parts, []) == ids
    assert token_output.shards(none).count() == 0


def test_output_order_depends_on_documents_alone(spark, odd):
    """Other partitions and other shuffles: the same shards, byte by byte."""
    want = sorted((r["shard"], r["payload_sha256"]) for r in token_output.shards(odd.repartition(1), 64, 16).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = sorted((r["shard"], r["payload_sha256"]) for r in token_output.shards(odd.repartition(5, "n_chars"), 64, 16).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want and len(want) > 3
    assert want != sorted((r["shard"], r["payload_sha256"]) for r in token_output.shards(odd, 64, 16, key=7).collect())


def test_output_of_another_corpus_into_the_same_folder(spark, tmp_path):
    """Shards of equal size are written anew, and so is one whose description is missing or whose file was cut."""
    folder, texts = f"{tmp_path}/out", lambda word: spark.createDataFrame([(i, f"{word} {i} " * 60) for i in range(60)], "doc_id long, text string")
    one, two = (stored(token_output.shards(texts(w), 32, 16), "shards") for w in ("red", "blue"))
    assert token_output.write_files(one, folder) == one.count() > 2
    assert token_output.write_files(two, folder) == two.count()
    want = {r["shard"]: r["payload"] for r in two.collect()}
    for k, payload in want.items():
        assert open(f"{folder}/shard-{k:09d}.bin", "rb").read() == payload
    os.remove(f"{folder}/shard-{1:09d}.json")
    with open(f"{folder}/shard-{2:09d}.bin", "ab") as f:
        f.truncate(10)
    with pytest.raises(ValueError):
        list(token_output.read_slots(folder, 0, 32, 16))
    assert token_output.write_files(two, folder) == 2 and token_output.write_files(two, folder) == 0
    total = sum(r["n_slots"] for r in two.select("n_slots").collect())
    token_output.write_files(one.filter("shard = 0"), folder)
    with pytest.raises(ValueError):
        list(token_output.read_slots(folder, 0, 32, 16))
    assert len(list(token_output.read_slots(folder, 16, 32, 16))) == total - 16


def test_long_texts_encode_alike():
    encode, text = token_output.encoder().encode_ordinary, ("word  two\n\n three's 12 " * 9000)
    assert [i for p in token_output.parts(text) for i in encode(p)] == encode(text)


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad é"), (1, "chosen", 2, "user", "bye"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, "assistant", None), (None, "rejected", None, None, "x"),
        (4, "chosen", 0, "user", "a"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"),
    ]
    got = {r["pair"]: r for r in chat_format.preference(spark.createDataFrame(turns, "pair long, side string, turn long, role string, text string")).collect()}
    r = got[1]
    assert r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and r["prompt_turns"] == 1
    assert r["chosen"].startswith("<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nbye")
    cut = lambda text, mask: [text[int(a) : int(z)] for a, z in (m.split(":") for m in mask.split(",") if m)]
    assert cut(r["chosen"], r["chosen_mask"]) == ["good<|im_end|>"] and cut(r["rejected"], r["rejected_mask"]) == ["bad é<|im_end|>"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt_turns"] == 1
    assert got[3]["rejected"] == "" and cut(got[3]["chosen"], got[3]["chosen_mask"]) == ["<|im_end|>"]
    assert got[None]["rejected"].endswith("x<|im_end|>\n") and got[4]["prompt_turns"] == 1 and got[4]["chosen"].count("im_start") == 1


def test_long_conversations_are_one_row(spark):
    turns = [(1, s, k, "assistant" if k % 2 else "user", f"{k}" if k < 700 else f"{s}{k}") for s in ("chosen", "rejected") for k in range(1000)]
    got = chat_format.preference(spark.createDataFrame(turns, "pair long, side string, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0]["prompt_turns"] == 700 and got[0]["prompt"].count("<|im_start|>") == 700
    for side in ("chosen", "rejected"):
        spans = [got[0][side][int(a) : int(z)] for a, z in (m.split(":") for m in got[0][f"{side}_mask"].split(","))]
        assert spans == [f"{side}{k}<|im_end|>" for k in range(701, 1000, 2)]


def test_turns_without_a_number_stay_apart(spark):
    turns = [(1, s, k, "user", t) for s in ("chosen", "rejected") for k, t in ((None, "none"), (-1, "minus"), (0, f"{s}"))]
    got = chat_format.preference(spark.createDataFrame(turns, "pair long, side string, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0]["prompt_turns"] == 2 and got[0]["prompt"].index("none") < got[0]["prompt"].index("minus")


def test_chat_query_odd_rows(spark, tmp_path):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "z"), (7, None, "user", "q"), (7, None, "user", "q"), (7, -1, "user", "r"), (7, 3, "assistant", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_format.op10(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 7, None} and got[0]["prompt"].count("im_start") == 1 and got[7]["prompt_turns"] == 3
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert chat_format.op10(spark, f"{tmp_path}/e").count() == 0
