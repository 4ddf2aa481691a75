import zlib

import duckdb

from kairoframe.llm import language_id, lattice, lm_scoring, quality
from kairoframe.llm.common import TOKENIZERS
from kairoframe.llm.decontaminate import Index

SF = "/root/testdata/sf0.01"


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def test_quality_on_held_out(spark):
    got = {r["doc_id"]: r for r in quality.op1(spark, SF).collect()}
    labels = dict(table("labels", "doc_id, quality"))
    held = [(got[i]["predicted"], got[i]["score"], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(p == y for p, _, y in held) / len(held) > 0.95
    assert sum(s < 0.5 for _, s, y in held if y == 0) / sum(y == 0 for *_, y in held) > 0.7


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, 0), (4, 0, 0)], "doc_id long, good int, part int")
    model = quality.fit(odd, labels)  # too little for dictionaries
    rows = quality.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    trained = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as good", "cast(doc_id % 2 as int) as part"))
    assert trained.good and len({(r["doc_id"], r["score"]) for r in quality.scored(odd, trained).collect()}) == odd.dropDuplicates(["doc_id", "text"]).count()
    assert quality.scored(none, trained).count() == 0


def test_language_on_held_out(spark):
    got = {r["doc_id"]: r for r in language_id.op9(spark, SF).collect()}
    langs = dict(table("documents", "doc_id, lang"))
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_language_odd_rows(spark, odd, none):
    langs, logp = language_id.fit(odd.select("doc_id", "text", "lang"))
    assert langs == ["en", "fr"]
    got = language_id.predict(odd, langs, logp).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert language_id.predict(none, langs, logp).count() == 0
    assert language_id.fit(none.select("doc_id", "text", "lang"))[0] == []
    assert {r["lang_pred"] for r in language_id.predict(odd, [], logp[:, :0]).collect()} == {"und"}
    kept = language_id.recognised(odd)
    assert kept.columns == odd.columns and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}


def test_languages_without_spaces(spark):
    """Each text is one long word; the even ids are learned from, the odd ones are held out."""
    import random

    rng = random.Random(5)
    letters = {"ja": "のはをにがたでとしてれいなるこ日本人", "th": "กขคงจชดตถนบปมยรลวส", "zh": "的一是不了人我在有他这中大来上国", "zz": "あかきくけさすせそちつぬねひふ東京"}
    rows = [(i, "".join(rng.choice(letters[k]) for _ in range(90)), k) for i, k in enumerate(list(letters) * 40)]
    learn = lambda i: i // 4 % 2 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for some in (["ja", "zh"], list(letters)):
        own = docs.filter(docs.lang.isin(some))
        langs, logp = language_id.fit(own.filter("doc_id div 4 % 2 = 0"))
        got = {r["doc_id"]: r for r in language_id.predict(own.filter("doc_id div 4 % 2 = 1"), langs, logp).collect()}
        assert len(got) == 20 * len(some)
        assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.9 for i, _, k in rows if k in some and not learn(i))
    assert language_id.recognised(docs).count() == len(rows)


def test_more_languages_than_a_block(spark, monkeypatch):
    """Blocks of languages give the languages and scores of one block; letters are those of Unicode's category L."""
    rows = [(i, f"{w} {w}x", lang) for i, (w, lang) in enumerate([("alpha", "a"), ("beta", "b"), ("gamma", "c"), ("delta", "d"), ("zeta", "e")] * 4)]
    docs = spark.createDataFrame([*rows, (90, "\u00b2 \u00bd \u2167 12", None), (91, None, "a"), (None, "alpha", None)], "doc_id long, text string, lang string")
    langs, logp = language_id.fit(docs.filter("doc_id < 50"))
    want = sorted(map(str, language_id.predict(docs, langs, logp).collect()))
    kept = sorted(map(str, language_id.recognised(docs).collect()))
    assert langs == list("abcde") and "Row(doc_id=90, lang_pred='und', score=0.0)" in want
    monkeypatch.setattr(language_id, "LANGS", 2)
    got = {r["doc_id"]: r for r in language_id.predict(docs, langs, logp).collect()}
    for line in language_id.predict(docs, langs, logp).collect():
        assert got[line["doc_id"]]["lang_pred"] == line["lang_pred"]
    monkeypatch.setattr(language_id, "LANGS", 64)
    one = {r["doc_id"]: r for r in language_id.predict(docs, langs, logp).collect()}
    assert all(one[d]["lang_pred"] == got[d]["lang_pred"] and abs(one[d]["score"] - got[d]["score"]) < 1e-12 for d in one)
    monkeypatch.setattr(language_id, "LANGS", 2)
    assert sorted(map(str, language_id.recognised(docs).collect())) == kept


def _naive(pieces, logp, word):
    """Log probability of a word and the expected uses of each piece, character by character, in plain floats."""
    import math
    from collections import Counter

    text = lattice.MARK + word
    edges = [(i, j, [pieces.ids[text[i:j]]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.ids]
    edges += [(i, i + 1, pieces.spelt(text[i])) for i in range(len(text)) if text[i] not in pieces.ids]
    a, b = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    for i, j, ids in sorted(edges):
        a[j] += a[i] * math.exp(sum(logp[p] for p in ids))
    for i, j, ids in sorted(edges, reverse=True):
        b[i] += b[j] * math.exp(sum(logp[p] for p in ids))
    uses = Counter()
    for i, j, ids in edges:
        for p in ids:
            uses[p] += a[i] * math.exp(sum(logp[q] for q in ids)) * b[j] / a[-1]
    return math.log(a[-1]), uses


def test_language_query_against_brute_force(spark, tmp_path):
    """Predictions and scores of the query, from a model learned and summed by hand."""
    import math
    import random

    rng, words = random.Random(2), {"x": ["lorem", "ipsum", "dolor"], "y": ["gratia", "plena", "dominus"], "z": ["日本語", "東京", "大阪"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 25))), k) for i, k in enumerate(list(words) * 14)]
    rows += [(900, "lorem dominus", None), (901, "123 ²", "x"), (902, "", "y"), (None, "plena", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op9(spark, str(tmp_path)).collect()}
    pieces = lattice.Pieces(language_id.VOCABULARY)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    model = {}
    for k in words:
        counts, logp = {}, pieces.initial()
        for d, t, lang in rows:
            if lang == k and not held(d):
                for w in t.split():
                    counts[w] = counts.get(w, 0) + 1
        for _ in range(language_id.ROUNDS):
            total = lattice.np.zeros(pieces.size)
            for w, c in counts.items():
                for p, n in _naive(pieces, logp, w)[1].items():
                    total[p] += c * n
            logp = lattice.reestimated(total)
        model[k] = logp
    for d, t, _ in rows:
        n = len(t.split())
        if d in (901, 902):
            assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0
            continue
        x = {k: sum(_naive(pieces, logp, w)[0] for w in t.split()) * min(n, 12) / n for k, logp in model.items()}
        best = max(x, key=x.get)
        assert got[d]["lang_pred"] == best and got[d]["held_out"] == held(d)
        assert abs(got[d]["score"] - 1 / sum(math.exp(v - x[best]) for v in x.values())) < 1e-6


def test_lm_score_against_brute_force(spark, tmp_path):
    """The lattice's score of the query, from a model learned and summed by hand."""
    import collections
    import math

    rows = [(i, t) for i, t in enumerate(["the cat sat", "The CAT", "on the mat 日本", None, "", "x" * 70, "unseen words here", "cat mat"] * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.op7(spark, str(tmp_path)).collect()}
    pieces = lattice.Pieces(lm_scoring.VOCABULARY)
    train = [(t or "").lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    total, start = lattice.np.zeros(pieces.size + 1), pieces.initial()
    for w, c in collections.Counter(w for ws in train for w in ws).items():
        for p, n in _naive(pieces, start, w)[1].items():
            total[p] += c * n
    total[-1] = len(train)
    logp = lattice.reestimated(lattice.np.round(total, 6))
    for i, t in rows:
        want = (sum(_naive(pieces, logp, w)[0] for w in (t or "").lower().split()) + logp[-1]) / math.log(10)
        assert abs(got[i] - want) < 1e-5


def test_lattice_against_all_segmentations():
    pieces = lattice.Pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    logp = pieces.initial()
    words = ["the", "über", "", "a", "日x", "\U0001f600", "retitio"]
    got = lattice.log_likelihood(pieces, logp[:, None], words)[:, 0]
    assert all(abs(g - lattice.brute_force(pieces, logp, w)) < 1e-9 for g, w in zip(got, words, strict=True))
    long = "retition" * 20
    assert abs(lattice.log_likelihood(pieces, logp[:, None], [long])[0, 0] - lattice._alone(pieces, logp[:, None], {}, lattice.MARK + long)[0]) < 1e-9
    counts = lattice.expected_counts(pieces, logp, ["the"], lattice.np.array([2.0]))
    assert 2 <= counts.sum() <= 8


def test_long_words_are_counted(monkeypatch):
    """Words of over LONG characters, done alone, count as words of equal length done together do."""
    pieces = lattice.Pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    words, weights = ["retition" * 20, "日本語の文" * 30, "a\U0001f600" * 50, "ab" * 31, "ab" * 32, "the"], lattice.np.arange(1.0, 7.0)
    got = lattice.expected_counts(pieces, pieces.initial(), words, weights)
    monkeypatch.setattr(lattice, "LONG", 10**9)
    want = lattice.expected_counts(pieces, pieces.initial(), words, weights)
    assert abs(got - want).max() < 1e-9 and got[pieces.ids["日"]] > 1


def test_lm_learns_from_unspaced_texts(spark):
    pieces = lattice.Pieces(lm_scoring.VOCABULARY)
    train = spark.createDataFrame([("日本語の文" * 30,)], "text string")
    logp = lm_scoring.piece_model(lm_scoring.word_counts(train), 1)
    want = lattice.reestimated(lattice.np.append(lattice.np.round(lattice.expected_counts(pieces, pieces.initial(), ["日本語の文" * 30], lattice.np.ones(1)), 6), 1))
    assert abs(logp - want).max() < 1e-9
    assert logp[pieces.ids["日"]] > logp[pieces.ids["the"]] + 2


def test_lm_scores_against_brute_force(spark, tmp_path, odd):
    import collections
    import math

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_scoring.op7(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + ["END"]) for r in odd.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_decontamination_tolerates_any_one_word():
    item = [f"w{i}" for i in range(20)]
    index = Index([(7, " ".join(item)), (8, "too short"), (9, None), (10, "five words make one window")])
    from kairoframe.llm.decontaminate import word_hashes
    from kairoframe.llm.jaccard_join import Hashes

    h = Hashes()
    clean = [f"x{i}" for i in range(30)]
    for at in range(12):
        part = item[3:15]
        part[at] = "other"
        found = index.overlaps(word_hashes(" ".join(clean + part + clean), h))
        inner = 0 < at < 11  # at an end the rest is a word too short
        assert (list(found) == [0]) == inner
    assert index.overlaps(word_hashes(" ".join(clean + item[:8] + clean), h)) == {}
    assert list(index.overlaps(word_hashes("say Five words make ONE window now", h))) == [3]
    assert list(index.overlaps(word_hashes("too short", h))) == [1] and index.overlaps(word_hashes("now too short", h)) == {}
