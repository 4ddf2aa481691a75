import collections

import corpus_pipeline
from kairoframe.llm import jaccard_join, token_output

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = jaccard_join.stored(docs, "stage")
            rows[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    start = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, single, clean, mix = (rows[n] for n, _ in corpus_pipeline.STAGES[:4])
    assert len(first) > 0.98 * len(start)
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for d, t in first for w in [t.encode().lower().split()]}
    rule = jaccard_join.Rule(5, 80, 100)
    kept = {d for d, _ in single}
    near = lambda a, b: rule.linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]))
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    up = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and near(a, b):
                x, y = sorted((up[a], up[b]))
                up = {k: x if v == y else v for k, v in up.items()}
    assert kept == set(up.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for _, t in clean for i in items)
    assert {d for d, t in single if not any(i in t for i in items)} - {d for d, _ in clean} == set()
    assert set(mix) == set(clean) and max(collections.Counter(mix).values()) <= 3
    n = sum(-(-(len(token_output.encoder().encode_ordinary(t)) + 1) // token_output.LENGTH) for _, t in mix)
    assert sum(r["n_slots"] for r in docs.select("n_slots").collect()) == n


def test_odd_and_empty_tables(spark, tmp_path, odd, none):
    """Nulls in any column, repeated rows and ids, long texts, clashing names; a contaminated document; nothing at all."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    more = spark.createDataFrame([(30, f"well then {item} and so on", "en", "a", 80, 99, "keep", 1.5)], odd.schema)
    spark.createDataFrame([(1, item), (2, None), (None, ""), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in (("odd", odd.unionByName(more)), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    ids = [i for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect() for i in r["doc_ids"]]
    assert not {1, 2, 3, 8, 30} & set(ids) and {4, 5, None} <= set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
