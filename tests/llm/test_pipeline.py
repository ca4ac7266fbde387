import collections

import corpus_pipeline
from headway.llm.common import store

from test_minhash import brute as brute_groups

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = store(stage(spark, docs, DATA), f"test-{name}")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        assert set(ids) <= set(before) and all(r.text == before[r.doc_id] for r in after)
        if name == "near_dedup":
            assert sorted(ids) == [i for i, _, _, kept in brute_groups(sorted(before.items())) if kept]
        if name == "decontamination":
            assert set(before) - set(ids) == {i for i, t in before.items() if any(x in t for _, x in items)}
        if name == "mixing":
            assert max(collections.Counter(ids).values()) <= 2
        if name == "sharding":
            assert len(ids) == n_mixed and {r.shard for r in after}
        else:
            assert docs.columns == columns
        n_mixed = len(ids)


def test_run_and_edges(spark, make_docs):
    rows = [(None, None), (1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (4, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y z")]
    for docs in (make_docs(rows), make_docs(rows).filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, DATA), f"edge-{name}")
        out = docs.collect()
    assert out == []
    assert corpus_pipeline.run(spark, DATA).count() > 0
