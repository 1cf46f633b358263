"""The pipeline's stages against what they must keep and drop."""

import pytest
import regex

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_copies", "near_copies", "mixture", "tokens"]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, base).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "tokens":
            assert after.columns == docs.columns
        if name == "exact_copies":
            from quillon.llm.exact import normalised
            from pyspark.sql import functions as F

            assert after.count() == docs.select(normalised(F.col("text"))).distinct().count()
        if name == "near_copies":
            shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
            had, kept = {r.doc_id: shingles(r.text) for r in docs.collect()}, {r.doc_id for r in after.collect()}
            alike = lambda a, b: len(a & b) / len(a | b)
            assert all(any(alike(had[i], had[k]) > 0.5 for k in kept) for i in had.keys() - kept)  # what went is like something that stays
            assert not any(alike(had[i], had[k]) > 0.9 for i in kept for k in kept if i < k)
        if name == "tokens":
            assert after.count() == docs.count()
        if name == "language":
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in docs.collect() if r.text and regex.search(r"\p{L}", r.text))
        if name == "mixture":
            kept, had = ({r.doc_id for r in d.collect()} for d in (after, docs))
            assert after.count() == len(kept) and kept <= had
            labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
            share = lambda own: sum(i in kept for i in own) / max(1, len(own))
            assert share([i for i in had if labels.get(i) == (1, 0)]) > 0.85 > 0.6 > share([i for i in had if labels.get(i, (0, 0))[1] == 1])
        docs = after
    assert 0 < docs.count() <= before
