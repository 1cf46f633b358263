"""What the pipeline's last stage holds in memory at a time."""

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_texts_are_encoded_in_small_slices(spark, monkeypatch):
    """A batch of 1 MB goes to the coder in slices of SLICE_BYTES, give or take a row, with all rows in order."""
    functions, sizes = [], []
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(bpe, "map_arrow", lambda df, f, schema: functions.append(f) or spark.createDataFrame([], schema))
    bpe.encode_column(docs, decode=True)
    own = bpe.coder(bpe.default_vocabulary())
    encode = own.encode
    monkeypatch.setattr(own, "encode", lambda texts: sizes.append(sum(map(len, texts))) or encode(texts))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 400)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = pa.Table.from_batches(list(functions[0](iter([batch])))).to_pydict()
    assert sum(sizes) == sum(map(len, texts)) > 900_000
    assert max(sizes) <= 300_000
    assert out["id"] == list(range(500))
    flat, at = encode(texts)
    assert out["ids"] == [flat[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]


def test_tokens_begin_with_shrunk_heaps(spark):
    """The garbage of the stages before is collected where the tasks run (here in the one JVM) before Python workers need memory."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    before = full()
    rows = corpus_pipeline.tokens(spark, docs, "").collect()
    assert full() > before
    assert [r.doc_id for r in rows] == [1]
