"""The registered queries over small difficult tables and over empty ones: names, types, rows."""

import pytest

from quillon.llm.queries import ORACLES, QUERIES

from .conftest import SCHEMA, rows

CONTRACT = {
    "op1_mixing": {"doc_id": "bigint", "tokens": "bigint", "p_good": "double", "p_poor": "double", "p_toxic": "double", "rate": "double"},
    "op2_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op3_token_counts": {"doc_id": "bigint", "n_tokens": "bigint", "n_tokens_edited": "bigint", "n_chars_edited": "bigint", "n_chars_encoded": "bigint", "n_chars_encoded_again": "bigint"},
    "op4_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "host_failed": "boolean"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_sstable": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op11_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "virtual_slot": "int", "map_version": "int"},
    "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
}
VECTORS = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (2, [0.25, -3.0, 1.0]), (None, [1.5, 4.0, -1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0])]
PAGES = [(1, "u", "<article><p>Some text of a page, with words.</p></article>", "x", 1), (1, "u", None, "x", 2), (2, None, "", "x", 3), (None, "v", "<nav><a href='/'>Home</a></nav>", None, 4)]


def tables(spark, path, documents, pages, labels, vectors):
    spark.createDataFrame(documents, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars long").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, n long, component int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls, repeats, ties, a text of a megabyte, and columns whose names are those of results."""
    long = (20, "one long text of words that go on. " * 30_000, "en", "c", None, 5, "x", -1, 3, 0.5, "y")
    return tables(spark, str(tmp_path_factory.mktemp("hard")), [*rows(), long], PAGES, [(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (999, 1, 0)], VECTORS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), [], [], [], [])


def test_every_query_has_its_contract():
    assert QUERIES.keys() == CONTRACT.keys() and ORACLES.keys() <= CONTRACT.keys()


@pytest.mark.parametrize("name", CONTRACT)
def test_query_on_difficult_rows(spark, hard, name):
    out = QUERIES[name](spark, hard)
    assert dict(out.dtypes) == CONTRACT[name]
    got = out.collect()
    if name == "op6_html":
        assert sorted(((r.page_id, r.text, r.n_chars) for r in got), key=repr) == sorted([(1, "Some text of a page, with words.", 32), (1, "", 0), (2, "", 0), (None, "", 0)], key=repr)
        return
    if name == "op12_whitening":  # three different vectors differ in two directions
        assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted([(i, c) for i in (1, 1, 2, None) for c in (1, 2)], key=repr)
        assert all(r.n == 3 and r.identity_error < 1e-9 for r in got)
        return
    if name == "op13_divergence":
        sources = {(r[2] or "", r[3] or "") for r in [*rows(), (20, "", "en", "c")]}
        assert {(r.lang, r.source, r.item) for r in got if r.part == "pair"} == {(l, a, b) for l, a in sources for k, b in sources if k == l and a != b}
        return
    # one row for each row, repeated ones too
    assert sorted((r.doc_id for r in got), key=repr) == sorted([*(r[0] for r in rows()), 20], key=repr)
    for column, kind in CONTRACT[name].items():
        if column not in ("doc_id", "first_word", "last_word", "keep_id", "component_id", "grown_shard"):
            assert all(r[column] is not None for r in got), column
    for column in ("score", "p_good", "p_poor", "p_toxic"):
        assert column not in CONTRACT[name] or all(0 <= r[column] <= 1 for r in got)


@pytest.mark.parametrize("name", CONTRACT)
def test_query_on_empty_tables(spark, empty, name):
    out = QUERIES[name](spark, empty)
    assert dict(out.dtypes) == CONTRACT[name] and out.count() == 0


def test_pipeline_on_difficult_and_empty_tables(spark, hard, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    kind = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    for folder in (hard, empty):
        out = pipeline.run(spark, folder)
        assert dict(out.dtypes) == kind
        got = [r.doc_id for r in out.collect()]
        assert len(got) == len(set(got)) and (folder == hard) == bool(got) and not {4, 5, 6, 7} & set(got)
