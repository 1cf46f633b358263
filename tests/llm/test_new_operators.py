"""Sharding, whitening and divergence against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import divergence, slots, whitening
from quillon.llm.common import scratch

from .conftest import rows

# -- sharding by virtual slots


def test_shards_of_difficult_rows(docs):
    got = slots.assign(docs, 3).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()), key=repr)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= {0, 1, 2}


def test_empty_table_has_no_shards(nothing):
    assert slots.assign(nothing).collect() == []


def test_shards_are_even(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.abs(F.hash("id")) % 300).cast("int")).alias("text"))
    got = slots.assign(docs).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("place").alias("p"), F.max("place").alias("m")).collect()
    sizes = [r.b for r in got]
    assert len(got) == 24 and max(sizes) - min(sizes) <= 100 and all(r.n == r.p == r.m + 1 for r in got)


def test_a_hot_record_is_dealt_out(spark):
    """A third of all rows are one document, identifier and all; their slot is split and the shards stay even."""
    docs = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("some text of a document").alias("text"))
    folder = scratch(spark, "slots")
    got = slots.assign(docs, 6, folder)
    sizes = [r.n for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 0.01 * max(sizes)
    hot = slots.load(spark, folder).hot()
    assert got.filter("doc_id = -1").select("virtual_slot").distinct().collect()[0][0] in hot


def test_versions_of_a_map(spark, docs):
    """A second call goes on from the version before; slots whose records didn't change seldom move."""
    folder = scratch(spark, "slots")
    base = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    one = {r.doc_id: r.shard for r in slots.assign(base, 5, folder).collect()}
    seen = slots.versions(spark, folder)
    first, last = slots.load(spark, folder, 1), slots.load(spark, folder)
    assert seen == list(range(1, last.version + 1)) and first.shard == slots.first_map(5).shard
    again = {r.doc_id: r.shard for r in slots.assign(base, 5, folder).collect()}
    assert again == one and slots.versions(spark, folder) == seen
    more = base.unionByName(base.filter("doc_id < 500").withColumn("doc_id", F.col("doc_id") + 10_000))
    moved = sum(r.shard != one[r.doc_id] for r in slots.assign(more, 5, folder).collect() if r.doc_id in one)
    assert moved < 500 and slots.versions(spark, folder)[-1] > seen[-1]
    with pytest.raises(FileExistsError):
        slots.publish(spark, folder, last)


def test_rebalancing_and_growing():
    rng = np.random.default_rng(3)
    old = slots.first_map(7, 2000)
    size = {(s, 0): int(rng.pareto(1.5) * 100) for s in range(2000)}
    total = lambda m: [sum(size[k] for k, s in m.shard.items() if s == n) for n in range(m.shards)]
    even = slots.rebalance(old, size)
    assert max(total(even)) - min(total(even)) < max(total(old)) - min(total(old)) and even.version == 2
    assert max(total(even)) - min(total(even)) <= 2 * min(v for v in size.values() if v)
    assert slots.rebalance(even, size).shard == even.shard and slots.rebalance(even, {}).version == 2
    grown = slots.grow(even, size)
    moved = {k for k in even.shard if even.shard[k] != grown.shard[k]}
    assert moved and all(grown.shard[k] == 7 for k in moved) and grown.version == 3
    assert abs(total(grown)[7] - sum(size.values()) / 8) < 0.02 * sum(size.values()) / 8
    split = slots.split(even, [5])
    assert {split.shard[5, p] for p in range(slots.PARTS)} == {even.shard[5, 0]} and split.hot() == [5]


# -- whitening


def plain_fit(vectors):
    x = np.array([[int(np.floor(np.float32(c).astype(float) * 64)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    z = np.unique(x, axis=0).astype(float)
    centred = z - z.mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(z))
    return x, z, values[::-1], turn[:, ::-1]


def test_whitening_is_that_of_a_full_decomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((700, 30)) * np.linspace(3, 0.2, 30)).tolist()
    vectors += vectors[:50] + [vectors[0]] * 300
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = whitening.whitened(frame, 16).collect()
    x, z, values, turn = plain_fit(vectors)
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {len(z)} and max(r.identity_error for r in got) < 1e-9
    sums = [int(s) for s in z.sum(axis=0)]
    white = np.zeros((len(vectors), 16))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        if r.component == 1:
            assert r.deviation == sum((len(z) * int(a) - s) ** 2 for a, s in zip(x[r.vec_id], sums))
    want = (x - z.mean(axis=0)) @ turn[:, :16] / np.sqrt(values[:16])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-7


@pytest.mark.parametrize("spread", [np.linspace(1, 0.98, 120), np.r_[np.ones(40) * 5, np.ones(80)], 0.5 ** np.arange(120)])
def test_subspace_certifies_near_and_equal_eigenvalues(spread):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((120, 120)))
    matrix = (q * spread) @ q.T
    values, vectors, passes = whitening.subspace(lambda b: matrix @ b, 120, 16, held=3)
    assert np.abs(values - np.sort(spread)[::-1][:16]).max() < 1e-12 * spread.max()
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * spread.max() and np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_components_that_cannot_be_certified_are_an_error():
    with pytest.raises(ArithmeticError):
        whitening.subspace(lambda b: np.linspace(1, 0.98, 300)[:, None] * b, 300, 16, passes=2)


def test_vectors_all_alike_have_no_components(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whitened(frame).collect() == []


def test_large_entries(spark):
    """Sums beyond a long, deviations that don't fit in one."""
    frame = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e10, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened(frame).collect()
    assert len(got) == 3 and all(r.deviation is None for r in got)  # the second direction is nothing beside the first
    assert whitening._deviation(np.array([[10, 20], [1 << 40, 3]]), np.array([9, 21]), 3, np.array([1, 2])) == [(3 - 1) ** 2 + (-3 - 2) ** 2, None]


# -- divergence


def plain_audit(table, least=10, top=10):
    words = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    own, stands = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        found = words.findall((text or "").translate(lower))
        own[lang or "", source or ""].update(found)
        stands[lang or ""].update(set(found))
    out = []
    for lang in {l for l, _ in own}:
        kept = [t for t, n in stands[lang].items() if n >= least]
        groups = {s: own[l, s] for l, s in own if l == lang}
        every = sum((c for c in groups.values()), Counter())

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // total for t in kept}

        share, q = {s: shares(c) for s, c in groups.items()}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in share.items():
            pairs = [(-sum(f(p[t], r[t]) for t in kept), o.encode(), o) for o, r in share.items() if o != s]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    vocabulary = ["the", "Of", "naïve", "über", "日本", "x1y", "İß", "zz", "a\x00b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    table = []
    for i in range(400):
        lang = [None, "", "en", "de", "fr"][rng.integers(5)]
        source = ["hot", "hot", "hot", "b", "ß", None, f"rare{i}"][rng.integers(7)]
        n = int(rng.integers(0, 40))
        table.append((None if i % 17 == 0 else " ".join(rng.choice(vocabulary, n)), lang, source))
    return table + [("12 34 !!", "it", "only")] * 3 + [("one two", "xx", "p"), ("three", "xx", "q")] + [table[1]] * 30


def test_divergence_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "text string, lang string, source string").withColumn("term", F.lit(1)).repartition(5)
    for least, size in ((10, divergence.SHARD_ROWS), (3, 100)):
        got = sorted(tuple(r) for r in divergence.audit(docs, least=least, shard_rows=size).collect())
        assert got == plain_audit(corpus, least)


def test_term_counts(spark, corpus):
    """Occurrences by group and term, and of each group its documents under the empty term."""
    docs = spark.createDataFrame([(t or "", l or "", s or "") for t, l, s in corpus], "text string, lang string, source string")
    want = sorted(tuple(r) for r in divergence.term_counts(docs).collect())
    assert sum(r[4] for r in want if r[2] == "") == len(corpus)
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    seen = Counter((l or "", s or "", t) for x, l, s in corpus for t in re.findall(divergence.TERM, (x or "").translate(lower)))
    assert {r[:3]: r[3] for r in want if r[2]} == dict(seen)


def test_divergence_sql(spark, corpus, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(corpus)], "doc_id long, text string, lang string, source string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(db.execute(divergence.OP13_SQL).fetchall()) == plain_audit(corpus)
