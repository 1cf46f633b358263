"""Long fingerprints and near copies against plain sets of shingles."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import near

from .conftest import rows


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def alike(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited(rng, text, edits):
    w = text.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Clean texts, copies with 0 to 14 words changed, copies of copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(150, 400))) for i in range(300)}
    for i in range(300, 500):
        texts[i] = edited(rng, texts[rng.randrange(i) if i > 400 else rng.randrange(300)], rng.randrange(15))
    return texts


def test_expected_bits():
    """Texts alike to a share differ in about the expected bits, clean ones in half."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = " ".join(rng.choices(words, k=2000))
    for edits in (0, 20, 60, 120):
        other = edited(rng, base, edits)
        bits = int(np.bitwise_count(near.fingerprint(base) ^ near.fingerprint(other)).sum())
        p = near.differing(alike(base, other)) if edits else 0
        assert abs(bits - near.BITS * p) <= 4 * (near.BITS * p * (1 - p)) ** 0.5
    far = near.fingerprint(" ".join(rng.choices(words, k=300)))
    assert abs(int(np.bitwise_count(far ^ near.fingerprint(base)).sum()) - 256) < 60
    assert not near.fingerprint(None).any() and not near.fingerprint(" \n").any() and near.fingerprint("one two").any()
    assert (near.fingerprint("A b C d E f") == near.fingerprint("a B c D e F")).all()


def test_cell_links_equal_brute_force():
    """Components of one cell, over random points, chains and dense groups; links are real ones."""
    rng = np.random.default_rng(5)
    for n, most in ((1, 40), (2, 40), (90, 200), (300, 225), (500, 235), (700, 40)):
        fp = rng.integers(0, 1 << 63, (n, near.WORDS)).astype(np.uint64)
        for i in range(max(1, n // 3), n):  # a third are new, others lie near one before
            fp[i] = fp[rng.integers(0, i)] ^ (np.uint64(1) << rng.integers(0, 64, near.WORDS).astype(np.uint64))
            for _ in range(int(rng.integers(0, 5))):
                fp[i] ^= np.uint64(1) << rng.integers(0, 64, near.WORDS).astype(np.uint64)
        fp = fp[np.argsort(np.bitwise_count(fp).sum(axis=1), kind="stable")]
        apart = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2)
        left, right = near.cell_links(fp, most)
        assert (apart[left, right] <= most).all()

        def classes(pairs):
            label = list(range(n))
            root = lambda i: i if label[i] == i else root(label[i])
            for a, b in pairs:
                label[root(a)] = root(b)
            return [root(i) for i in range(n)]

        same = lambda c: [[x == y for y in c] for x in c]
        got = classes(zip(left.tolist(), right.tolist()))
        want = classes(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= most, 1)))))
        assert len(set(got)) == len(set(want)) and same(got) == same(want)
        assert len(left) == n - len(set(want))


@pytest.mark.parametrize("strip", [near.STRIP, 3])
def test_copies_are_found_and_clean_texts_stay(spark, corpus, strip, tmp_path):
    spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    prints, classes = near.near_classes(docs, ["doc_id"], strip=strip)
    root = {r.doc_id: r.root for r in prints.join(classes, "fp").select("doc_id", "root").collect()}
    pairs = [(alike(corpus[a], corpus[b]), a, b) for b in range(500) for a in range(b) if len(shingles(corpus[a]) & shingles(corpus[b])) > 20]
    close, far = [p for p in pairs if p[0] >= 0.8], [p for p in pairs if p[0] < 0.6]
    caught = sum(root[a] == root[b] for _, a, b in close)
    assert len(close) > 100 and caught / len(close) >= 0.9
    assert all(root[a] == root[b] for j, a, b in close if j > 0.9)
    linked = {i for _, a, b in pairs for i in (a, b)}
    roots = [root[i] for i in range(500) if i not in linked]
    assert len(set(roots)) == len(roots) and len(roots) > 100 and far is not None
    left = {r.doc_id for r in near.drop_near_copies(docs, strip=strip).collect()}
    assert left == {min(i for i in root if root[i] == r) for r in set(root.values())}


def test_keys_grow_with_the_table():
    assert [near.key_bits(n) for n in (0, 1, 10**4, 10**6, 10**9)] == [4, 4, 6, 12, 22]
    for width in (4, 10, 20):
        p = (1 - near.differing(0.8)) ** width
        assert 1 - (1 - p) ** near.table_count(width) >= near.RECALL
        bits = near.chosen_bits(width, near.table_count(width))
        assert all(len(set(b)) == width for b in bits.tolist()) and len({tuple(b) for b in bits.tolist()}) == len(bits)


def test_difficult_rows(spark, docs, nothing):
    got = near.drop_near_copies(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids, key=repr) == sorted({1, 2, 4, 7, 9, None, 8} & set(ids), key=repr) and len(ids) == len(set(ids)) and {1, 2, 4, 7, 9} <= set(ids)
    assert len(rows()) > len(ids) and near.drop_near_copies(nothing).count() == 0
    same = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("one text of several words that all have").alias("text"))
    assert [r.doc_id for r in near.drop_near_copies(same).collect()] == [0]


def classes_by_force(texts, share=0.8):
    """The class of each text: of all pairs alike to the share, by their sets of shingles."""
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    root = lambda i: i if label[i] == i else root(label[i])
    for b in texts:
        for a in texts:
            if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_no_link_is_lost_or_made_at_the_edge(spark):
    """Pairs just above and just below 0.8, a common passage, a large group that hangs together by some of its pairs only."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda k: " ".join(rng.choices(words, k=k))
    passage, texts = draw(40), {}
    for i in range(100):
        base = draw(rng.randrange(60, 400))
        texts[2 * i] = f"{passage} {base}" if i % 3 == 0 else base
        n = len(texts[2 * i].split()) - 4
        texts[2 * i + 1] = f"{texts[2 * i]} {draw(n // 4 + i % 2)}"  # n of n + n // 4 shingles are common, or one fewer of them
    template = draw(90)
    for i in range(200, 260):
        texts[i] = edited(rng, template, rng.randrange(1, 3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = classes_by_force(texts)
    assert sum(want[2 * i] == want[2 * i + 1] for i in range(100)) >= 50 and want[1] == 0
    assert sum(want[2 * i] != want[2 * i + 1] for i in range(100)) >= 10 and 1 < len({want[i] for i in range(200, 260)}) < 60
    prints, classes = near.near_classes(docs, ["doc_id"])
    root = {r.doc_id: r.root for r in prints.join(classes, "fp").select("doc_id", "root").collect()}
    assert len(set(root.values())) == len(set(want.values())) == len({(root[i], want[i]) for i in texts})
    assert {r.doc_id for r in near.drop_near_copies(docs).collect()} == set(want.values())


def test_large_sets_are_ruled_out_unread(spark):
    """Of large texts with a passage in common BITS parities rule out nothing; those by size leave the pairs that are alike, or nearly so."""
    rng = random.Random(13)
    draw = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    passage, texts = draw(60), []
    for size in (700, 2500, 2900, 9000):
        for _ in range(6):
            base = f"{passage} {draw(size)}"
            texts += [base, f"{base} {draw(size // 4)}", edited(rng, base, size // 200)]
    sets = [near.shingles(t) for t in texts]
    for s in sets:
        wide = near.wide_parity(s)
        assert len(s) <= 64 * len(wide) < 2 * max(near.BITS, len(s)) and (near.fold(wide, near.WORDS) == near.parity(s)).all()
    held = [(i, len(s), near.wide_parity(s).tobytes()) for i, s in enumerate(sets)]
    unique = spark.createDataFrame(held, "id long, size int, wide binary")
    every = [(a, b) for b in range(len(sets)) for a in range(b)]
    share = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in every}
    left = {tuple(r) for r in near.possible(spark.createDataFrame(every, "u long, v long"), unique, Fraction("0.8")).collect()}
    assert {p for p in every if share[p] >= 0.8} <= left <= {p for p in every if share[p] >= 0.6} and len(left) >= 24
    narrow = [(a, b) for a, b in every if 9 * int(np.bitwise_count(near.parity(sets[a]) ^ near.parity(sets[b])).sum()) <= len(sets[a]) + len(sets[b])]
    assert len(narrow) > 10 * len(left)
