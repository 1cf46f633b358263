"""Column functions, grammar and folds: golden values."""

import hashlib
import zlib

from pyspark.sql import functions as F

from quillon.functions import columns as X
from quillon.operators import fusion, relations, sample, screen, segment
from quillon.sources import readers, sinks


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def strings(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_set_measures(spark):
    a, b, none = strings("x", "y"), strings("y", "z"), strings()
    assert one(spark, X.jaccard(a, b), X.jaccard(none, none), X.jaccard(a, F.lit(None).cast("array<string>")), X.set_f1(a, b), X.set_f1(none, none)) == (1 / 3, 1.0, 0.0, 0.5, 1.0)


def test_maps(spark):
    m = F.create_map(F.lit("moaning"), F.lit(0.6), F.lit("whispering"), F.lit(0.93), F.lit("tapping"), F.lit(1.0))
    empty = F.create_map().cast("map<string,double>")
    got = one(spark, X.argmax_key(m, ["moaning", "whispering"]), X.argmax_key(m, ["none"]), X.uncertainty(m), X.uncertainty(empty))
    assert got[:2] == ("whispering", None) and abs(got[2] - 0.8) < 1e-9 and got[3] == 0.0


def test_identifiers(spark):
    u = F.lit("anna/file.m4a_000012345")
    assert one(spark, X.recording_of(u), X.creator_of(u), X.start_of(u), X.filename_safe(u)) == ("anna/file.m4a", "anna", 12.345, "anna_file.m4a_000012345")
    v = F.lit("yt:abc:120")
    assert one(spark, X.recording_of(v), X.start_of(v), X.recording_of(F.lit("fs:9"))) == ("yt:abc", 120.0, "fs:9")


def test_hashes(spark):
    for k in ("a", "src1/7", "ä"):
        assert one(spark, X.crc_split(F.lit(k), 1000), X.sha1_mod10(F.lit(k))) == (zlib.crc32(k.encode()) % 1000, int(hashlib.sha1(k.encode()).hexdigest(), 16) % 10)


def test_labels_and_answers(spark):
    got = one(spark, X.normalise_labels(strings(" Tap ", "BRUSH", "tapping", "x"), {"tap": "tapping", "brush": "brushing"}, ["tapping", "brushing"]), X.parse_answer(F.lit("It is page turning, soft"), ["page", "page turning"]), X.parse_answer(F.lit("a keyboard"), ["page"], [("key", "typing")]))
    assert got == (["tapping", "brushing"], "page turning", "typing")
    t = X.tags(F.lit("Slow Whisper at night"), [("whisper", r"\bwhisper\b"), ("mouth", "mouth")])
    assert one(spark, t, X.override_classes(strings("a", "b"), {"a": ["b"]})) == (["whisper"], ["a"])


def test_runs_and_intervals(spark):
    assert one(spark, X.max_run(F.lit("no no [tag] No, yes")), X.max_run(F.lit(""))) == (3, 0)
    assert abs(one(spark, X.interval_iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)))[0] - 1 / 3) < 1e-9


def test_script_grammar(spark):
    cases = {
        "[tapping]": [("trigger", None, "tapping", 0.65, None)],
        "[soft][brushing]": [("trigger", None, "brushing", 0.5, "soft")],
        "relax now [vigorous][crinkling] and breathe": [("speech", "relax now", None, None, None), ("trigger", None, "crinkling", 0.85, "vigorous"), ("speech", "and breathe", None, None, None)],
        "[soft] just breathe": [("speech", "just breathe", None, None, None)],
        "[tapping][loud]": [("trigger", None, "tapping", 0.65, None)],
        "[soft][brushing][tapping]": [("trigger", None, "brushing", 0.5, "soft"), ("trigger", None, "tapping", 0.65, None)],
        "[ Soft ][ BRUSHING ]": [("trigger", None, "brushing", 0.5, "soft")],
    }
    for text, want in cases.items():
        assert [tuple(x) for x in one(spark, segment.parse_script(F.lit(text)))[0]] == want, text


def test_script_tags_over_whole_texts(spark, tmp_path):
    from quillon.plans import catalogue  # noqa: F401
    from quillon.plans.registry import QUERIES

    long = "word " * 30 + "[soft]\n[crinkling] late\n\nspeech [] [ open " + "[loud] [tapping] x " * 20000
    spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[1:] for r in QUERIES["script_tags"](spark, str(tmp_path)).collect()]
    want = [("trigger", None, "brushing", 0.5, "soft"), ("speech", ("word " * 30).strip(), None, None, None), ("trigger", None, "crinkling", 0.5, "soft"), ("speech", "late speech [] [ open", None, None, None)]
    want += [("trigger", None, "tapping", 0.8, "loud"), ("speech", "x", None, None, None)] * 20000
    assert got == [*want, ("speech", "ok", None, None, None), ("trigger", None, "tapping", 0.65, None)]


def test_registered_rounds_are_the_references(spark, monkeypatch):
    from quillon.plans import agreement_queries, catalogue, metric_queries  # noqa: F401
    from quillon.plans.registry import QUERIES

    seen = {}

    def note(name, argument):
        def f(*a, **b):
            seen[name] = b[argument]
            return (spark.createDataFrame([(1, {"a": 0.5}, ["a"])], "uid int, probs map<string,double>, labels array<string>"), None) if name == "fuse_labels" else spark.createDataFrame([(0.5,)], "conf double")

        return f

    monkeypatch.setattr(agreement_queries.fusion, "fuse", note("fuse_labels", "rounds"))
    monkeypatch.setattr(agreement_queries.fusion, "anchored_em", note("fuse_judges", "rounds"))
    monkeypatch.setattr(metric_queries.metrics, "learnability", note("learnability", "repeats"))
    for name in ("fuse_labels", "fuse_judges", "learnability"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"fuse_labels": 30, "fuse_judges": 50, "learnability": 5}


def entry(kind, start, end, word=None):
    return {"type": kind, "start": start, "end": end, "word": word}


SPLITS = [
    ([("word", 0, 0.4, "hello"), ("word", 0.5, 1.2, "there")], [(0, 1.2, "speech", "hello there")]),
    ([("word", 0, 1, "one"), ("word", 3, 4.2, "two")], [(0, 1, "speech", "one"), (3, 4.2, "speech", "two")]),
    ([("word", 0, 0.3, "hi")], []),
    ([("silence", 0, 5, None)], [(0, 5, "trigger_candidate", None)]),
    ([("silence", 0, 13, None)], [(0, 12, "trigger_candidate", None)]),
    ([("silence", 0, 60, None)], [(i * 12, i * 12 + 12, "trigger_candidate", None) for i in range(5)]),
    ([("word", i * 0.5, i * 0.5 + 0.5, "w") for i in range(60)], [(0, 20, "speech", " ".join("w" * 40)), (20, 30, "speech", " ".join("w" * 20))]),
    ([("word", 2, 1, "bad"), ("word", None, 1, "bad"), ("word", float("nan"), 1, "bad"), ("word", 0, float("nan"), "bad"), ("other", 0, 9, None)], [(0, 9, "trigger_candidate", None)]),
    # a phrase ends with its last word, blank ones are none, and white space is collapsed
    ([("word", 0, 3, "long"), ("word", 1, 2, " short \n one ")], [(0, 2, "speech", "long short one")]),
    ([("word", 0, 2, " "), ("word", 2, 4, None)], []),
    ([("word", 0, 2, "a"), ("noise", 2, 4, None), ("word", 4, 6, "b")], [(0, 2, "speech", "a"), (2, 4, "trigger_candidate", None), (4, 6, "speech", "b")]),
    ([("silence", 0, 5, None), ("word", 5, 6.5, "go"), ("silence", 6.5, 9, None)], [(5, 6.5, "speech", "go"), (6.5, 9, "trigger_candidate", None)]),
    # a short silence within a phrase neither ends it nor is part of its text; entries come in any order
    ([("word", 1.2, 2, "b"), ("silence", 0.8, 1.2, "x"), ("word", 0, 0.8, "a")], [(0, 2, "speech", "a b")]),
    (None, []),
    ([], []),
]


def floats(row):
    return tuple(float(v) if isinstance(v, int) else v for v in row) if row is not None else None


def recordings(spark, lists):
    return spark.createDataFrame([(i, [floats(x) for x in e] if e is not None else None) for i, e in enumerate(lists)], f"i int, e {segment.ENTRIES}")


def test_splits(spark):
    rows = recordings(spark, [e for e, _ in SPLITS])
    got = {r.i: [tuple(x) for x in r.s] for r in rows.select("i", segment.split_spans(F.col("e")).alias("s")).collect()}
    for i, (_, want) in enumerate(SPLITS):
        assert got[i] == [floats(x) for x in want], i


def plain_split(entries):
    """The rules in a loop: what has been said so far is a phrase until something ends it."""
    known = sorted([e for e in entries if e[2] > e[1]], key=lambda e: e[1])
    first = next((i for i, e in enumerate(known) if e[0] == "word"), None)
    phrases, going = [], []
    for e in known:
        word, long_quiet = e[0] == "word", e[0] != "word" and e[2] - e[1] > 0.7
        if going and (long_quiet or word and (e[1] - going[-1][2] > 0.7 or e[2] - going[0][1] > 20)):
            phrases.append(going)
            going = []
        going = going + [e] if word else going
    out = [(p[0][1], p[-1][2], "speech", " ".join(w[3] for w in p)) for p in [*phrases, going] if p and 1 <= p[-1][2] - p[0][1] <= 20]
    for i, e in enumerate(known):
        if e[0] != "word" and e[2] - e[1] > 0.7 and (first is None or i > first):
            out += [(e[1] + 12 * k, min(e[1] + 12 * k + 12, e[2]), "trigger_candidate", None) for k in range(9) if e[2] - e[1] - 12 * k >= 1.5]
    return sorted(out, key=lambda x: (x[0], x[1]))


def test_long_splits(spark):
    """Hundreds of entries, more than the scan puts away at once."""
    import random

    rng, lists = random.Random(9), []
    for _ in range(20):
        at, entries = 0.0, []
        for k in range(rng.randrange(1, 600)):
            size = rng.choice([0.25, 0.5, 1.0, 3.0])
            entries.append((rng.choice(["word", "word", "word", "silence"]), at, at + size, f"w{k}"))
            at += size + rng.choice([0.0, 0.0, 0.0, 0.5, 1.0])
        lists.append(entries)
    for r in recordings(spark, lists).select("i", segment.split_spans(F.col("e")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == plain_split(lists[r.i])


def test_nearest_words(spark):
    import random

    rng = random.Random(2)
    words = [(s, t / 4, t / 4 + 0.25, rng.choice(["a", "b", " c ", "", None])) for s in "xy" for t in sorted(rng.sample(range(400), 150))]
    gaps = [(s, a := rng.randrange(100), a + rng.randrange(1, 5)) for s in "xyz" for _ in range(60)] + [("x", 5, 6)] * 3
    got = segment.context_words(spark.createDataFrame(words, "source string, start double, end double, word string"), spark.createDataFrame(gaps, "source string, start int, end int"), 3).collect()
    text = lambda ws: " ".join(x for x in ((w[3] or "").strip() for w in ws) if x)
    want = [(s, a, b, text([w for w in words if w[0] == s and w[2] <= a][-3:]), text([w for w in words if w[0] == s and w[1] >= b][:3])) for s, a, b in gaps]
    assert sorted(map(tuple, got)) == sorted(want)


def test_split_alignment(spark):
    rows = spark.createDataFrame([("a", [("word", 0.0, 0.4, "hello"), ("word", 0.5, 1.2, "there")]), ("b", None)], f"source string, entries {segment.ENTRIES}")
    assert [tuple(r) for r in segment.split_alignment(rows).collect()] == [("a", 0.0, 1.2, "speech", "hello there", "a_000000000")]


def test_gap_windows(spark):
    got = one(spark, segment.gap_windows(F.lit(0.0), F.lit(26.0)), segment.gap_windows(F.lit(0.0), F.lit(25.0)), segment.gap_windows(F.lit(0.0), F.lit(1.0)))
    assert [[tuple(x) for x in g] for g in got] == [[(0.0, 12.0), (12.0, 24.0), (24.0, 26.0)], [(0.0, 12.0), (12.0, 24.0)], []]


def test_groups_of_neighbours():
    groups = segment.group_neighbours([(i, 2.0) for i in range(7)])
    assert groups == [[0, 1, 2], [3, 4, 5]]
    assert segment.group_neighbours([(0, 9.0), (1, 2.0)]) == []


def test_packing():
    got = segment.pack_windows([(0, 1, "a"), (2, 3, "b"), (20, 21, "c")], iter([10.0] * 9))
    assert got == [(0, 3, "a [pause] b"), (20, 21, "c")]


def test_word_errors():
    assert segment.word_errors("a b c", "a x c d") == (0, 1, 1)
    assert segment.word_errors("a b", None) == (2, 0, 0)


def test_context_words(spark):
    words = spark.createDataFrame([("x", 0.0, 0.4, "some"), ("x", 0.5, 0.9, "tapping"), ("x", 4.0, 4.4, "right"), ("x", 4.5, 5.0, "there")], "source string, start double, end double, word string")
    gaps = spark.createDataFrame([("x", 0.9, 4.0)], "source string, start double, end double")
    r = segment.context_words(words, gaps).first()
    assert (r.before, r.after) == ("some tapping", "right there")


def test_clean_spans(spark):
    kind = "array<struct<label:string,start_ms:int,end_ms:int,lane:int>>"
    good = F.array(F.struct(F.lit("tap").alias("label"), F.lit(0).alias("start_ms"), F.lit(5100).alias("end_ms"), F.lit(0).alias("lane"))).cast(kind)
    twice = F.concat(good, good)
    got = one(spark, relations.clean_spans(good, F.lit(5.0), ["tap"]), relations.clean_spans(twice, F.lit(5.0), ["tap"]), relations.clean_spans(good, F.lit(4.0), ["tap"]))
    assert [tuple(x) for x in got[0]] == [("tap", 0, 5000, 0)] and got[1] is None and got[2] is None


def test_tempered_targets():
    got = sample.tempered_targets({"a": 10_000, "b": 100, "c": 4}, 300)
    assert got["c"] == 4 and sum(got.values()) <= 300 and got["a"] > got["b"]


def test_round_robin_quota(spark):
    rows = spark.range(200).select("id", (F.col("id") % 5 + F.when(F.col("id") < 100, 0).otherwise(10)).alias("creator"), (F.col("id") % 3).alias("source"))
    got = sample.round_robin_quota(rows, 40, 0.1, "creator", "source", "id")
    by = [r["count"] for r in got.groupBy("creator").count().collect()]
    assert got.count() == 40 and max(by) <= 4
    again = sample.round_robin_quota(rows.repartition(7), 40, 0.1, "creator", "source", "id")
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}


def test_creator_split(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("c"), F.col("id") % 10).alias("creator"))
    got = sample.creator_split(rows, "creator", 3, pinned=["c4"], blocked=["c5"])
    by = {(r.creator, r.split) for r in got.select("creator", "split").distinct().collect()}
    assert ("c4", "eval") in by and len(by) == 9 and sum(s == "eval" for _, s in by) == 3


def test_binary_em_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(60) < 0.4
    votes = [(i, w, bool(t) if rng.random() < acc else not t) for i, t in enumerate(truth) for w, acc in (("h", 0.95), ("m1", 0.8), ("m2", 0.6))]
    cells = spark.createDataFrame([(i, w, "x", int(y)) for i, w, y in votes], "uid long, labeller string, label string, yes int")
    people = spark.createDataFrame([("h", 10.0)], "labeller string, k double")
    post, _ = fusion.binary_em(cells, people, rounds=6)
    got = {r.uid: r.p for r in post.collect()}
    yes = {w: np.array([y for i, v, y in votes if v == w], float) for w in ("h", "m1", "m2")}
    p = (yes["h"] + 0.5) / 2
    for _ in range(6):
        prior = (p.sum() + 1) / (len(p) + 2)
        odds = np.full(len(p), np.log(prior / (1 - prior)))
        for w, y in yes.items():
            tp, fp, fn, tn = (p * y).sum(), ((1 - p) * y).sum(), (p * (1 - y)).sum(), ((1 - p) * (1 - y)).sum()
            if w == "h":
                tp, fn, tn, fp = tp + 8, fn + 2, tn + 9.5, fp + 0.5
            se, sp = (tp + 1) / (tp + fn + 2), (tn + 1) / (tn + fp + 2)
            odds += np.where(y == 1, np.log(se / (1 - sp)), np.log((1 - se) / sp))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    assert max(abs(got[i] - p[i]) for i in range(60)) < 1e-9


def test_readers(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"uid": "a", "n": 1}\n\n{"uid": "b", "n"\n{"uid": "c", "n": 3}\n')
    assert sorted(map(tuple, readers.jsonl(spark, str(f), "uid string, n int").collect())) == [("a", 1), ("c", 3)]
    assert readers.jsonl(spark, str(tmp_path / "none"), "uid string").count() == 0
    c = tmp_path / "a.csv"
    c.write_text("id;text\n1;hello there\n2;x\n")
    assert [r.transcript for r in readers.widest(readers.sniffed_csv(spark, str(c))).orderBy("id").collect()] == ["hello there", "x"]
    pages = spark.createDataFrame([(1, '<script id="kit-answers">{"a": ["x", "y"]}</script>')], "page_id int, html string")
    assert [tuple(r) for r in readers.embedded_json(pages, "kit-answers", "array<string>").collect()] == [(1, "a", ["x", "y"])]
    wrapped = spark.createDataFrame([('[{"type":"word","start":0,"end":1,"word":"a"}]',), ('{"words":[{"type":"word","start":0,"end":1,"word":"b"}]}',)], "value string")
    assert sorted(r.entries[0].word for r in readers.alignments(wrapped).collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "ledger")
    make = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "uid string, v string")
    sinks.append_new(make("a", "b"), out, "uid")
    sinks.append_new(make("b", "c", "c"), out, "uid")
    assert sorted(r.uid for r in spark.read.json(out).collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([("a", "eval", "x", 3600.0)], "uid string, split string, label string, seconds double")
    assert [tuple(r) for r in sinks.pack(rows, str(tmp_path / "p"))  .collect()] == [("eval", "x", 1, 1.0)]
    gone = sinks.tombstone(make("a", "b"), make("a"), "uid", ["v"])
    assert sorted(map(tuple, gone.collect())) == [("a", None, True), ("b", "v", False)]


def test_merge_info(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}), ("b", None)], "k string, info map<string,string>")
    patch = spark.createDataFrame([("a", {"x": "2", "y": "3"})], "k string, info map<string,string>")
    got = {r.k: (r.info, r.changed) for r in relations.merge_info(rows, patch, "k").collect()}
    assert got == {"a": ({"x": "2", "y": "3"}, True), "b": (None, False)}


def test_screens(spark):
    rows = spark.createDataFrame([("a/Bad-Title_x.mp3", "fine"), ("b/ok.mp3", "no no no no no"), ("c/ok.mp3", None)], "path string, text string")
    assert [r.blocked_title for r in screen.title_screen(rows, r"\bbad title\b").collect()] == [True, False, False]
    assert screen.looped(rows).count() == 2
