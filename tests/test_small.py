"""Rules of few lines: scripts and their gaps, takes, candidates, labels from titles and texts, files, splits."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import columns as X
from quillon.operators import metrics, sample, screen, segment, serving
from quillon.sources import readers


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


# -- scripts


def test_scripts_are_packed_by_their_seconds():
    text = "One two three. [pause 5s] Four five, six seven! " + "word " * 60 + "end. [moaning] Last… one."
    chunks = segment.plan_script(text)
    assert " ".join(chunks).split() == text.split()
    assert all(segment.seconds_of(c) <= 12 for c in chunks)
    assert all(segment.seconds_of(f"{a} {b}") > 12 or len(b.split()) > 20 for a, b in zip(chunks, chunks[1:])) and len(chunks) > 2
    assert segment.plan_script("") == segment.plan_script(None) == [] and segment.plan_script("[pause 40s]") == ["[pause 40s]"]
    assert segment.plan_script("Costs 3.5 in all. Two.") == ["Costs 3.5 in all. Two."]
    assert segment.plan_script("[pause 11s] a b. c d.") == ["[pause 11s] a b.", "c d."]


def test_predicted_seconds_are_those_of_the_column(spark):
    texts = ["a b c [pause 2.5s] d", "[moaning] x [pause] y", "", "no tags at all, but words."]
    got = values(spark, [(t,) for t in texts], "t string", segment.predicted_seconds(F.col("t")).alias("s"))
    assert [round(r[0], 9) for r in got] == [round(segment.seconds_of(t), 9) for t in texts]


def plain_gaps(text, sentence=0.6, ellipsis=1.2):
    gaps, words, clause = {}, 0, []
    for token in re.findall(r"\[[^\]]*\]|[^\s\[]+", text):
        tag = re.fullmatch(segment.TIMED_TAG, token)
        if tag:
            least, event = gaps.get(words, (0.0, False))
            gaps[words] = (max(least, float(tag[2] or 0)), event) if tag[1] == "pause" else (least, True)
        elif re.search("[a-zA-Z0-9]", token):
            words += 1
            clause.append(token)
            if re.search(r"(\.\.\.|…|[.!?,;:])[\"')]*$", token):
                whole, clause = " ".join(clause), []
                quiet = next((s for p, s in segment.BREATH_CUES if re.search(p, whole)), 0.0)
                quiet = max(quiet, ellipsis if re.search(r"(\.\.\.|…)[\"')]*$", token) else sentence if re.search(r"[.!?][\"')]*$", token) else 0.0)
                if quiet:
                    least, event = gaps.get(words, (0.0, False))
                    gaps[words] = (max(least, quiet), event)
    return gaps


def test_gaps_of_scripts(spark):
    texts = [
        "Breathe in. And hold... [pause 7s] now out. [moaning] Relax, please [pause 0.5s] okay?",
        "[pause 2s] [whisper] Slowly, in, and out; \"let it go.\" he said… [pause]",
        "Take a deep breath, hold it, and let it all out! [odd 1] [kissing 2s] x [pause 3s] [pause 1s].",
        "", "no ends here", None,
    ]
    got = segment.gap_plan(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    want = {(i, k): g for i, t in enumerate(texts) for k, g in plain_gaps(t or "").items()}
    assert {(r.id, r.after): (r.least, r.event) for r in got} == want and len(want) > 10


def test_take_scores(spark):
    rows = [("one two three four", "one two three four", 1.6), ("one two", "one haha two", 0.77), ("they laugh", "haha they laugh", 0.8), ("a b c d e f", "a b c", 0.5), ("a b", "a b", 9.0), ("", None, None)]
    got = segment.take_scores(spark.createDataFrame(rows, "script string, heard string, seconds double"), seconds="seconds").collect()
    assert [(r.laughs, r.score) for r in got] == [(0, 0.0), (1, 3.0), (0, 0.0), (0, 6.0), (0, 3.0), (0, 0.0)]
    assert [r.score for r in segment.take_scores(spark.createDataFrame(rows, "script string, heard string, seconds double")).collect()] == [0.0, 3.0, 0.0, 3.0, 0.0, 0.0]


# -- labels from words


def test_titles(spark):
    uids = ["creator/F4M-Spanking-and-Giggles.m4a_000123450", "yt:abc/laugh.m4a", "x/" + "0f" * 16 + ".mp3", "x/Song_about.toys.mp3", "x/passing.m4a"]
    got = values(spark, [(u,) for u in uids], "u string", X.title_tags(F.col("u")))
    assert [r[0] for r in got] == [["spanking", "laughing"], [], [], ["vibrator", "singing"], []]


def test_free_text(spark):
    texts = ["Giggling", "VELCRO and rain", "crowd", None, "she cries"]
    got = values(spark, [(t,) for t in texts], "t string", X.labels_in(F.col("t")), X.labels_in(F.col("t"), ["liquid"]))
    assert got == [(["laughing"], []), (["sticky", "liquid"], ["liquid"]), ([], []), ([], []), (["crying"], [])]


def test_merged_labels_keep_what_they_were(spark):
    got = values(spark, [("licking",), ("tapping",), (None,)], "l string", X.merged_label(F.col("l"), {"licking": "oral sounds"}).alias("m"))
    assert [tuple(r[0]) for r in got] == [("oral sounds", "licking"), ("tapping", None), (None, None)]


def test_single_class(spark):
    got = values(spark, [(["a"],), (["bg"],), (["a", "bg"],), ([],), (["a", "b"],)], "h array<string>", X.single_class(F.col("h"), "bg"))
    assert [r[0] for r in got] == ["a", "bg", None, None, None]


# -- numbers


def test_needs(spark):
    rows = [(0, 5, None, 0.5, 0), (5, 5, 0.75, 0.5, 1), (9, 5, 0.75, 0.5, 0)]
    got = values(spark, rows, "v int, t int, a double, u double, s int", X.need_by_agreement(*map(F.col, "vtaus")))
    want = [(0.5 * max(0, 1 - v / t) + 0.3 * u + 0.2 * (u if a is None else 1 - a)) / (1 + 0.25 * max(0, v - t)) / (1 + s) for v, t, a, u, s in rows]
    assert np.allclose([r[0] for r in got], want)


def test_intensity_and_balance(spark):
    got = values(spark, [(0.0,), (0.25,), (0.5,), (0.78,)], "x double", X.intensity(F.col("x")))
    assert [r[0] for r in got] == ["soft", "gentle", "firm", "vigorous"]
    left, right = [1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0]
    assert np.allclose(values(spark, [(left, right)], "l array<double>, r array<double>", segment.balance(F.col("l"), F.col("r")))[0][0], [-1.0, 1.0])


def test_cuts(spark):
    a, b = segment.cut_geometry(F.col("s"), F.col("d"))
    assert values(spark, [(0.5, 2.0), (9.0, 7.5)], "s double, d double", a, b) == [(0.0, 4.0), (8.0, 8.0)]


def test_chapter_windows(spark):
    got = segment.chapter_windows(spark.createDataFrame([(1, 0.0, 100.0), (2, 5.0, 9.0), (3, 5.0, 8.9)], "id int, start double, end double"), most=6).collect()
    at = {i: sorted(r.window_start for r in got if r.id == i) for i in (1, 2, 3)}
    assert len(at[1]) == 6 and set(at[1]) <= {3.0 * k for k in range(33)} and at[2] == [5.0] and at[3] == []


# -- samples and screens


def test_shards(spark):
    got = sample.shards(spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string"), "k", 7).collect()
    assert all(r.shard == zlib.crc32(r.k.encode()) % 7 for r in got)


def test_rows_by_weight(spark):
    rows = [(i, [None, 0.0, 0.3, 1.0, 5.0][i % 5]) for i in range(5000)]
    kept = sample.keep_by_weight(spark.createDataFrame(rows, "k int, w double"), "w", "k").groupBy("w").count().collect()
    n = {r.w: r["count"] for r in kept}
    assert set(n) == {0.3, 1.0, 5.0} and n[1.0] == n[5.0] == 1000 and abs(n[0.3] - 300) < 60


def test_thin_classes(spark):
    judged = [("s", "a", "a")] * 4 + [("s", "b", "b"), ("s", "b", "x"), ("s", "c", "x")]
    rows = [(i, "s", "abc"[i % 3]) for i in range(9)] + [(99, "t", "a")]
    frames = spark.createDataFrame(judged, "source string, label string, pred string"), spark.createDataFrame(rows, "uid int, source string, label string")
    assert sorted((r.uid, r.w) for r in screen.cell_precision(*frames).collect()) == sorted((i, 1.0 if i % 3 == 0 else 0.5) for i in range(9) if i % 3 < 2)
    assert {r.label for r in screen.cell_precision(*frames, thin=2.0).collect()} == {"a"}


def test_candidates(spark):
    good, long, short = "abcdefghij", [(0.0, 60.0)], [(0.0, 59.9)]
    rows = [(1, good + "1", "c", "x", "single", None), (2, good + "1", "d", "y", "single", None), (3, "bad", "c", "x", "single", None), (4, None, "c", "x", "single", None), (5, good + "2", "c", "x", "film", None), (6, good + "3", "c", "x", "chapter", short), (7, good + "4", "c", "x", "chapter", short + long), (8, good + "5", "c", "x", "single", None), (9, good + "6", "c", "z", "single", None), (10, good + "7", "c", "z", None, None)]
    frame = spark.createDataFrame(rows, "n int, id string, cls string, channel string, kind string, chapters array<struct<start:double,end:double>>")
    got = {r.n: (r.reason, r.chapters) for r in screen.candidate_checks(frame, spark.createDataFrame([(good + "6",)], "id string"), per_channel=2).collect()}
    assert {n: r for n, (r, _) in got.items()} == {1: None, 2: "dup", 3: "schema", 4: "schema", 5: "kind", 6: "no chapters", 7: None, 8: "channel cap", 9: "dup", 10: "schema"}
    assert [tuple(c) for c in got[7][1]] == long


def test_judges_against_people(spark):
    people = [(1, "p", ["a", "b"]), (1, "q", ["a"]), (1, "r", ["a", "c"]), (2, "p", ["b"]), (2, "q", ["b", "c"])]
    judged = [(1, "j", ["a", "b"]), (2, "j", []), (1, "k", ["a"]), (2, "k", ["b", "c"]), (9, "k", ["a"])]
    frames = spark.createDataFrame(judged, "item int, judge string, labels array<string>"), spark.createDataFrame(people, "item int, who string, labels array<string>")
    got = {(r.judge, r.label): (r.tp, r.fp, r.fn, r.f1) for r in metrics.judges_against_people(*frames).collect()}
    assert got == {("j", "a"): (1, 0, 0, 1.0), ("j", "b"): (0, 1, 1, 0.0), ("k", "a"): (1, 0, 0, 1.0), ("k", "b"): (1, 0, 0, 1.0)}


def test_modes(spark):
    clips = lambda *votes: spark.createDataFrame([(True, False, v) for v in votes] + [(True, True, 0), (False, False, 0)], "gold boolean, blocked boolean, votes int")
    people = spark.createDataFrame([("a", True), ("b", None)], "who string, beta boolean")
    modes = lambda c, **o: {r.who: (r.mode, r.gold_done, r.gold_total) for r in serving.labelling_modes(c, people, **o).collect()}
    assert modes(clips(12, 3)) == {"a": ("timeline", 1, 2), "b": ("tags", 1, 2)}
    assert modes(clips(12, 13))["b"][0] == "timeline" and modes(clips())["b"] == ("tags", 0, 0)
    assert {m for m, *_ in modes(clips(12), timeline_ui=-1).values()} == {"tags"} and {m for m, *_ in modes(clips(0), timeline_ui=1).values()} == {"timeline"}


# -- files


def test_files(spark, tmp_path):
    for name in ("a.m4a", "a.m4a.json", "b.m4a", "sub/c.m4a", "sub/c.m4a.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 5)
    files = readers.listing(spark, str(tmp_path))
    assert files.count() == 5 and {r.bytes for r in files.collect()} == {5}
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.paired(files).collect()) == ["a.m4a", "c.m4a"]
    table = spark.createDataFrame([("k", 2.5)], "key string, value double")
    assert readers.setting(table, "k", 1.0) == 2.5 and readers.setting(table, "other", 1.0) == 1.0


def test_first_rows(spark):
    rng = random.Random(0)
    rows = [(f"f{rng.randrange(5)}", n) for n in range(30)]
    first = {}
    for name, n in rows:
        first.setdefault(name, n)
    frame = spark.createDataFrame(rows, "file_name string, n int")
    assert {r.file_name: r.n for r in readers.first_rows(frame, "file_name", ["n"]).collect()} == first
    there = spark.createDataFrame([("f1",), ("f3",), ("f3",), ("other",)], "file_name string")
    assert {r.file_name: r.n for r in readers.first_rows(frame, "file_name", ["n"], there).collect()} == {k: first[k] for k in ("f1", "f3")}
