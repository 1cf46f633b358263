"""Answers, orders, serving and sources against brute force on small rows."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns as X
from quillon.operators import answers as N
from quillon.operators import agreement, fusion, order, relations, sample, screen, serving
from quillon.sources import readers, sinks
from quillon.streaming import jobs


def test_running_and_percentiles(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None, "c"]), rng.randrange(6), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, s int, v int")
    for group in (None, "g"):
        out = {r.id: (r.n, r.total) for r in order.running(df, [F.col("s").desc(), "id"], group, {"n": F.lit(1), "total": F.col("v")}).collect()}
        for g in {r[1] for r in rows} if group else {0}:
            total = 0
            for n, r in enumerate(sorted((r for r in rows if not group or r[1] == g), key=lambda r: (-r[2], r[0])), 1):
                total += r[3]
                assert out[r[0]] == (n, total)
    got = order.percentiles(df, "v", [0.0, 0.5, 0.9, 1.0])
    assert np.allclose(got, np.percentile([r[3] for r in rows], [0, 50, 90, 100]))
    assert order.percentiles(df.limit(0), "v", [0.5]) == [None] and order.percentiles(df.limit(1), "v", [0.5]) == [float(df.first().v)]
    assert order.running(df.limit(0), ["id"]).count() == 0


def test_next_items_never_starve(spark):
    """A labeller who has seen all but the last clips gets these; one who has seen all gets none."""
    clips = spark.createDataFrame([(i, i != 3, i % 4, 5, i % 11 == 0, i % 7 == 0, i / 100) for i in range(60)], "item int, active boolean, votes int, target int, gold boolean, boosted boolean, need double")
    people = spark.createDataFrame([(w,) for w in "abcd"], "who string")
    seen = [("a", i) for i in range(58)] + [("b", i) for i in range(60)] + [("c", 11), ("c", 11), ("c", 999)]
    got = serving.next_items(clips, people, spark.createDataFrame(seen, "who string, item int"), each=3).collect()
    key = lambda i: (0 if i % 11 == 0 and i % 4 < 12 else 1 if i % 7 == 0 and 0 < i % 4 < 3 else 2 if i % 7 == 0 else 3 if 0 < i % 4 < 3 else 4, -i / 100, i)
    for who in "abcd":
        left = sorted((i for i in range(60) if i != 3 and (who, i) not in seen), key=key)[:3]
        assert [r.item for r in sorted(got, key=lambda r: r.rank) if r.who == who] == left


def test_next_items_of_crews(spark):
    """What a crew has seen stands in seen once; the rows are those of seen by labeller."""
    rng = random.Random(8)
    clips = spark.createDataFrame([(i, i % 5 > 0, i % 4, 5, i % 11 == 0, i % 7 == 0, rng.randrange(9) / 10) for i in range(80)], "item int, active boolean, votes int, target int, gold boolean, boosted boolean, need double")
    people = spark.createDataFrame([(f"w{i}", "abcd"[i % 4]) for i in range(10)], "who string, crew string")
    seen = spark.createDataFrame([(c, i) for c, n in zip("abc", (40, 79, 80)) for i in rng.sample(range(80), n)], "crew string, item int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(serving.next_items(clips, people, seen, each=4, by="crew"))
    assert got == rows(serving.next_items(clips, people, people.join(seen, "crew"), each=4)) and got


def test_shared_peers(spark):
    rng = random.Random(2)
    marks = [(k, rng.randrange(12), rng.randrange(30)) for k in ("net", "device") for _ in range(60)]
    got = {r.who: r.peers for r in relations.shared_peers(spark.createDataFrame(marks, "kind string, value int, who int")).collect()}
    peers = {}
    for k, v, a in marks:
        peers.setdefault(a, set()).update(b for k2, v2, b in marks if (k2, v2) == (k, v) and b != a)
    assert got == {a: len(p) for a, p in peers.items() if p}


def test_anchored_em_item_by_item(spark):
    """All 50 rounds over single items, in plain Python."""
    rng = random.Random(3)
    classes, truths = ["x", "y"], ["x", "y", "other"]
    rows = [(i, rng.choice(["x", "y", "z"]), rng.choice(["x", "y", "x", "none"])) for i in range(80)]
    calibration = [("x", "x", 8), ("x", "y", 1), ("y", "y", 3), ("y", "other", 2), ("q", "x", 50)]
    got = {r.uid: r for r in fusion.anchored_em(spark.createDataFrame(rows, "uid int, label string, pred string"), spark.createDataFrame(calibration, "truth string, pred string, n int"), classes).collect()}
    named = lambda c: c if c in truths else "other"
    n0 = {t: {p: float(sum(n for a, b, n in calibration if (a, b) == (t, p))) for p in truths} for t in truths}
    for t in truths:
        if t == "other" or not sum(n0[t].values()):
            n0[t] = dict.fromkeys(truths, 1.0)
    g0 = {t: {p: n0[t][p] / sum(n0[t].values()) * 20 + 0.5 for p in truths} for t in truths}
    g = {t: {p: g0[t][p] / sum(g0[t].values()) for p in truths} for t in truths}
    c = {t: {w: 0.6 if t == w else 0.2 for w in truths} for t in truths}
    prior = dict.fromkeys(truths, 1 / 3)
    for _ in range(50):
        post = []
        for _, w, p in rows:
            u = {t: prior[t] * g[t][named(p)] * c[t][named(w)] for t in truths}
            post.append({t: u[t] / sum(u.values()) for t in truths})
        for t in truths:
            prior[t] = sum(q[t] for q in post) / len(rows)
            gs = {p: g0[t][p] + sum(q[t] for q, r in zip(post, rows) if named(r[2]) == p) for p in truths}
            cs = {w: 0.5 + sum(q[t] for q, r in zip(post, rows) if named(r[1]) == w) for w in truths}
            g[t], c[t] = {p: v / sum(gs.values()) for p, v in gs.items()}, {w: v / sum(cs.values()) for w, v in cs.items()}
    for q, (i, w, _) in zip(post, rows):
        assert abs(got[i].conf - max(q.values())) < 1e-9 and got[i].fused == max(truths, key=lambda t: (q[t], t))
        assert got[i].hard_negative == (q[named(w)] <= 0.1)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"short_items": 0}, {"broadcast_rows": 0, "short_items": 0}])
def test_passages_over_lines(spark, limits):
    docs = [(1, "before\none two three four five\nsix seven eight nine ten eleven twelve after"), (2, "one two three four five six"), (3, None), (4, ""), (5, "xalpha beta gammax"), (5, "xalpha beta gammax"), (6, "alpha beta\tgamma"), (7, "beta"), (8, " a\u00e9 b ")]
    items = [(10, "one two three four five\nsix seven eight nine ten eleven twelve"), (11, "alpha beta gamma"), (12, "short one"), (13, None), (14, "two three four five"), (15, "beta"), (16, "beta gamma"), (17, "alpha beta gammax"), (18, ""), (19, " "), (20, "\u00e9 b"), (21, "one"), (22, "five six"), (23, "e"), (24, "\t"), (25, "one  two three")]
    got = screen.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), **limits).collect()
    assert sorted(map(tuple, got)) == sorted({(d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t})
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert screen.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), nothing, **limits).count() == 0


def test_answers_of_models(spark):
    texts = ['Sure: {"labels": ["Tapping", " brush "], "x": {}} bye', '{"labels": ["tapping"', '{"labels": "tapping"}', "ERROR", None, '{"a"\n: 1, "labels"\n: ["x", "tapping", "tapping"]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(N.answer_labels(F.col("t"), ["tapping", "brushing"], {"brush": "brushing"}).alias("l"))
    assert [r.l for r in df.collect()] == [["tapping", "brushing"], [], [], [], [], ["tapping"]]
    people = [('{"a": ["x", "y"], "b": ["x"], "c": []}', ["x"]), ('["x"]', None), ("{}", []), (None, None), ('{"a": ["x"], "b": ["y"]}', ["x", "y"])]
    got = spark.createDataFrame([(p,) for p, _ in people], "p string").select(N.majority_labels(F.col("p")).alias("m")).collect()
    assert [r.m for r in got] == [w for _, w in people]


def test_device_slots(spark, tmp_path):
    """Batches in order of time: two devices, a third once one has rested for a month."""
    schema = "who int, device int, at timestamp"
    days = [[(1, 7, 0), (1, 8, 1), (1, 9, 2), (2, 7, 2)], [(1, 7, 25), (1, 9, 30), (1, 9, 32), (1, 8, 33)], [(1, 9, 60), (1, 5, 61), (2, 5, 61), (2, 6, 61)]]
    out, folder = [], str(tmp_path / "in")
    for k, batch in enumerate(days):
        rows = spark.createDataFrame(batch, "who int, device int, d int").select("who", "device", F.timestamp_seconds(1_700_000_000 + F.col("d") * 86400).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        slots = jobs.device_slots(jobs.follow(spark, folder, rows.schema, "parquet"))
        jobs.run_available(slots, lambda df, n: out.extend((r.who, r.device, (r.at.timestamp() - 1_700_000_000) / 86400, r.allowed) for r in df.collect()), str(tmp_path / "check"))
    allowed = {(w, x, int(d)): ok for w, x, d, ok in out}
    assert len(out) == 12 and not [k for k, ok in allowed.items() if not ok and k not in {(1, 9, 2), (1, 9, 30), (1, 8, 33)}]
    assert [allowed[k] for k in ((1, 9, 2), (1, 9, 30), (1, 9, 32), (1, 8, 33), (1, 5, 61), (2, 6, 61))] == [False, False, True, False, True, True]


def test_sessions_hold_what_is_near(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 70), (2, 5), (1, 75)], "who int, m int").select("who", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    got = jobs.collected(jobs.sessions(jobs.follow(spark, str(tmp_path / "in"), rows.schema, "parquet"), "at", "30 minutes", "who", late="1 day"), "complete").collect()
    minute = lambda t: (t.timestamp() - 1_700_000_000) / 60
    assert sorted((r.who, minute(r.start), minute(r.end), r.n) for r in got) == [(1, 0, 40, 2), (1, 70, 105, 2), (2, 5, 35, 1)]


def test_more_sources(spark, tmp_path):
    clip = base64.b64encode(b"\x00sound").decode()
    page = spark.createDataFrame([(1, 'var c = [{"id": "c12", "dur": 3.5, "src": "data:audio/mpeg;base64,%s"}];' % clip), (2, None)], "page int, html string")
    assert [(r.page, r.id, r.seconds, bytes(r.clip)) for r in readers.embedded_clips(page).collect()] == [(1, "c12", 3.5, b"\x00sound")]
    (tmp_path / "ids.tsv").write_text("repo\tcreator\n\nrepo\tcreator\nother\n")
    assert sorted(map(tuple, readers.id_list(spark, str(tmp_path / "ids.tsv"), ("repo", "creator")).collect()), key=repr) == [("other", None), ("repo", "creator")]
    (tmp_path / "l.csv").write_text('file,labels\na,"Tap, Brush"\nb,\n')
    assert [r.labels for r in readers.labelled_csv(spark, str(tmp_path / "l.csv")).orderBy("file").collect()] == [["Tap", "Brush"], []]
    vectors = np.arange(20, dtype=np.float16).reshape(5, 4) / 8
    vectors.tofile(tmp_path / "e.f16")
    (tmp_path / "e.jsonl").write_text("".join(json.dumps({"uid": f"u{i}"}) + "\n" for i in range(5)))
    got = {r.uid: r.embedding for r in readers.half_matrix(spark, str(tmp_path / "e.f16"), str(tmp_path / "e.jsonl"), 4, "uid string").collect()}
    assert got == {f"u{i}": v.astype(float).tolist() for i, v in enumerate(vectors)}
    sinks.rate_table(spark.createDataFrame([("b", 0.5), ("a", 0.25)], "label string, sens double"), str(tmp_path / "rates"), ["label"])
    assert [r.label for r in spark.read.schema("label string, sens double").json(str(tmp_path / "rates")).collect()] == ["a", "b"]


def test_loudness(spark):
    loud, soft = [0.5] * 8 + [0.0] * 2, [0.001] * 10
    row = spark.range(1).select(*(f(F.array(*map(F.lit, s)), 2) for s in (loud, soft) for f in (X.frame_db, X.is_silent)), X.is_silent(F.array().cast("array<double>"), 2), X.loud_enough(F.lit(-49.0)), X.loud_enough(F.lit(None).cast("double"))).first()
    assert abs(row[0] + 6.0206) < 1e-3 and row[1] is False and abs(row[2] + 60) < 1e-3 and row[3] is True and row[4] is True and row[5] is True and row[6] is False
    scores = F.create_map(*[F.lit(x) for x in ("tap", 0.6, "brush", 0.5, "talk", 0.45)])
    got = spark.range(1).select(X.margin_choice(scores, ["tap", "brush"], ["talk"], 0.1), X.margin_choice(scores, ["tap", "brush"], ["talk"], 0.2)).first()
    assert tuple(got) == ("tap", None)


def test_peers_of_many_marks(spark):
    """Inclusion and exclusion, and row by row beyond the bound, against sets."""
    rng = random.Random(6)
    rows = [(rng.choice(["ip", "net"]), f"m{rng.randrange(9)}", who) for who in range(60) for _ in range(rng.choice([1, 1, 2, 3, 8]))] + [("ip", "hot", w) for w in range(40)] + [("ip", f"own{w}", w) for w in range(60)] * 2
    members = {}
    for k, v, w in rows:
        members.setdefault((k, v), set()).add(w)
    want = {}
    for w in range(60):
        others = set().union(*(m for m in members.values() if w in m)) - {w}
        if others:
            want[w] = len(others)
    frame = spark.createDataFrame(rows, "kind string, value string, who int")
    for few in (0, 2, 6):
        assert {r.who: r.peers for r in relations.shared_peers(frame, few=few).collect()} == want
    told = agreement.shared_marks(frame, named=3).collect()
    assert {(r.kind, r.value): r.accounts for r in told} == {k: len(m) for k, m in members.items() if len(m) > 1} and all(len(r.members) == min(3, r.accounts) for r in told)
    assert {(r.kind, r.value, r.who) for r in agreement.mark_members(frame).collect()} == {(*k, w) for k, m in members.items() if len(m) > 1 for w in m}


def test_first_of_a_class_by_hash(spark):
    import hashlib

    rows = [(f"k{i}", "abcd"[i % 7 % 4]) for i in range(700)]
    limits = {"a": 5, "b": 0, "c": 150, "d": 10**6}
    rank = lambda k: (hashlib.md5(f"3|{k}".encode()).hexdigest(), k)
    want = {k for label, n in limits.items() for k in sorted((k for k, x in rows if x == label), key=rank)[:n]}
    frame, table = spark.createDataFrame(rows, "key string, label string"), spark.createDataFrame(list(limits.items()), "label string, _limit long")
    got = sample.first_by_hash(frame, "label", "key", table, 3)
    assert {r.key for r in got.collect()} == want and got.columns == ["key", "label"]
    head = sample.head_cap(frame, "label", "key", 0.1, 30, 3)
    sizes = {label: sum(x == label for _, x in rows) for label in "abcd"}
    assert {r.label: r["count"] for r in head.groupBy("label").count().collect()} == {label: min(n, max(30, int(n * 0.1))) for label, n in sizes.items()}
