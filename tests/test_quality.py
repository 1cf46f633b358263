"""Six labellers over twenty clips: three careful, one random, one constant, one hurried."""

from pyspark.sql import functions as F

from quillon.operators import agreement as A

SETS = (["whispering"], ["tapping"], ["brushing", "tapping"], ["crinkling"], ["liquid", "whispering"])


def test_statuses(spark):
    truth = {i: SETS[i % 5] for i in range(1, 21)}
    rows = []
    for i in truth:
        for who in ("a1", "a2", "a3"):
            rows.append((who, i, truth[i], 9.0))
        rows.append(("a4", i, truth[1 + (i + 6) % 20], 9.0))
        rows.append(("a5", i, ["whispering"], 9.0))
        rows.append(("a6", i, truth[i], 2.5))
    answers = spark.createDataFrame(rows, "who string, item int, labels array<string>, answer_s double")
    answers = answers.withColumns({"attempt": F.lit(1), "unsure": F.lit(False), "listen_ms": F.lit(6000.0), "at": F.col("item")})
    got = {r.who: r for r in A.refresh_quality(answers, 2).collect()}
    for who in ("a1", "a2", "a3"):
        assert got[who].status == "ok" and got[who].follow > 0.8
    assert got["a4"].status == "weak" and got["a4"].follow < 0.1
    assert got["a5"].status == "weak" and "same label every time" in got["a5"].flags
    assert got["a6"].status == "watch" and got["a6"].flags == ["rushing"]


def test_agreement_of_few(spark):
    v = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x"]), (1, "c", ["y"]), (2, "a", ["x"])], "item int, who string, labels array<string>")
    got = {r.item: r.agreement for r in A.clip_agreement(v).collect()}
    assert abs(got[1] - 1 / 3) < 1e-9 and got[2] is None


def test_consensus_branches(spark):
    v = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x"]), (2, "a", ["x"]), (3, "a", []), (3, "b", [])], "item int, who string, labels array<string>")
    t = spark.createDataFrame([("a", 0.9, 30, False), ("b", 0.5, 30, False)], "who string, trust double, evidence int, weak boolean")
    assert {r.item: r.consensus for r in A.clip_consensus(v, t).collect()} == {1: 1.0, 2: None, 3: 1.0}


def test_kappa(spark):
    rows = [(i, "a", x) for i, x in enumerate("ppnn")] + [(i, "b", x) for i, x in enumerate("pnnn")]
    r = A.cohen_kappa(spark.createDataFrame(rows, "item int, judge string, answer string")).first()
    assert r.n == 4 and abs(r.agreement - 0.75) < 1e-9 and abs(r.kappa - 0.5) < 1e-9


def test_a_figure_at_the_limit_is_not_under_it(spark):
    """In fractions all three follow others by one tenth exactly, in doubles by 0.09999999999999999, ...95 and ...98."""
    for truth, said in (("adeeceeedbeddeaa", "eeaeeaeeaaedcedb"), ("dcabcbdadacaabcabd", "cadbbadadbddacbaab"), ("abbcacacdabcdaacab", "adacccdbacbadabdcc")):
        n = len(truth)
        # the newest answer comes first, and of equal times the highest item
        rows = [(n - i, "x", [a], [b]) for i, (a, b) in enumerate(zip(truth, said))]
        a = spark.createDataFrame(rows, "item int, who string, truth array<string>, labels array<string>")
        a = a.withColumns({"attempt": F.lit(1), "unsure": F.lit(False), "listen_ms": F.lit(6000.0), "answer_s": F.lit(9.0), "at": F.lit(0)})
        r = A.labeller_quality(a, a.select("item", F.col("truth").alias("labels"))).first()
        assert r.refs == n and abs(r.follow - 0.1) < 1e-12 and r.flags == []
