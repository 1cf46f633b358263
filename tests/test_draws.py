"""Draws and working sets on small states: each rule by itself, and budgets that are met exactly."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import draws as D
from quillon.operators import working_set as S

NOW = datetime.datetime(2026, 1, 1)
CLIP = "item string, active boolean, votes int, target int, gold boolean, boost double, need double, voice string, nsfw boolean, kind string"
PERSON = "who string, n int, status string, sound_pref string, content_pref string, voice_pref string"
GIVEN = "who string, item string, attempt int, state string, assigned_at timestamp, expires_at timestamp"
ANSWER = "who string, item string, attempt int, seq int, unsure boolean"
QUIET = D.Settings(repeat_rate=0.0, control_rate_min=0.0, control_rate_max=0.0, audit_control_rate=0.0, male_share=0.0)


def clip(item, **other):
    row = dict(item=item, active=True, votes=0, target=12, gold=False, boost=0.0, need=0.5, voice=None, nsfw=False, kind="unsure") | other
    return tuple(row[c.split()[0]] for c in CLIP.split(", "))


def person(who, **other):
    row = dict(who=who, n=0, status=None, sound_pref=None, content_pref=None, voice_pref=None) | other
    return tuple(row[c.split()[0]] for c in PERSON.split(", "))


def draw(spark, clips, people, given=(), labels=(), settings=QUIET, seed=0):
    tables = [spark.createDataFrame(list(r), s) for r, s in ((clips, CLIP), (people, PERSON), (given, GIVEN), (labels, ANSWER))]
    return {r.who: (r.item, r.attempt, r.step) for r in D.draws(*tables, F.lit(NOW), settings, seed).collect()}


def done(who, item, attempt=1):
    return (who, item, attempt, "done", NOW - datetime.timedelta(days=9), NOW - datetime.timedelta(days=9))


def test_started_before_fresh_up_to_the_breadth(spark):
    """A started clip is finished before a needier fresh one is opened; at three votes, or at its target, it gives way."""
    for votes, target, want in ((1, 12, "dull"), (3, 12, "hot"), (1, 1, "hot")):
        got = draw(spark, [clip("dull", need=0.1, votes=votes, target=target), clip("hot", need=0.95)], [person("hugo")])
        assert got["hugo"][0] == want


def test_thin_classes_first_and_started_ones_before_those(spark):
    clips = [clip("dull", votes=1), clip("hot", need=0.95), clip("thin", need=0.2, boost=0.3), clip("thin2", need=0.2, boost=0.3)]
    assert draw(spark, clips, [person("h")])["h"][0] in ("thin", "thin2")
    assert draw(spark, [*clips[:3], clip("thin2", need=0.2, boost=0.3, votes=1)], [person("h")])["h"][0] == "thin2"
    assert draw(spark, clips, [person("h")], [done("h", "thin"), done("h", "thin2")])["h"][0] == "dull"


def test_gold_first_and_fullest_first(spark):
    clips = [clip("thin", boost=0.9, votes=2), clip("g1", gold=True, votes=4), clip("g2", gold=True, votes=11), clip("g3", gold=True, votes=12, need=0.99)]
    assert draw(spark, clips, [person("h")])["h"] == ("g2", 1, 0)
    assert draw(spark, clips, [person("h")], [done("h", "g2")])["h"][0] == "g1"


def test_open_clip_comes_back_until_it_expires(spark):
    later, before = NOW + datetime.timedelta(minutes=5), NOW - datetime.timedelta(minutes=5)
    clips = [clip("a"), clip("b", need=0.9), clip("off", active=False)]
    given = [("h", "a", 2, "open", before, later), ("h", "b", 1, "open", NOW, later), ("i", "b", 1, "open", before, before), ("j", "off", 1, "open", before, later)]
    got = draw(spark, clips, [person(w) for w in "hij"], given)
    assert got["h"] == ("a", 2, D.OPEN) and got["i"][0] == "a" and got["j"][0] in ("a", "b")


def test_retests(spark):
    """After the gap, of sure first answers only, each once; none is due below the gap."""
    often = D.Settings(male_share=0.0, repeat_rate=1.0, repeat_gap=4, repeat_gap_min=2, control_rate_min=0.0, control_rate_max=0.0)
    clips = [clip(x) for x in "abcdef"]
    labels = [("h", x, 1, i + 1, x == "b") for i, x in enumerate("abcde")]
    given = [done("h", x) for x in "abcde"]
    assert {draw(spark, clips, [person("h", n=5)], given, labels, often, s)["h"] for s in range(4)} <= {("a", 2, D.RETEST), ("c", 2, D.RETEST)}  # gap max(2, 5 // 2): seq up to 3
    assert draw(spark, clips, [person("h", n=5)], [*given, done("h", "a", 2), done("h", "c", 2)], labels, often)["h"] == ("f", 1, 4)
    assert draw(spark, clips, [person("h", n=1)], given[:1], labels[:1], often)["h"][2] >= 0
    watched = D.Settings(audit_repeat_rate=1.0, audit_repeat_gap=1)
    assert draw(spark, clips, [person("h", n=5, status="watch")], given, labels, watched)["h"][2] == D.RETEST


def test_controls(spark):
    """The neediest control not yet given; fewer the more controls somebody has answered; those on watch get more."""
    always = D.Settings(male_share=0.0, repeat_rate=0.0, control_rate_max=1.0)
    clips = [clip("c1", kind="control", need=0.3), clip("c2", kind="control", need=0.4), clip("x", need=0.9), clip("c3", kind="control", need=0.99, active=False)]
    assert draw(spark, clips, [person("h")], settings=always)["h"] == ("c2", 1, D.CONTROL)
    assert draw(spark, clips, [person("h")], [done("h", "c2")], settings=always)["h"][0] == "c1"
    assert draw(spark, clips, [person("h")], [done("h", "c2"), done("h", "c1")], settings=always)["h"] == ("x", 1, 4)
    people = [person(f"p{i}", n=1) for i in range(200)]
    share = lambda labels, **o: sum(v[2] == D.CONTROL for v in draw(spark, clips, [p[:2] + (o.get("status"),) + p[3:] for p in people], (), labels, D.Settings(repeat_rate=0.0, audit_repeat_rate=0.0, repeat_gap_min=9)).values()) / 200
    fresh, trained, weak = share([]), share([(f"p{i}", "c3", 1, k, False) for i in range(200) for k in range(25)]), share([], status="weak")
    assert 0.15 < fresh < 0.35 and trained < 0.12 and 0.2 < weak < 0.42


def test_preferences(spark):
    clips = [clip("m", voice="male", need=0.1), clip("f", voice="female", need=0.2), clip("s", need=0.3), clip("n", nsfw=True, voice="male", need=0.4), clip("fn", nsfw=True, voice="female", need=0.9)]
    people = [person("male", voice_pref="male"), person("speech", sound_pref="speech", content_pref="sfw"), person("quiet", sound_pref="nonspeech"), person("nsfw", content_pref="nsfw", voice_pref="female"), person("sfw", content_pref="sfw", voice_pref="male"), person("all")]
    got = {w: v[0] for w, v in draw(spark, clips, people, settings=D.Settings(**{**QUIET.__dict__, "jitter": 0.0})).items()}
    assert got == {"male": "n", "speech": "f", "quiet": "s", "nsfw": "fn", "sfw": "s", "all": "fn"}
    rest = [done(w, x) for w in ("male", "quiet", "nsfw") for x in ("n", "s", "fn")]
    got = {w: v[0] for w, v in draw(spark, clips, people, rest).items()}
    assert got["male"] == "m" and got["quiet"] == "f" and "nsfw" not in got


def test_open_leases_count_against_a_clip(spark):
    later = NOW + datetime.timedelta(minutes=5)
    clips = [clip("a", need=0.6), clip("b", need=0.5)]
    given = [(w, "a", 1, "open", NOW, later) for w in ("x", "y")]
    assert draw(spark, clips, [person("h")], given)["h"][0] == "b"
    assert draw(spark, clips, [person("h")])["h"][0] == "a"


def test_budgets(spark):
    """Down until the goal, back until the first that doesn't fit, absent files passed over; against a plain loop."""
    rng = random.Random(4)
    kind = "item int, active boolean, votes int, target int, batch string, need double, bytes long, blocked boolean, kind string"
    rows = [(i, rng.random() < 0.5, rng.randrange(4), 3, rng.choice("xy"), round(rng.random(), 1), rng.randrange(0, 50), rng.random() < 0.1, rng.choice(["unsure", "confident"])) for i in range(150)]
    files = {r[0]: r[6] for r in rows if r[0] % 7} | {1000 + i: 10 * i for i in range(9)}
    held = {i for i in range(0, 150, 9)}
    new = [(3, 1), *((1000 + i, i + 2) for i in range(9)), (2000, 0)]
    tables = spark.createDataFrame(rows, kind), spark.createDataFrame([(h,) for h in held], "item int"), spark.createDataFrame(list(files.items()), "item int, bytes long")
    fresh = spark.createDataFrame(new, "item int, place int")

    def plain(budget, used, goal):
        out, freed = [], 0
        for r in sorted((r for r in rows if r[1] and not r[2] and r[4] == "x" and r[0] not in held), key=lambda r: (r[5], r[0])):
            if freed >= goal:
                break
            out.append((r[0], "down", r[6]))
            freed += r[6]
        room = budget - used + freed
        back = sorted((r for r in rows if not r[1] and not r[7] and r[2] < r[3] and r[8] != "confident"), key=lambda r: (r[2] == 0, -r[5], r[0]))
        for name, line in (("back", [r[0] for r in back]), ("new", [i for i, _ in sorted(new, key=lambda x: x[1]) if i >= 150])):
            full = room <= 0
            for i in line:
                if full or (i in files and files[i] > room):
                    break
                out.append((i, name, files[i]) if i in files else (i, "missing", None))
                room -= files.get(i, 0)
        return sorted(out, key=repr)

    for budget, used, goal in ((1000, 700, 100), (1000, 1000, 0), (1000, 1000, 300), (0, 500, 100), (10_000, 0, 10_000), (1000, 995, 1)):
        got = S.working_set(*tables, budget, used, goal, "x", fresh).collect()
        assert sorted(map(tuple, got), key=repr) == plain(budget, used, goal), (budget, used, goal)


def test_nothing_to_draw(spark):
    assert draw(spark, [], [person("h")]) == {} and draw(spark, [clip("a")], []) == {}
    assert draw(spark, [clip("a")], [person("h")], [done("h", "a")]) == {}
    with pytest.raises(TypeError):
        D.Settings(unknown=1)
