"""Speech windows against the rules in loops."""

import hashlib
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from quillon.operators import segment, windows


def length(source, start, shortest=2.0, longest=20.0, seed=0):
    return shortest + int(hashlib.md5(f"{source}|{seed}|{int(start * 1000)}".encode()).hexdigest()[:8], 16) / 2**32 * (longest - shortest)


def between(labels, a, b):
    """What stands in a gap, or None if somebody speaks there."""
    heard = [x for ms, x in labels if a * 1000 - 50 <= ms < b * 1000]
    if set(heard) & set(windows.SPEECH):
        return None
    names = Counter(windows.VOCAL[x] for x in heard if x in windows.VOCAL)
    return f"[{names.most_common(1)[0][0]}]" if names else f"[pause {max(0.5, round((b - a) * 2) / 2):.1f}s]"


def says_again(text, most=3):
    last, run = "", 0
    for w in ("".join(c for c in t.lower() if c.isalnum()) for t in text.split() if not t.startswith("[")):
        run = run + 1 if w and w == last else 1
        last = w
        if run > most:
            return True
    return False


def plain(source, phrases, labels):
    out, here = [], 0
    while here < len(phrases):
        start, end, text = phrases[here]
        reason, after, most = "", here + 1, length(source, start)
        while after < len(phrases):
            a, b, more = phrases[after]
            if a - end > 6 or b - start > most:
                break
            if a - end >= 0.7:
                tag = between(labels, end, a)
                if tag is None:
                    reason = windows.SPOKEN
                    break
                text += " " + tag
            text, end, after = f"{text} {more}", b, after + 1
        if not reason:
            reason = windows.LENGTH if not 2 <= end - start <= 20 else windows.LOOPED if says_again(text) else windows.WORDY if len(text.split()) > 30 else windows.KEPT
        out.append((source, start, end, text, start - 4 if start >= 4 else None, reason))
        here = after
    return out


def test_windows(spark):
    rng = random.Random(3)
    phrases, labels, want = [], [], []
    for source in ("a", "b", "c"):
        at, mine, heard = 0.0, [], []
        for _ in range(150):
            size = rng.choice([1.0, 1.5, 2.5, 6.0])
            mine.append((at, at + size, " ".join(rng.choice(["uh,", "Uh", "one", "two", "three"]) for _ in range(rng.randrange(1, 9)))))
            gap = rng.choice([0.25, 0.5, 0.75, 1.25, 2.0, 7.0])
            for _ in range(rng.choice([0, 0, 1, 3])):
                heard.append((int((at + size) * 1000) + rng.randrange(-60, int(gap * 1000) + 60), rng.choice([*windows.VOCAL, "whispering", "tapping", "tapping"])))
            at += size + gap
        heard = sorted({ms: x for ms, x in heard}.items())
        phrases += [(source, *p) for p in mine]
        labels += [(source, *h) for h in heard]
        want += plain(source, mine, heard)
    rng.shuffle(phrases)
    got = windows.speech_windows(spark.createDataFrame(phrases, "source string, start double, end double, text string"), spark.createDataFrame(labels, "source string, ms long, label string"), most_words=30).collect()
    assert sorted((r.source, r.start, r.end, r.text, r.prompt_start, r.reason) for r in got) == sorted(want)
    reasons = Counter(r.reason for r in got)
    assert all(reasons[x] for x in (windows.KEPT, windows.SPOKEN, windows.LENGTH, windows.LOOPED, windows.WORDY))
    assert all(r.uid == f"{r.source}_{int(r.start * 1000):09d}" and r.dur == round(r.end - r.start, 3) for r in got)


def test_nothing_to_pack(spark):
    phrases = spark.createDataFrame([], "source string, start double, end double, text string")
    labels = spark.createDataFrame([("a", 5, "x")], "source string, ms long, label string")
    assert windows.speech_windows(phrases, labels).count() == 0
    one = spark.createDataFrame([("a", 5.0, 8.0, None)], phrases.schema)
    assert [(r.text, r.prompt_start, r.reason) for r in windows.speech_windows(one, labels.limit(0)).collect()] == [("", 1.0, "kept")]


def test_runs(spark):
    texts = ["a a a b", "a b a b", "a  a", "x x x x", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(windows.longest_run(F.split("t", " ")).alias("n"))
    assert [r.n for r in rows.collect()] == [3, 1, 1, 4, 1]


def test_a_long_recording_is_split_in_linear_time(spark):
    """4,000 words with silences between: 102 s when the entries were sorted anew for every phrase and silence."""
    rows = [x for i in range(4000) for x in (("word", 2.0 * i, 2 * i + 1.2, f"w{i}"), ("silence", 2 * i + 1.2, 2.0 * i + 2, None))]
    df = spark.createDataFrame([(rows,)], "e array<struct<type:string,start:double,end:double,word:string>>")
    at = time.monotonic()
    got = df.select(segment.split_spans(F.col("e")).alias("s")).first().s
    assert time.monotonic() - at < 30
    assert [(s.start, s.kind, s.text) for s in got] == [(2.0 * i, "speech", f"w{i}") for i in range(4000)]
