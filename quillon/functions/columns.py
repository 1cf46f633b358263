"""Column builders shared by the operators. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast("array<string>"))


def jaccard(a, b) -> Column:
    """Elements of a that are in b, over the distinct union; 1 if both are empty. Null counts as empty."""
    a, b = _array(a), _array(b)
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / F.size(F.array_union(a, b)))


def set_f1(a, b) -> Column:
    """2 * shared / (size a + size b); 1 if both are empty."""
    a, b = _array(a), _array(b)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothed_ratio(total, n, prior: float, at: float = 0.5) -> Column:
    """(total + prior * at) / (n + prior), within 0 to 1."""
    return clamp((total + prior * at) / (n + prior))


def uncertainty(probs) -> Column:
    """The largest 1 - |2p - 1| of a map of probabilities; 0 for an empty map."""
    return F.coalesce(F.array_max(F.transform(F.map_values(probs), lambda p: 1 - F.abs(2 * p - 1))), F.lit(0.0))


def argmax_key(probs, allowed: Sequence[str] | None = None) -> Column:
    """The key of the largest value among the allowed keys, the last key on ties; null if there is none."""
    m = F.map_filter(probs, lambda k, v: k.isin(*allowed)) if allowed else probs
    return F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]


def need(votes, target, max_votes, crowd_conf, uncertain, skips) -> Column:
    """How much a clip needs another answer."""
    missing = 0.5 * F.greatest(F.lit(0.0), 1 - votes / target)
    doubt = 0.3 * F.coalesce(1 - crowd_conf, uncertain) + 0.2 * uncertain
    return (missing + doubt) * F.when(votes >= max_votes, 0.05).otherwise(1.0) / (1 + skips)


def need_by_agreement(votes, target, agreement, uncertain, skips) -> Column:
    """The same where votes beyond the target count less and less, and agreement stands for the crowd's confidence."""
    missing = 0.5 * F.greatest(F.lit(0.0), 1 - votes / target)
    doubt = 0.3 * uncertain + 0.2 * F.coalesce(1 - agreement, uncertain)
    return (missing + doubt) / (1 + 0.25 * F.greatest(F.lit(0), votes - target)) / (1 + skips)


def intensity(level) -> Column:
    """Four steps of a loudness between 0 and 1."""
    return F.when(level < 0.25, "soft").when(level < 0.5, "gentle").when(level < 0.78, "firm").otherwise("vigorous")


def recording_of(uid) -> Column:
    """The recording a clip was cut from, for the three forms of clip identifiers."""
    uid = F.col(uid) if isinstance(uid, str) else uid
    return F.when(uid.startswith("yt:"), F.substring_index(uid, ":", 2)).when(uid.startswith("fs:"), uid).otherwise(F.regexp_replace(uid, r"_\d+$", ""))


def start_of(uid) -> Column:
    """Start in seconds, from the milliseconds (or the seconds of a video) that end an identifier; null without."""
    uid = F.col(uid) if isinstance(uid, str) else uid
    ms = F.regexp_extract(uid, r"_(\d+)$", 1)
    video = F.regexp_extract(uid, r"^yt:[^:]+:(\d+)", 1)
    return F.when(video != "", F.try_to_number(video, F.lit("9999999999")).cast("double")).when(ms != "", ms.try_cast("double") / 1000)


def creator_of(uid) -> Column:
    return F.split_part(uid, F.lit("/"), F.lit(1))


def filename_safe(uid) -> Column:
    return F.regexp_replace(uid, r"[^A-Za-z0-9_.\-]", "_")


def crc_split(key, parts: int) -> Column:
    """crc32 of the key's text modulo parts: the same bucket in every language with crc32."""
    return F.crc32(key.cast("string") if isinstance(key, Column) else F.col(key).cast("string")) % parts


def sha1_mod10(key) -> Column:
    """The last decimal digit of the whole 160-bit SHA-1 number, by 16^k mod 10 = 6."""
    h = F.sha1(key)
    upper = F.aggregate(F.sequence(F.lit(1), F.lit(39)), F.lit(0), lambda acc, i: acc + F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    last = F.conv(F.substring(h, F.lit(40), F.lit(1)), 16, 10).cast("int")
    return (6 * upper + last) % 10


def normalise_labels(labels, synonyms: dict[str, str], menu: Sequence[str]) -> Column:
    """Lower-case, strip, map synonyms, keep what is on the menu, once each in order."""
    pairs = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]) if synonyms else None
    clean = F.transform(_array(labels), lambda x: F.trim(F.lower(x)))
    mapped = F.transform(clean, lambda x: F.coalesce(F.try_element_at(pairs, x), x)) if synonyms else clean
    return F.array_distinct(F.filter(mapped, lambda x: x.isin(*menu)))


def parse_answer(text, menu: Sequence[str], fallbacks: Sequence[tuple[str, str]] = ()) -> Column:
    """The longest menu entry that a free answer contains, then keyword fallbacks in order; null if none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for word, label in reversed(list(fallbacks)):
        out = F.when(low.contains(word), label).otherwise(out)
    for entry in sorted(menu, key=lambda m: (len(m), m)):
        out = F.when(low.contains(entry), entry).otherwise(out)
    return out


def tags(text, patterns: Sequence[tuple[str, str]]) -> Column:
    """Names of the patterns that the padded, lower-cased text matches, in the given order."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = F.array(*(F.when(padded.rlike(p), F.lit(t)) for t, p in patterns))
    return F.array_compact(hits)


#: Sounds that a recording's title promises.
TITLE_TAGS: tuple[tuple[str, str], ...] = (
    ("sex slapping", r"slap|clap|skin on skin|pounding|fap sound"),
    ("wet sounds", r"wet sound|squelch|wetsound|wet noise|fingering|fleshlight|\blube\b|lotion"),
    ("squirting", r"squirt"),
    ("spanking", r"spank"),
    ("vibrator", r"vibrat|hitachi|\bwand\b|thruster|\btoys?\b"),
    ("gagging", r"\bgag|deep ?throat"),
    ("whimpering", r"whimper"),
    ("growling", r"growl"),
    ("grunting", r"grunt|groan"),
    ("bed creaking", r"creak|squeak|bed sound"),
    ("laughing", r"laugh|giggl|chuckl"),
    ("gasping", r"gasp"),
    ("singing", r"\bsing(s|ing)?\b|\bsong|humming"),
)
#: Menu labels that a free text names.
FREE_TEXT: tuple[tuple[str, str], ...] = (
    ("laughing", r"laugh|giggl|chuckl"),
    ("gasping", r"gasp"),
    ("spanking", r"spank|beating"),
    ("clapping", r"\bclap"),
    ("scratching", r"writing|drag"),
    ("sticky", r"velcro|hook.and.loop|slime"),
    ("liquid", r"\brain"),
    ("oral sounds", r"slurp|suck"),
    ("crying", r"\bcr(y|ies|ying)\b|sob"),
)


def title_of(uid) -> Column:
    """The words of the title in a recording's identifier; empty for identifiers of other places and for names that are hashes."""
    stem = F.element_at(F.split(F.regexp_replace(uid, r"\.(m4a|mp3)(_\d+)?\z", ""), "/"), -1)
    none = F.contains(F.get(F.split(uid, "/"), F.lit(0)), F.lit(":")) | stem.rlike(r"\A[0-9a-f]{32,64}\z")
    return F.when(none, "").otherwise(F.lower(F.regexp_replace(stem, r"[-_.]+", " ")))


def title_tags(uid) -> Column:
    """What a recording's title promises, in the fixed order."""
    title = title_of(uid)
    return F.when(title == "", F.array().cast("array<string>")).otherwise(tags(title, TITLE_TAGS))


def labels_in(text, menu: Sequence[str] | None = None) -> Column:
    """Menu labels that a free text names, of those on the menu if one is given."""
    hits = [F.when(text.rlike(f"(?i){p}"), F.lit(t)) for t, p in FREE_TEXT if menu is None or t in menu]
    return F.coalesce(F.array_compact(F.array(*hits)), F.array()).cast("array<string>")


def merged_label(label, merge: dict[str, str]) -> Column:
    """struct(label, raw_label): the label as the ontology has it now, and, if that changed it, what it was."""
    new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in merge.items() for x in kv]), label), label) if merge else label
    return F.struct(new.alias("label"), F.when(new != label, label).alias("raw_label"))


def single_class(hits, background: str) -> Column:
    """The class if exactly one matched and the background didn't; the background if it alone matched; else null."""
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def override_classes(hits, rules: dict[str, Sequence[str]]) -> Column:
    """Where a winner is present, the classes it beats go."""
    for winner, losers in rules.items():
        hits = F.when(F.array_contains(hits, winner), F.array_except(hits, F.array(*map(F.lit, losers)))).otherwise(hits)
    return hits


def title_words(path) -> Column:
    """Last part of a path, lower-case, with -, _ and . as spaces."""
    return F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"[-_.]+", " ")


def max_run(text) -> Column:
    """The largest number of times a word stands in a row, bracketed tags left out."""
    words = F.filter(F.transform(F.split(F.regexp_replace(text, r"\[[^\]]*\]", " "), r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")), lambda w: w != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda acc: acc["best"])


def interval_iou(a0, a1, b0, b1, tick: float = 0.1) -> Column:
    """Intersection over union of two intervals on a grid of ticks; 0 if both are empty."""
    grid = lambda lo, hi: (F.greatest(F.floor(hi / tick), F.lit(0)) - F.greatest(F.floor(lo / tick), F.lit(0)))
    shared = F.greatest(F.lit(0), grid(F.greatest(a0, b0), F.least(a1, b1)))
    union = F.greatest(F.lit(0), grid(a0, a1)) + F.greatest(F.lit(0), grid(b0, b1)) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def rms_db(samples) -> Column:
    """Root mean square in decibels of an array of samples; null for an empty one."""
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when(F.size(samples) > 0, 20 * F.log10(F.greatest(F.sqrt(mean), F.lit(1e-10))))


def frame_db(samples, frame: int, share: float = 0.9) -> Column:
    """The given percentile (by rank) of the loudness of a signal's whole frames, in decibels; null if it has none."""
    n = F.floor(F.size(samples) / frame).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: rms_db(F.slice(samples, i * frame + 1, F.lit(frame))))
    return F.when(n > 0, F.get(F.array_sort(frames), F.floor((n - 1) * share).cast("int")))


def is_silent(samples, frame: int, floor: float = -50.0) -> Column:
    """Silence vote: even the loud frames stay under the floor."""
    return F.coalesce(frame_db(samples, frame) < floor, F.lit(True))


def loud_enough(level_db, floor: float = -50.0) -> Column:
    """Loudness gate; an unknown level doesn't pass."""
    return F.coalesce(level_db >= floor, F.lit(False))


def margin_choice(scores, positives: Sequence[str], negatives: Sequence[str], margin: float) -> Column:
    """The positive of the best score of a map if it leads the best negative by the margin, else null."""
    best = lambda names: F.array_max(F.transform(F.filter(F.map_entries(scores), lambda e: e["key"].isin(*names)), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    lead = best(positives)["v"] - F.coalesce(best(negatives)["v"], F.lit(0.0))
    return F.when(lead >= margin, best(positives)["k"])


def top_k_mean(scores, k: int) -> Column:
    """Mean of the k largest values of an array (of all, if fewer)."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)


def heat_level(n, largest) -> Column:
    return F.least(F.lit(4), F.ceil(4 * n / largest)).cast("int")


def allowed(voice, nsfw, content, want_voice, want_nsfw, excluded) -> Column:
    """Preference predicate; what is unknown is allowed."""
    ok = lambda c: F.coalesce(c, F.lit(True))
    return ok((want_voice == "any") | (voice == want_voice)) & ok(want_nsfw | ~nsfw) & ok(~F.array_contains(excluded, content))


#: Results that a scan gathers before it puts them away, so that it doesn't copy all of them at each step.
_CHUNK = 64


def let(value, body) -> Column:
    """body(value), with the value found once however often the body names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items, start, step, result, kind: str, finish=None) -> Column:
    """Of each item of an array, in order, the result by the state before it, nulls left out; ``step`` leads from state to state.

    ``finish`` makes one more result of the last state. In linear time, in the JVM.
    """
    some = lambda k: F.array().cast(k)
    first = F.struct(start.alias("at"), some(f"array<{kind}>").alias("now"), some(f"array<array<{kind}>>").alias("put"))

    def fold(acc: Column, x: Column) -> Column:
        full = F.size(acc["now"]) >= _CHUNK
        r = result(acc["at"], x).cast(kind)
        now = F.when(full, some(f"array<{kind}>")).otherwise(acc["now"])
        return F.struct(
            step(acc["at"], x).alias("at"),
            F.when(r.isNull(), now).otherwise(F.array_append(now, r)).cast(f"array<{kind}>").alias("now"),
            F.when(full, F.array_append(acc["put"], acc["now"])).otherwise(acc["put"]).cast(f"array<array<{kind}>>").alias("put"),
        )

    last = lambda acc: F.array_compact(F.array(finish(acc["at"]).cast(kind))) if finish else some(f"array<{kind}>")
    return F.aggregate(items, first, fold, lambda acc: F.concat(F.flatten(acc["put"]), acc["now"], last(acc)))
