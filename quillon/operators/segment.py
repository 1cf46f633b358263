"""Segmentation of time-aligned streams: phrases, gaps, windows, packing, tag grammar.

Window functions and closed forms where the rules allow it. Rules that depend on
what was decided before (run caps, packing) are folds over one recording, in Arrow
batches of recordings; a recording is the unit that cannot be split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.functions import columns as X
from quillon.operators.order import running
from quillon.operators.sample import hash_order
from quillon.sources.shared import cut

ENTRIES = "array<struct<type:string,start:double,end:double,word:string>>"
SPANS = "array<struct<start:double,end:double,kind:string,text:string>>"


def words_to_alignment(words: DataFrame, gap: float = 0.7, source: str = "source") -> DataFrame:
    """words(source, start, end, word) -> (source, type, start, end, word) with a silence before each word after a longer gap."""
    order = W.partitionBy(source).orderBy("start", "end")
    prev = F.lag("end", 1, 0.0).over(order)
    word = F.struct(F.lit("word").alias("type"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("word"))
    silence = F.struct(F.lit("silence").alias("type"), F.col("_prev").cast("double").alias("start"), F.col("start").cast("double").alias("end"), F.lit(None).cast("string").alias("word"))
    rows = words.withColumn("_prev", prev).select(source, F.explode(F.when(F.col("start") - F.col("_prev") > gap, F.array(silence, word)).otherwise(F.array(word))).alias("e"))
    return rows.select(source, "e.*")


def gap_windows(start: Column, end: Column, longest: float = 12.0, shortest: float = 1.5) -> Column:
    """Array of windows of a gap: full lengths, then a remainder that isn't too short; empty for short gaps."""
    n = F.floor((end - start - shortest) / longest)
    window = lambda k: F.struct((start + k * longest).alias("start"), F.least(start + (k + 1) * longest, end).alias("end"))
    return F.when(end - start >= shortest, F.transform(F.sequence(F.lit(0).cast("long"), n), window)).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def gaps_between_words(words: DataFrame, least: float = 0.8, source: str = "source") -> DataFrame:
    """(source, start, end): gaps after the latest end so far, so overlapping words make none."""
    order = W.partitionBy(source).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return words.withColumn("_r", reached).filter(F.col("start") - F.col("_r") >= least).select(source, F.col("_r").alias("start"), F.col("start").alias("end"))


def dense_windows(gaps: DataFrame, hop: float = 3.0, tail: float = 0.4, pad: float = 1.0, longest: float = 8.0, least: float = 0.8) -> DataFrame:
    """Each gap (start, end) as overlapping windows: adds window_start and window_seconds."""
    g0, g1 = F.col("start"), F.col("end")
    last = F.ceil((g1 - tail - g0) / hop).cast("int") - 1
    rows = gaps.filter(g1 - g0 >= least).withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    cursor = g0 + F.col("_k") * hop
    return rows.withColumns({"window_start": F.greatest(F.lit(0.0), cursor - pad), "window_seconds": F.least(F.lit(longest), g1 - cursor + 2 * pad)}).drop("_k")


def cut_geometry(start: Column, duration: Column) -> tuple[Column, Column]:
    """Start and length of a cut around a clip: a second before, at most eight in all."""
    return F.greatest(F.lit(0.0), start - 1), F.least(F.lit(8.0), duration + 2)


def video_windows(spans: DataFrame, step: float = 30.0, most: int = 80) -> DataFrame:
    """spans(id, kind, start, end): single videos lose a minute at both ends (if over 180 s), chapters 3 s (if over 12 s);
    then a window every step seconds, at most ``most``, evenly spread. Adds window_start."""
    size = F.col("end") - F.col("start")
    trim = F.when((F.col("kind") == "single") & (size > 180), 60.0).when((F.col("kind") == "chapter") & (size > 12), 3.0).otherwise(0.0)
    s = spans.withColumns({"_a": F.col("start") + trim, "_b": F.col("end") - trim})
    n = F.greatest(F.lit(1), F.floor((F.col("_b") - F.col("_a")) / step).cast("int"))
    s = s.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(most)) - 1)))
    at = F.when(F.col("_n") <= most, F.col("_i")).otherwise(F.bround(F.col("_i") * (F.col("_n") - 1) / (most - 1)).cast("int"))
    return s.withColumn("window_start", F.col("_a") + at * step).drop("_a", "_b", "_n", "_i")


# -- folds over one recording


def split_spans(entries, gap: float = 0.7, longest_run: float = 20.0, shortest_phrase: float = 1.0, longest_window: float = 12.0, shortest_gap: float = 1.5) -> Column:
    """Phrases and gap windows of a recording's entries: array<struct<start, end, kind, text>>, in order of start.

    Entries that aren't whole go. Of the others in order of start, every silence longer than
    ``gap`` after the first word (any, where there are no words) gives its windows by
    ``gap_windows``. Words make a phrase until a silence or gap of that length, or until it would be
    longer than ``longest_run``. One scan over the words finds where phrases end; their texts
    are cut from the array.
    """
    right = lambda x: F.coalesce((x["start"] < x["end"]) & ~F.isnan(x["start"]) & ~F.isnan(x["end"]), F.lit(False))
    whole = F.filter(F.coalesce(entries.cast(ENTRIES), F.array().cast(ENTRIES)), right)
    placed = F.transform(whole, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"), (x["type"] == "word").alias("word"), x["word"].alias("text")))
    ordered = F.transform(F.array_sort(placed), lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(x["word"], F.lit(False)).alias("word"), F.coalesce(x["text"], F.lit("")).alias("text")))
    quiet = lambda x: ~x["word"] & (x["end"] - x["start"] > gap)
    # a phrase that is going on: where it began and ended last, by place and by time; place -1: none
    none = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0.0).alias("begin"), F.lit(0.0).alias("end"))
    on = lambda at: at["a"] >= 0
    over = lambda at, x: on(at) & (quiet(x) | (x["word"] & ((x["start"] - at["end"] > gap) | (x["end"] - at["begin"] > longest_run))))

    def step(at: Column, x: Column) -> Column:
        goes_on = on(at) & ~over(at, x)
        word = F.struct(F.when(goes_on, at["a"]).otherwise(x["i"]).alias("a"), x["i"].alias("b"), F.when(goes_on, at["begin"]).otherwise(x["start"]).alias("begin"), x["end"].alias("end"))
        return F.when(x["word"], word).when(quiet(x), none).otherwise(at)

    phrase = lambda at: F.when(on(at) & (at["end"] - at["begin"]).between(shortest_phrase, longest_run), at)
    span = lambda start, end, kind, text: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    def spans(rows: Column) -> Column:
        ends = X.scan(rows, none, step, lambda at, x: F.when(over(at, x), phrase(at)), "struct<a:int,b:int,begin:double,end:double>", phrase)
        said = lambda p: F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(F.slice(rows, p["a"] + 1, p["b"] - p["a"] + 1), lambda x: x["word"]), lambda x: x["text"]), " "), "(?U)" + SPACE, " "))
        speech = F.filter(F.transform(ends, lambda p: span(p["begin"], p["end"], "speech", said(p))), lambda x: x["text"] != "")
        word = F.coalesce(F.get(F.filter(rows, lambda x: x["word"]), F.lit(0))["i"], F.lit(-1))  # the first one's place
        late = X.let(word, lambda first: F.filter(rows, lambda x: quiet(x) & (x["i"] > first)))
        windows = F.flatten(F.transform(late, lambda x: F.transform(gap_windows(x["start"], x["end"], longest_window, shortest_gap), lambda w: span(w["start"], w["end"], "trigger_candidate", F.lit(None)))))
        return F.array_sort(F.concat(speech.cast(SPANS), windows.cast(SPANS)))

    return X.let(ordered, spans)


def split_alignment(recordings: DataFrame, entries: str = "entries", **rules) -> DataFrame:
    """recordings(..., entries) -> spans, one row each: all columns but entries, then start, end, kind, text, uid.

    uid is the source with the start in milliseconds, truncated, in nine digits. A row's
    entries are all that a step needs, so nothing is shuffled.
    """
    rest = [c for c in recordings.columns if c != entries]
    rows = recordings.select(*rest, F.explode(split_spans(F.col(entries), **rules)).alias("_s")).select(*rest, "_s.*")
    return rows.withColumn("uid", F.format_string("%s_%09d", F.col("source"), (F.col("start") * 1000).cast("bigint"))) if "source" in rest else rows


def span_summary(spans: DataFrame) -> DataFrame:
    """(kind, spans, seconds, hours, words)."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    d = F.col("end") - F.col("start")
    return spans.groupBy("kind").agg(F.count(F.lit(1)).alias("spans"), F.sum(d).alias("seconds"), (F.sum(d) / 3600).alias("hours"), F.sum(n).alias("words"))


def group_neighbours(segments: list[tuple], target: float = 5.0, longest: float = 8.0, least: int = 2, join: float = 0.1) -> list[list[int]]:
    """Indices of neighbours (by start) put together until the target; groups of fewer than ``least`` go."""
    order = sorted(range(len(segments)), key=lambda i: segments[i][0])
    out, group, total = [], [], 0.0

    def flush() -> None:
        nonlocal group, total
        if len(group) >= least:
            out.append(group)
        group, total = [], 0.0

    for i in order:
        d = segments[i][1]
        if d > longest:
            flush()
            continue
        if group and total + join + d > longest:
            flush()
        total = total + d + (join if group else 0.0)  # from left to right, as the SQL adds: which side of the target a sum falls on hangs on it
        group = [*group, i]
        if total >= target:
            flush()
    flush()
    return out


def concat_neighbours(segments: DataFrame, target: float = 5.0, longest: float = 8.0, least: int = 2, join: float = 0.1) -> DataFrame:
    """segments(source, file_name, text, start, duration) -> (source, files, text, seconds); sources never mix."""
    schema = "source string, files array<string>, text string, seconds double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        source, files, texts, seconds = pdf.source.iloc[0], pdf.file_name.tolist(), pdf.text.tolist(), pdf.duration.tolist()
        out = []
        for g in group_neighbours(list(zip(pdf.start.tolist(), seconds)), target, longest, least, join):
            out.append((source, [files[i] for i in g], " ".join(texts[i] for i in g if texts[i]), sum(seconds[i] for i in g) + join * (len(g) - 1)))
        return pd.DataFrame(out, columns=["source", "files", "text", "seconds"])

    return segments.select("source", "file_name", "text", F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration")).groupBy("source").applyInPandas(fold, schema)


def pack_windows(entries: list, lengths, gap: float = 0.7, broken: float = 6.0, tag: str = "[pause]", max_words: int = 55) -> list[tuple[float, float, str]]:
    """Phrases (start, end, text) packed into windows of drawn lengths; gaps inside become tags."""
    out, window, text, words, length = [], None, [], 0, next(lengths)
    for start, end, phrase in sorted(entries):
        n = len(phrase.split())
        if window and (start - window[1] > broken or end - window[0] > length or words + n > max_words):
            out.append((window[0], window[1], " ".join(text)))
            window, text, words, length = None, [], 0, next(lengths)
        if window and start - window[1] >= gap:
            text.append(tag)
        window = (window[0], end) if window else (start, end)
        text.append(phrase)
        words += n
    if window:
        out.append((window[0], window[1], " ".join(text)))
    return out


def packed_windows(spans: DataFrame, shortest: float = 2.0, longest: float = 20.0, seed: int = 0, **rules) -> DataFrame:
    """spans(source, start, end, text) -> (source, start, end, text); lengths drawn from a hash of source, seed and number."""
    import zlib

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf.source.iloc[0]

        def lengths():
            k = 0
            while True:
                u = zlib.crc32(f"{source}|{seed}|{k}".encode()) / 2**32
                yield shortest + u * (longest - shortest)
                k += 1

        rows = pack_windows(list(zip(pdf.start, pdf.end, pdf.text.fillna(""))), lengths(), **rules)
        return pd.DataFrame([(source, *r) for r in rows], columns=["source", "start", "end", "text"])

    return spans.select("source", "start", "end", "text").groupBy("source").applyInPandas(fold, "source string, start double, end double, text string")


INTENSITIES = {"soft": 0.5, "gentle": 0.55, "slow": 0.6, "firm": 0.75, "loud": 0.8, "vigorous": 0.85}
PLAIN = 0.65


#: White space of Python's str: Unicode's and four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]+"
TAG = r"\[[^\[\]]+\]"


def parse_script(transcript: Column) -> Column:
    """Speech and tags of a script: array<struct<kind, text, name, intensity, modifier>>.

    ``[word]`` is a trigger or, if a known intensity, binds to the next trigger;
    speech between clears it and dangling ones go. White space in speech is
    collapsed, blank speech is none, and brackets that enclose no tag are speech.
    Only the piece before matters to a piece, so the cost is linear in the text.
    """
    table = F.create_map(*[F.lit(x) for kv in INTENSITIES.items() for x in kv])
    none = F.lit(None).cast("string")

    def pair(between: Column, raw: Column) -> Column:
        tag = F.regexp_replace(F.lower(F.substring(raw, F.lit(2), F.length(raw) - 2)), f"(?U)^{SPACE}|{SPACE}$", "")
        return F.array(F.struct(F.trim(F.regexp_replace(between, f"(?U){SPACE}", " ")).alias("text"), none.alias("tag")), F.struct(none.alias("text"), tag.alias("tag")))

    def known(tag: Column) -> Column:
        return F.map_contains_key(table, F.coalesce(tag, F.lit("")))

    def segment(p: Column, before: Column) -> Column:
        is_tag, modifier = p["tag"].isNotNull(), F.when(known(before["tag"]), before["tag"])
        intensity = F.when(is_tag, F.coalesce(F.try_element_at(table, modifier), F.lit(PLAIN)))
        return F.struct(F.when(is_tag, "trigger").otherwise("speech").alias("kind"), p["text"].alias("text"), p["tag"].alias("name"), intensity.alias("intensity"), F.when(is_tag, modifier).alias("modifier"))

    def segments(pieces: Column) -> Column:
        # one past the end, as the shifted array is longer: dropped with the intensities
        paired = F.zip_with(pieces, F.concat(F.array(F.lit(None).cast("struct<text:string,tag:string>")), pieces), segment)
        return F.filter(paired, lambda x: (x["text"].isNotNull() | x["name"].isNotNull()) & ~known(x["name"]))

    pieces = F.flatten(F.zip_with(F.split(transcript, TAG, -1), F.regexp_extract_all(transcript, F.lit(TAG), F.lit(0)), pair))
    spoken = F.filter(pieces, lambda p: p["tag"].isNotNull() | (p["text"] != ""))
    # bound to a variable, so that it is made once
    return F.element_at(F.transform(F.array(spoken), segments), 1)


def vocabulary(scripts: DataFrame, transcript: str = "transcript") -> DataFrame:
    """(name, kind, n): triggers and intensities of all scripts."""
    tag = F.explode(F.regexp_extract_all(F.lower(F.col(transcript)), F.lit(r"\[\s*([^\]]*?)\s*\]"), F.lit(1))).alias("name")
    rows = scripts.select(tag).filter("name <> ''")
    return rows.withColumn("kind", F.when(F.col("name").isin(*INTENSITIES), "intensity").otherwise("trigger")).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


def announcements(entries: DataFrame, keywords: dict[str, str], longest: float = 8.0, shortest: float = 0.6) -> DataFrame:
    """entries(source, type, start, end, word) -> (source, label, start, seconds): a keyword right before a silence."""
    order = W.partitionBy("source").orderBy("start", "end")
    key = F.regexp_replace(F.lower("word"), r"[^a-z']", "")
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in keywords.items() for x in kv]), key)
    rows = entries.withColumns({"_t": F.lead("type").over(order), "_s": F.lead("start").over(order), "_e": F.lead("end").over(order), "label": F.when(F.col("type") == "word", label)})
    seconds = F.least(F.lit(longest), F.col("_e") - F.col("_s"))
    return rows.filter(F.col("label").isNotNull() & (F.col("_t") == "silence") & (seconds >= shortest)).select("source", "label", F.col("_s").alias("start"), seconds.alias("seconds"))


def longest_quiet(frames: DataFrame, quiet: Column, key: str = "source", index: str = "i") -> DataFrame:
    """(key, start, length) of the longest run of quiet frames, the first on ties: islands by index minus rank."""
    q = frames.filter(quiet)
    island = F.col(index) - F.row_number().over(W.partitionBy(key).orderBy(index))
    runs = q.withColumn("_i", island).groupBy(key, "_i").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.groupBy(key).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r")).select(key, "r.start", "r.length")


def context_words(word_rows: DataFrame, gaps: DataFrame, n: int = 2) -> DataFrame:
    """gaps(source, start, end) with the texts of the n words that end last by its start (before) and begin first from its end on (after).

    An as-of join to the n nearest on either side: words and gaps are numbered together in
    order of time, so that a gap knows the number of the word next to it, and n numbers are
    joined to the words. Linear in words and gaps; neither a source nor its words are held in one
    task or array. Gaps that repeat get their words each; blank words give no text.
    """
    g = cut(gaps.withColumn("_gap", F.monotonically_increasing_id()))
    w = word_rows.select("source", "start", "end", F.coalesce(F.trim("word"), F.lit("")).alias("word"))
    out = g
    for name, at, of, sign in (("before", "end", "start", 1), ("after", "start", "end", -1)):
        words = w.select("source", (sign * F.col(at)).alias("_t"), F.lit(0).alias("_kind"), (sign * F.col(of)).alias("_u"), "word", F.lit(None).cast("long").alias("_gap"))
        asked = g.select("source", (sign * F.col(of)).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(words.schema["_u"].dataType).alias("_u"), F.lit(None).cast("string").alias("word"), "_gap")
        both = cut(running(words.unionByName(asked).filter("_t IS NOT NULL"), ["_t", "_kind", "_u", "word", "_gap"], "source", {"_n": (F.col("_kind") == 0).cast("long")}))
        near = both.filter("_kind = 1 AND _n > 0").select("source", "_gap", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - n + 1), F.col("_n"))).alias("_n"))
        found = near.join(both.filter("_kind = 0").select("source", "_n", "word"), ["source", "_n"])
        listed = found.groupBy("_gap").agg(F.sort_array(F.collect_list(F.struct((sign * F.col("_n")).alias("o"), "word"))).alias("_l"))
        text = F.array_join(F.filter(F.transform("_l", lambda x: x["word"]), lambda x: x != ""), " ")
        out = out.join(listed.select("_gap", text.alias(name)), "_gap", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.drop("_gap")


def word_errors(reference: str, heard: str) -> tuple[int, int, int]:
    """Deletions, insertions and substitutions between the words of two texts, by edit distance."""
    a, b = (re.findall(r"[a-z']+", (t or "").lower()) for t in (reference, heard))
    row = [(j, 0, j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i, 0, 0)]
        for j, y in enumerate(b, 1):
            if x == y:
                best = row[j - 1]
            else:
                sub, dele, ins = row[j - 1], row[j], new[j - 1]
                best = min((sub[0] + 1, sub[1], sub[2], sub[3] + 1), (dele[0] + 1, dele[1] + 1, dele[2], dele[3]), (ins[0] + 1, ins[1], ins[2] + 1, ins[3]))
            new.append(best)
        row = new
    return row[-1][1], row[-1][2], row[-1][3]


def word_error_rate(pairs: DataFrame, reference: str = "reference", heard: str = "heard") -> DataFrame:
    """Adds deletions, insertions, substitutions and wer (errors over reference words, at least 1)."""
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("deletions", "insertions", "substitutions")])

    @F.pandas_udf(kind)
    def errors(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_errors(x, y) for x, y in zip(a, b)], columns=kind.names)

    n = F.size(F.regexp_extract_all(F.lower(reference), F.lit("[a-z']+"), F.lit(0)))
    out = pairs.withColumn("_e", errors(reference, heard)).select("*", "_e.*").drop("_e")
    return out.withColumn("wer", (F.col("deletions") + F.col("insertions") + F.col("substitutions")) / F.greatest(n, F.lit(1)))


def chapter_windows(chapters: DataFrame, size: float = 4.0, hop: float = 3.0, most: int = 20, seed: int = 0) -> DataFrame:
    """chapters(id, start, end) -> (id, window_start): windows a hop apart that fit, at most ``most`` of a chapter by hash."""
    n = F.floor((F.col("end") - F.col("start") - size) / hop)
    w = chapters.filter(F.col("end") - F.col("start") >= size).select("id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.col("start") + k * hop)).alias("window_start"))
    r = F.row_number().over(W.partitionBy("id").orderBy(hash_order(seed, F.col("id"), F.floor(F.col("window_start") * 1000)), "window_start"))
    return w.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def seconds_of(text: str) -> float:
    """``predicted_seconds`` of one text."""
    tags = re.findall(TIMED_TAG, text)
    held = sum(float(s) if name == "pause" and s else EVENT_SECONDS for name, s in tags)
    return held + len(re.sub(TIMED_TAG, " ", text).split()) / WORDS_A_SECOND


def plan_script(text: str, longest: float = 12.0) -> list[str]:
    """Sentences packed into chunks that take at most so many seconds, pauses and events included.

    A longer sentence is split at commas, and a longer part at words; a tag is never
    split, and one that alone takes longer is a chunk of its own.
    """

    def packed(pieces: list[str]) -> list[str]:
        out: list[str] = []
        for p in pieces:
            if out and seconds_of(f"{out[-1]} {p}") <= longest:
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
        return out

    def ended(units: list[str], marks: str) -> list[str]:
        """Runs of units up to one that ends in a mark."""
        out: list[list[str]] = [[]]
        for u in units:
            out[-1].append(u)
            if u[-1] in marks:
                out.append([])
        return [" ".join(r) for r in out if r]

    units = lambda t: re.findall(r"(?:\[[^\]]*\]|[^\s\[]|\[)+", t)  # noqa: E731  words, and tags with their spaces
    fits = lambda t: seconds_of(t) <= longest
    pieces: list[str] = []
    for sentence in ended(units(text or ""), ".!?…"):
        for part in [sentence] if fits(sentence) else ended(units(sentence), ","):
            pieces += [part] if fits(part) else packed(units(part))
    return packed(pieces)


def planned_scripts(scripts: DataFrame, text: str = "text", longest: float = 12.0) -> DataFrame:
    """Adds chunks array<string>."""

    @F.pandas_udf("array<string>")
    def plan(s: pd.Series) -> pd.Series:
        return s.map(lambda t: plan_script(t, longest))

    return scripts.withColumn("chunks", plan(text))


#: What a clause asks the breath to do, and for how many seconds; the first that is found counts.
BREATH_CUES = (
    (r"(?i)\b(breathe in|breathing in|inhale|take a (deep |slow )?breath)\b", 4.0),
    (r"(?i)^\W*((and|now|slowly|then)\s+)*in\W*$", 4.0),
    (r"(?i)\bhold (it|that|your breath)\b|^\W*hold\W*$", 3.0),
    (r"(?i)\b(breathe out|breathing out|exhale|let it (all )?(out|go))\b", 5.0),
    (r"(?i)^\W*((and|now|slowly|then)\s+)*out\W*$", 5.0),
)
_QUOTES = "[\"')]*$"


def gap_plan(scripts: DataFrame, key: str = "id", text: str = "text", sentence: float = 0.6, ellipsis: float = 1.2, cues: bool = True) -> DataFrame:
    """(key, after, least, event): what the gap after a script's word (0: before the first) must hold, where it must hold anything.

    ``least`` is the largest of what asks for quiet there: a pause with its length, a sentence's
    end, an ellipsis, or a clause that is a breathing cue. ``event``: a tag that is no pause
    stands there. Clauses end at . ! ? , ; : and ellipses. One scan over a script's tokens.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[[^\]]*\]|[^\s\[]+"), F.lit(0))
    tag = lambda x: x.rlike(f"^{TIMED_TAG}$")
    word = lambda x: ~tag(x) & x.rlike("(?i)[a-z0-9]")
    ends = lambda x: x.rlike(r"(\.\.\.|…|[.!?,;:])" + _QUOTES)
    grown = lambda at, x: F.when(at["clause"] == "", x).otherwise(F.concat(at["clause"], F.lit(" "), x))
    first = F.struct(F.lit(0).alias("k"), F.lit("").alias("clause"))

    def step(at: Column, x: Column) -> Column:
        return F.when(word(x), F.struct((at["k"] + 1).alias("k"), F.when(ends(x), "").otherwise(grown(at, x)).alias("clause"))).otherwise(at)

    def told(at: Column, x: Column) -> Column:
        name, length = F.regexp_extract(x, TIMED_TAG, 1), F.regexp_extract(x, TIMED_TAG, 2)
        pause = name == "pause"
        cue = F.lit(0.0)
        for pattern, seconds in reversed(BREATH_CUES if cues else ()):
            cue = F.when(grown(at, x).rlike(pattern), seconds).otherwise(cue)
        quiet = F.greatest(cue, F.when(x.rlike(r"(\.\.\.|…)" + _QUOTES), ellipsis).when(x.rlike("[.!?]" + _QUOTES), sentence).otherwise(0.0))
        held = F.struct(at["k"].alias("after"), F.when(pause, F.coalesce(length.try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("least"), (~pause).alias("event"))
        said = F.struct((at["k"] + 1).alias("after"), quiet.alias("least"), F.lit(False).alias("event"))
        return F.when(tag(x), held).when(word(x) & ends(x) & (quiet > 0), said)

    found = X.scan(tokens, first, step, told, "struct<after:int,least:double,event:boolean>")
    rows = scripts.select(key, F.explode(found).alias("g")).select(key, "g.*")
    return rows.groupBy(key, "after").agg(F.max("least").alias("least"), F.max("event").alias("event"))


#: Of a script's length in seconds: words a second, and of a tag that isn't a pause with its own length.
WORDS_A_SECOND, EVENT_SECONDS = 2.6, 1.5
#: A tag with an optional length in seconds.
TIMED_TAG = r"\[([a-z ]+?)(?: ([\d.]+)s)?\]"


def predicted_seconds(text: Column) -> Column:
    """How long a script will take: its pauses as long as they say, other tags as events, and its words."""
    part = lambda n: F.regexp_extract_all(text, F.lit(TIMED_TAG), F.lit(n))
    lengths = F.zip_with(part(1), part(2), lambda name, s: F.when((name == "pause") & (s != ""), s.try_cast("double")).otherwise(F.lit(EVENT_SECONDS)))
    words = F.size(F.filter(F.split(F.regexp_replace(text, TIMED_TAG, " "), r"\s+"), lambda w: w != ""))
    return F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) + words / F.lit(WORDS_A_SECOND)


def retag(windows: DataFrame, verdicts: DataFrame, least: float = 0.5) -> DataFrame:
    """windows(uid, tag) and verdicts(uid, label, conf) -> uid, tag as judged and why: confirmed, changed, pause or dropped."""
    j = windows.join(verdicts, "uid", "left")
    sure = F.coalesce(F.col("conf") >= least, F.lit(False))
    why = F.when(sure & (F.col("label") == F.col("tag")), "confirmed").when(sure & (F.col("label") == "other"), "dropped").when(sure, "changed").otherwise("pause")
    return j.withColumn("why", why).select("uid", F.when(F.col("why") == "pause", "pause").when(F.col("why") != "dropped", F.col("label")).alias("tag"), "why")


def take_scores(takes: DataFrame, script: str = "script", heard: str = "heard", seconds: str | None = None) -> DataFrame:
    """Adds word_err (indices of script words that a diff replaced or deleted), laughs, len_ratio and score.

    The score counts errors, thrice each laugh that the script doesn't have, and 3 if the take's
    ``seconds`` (a column; none: not looked at) are under half or over 1.8 times what the script should take.
    """
    import difflib

    @F.pandas_udf("array<int>")
    def wrong(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = (re.findall(r"[a-z']+", (t or "").lower()) for t in (x, y))
            ops = difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes()
            return [i for op, i0, i1, _, _ in ops if op in ("replace", "delete") for i in range(i0, i1)]

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    said = F.coalesce(F.col(script), F.lit(""))
    laughs = F.when(said.rlike(r"(?i)laugh|\bha"), 0).otherwise(F.regexp_count(F.lower(F.coalesce(heard, F.lit(""))), F.lit(r"\bha(?:ha)+\b")))
    ratio = F.col(seconds) / F.greatest(F.lit(1.0), predicted_seconds(said)) if seconds else F.lit(None).cast("double")
    bad = F.coalesce((ratio < 0.5) | (ratio > 1.8), F.lit(False)).cast("int")
    out = takes.withColumns({"word_err": wrong(script, heard), "laughs": laughs, "len_ratio": ratio})
    return out.withColumn("score", (F.size("word_err") + 3 * F.col("laughs") + 3 * bad).cast("double"))


def balance(left: Column, right: Column, parts: int = 2) -> Column:
    """Stereo balance (-1 left to 1 right) of each part of two sample arrays, by their energies."""
    n = F.floor(F.size(left) / parts).cast("int")
    energy = lambda a, k: F.aggregate(F.slice(a, k * n + 1, n), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: (energy(right, k) - energy(left, k)) / F.greatest(energy(left, k) + energy(right, k), F.lit(1e-12)))
