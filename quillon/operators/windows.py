"""Training windows of phrases: gaps with verdicts, windows of drawn lengths, prompts, and why a window goes.

Whether two phrases may stand in one window, and what stands between them, depends on
their gap alone and is found for all gaps at once; where a window ends depends on where it
began, which one scan over a recording's phrases decides. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import columns as X
from quillon.operators.segment import SPACE
from quillon.sources.shared import cut

#: Labels that are speech, and what the others are called in a text.
SPEECH = ("whispering", "normal speech")
VOCAL = {"breathing": "breathing", "moaning": "moaning", "kissing": "oral sounds", "mouth sounds": "oral sounds", "licking": "oral sounds", "oral sounds": "oral sounds"}
#: A label's clip may begin so many milliseconds before its gap.
SLACK_MS = 50
KEPT, SPOKEN, LENGTH, LOOPED, WORDY = "kept", "speech in a gap", "length", "looped", "too many words"


def gap_verdicts(phrases: DataFrame, labels: DataFrame, least: float = 0.7, speech: tuple[str, ...] = SPEECH, vocal: dict[str, str] = VOCAL) -> DataFrame:
    """phrases(source, start, end, text) with what comes before each: gap (seconds, null for the first), tag, spoken.

    labels(source, ms, label) belong to the gap in which they begin. A gap of ``least``
    seconds or more has the tag of its most frequent vocal label (the first one's on ties), else
    a pause rounded to half seconds (ties to even); it is ``spoken`` if a label of speech begins in it.
    """
    order = W.partitionBy("source").orderBy("start", "end", "text")
    own = phrases.withColumns({"k": F.row_number().over(order), "_e": F.lag("end").over(order)}).withColumn("gap", F.col("start") - F.col("_e"))
    # gaps don't overlap: a label lies in the last gap that begins at or before it, if that hasn't ended
    begins = own.filter(F.col("gap") >= least).select("source", (F.col("_e") * 1000 - SLACK_MS).alias("t"), F.lit(0).alias("_o"), F.struct("k", (F.col("start") * 1000).alias("until")).alias("_g"), F.lit(None).cast("string").alias("label"))
    heard = labels.select("source", F.col("ms").cast("double").alias("t"), F.lit(1).alias("_o"), F.lit(None).cast(begins.schema["_g"].dataType).alias("_g"), "label")
    last = F.last("_g", ignorenulls=True).over(W.partitionBy("source").orderBy("t", "_o").rowsBetween(W.unboundedPreceding, 0))
    hits = begins.unionByName(heard).withColumn("_in", last).filter((F.col("_o") == 1) & (F.col("t") < F.col("_in.until")))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in vocal.items() for x in kv]), F.col("label"))
    each = hits.select("source", F.col("_in.k").alias("k"), "t", named.alias("name"), F.col("label").isin(*speech).alias("spoken"))
    counted = each.groupBy("source", "k", "name").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"), F.max("spoken").alias("spoken"))
    best = F.max(F.when(F.col("name").isNotNull(), F.struct("n", (-F.col("t")).alias("t"), "name")))
    told = counted.groupBy("source", "k").agg(best["name"].alias("name"), F.max("spoken").alias("spoken"))
    pause = F.format_string("[pause %.1fs]", F.greatest(F.lit(0.5), F.bround(F.col("gap") * 2, 0) / 2))
    tag = F.when(F.col("gap") >= least, F.coalesce(F.concat(F.lit("["), "name", F.lit("]")), pause))
    return own.join(told, ["source", "k"], "left").select("source", "k", "start", "end", "text", "gap", tag.alias("tag"), F.coalesce("spoken", F.lit(False)).alias("spoken"))


def drawn_length(source: Column, start: Column, shortest: float, longest: float, seed: int) -> Column:
    """The length that a window may have: uniform, by a hash of the source, the seed and its begin in milliseconds."""
    digest = F.md5(F.concat_ws("|", source.cast("string"), F.lit(str(seed)), F.floor(start * 1000).cast("string")))
    return F.lit(shortest) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32) * (longest - shortest)


def longest_run(words: Column) -> Column:
    """How often a word stands in a row at most; empty ones end a run."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(at: Column, w: Column) -> Column:
        run = F.when((w != "") & (at["last"] == w), at["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(at["best"], run).alias("best"))

    return F.aggregate(words, start, step, lambda at: at["best"])


def speech_windows(phrases: DataFrame, labels: DataFrame, shortest: float = 2.0, longest: float = 20.0, broken: float = 6.0, prompt: float = 4.0, most_words: int = 55, most_repeats: int = 3, seed: int = 0, least: float = 0.7) -> DataFrame:
    """(source, uid, start, end, dur, text, prompt_start, prompt_end, reason) of every window that was tried.

    A window goes on until a gap of over ``broken`` seconds, until the next phrase would make it
    longer than its drawn length, or until a gap in which somebody speaks, which kills it. Of
    the reasons, `kept` windows are the result; the others say why not: speech in a gap,
    a length out of bounds, a word more than ``most_repeats`` times in a row, too many words. A
    window has a prompt if there are ``prompt`` seconds before it.
    """
    told = gap_verdicts(cut(phrases.select("source", "start", "end", "text")), labels, least)  # read twice
    entry = F.struct("k", "start", "end", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "gap", "tag", "spoken", drawn_length(F.col("source"), F.col("start"), shortest, longest, seed).alias("length"))
    rows = told.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(0.0).alias("length"), F.lit(False).alias("dead"))
    too_far = lambda at, x: (x["gap"] > broken) | (x["end"] - at["start"] > at["length"])
    ends = lambda at, x: too_far(at, x) | x["spoken"]

    def step(at: Column, x: Column) -> Column:
        fresh = F.struct(x["k"].alias("a"), x["k"].alias("b"), x["start"].alias("start"), x["end"].alias("end"), x["length"].alias("length"), F.lit(False).alias("dead"))
        on = F.struct(at["a"].alias("a"), x["k"].alias("b"), at["start"].alias("start"), x["end"].alias("end"), at["length"].alias("length"), F.lit(False).alias("dead"))
        return F.when((at["a"] == 0) | ends(at, x), fresh).otherwise(on)

    closed = lambda at, dead: F.when(at["a"] > 0, F.struct(at["a"].alias("a"), at["b"].alias("b"), at["start"].alias("start"), at["end"].alias("end"), at["length"].alias("length"), dead.alias("dead")))
    kind = "struct<a:int,b:int,start:double,end:double,length:double,dead:boolean>"
    found = X.scan(F.col("_p"), none, step, lambda at, x: F.when(ends(at, x), closed(at, x["spoken"] & ~too_far(at, x))), kind, lambda at: closed(at, F.lit(False)))

    def text(w: Column) -> Column:
        inside = F.slice("_p", w["a"], w["b"] - w["a"] + 1)
        parts = F.flatten(F.transform(inside, lambda x: F.array(F.when(x["k"] > w["a"], F.coalesce(x["tag"], F.lit(""))).otherwise(F.lit("")), x["text"])))
        return F.array_join(F.filter(parts, lambda p: p != ""), " ")

    # texts are put together before windows become rows, which would each carry all phrases
    out = rows.select("source", F.explode(F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["dead"].alias("dead"), text(w).alias("text")))).alias("w")).select("source", "w.*")
    said = F.filter(F.split("text", "(?U)" + SPACE), lambda w: w != "")
    plain = F.transform(F.filter(said, lambda w: ~F.startswith(w, F.lit("["))), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    size = F.col("end") - F.col("start")
    reason = F.when(F.col("dead"), SPOKEN).when(~size.between(shortest, longest), LENGTH).when(longest_run(plain) > most_repeats, LOOPED).when(F.size(said) > most_words, WORDY).otherwise(KEPT)
    prompted = F.col("start") >= prompt
    return out.select(
        "source", F.format_string("%s_%09d", F.col("source").cast("string"), F.floor(F.col("start") * 1000)).alias("uid"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round(size, 3).alias("dur"), "text",
        F.when(prompted, F.round(F.col("start") - prompt, 3)).alias("prompt_start"), F.when(prompted, F.round("start", 3)).alias("prompt_end"), reason.alias("reason"),
    )
