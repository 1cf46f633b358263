"""The next clip of every labeller: a schedule of passes over clips that are numbered once.

A labeller's draw goes through steps in a fixed order: the clip they have open; a hidden
retest; a control; then passes by kind of sound and voice, each of which tries the gold
set, started and fresh clips of thin classes, started and fresh clips. What a step may
take differs from labeller to labeller only by voice and content, so clips are numbered
in the step's order within cells of (step, voice, content). A labeller finds the best
clip of a cell that they haven't been given at the first number missing among those they
have, and compares at most six cells a step: the work is that of what was given, plus a
constant a labeller, never labellers times clips.

Draws by chance come from a seed, so that a run can be repeated. The state is that of the
tables; two labellers may draw the same clip.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import running
from quillon.sources.shared import cut

TIERS = ("gold", "thin started", "thin fresh", "started", "fresh")
VOICES = ("male", "female", "none")
OPEN, RETEST, CONTROL = -3, -2, -1


@dataclass(frozen=True)
class Settings:
    """What the passes go by; the rates' names are those of the tests that hold them."""

    repeat_rate: float = 0.04
    repeat_gap: int = 300
    repeat_gap_min: int = 30
    audit_repeat_rate: float = 0.12
    audit_repeat_gap: int = 15
    audit_control_rate: float = 0.3
    control_rate_min: float = 0.05
    control_rate_max: float = 0.25
    control_step: float = 0.01
    breadth_votes: int = 3
    gold_votes: int = 12
    male_share: float = 0.3
    penalty: float = 0.15
    jitter: float = 0.05


def chance(seed: int, what: str, *keys) -> Column:
    """A number from 0 to 1 that the seed, the purpose and the keys decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def permitted(voice, nsfw, content, excluded) -> Column:
    """Whether a person's content preference and the voice they don't want to hear allow a clip."""
    wants = F.coalesce(content, F.lit("both"))
    return ((wants == "both") | ((wants == "sfw") & ~nsfw) | ((wants == "nsfw") & nsfw)) & (excluded.isNull() | voice.isNull() | (voice != excluded))


def excluded_voice(content, voice_pref) -> Column:
    return F.when(~(F.coalesce(content, F.lit("")) == "sfw") & (voice_pref == "male"), "female").when(~(F.coalesce(content, F.lit("")) == "sfw") & (voice_pref == "female"), "male")


def numbered(clips: DataFrame, open_now: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """(cell, place, item, a, b, c): active clips in the order of each step they belong to, by cells; first is largest a, then b, then smallest c."""
    count = open_now.groupBy("item").agg(F.count(F.lit(1)).alias("_open"))
    c = clips.filter("active").join(count, "item", "left").withColumn("_c", chance(seed, "draw", "item"))
    votes, need = F.col("votes").cast("double"), F.col("need") + F.col("boost")
    started = (F.col("votes") > 0) & (F.col("votes") < F.least(F.col("target"), F.lit(settings.breadth_votes)))
    fresh = need - F.lit(settings.penalty) * F.coalesce("_open", F.lit(0)) + F.lit(settings.jitter) * chance(seed, "jitter", "item")
    entry = lambda name, when, a, b: F.when(when, F.struct(F.lit(name).alias("tier"), a.alias("a"), b.alias("b")))
    zero, thin = F.lit(0.0), F.col("boost") > 0
    steps = F.array(
        entry("gold", F.col("gold") & (F.col("votes") < settings.gold_votes), votes, F.col("need")),
        entry("thin started", thin & started, votes, need),
        entry("thin fresh", thin, fresh, zero),
        entry("started", started, votes, need),
        entry("fresh", F.lit(True), fresh, zero),
        entry("control", F.col("kind") == "control", F.col("need"), zero),
    )
    rows = c.select("item", F.col("_c").alias("c"), F.coalesce("voice", F.lit("none")).alias("v"), "nsfw", F.explode(F.array_compact(steps)).alias("e"))
    cells = rows.select("item", F.concat_ws("|", "e.tier", "v", F.col("nsfw").cast("string")).alias("cell"), "e.a", "e.b", "c")
    return cut(running(cells, [F.col("a").desc(), F.col("b").desc(), "c", "item"], "cell"))


def schedule(people: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """(who, step, cell): the cells of each step of a labeller's passes, in order of step; people(who, sound_pref, content_pref, voice_pref)."""
    sound = F.col("sound_pref")
    content, voice = F.coalesce("content_pref", F.lit("both")), F.coalesce("voice_pref", F.lit(""))
    sounds = F.when(sound.isin("speech", "nonspeech"), F.array(sound, F.lit("any"))).otherwise(F.array(F.lit("any")))
    both, never = F.array(F.lit(True), F.lit(False)), F.array(F.lit(False))
    males = F.when((content == "sfw") | (voice == "female"), never).when(voice == "male", both).when(chance(seed, "male", "who") < settings.male_share, both).otherwise(never)
    p = people.withColumn("_excl", excluded_voice(F.col("content_pref"), F.col("voice_pref")))
    passes = F.flatten(F.transform(sounds, lambda s: F.transform(F.when(s == "nonspeech", never).otherwise(males), lambda m: F.struct(s.alias("sound"), m.alias("male")))))
    tried = p.select("who", "content_pref", "_excl", F.posexplode(passes).alias("i", "p"))
    one = [(v, n) for v in VOICES for n in (True, False)]

    def fits(v: str, n: bool) -> Column:
        real = F.lit(None).cast("string") if v == "none" else F.lit(v)
        heard = (F.col("p.sound") == "any") | ((F.col("p.sound") == "speech") == F.lit(v != "none"))
        return heard & (~F.col("p.male") | F.lit(v == "male")) & permitted(real, F.lit(n), F.col("content_pref"), F.col("_excl"))

    cells = F.array_compact(F.array(*(F.when(fits(v, n), F.lit(f"{v}|{str(n).lower()}")) for v, n in one)))
    each = tried.select("who", "i", F.explode(cells).alias("rest"))
    tiers = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(TIERS)))
    return each.select("who", "i", "rest", F.explode(tiers).alias("t")).select("who", (F.col("i") * len(TIERS) + F.col("t.k")).alias("step"), F.concat_ws("|", "t.t", "rest").alias("cell"))


def draws(clips: DataFrame, people: DataFrame, given: DataFrame, labels: DataFrame, now, settings: Settings = Settings(), seed: int = 0) -> DataFrame:
    """(who, item, attempt, step): the next clip of every labeller for whom there is one; step OPEN, RETEST, CONTROL, or the pass's number from 0.

    clips(item, active, votes, target, gold, boost, need, voice, nsfw, kind);
    people(who, n: answers so far, status: quality, sound_pref, content_pref, voice_pref);
    given(who, item, attempt, state, assigned_at, expires_at): every assignment;
    labels(who, item, attempt, seq, unsure): their answers; ``now``: the time.
    """
    s = settings
    live = given.filter((F.col("state") == "open") & (F.col("expires_at") > now))
    active = clips.filter("active").select("item", "voice", "nsfw", "kind")
    audited = F.coalesce(F.col("status").isin("watch", "weak"), F.lit(False))
    gap = F.when(audited, s.audit_repeat_gap).otherwise(F.least(F.lit(s.repeat_gap), F.greatest(F.lit(s.repeat_gap_min), F.floor(F.col("n") / 2))))
    rep = F.when(audited, s.audit_repeat_rate).otherwise(s.repeat_rate)
    controls = labels.join(clips.filter("kind = 'control'").select("item"), "item", "left_semi").groupBy("who").agg(F.count(F.lit(1)).alias("_controls"))
    p = cut(people.join(controls, "who", "left").withColumns({"_gap": gap, "_rep": rep, "_r": chance(seed, "r", "who"), "_excl": excluded_voice(F.col("content_pref"), F.col("voice_pref"))}))
    rate = F.greatest(F.lit(s.control_rate_min), F.lit(s.control_rate_max) - F.lit(s.control_step) * F.coalesce("_controls", F.lit(0)))
    rate = F.when(audited, F.greatest(rate, F.lit(s.audit_control_rate))).otherwise(rate)
    none = F.lit(0.0)
    pick = lambda step, a, b, c, attempt=1: ["who", F.struct(F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"), (-a).alias("a"), (-b).alias("b"), c.alias("c"), F.col("item"), F.lit(attempt).alias("attempt")).alias("pick")]

    opened = live.join(active.select("item"), "item", "left_semi").join(people.select("who"), "who", "left_semi")
    first_open = opened.select(*pick(OPEN, none, none, F.unix_micros(F.col("assigned_at").cast("timestamp")).cast("double"), 0))  # 0: as it was assigned
    tried_again = given.filter("attempt = 2").select("who", "item").distinct()
    askers = p.filter((F.col("n") >= F.col("_gap")) & (F.col("_r") < F.col("_rep")))
    old = labels.filter("attempt = 1 AND NOT unsure").join(askers, "who").filter(F.col("seq") <= F.col("n") - F.col("_gap"))
    again = old.join(active, "item").filter(permitted(F.col("voice"), F.col("nsfw"), F.col("content_pref"), F.col("_excl"))).join(tried_again, ["who", "item"], "left_anti")
    retests = again.select(*pick(RETEST, none, none, chance(seed, "retest", "who", "item"), 2))

    order = numbered(clips, live, s, seed)
    wanted = F.array_compact(F.array(*(F.when(permitted(F.lit(None if v == "none" else v).cast("string"), F.lit(n), F.col("content_pref"), F.col("_excl")), F.lit(f"control|{v}|{str(n).lower()}")) for v in VOICES for n in (True, False))))
    checked = p.filter((F.col("_r") >= F.col("_rep")) & (F.col("_r") < F.col("_rep") + rate)).select("who", F.lit(CONTROL).alias("step"), F.explode(wanted).alias("cell"))
    steps = cut(schedule(p, s, seed).unionByName(checked))
    # the first number of a cell that a labeller hasn't been given: given ones that lead up without a gap, and one
    had = given.select("who", "item").distinct().join(order.select("item", "cell", "place"), "item")
    led = had.withColumn("_i", F.row_number().over(W.partitionBy("who", "cell").orderBy("place")))
    begun = led.groupBy("who", "cell").agg((F.count_if(F.col("place") == F.col("_i")) + 1).alias("place"))
    looked = steps.join(begun, ["who", "cell"], "left").withColumn("place", F.coalesce("place", F.lit(1).cast("long")))
    found = looked.join(order, ["cell", "place"]).select(*pick(F.col("step"), F.col("a"), F.col("b"), F.col("c")))
    best = first_open.unionByName(retests).unionByName(found).groupBy("who").agg(F.min("pick").alias("pick"))
    attempts = live.groupBy("who", "item").agg(F.max("attempt").alias("_attempt"))
    out = best.select("who", "pick.item", "pick.attempt", "pick.step").join(attempts, ["who", "item"], "left")
    return out.select("who", "item", F.when(F.col("step") == OPEN, F.col("_attempt")).otherwise(F.col("attempt")).cast("int").alias("attempt"), F.col("step").cast("int").alias("step"))
