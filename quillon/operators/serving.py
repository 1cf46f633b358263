"""What to label next: eligibility, tiers and the state of a labeller, as batch queries.

Serving one item at a time changes the state that the next draw sees; these
functions answer for the state as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.order import running
from quillon.operators.sample import hash_order
from quillon.sources.shared import cut


def tier(votes: Column, target: Column, gold: Column, boosted: Column, gold_votes: int = 12) -> Column:
    """0 gold, 1 boosted and started, 2 boosted, 3 started, 4 the rest."""
    started = (votes > 0) & (votes < F.least(target, F.lit(3)))
    return F.when(gold & (votes < gold_votes), 0).when(boosted & started, 1).when(boosted, 2).when(started, 3).otherwise(4)


def next_items(clips: DataFrame, people: DataFrame, seen: DataFrame, open_leases: DataFrame | None = None, each: int = 1, penalty: float = 0.15, by: str = "who") -> DataFrame:
    """(who, item, tier, score, rank): the best unseen active clips of every labeller, as long as there are any.

    clips(item, active, votes, target, gold, boosted, need); people(who);
    seen(who, item); open_leases(item). ``by`` names a column of people and seen: people
    alike in it have seen the same items, which then stand in seen once for all of them.
    All active clips are numbered in serving order once. The seen ones among them are
    numbered too: one with the number r at place p has p - r unseen before it, so the
    j-th unseen clip stands at j and as many as have fewer than j unseen before them. The work is that
    of ``seen``, not of people times clips, and no one's seen items are gathered.
    """
    t = clips.filter("active").withColumn("tier", tier(F.col("votes"), F.col("target"), F.col("gold"), F.col("boosted")))
    if open_leases is not None:
        t = t.join(open_leases.groupBy("item").agg(F.count(F.lit(1)).alias("_open")), "item", "left")
    else:
        t = t.withColumn("_open", F.lit(0))
    t = t.select("item", "tier", (F.col("need") - penalty * F.coalesce("_open", F.lit(0))).alias("score"))
    placed = cut(running(t, ["tier", F.col("score").desc(), "item"]))
    groups = people.select(F.col(by).alias("_by")).distinct()
    known = seen.select(F.col(by).alias("_by"), "item").distinct().join(placed.select("item", F.col("place").alias("at")), "item").select("_by", "at")
    passed = running(known, ["at"], "_by").withColumn("_d", F.col("at") - F.col("place")).filter(F.col("_d") < each)
    # at most ``each`` counts of a group
    before = passed.groupBy("_by", "_d").agg(F.count(F.lit(1)).alias("_n")).groupBy("_by").agg(F.collect_list(F.struct("_d", "_n")).alias("_s"))
    number = groups.join(before, "_by", "left").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(each)))).filter(F.col("_k") <= each)
    place = F.col("_k") + F.aggregate(F.filter(F.coalesce("_s", F.array().cast("array<struct<_d:bigint,_n:bigint>>")), lambda x: x["_d"] < F.col("_k")), F.lit(0).cast("long"), lambda n, x: n + x["_n"])
    free = number.select("_by", "_k", place.alias("place")).join(placed, "place").select("_by", "_k", "item", "tier", "score")
    crew = people.select("who", F.col(by).alias("_of"))
    return crew.join(free, F.col("_of").eqNullSafe(F.col("_by"))).select("who", "item", "tier", "score", F.col("_k").alias("rank"))


def labelling_state(answers: DataFrame, gold: DataFrame, needed: int = 10) -> DataFrame:
    """(who, gold_done, gold_left, mode): training until enough gold clips are answered."""
    j = answers.join(gold.select("item").withColumn("_g", F.lit(1)), "item", "left")
    g = j.groupBy("who").agg(F.count("_g").alias("gold_done"))
    left = F.greatest(F.lit(0), F.lit(needed) - F.col("gold_done"))
    return g.select("who", "gold_done", left.alias("gold_left"), F.when(left == 0, "labelling").otherwise("training").alias("mode"))


def labelling_modes(clips: DataFrame, people: DataFrame, timeline_ui: int = 0, gold_votes: int = 12) -> DataFrame:
    """people(who, beta, ...) with mode, gold_done and gold_total; clips(gold, blocked, votes).

    The setting decides if it is 1 (`timeline`) or -1 (`tags`); else the timeline opens once every
    gold clip has its votes, or to those who asked for it.
    """
    gold = clips.filter(F.col("gold") & ~F.coalesce("blocked", F.lit(False))).agg(F.count(F.lit(1)).alias("gold_total"), F.count_if(F.col("votes") >= gold_votes).alias("gold_done"))  # one row
    open_now = (F.col("gold_total") > 0) & (F.col("gold_done") >= F.col("gold_total"))
    mode = F.when(F.lit(timeline_ui == 1), "timeline").when(F.lit(timeline_ui == -1), "tags").when(open_now | F.coalesce("beta", F.lit(False)), "timeline").otherwise("tags")
    return people.join(F.broadcast(gold)).withColumn("mode", mode)


def neediest(clips: DataFrame, open_leases: DataFrame, first: int = 300, penalty: float = 0.15, jitter: float = 0.05, seed: int = 0) -> DataFrame:
    """(item, need, score): the neediest clips, of which those that people hold open come later; chance breaks what is near.

    clips(item, active, need); the first ones by need are taken, then ranked anew.
    """
    top = clips.filter("active").orderBy(F.col("need").desc(), "item").limit(first)
    held = open_leases.groupBy("item").agg(F.count(F.lit(1)).alias("_open"))
    draw = F.conv(F.substring(hash_order(seed, F.col("item")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    score = F.col("need") - F.lit(penalty) * F.coalesce("_open", F.lit(0)) + F.lit(jitter) * draw
    return top.join(held, "item", "left").select("item", "need", score.alias("score")).orderBy(F.desc("score"), "item")


def interlude_gap(key: Column, low: int = 8, high: int = 17, seed: int = 0) -> Column:
    """Answers until the next interlude: uniform between the bounds, by a seeded hash."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(high - low + 1))).cast("int")


def takedowns(clips: DataFrame, kept: DataFrame, limit: int = 100) -> DataFrame:
    """Active clips to take down, with the reason: finished first, then those no longer wanted; the most voted first."""
    reason = F.when(F.col("votes") >= F.col("target"), "finished").otherwise("unwanted")
    c = clips.filter("active").join(kept.select("item").distinct().withColumn("_k", F.lit(True)), "item", "left")
    return c.filter((F.col("votes") >= F.col("target")) | F.col("_k").isNull()).withColumn("reason", reason).orderBy((F.col("votes") >= F.col("target")).desc(), F.col("votes").desc(), "item").limit(limit).select("item", "votes", "reason")
