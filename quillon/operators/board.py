"""Boards, snapshots, queues and other grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bounded(n: int | None, default: int = 50, most: int = 200) -> int:
    """A caller's limit within 1 to most."""
    return min(max(default if n is None else n, 1), most)


def leaderboard(labels: DataFrame, people: DataFrame, limit: int | None = None, who: str = "who", at: str = "at", name: str = "name") -> DataFrame:
    """(rank, who, name, labelled, last_at): most labels first, earlier last label and name break ties."""
    counts = labels.groupBy(who).agg(F.count(F.lit(1)).alias("labelled"), F.max(at).alias("last_at"))
    joined = counts.join(people, who).orderBy(F.col("labelled").desc(), "last_at", name).limit(bounded(limit))
    order = W.orderBy(F.col("labelled").desc(), "last_at", name)  # over the bounded board alone
    return joined.select(F.row_number().over(order).alias("rank"), who, name, "labelled", "last_at")


def contributions(labels: DataFrame, zone: str = "UTC", days: int = 371, until: str | None = None, at: str = "at") -> DataFrame:
    """(who, day, labelled, level): counts by the viewer's local day, and a heat level of 0 to 4 within each labeller."""
    day = F.to_date(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone))
    end = F.lit(until).cast("date") if until else F.current_date()
    g = labels.withColumn("day", day).filter((F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end)).groupBy("who", "day").agg(F.count(F.lit(1)).alias("labelled"))
    most = F.max("labelled").over(W.partitionBy("who"))
    return g.withColumn("level", F.least(F.lit(4), F.ceil(4 * F.col("labelled") / most)).cast("int"))


def queue_stats(clips: DataFrame) -> DataFrame:
    """clips(batch, kind, votes, target, need) -> counts, complete ones, votes and mean need by batch and kind."""
    return clips.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("votes") >= F.col("target")).alias("complete"), F.sum("votes").alias("votes"), F.avg("need").alias("mean_need"))


def inventory(rows: DataFrame, label: str = "label", creator: str = "creator", seconds: str = "seconds", target: int | None = None) -> DataFrame:
    """By label: clips, hours, creators, the top creator's share and, with a target, the deficit."""
    by = rows.groupBy(label, creator).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("s"))
    g = by.groupBy(label).agg(F.sum("n").alias("clips"), (F.sum("s") / 3600).alias("hours"), F.count(F.lit(1)).alias("creators"), (F.max("n") / F.sum("n")).alias("top_share"))
    return g.withColumn("deficit", F.greatest(F.lit(0), F.lit(target) - F.col("clips"))) if target is not None else g


def source_prior(rows: DataFrame, weights: dict[str, float], source: str = "source", label: str = "label") -> DataFrame:
    """(source, n, prior): mean weight of the labels a source has had; labels without a weight count 0."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(label)), F.lit(0.0))
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.avg(w).alias("prior"))


def progress(items: DataFrame, labels: DataFrame, seed: int = 0, item: str = "item") -> DataFrame:
    """One row: items, labelled (with the seed, at most all), answers and labellers."""
    a = items.agg(F.count(F.lit(1)).alias("items"))
    b = labels.agg(F.count_distinct(item).alias("touched"), F.count(F.lit(1)).alias("answers"), F.count_distinct("who").alias("labellers"))
    return a.join(b).select("items", F.least(F.col("items"), F.col("touched") + seed).alias("labelled"), "answers", "labellers")  # one row each


def mode_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, mode, n): the most frequent value, the first seen (by order) on ties."""
    g = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return g.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("mode"), "n"), F.struct("n", -F.col("first"))).alias("m")).select(key, "m.mode", "m.n")


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def shortfall(rows: DataFrame, sides: list, target: int, label: str = "label", side: str = "side") -> DataFrame:
    """Counts of each label by side as columns n_<side>, and how many are missing to the target on each side."""
    p = rows.groupBy(label).pivot(side, sides).agg(F.count(F.lit(1)))
    out = p.select(label, *(F.coalesce(F.col(str(s)), F.lit(0)).alias(f"n_{s}") for s in sides))
    return out.withColumn("short", sum((F.greatest(F.lit(0), F.lit(target) - F.col(f"n_{s}")) for s in sides), F.lit(0)))


def referral_funnel(people: DataFrame, labels: DataFrame) -> DataFrame:
    """people(who, referred_by, guest) -> by referrer: people, members, guests, labelling people and their labels."""
    n = labels.groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    j = people.filter(F.col("referred_by").isNotNull()).join(n, "who", "left")
    return j.groupBy("referred_by").agg(F.count(F.lit(1)).alias("people"), F.count_if(~F.col("guest")).alias("members"), F.count_if("guest").alias("guests"), F.count_if(F.col("n") > 0).alias("labelling"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"))
