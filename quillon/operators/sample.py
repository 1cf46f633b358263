"""Sampling, splitting and quotas. Randomness is a seeded hash of a key, never rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import running
from quillon.sources.shared import cut


def hash_order(seed: int, *keys) -> Column:
    """A pseudo-random order of keys: MD5 of seed and keys, the same in every language that has it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def interleave(rows: DataFrame, group: str, order: list, group_order: str | None = None) -> DataFrame:
    """Adds position (within the group) and turn order: first of each group, then the seconds, groups by first place or name.

    Sort by (position, group_rank) to read the groups round-robin.
    """
    position = F.row_number().over(W.partitionBy(group).orderBy(*order))
    first = rows.groupBy(group).agg(F.min(group_order or group).alias("_first"))
    ranks = running(first, ["_first", group], sums={"group_rank": F.lit(1).cast("long")}).select(group, F.col("group_rank").cast("int").alias("group_rank"))
    return rows.withColumn("position", position).join(ranks, group)


def round_robin_quota(rows: DataFrame, quota: int, share: float, creator: str, source: str, key: str, seed: int = 0, per_source: int | None = None) -> DataFrame:
    """At most quota rows; creators take turns in hash order, none beyond max(1, quota * share), sources within a creator take turns too."""
    most = max(1, int(quota * share))
    in_source = F.row_number().over(W.partitionBy(creator, source).orderBy(hash_order(seed, F.col(key)), key))
    r = rows.withColumn("_s", in_source)
    if per_source is not None:
        r = r.filter(F.col("_s") <= per_source)
    turn = F.row_number().over(W.partitionBy(creator).orderBy("_s", hash_order(seed, F.col(source)), source))
    r = r.withColumn("_t", turn).filter(F.col("_t") <= most)
    return r.orderBy("_t", hash_order(seed, F.col(creator)), creator).limit(quota).drop("_s", "_t")


def tempered_targets(counts: dict[str, int], total: int, alpha: float = 0.5) -> dict[str, int]:
    """Targets proportional to n^alpha; classes that cannot fill theirs are capped and the rest share what is left."""
    open_, out, left = {c: n for c, n in counts.items() if n > 0}, {}, total
    while open_:
        norm = sum(n**alpha for n in open_.values())
        want = {c: left * n**alpha / norm for c, n in open_.items()}
        full = [c for c in open_ if want[c] >= open_[c]]
        if not full:
            out |= {c: int(w) for c, w in want.items()}
            break
        for c in full:
            out[c] = open_.pop(c)
            left -= out[c]
    return out


def tempered_sample(rows: DataFrame, label: str, key: str, total: int, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """Rows by class up to tempered targets; only the table of class counts reaches the driver."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    targets = tempered_targets(counts, total, alpha)
    limit = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,int>")
    limits = rows.select(label).distinct().withColumn("_limit", F.coalesce(F.try_element_at(limit, F.col(label)), F.lit(0)).cast("long"))
    return first_by_hash(rows, label, key, limits, seed)


def first_by_hash(rows: DataFrame, label: str, key: str, limits: DataFrame, seed: int = 0) -> DataFrame:
    """Of each class the first rows in hash order, as many as limits(label, _limit) says; classes without a limit have none.

    A histogram of the first four digits of the hashes tells in which of 65,536 bins a class's
    limit falls. Rows of the bins before are in, and only those of that bin are numbered, so no task
    sorts a class.
    """
    h = hash_order(seed, F.col(key))
    binned = rows.withColumns({"_h": h, "_bin": F.conv(F.substring(h, 1, 4), 16, 10).cast("int")})
    hist = binned.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(label).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    summed = hist.withColumn("_upto", upto).join(limits, label).filter("_limit > 0")
    edges = cut(summed.groupBy(label).agg(F.max("_limit").alias("_limit"), F.min(F.when(F.col("_upto") >= F.col("_limit"), F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("before")))).alias("_e")))
    placed = binned.join(edges, label)
    sure = placed.filter(F.col("_e").isNull() | (F.col("_bin") < F.col("_e._bin")))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", key))
    edge = placed.filter(F.col("_bin") == F.col("_e._bin")).withColumn("_r", rank).filter(F.col("_r") <= F.col("_limit") - F.col("_e.before")).drop("_r")
    return sure.unionByName(edge).select(*rows.columns)


def cap_groups(rows: DataFrame, group: str, most: int, order: list, least: int = 1) -> DataFrame:
    """At most ``most`` rows of each group in the given order; groups left with fewer than ``least`` go."""
    kept = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
    if least <= 1:
        return kept
    big = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group)
    return kept.join(big, group, "left_semi")


def hash_split(rows: DataFrame, key: str, share: float, parts: int = 1000, name: str = "split") -> DataFrame:
    """Adds split: eval where crc32(key) mod parts is under share * parts."""
    return rows.withColumn(name, F.when(F.crc32(F.col(key).cast("string")) % parts < share * parts, "eval").otherwise("train"))


def strided_split(rows: DataFrame, source: str, stride: int, name: str = "split") -> DataFrame:
    """Every stride-th source in sorted order is eval. Sources are numbered over their distinct table."""
    numbered = running(rows.select(source).distinct(), [source])
    return rows.join(numbered.select(source, F.when((F.col("place") - 1) % stride == 0, "eval").otherwise("train").alias(name)), source)


def creator_split(rows: DataFrame, creator: str, evals: int, seed: int = 0, pinned: list[str] = (), blocked: list[str] = (), name: str = "split") -> DataFrame:
    """Creator-disjoint split: pinned creators and then others in hash order are eval; blocked creators' rows go."""
    people = rows.select(creator).distinct().filter(~F.col(creator).isin(*blocked)) if blocked else rows.select(creator).distinct()
    first = F.when(F.col(creator).isin(*pinned), 0).otherwise(1) if pinned else F.lit(1)
    chosen = people.orderBy(first, hash_order(seed, F.col(creator)), creator).limit(evals).withColumn("_e", F.lit(True))
    kept = rows.join(people, creator, "left_semi")
    return kept.join(chosen, creator, "left").withColumn(name, F.when(F.col("_e"), "eval").otherwise("train")).drop("_e")


def folds(rows: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold: rows of a group share it."""
    return rows.withColumn("fold", (F.conv(F.substring(hash_order(seed, F.col(group)), 1, 8), 16, 10).cast("long") % k).cast("int"))


def capped_top(rows: DataFrame, score: str, key: str, group: str, per_group: int, n: int) -> DataFrame:
    """Best n by score with at most per_group of a group; exact, as the cap doesn't depend on n."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), key))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= per_group).drop("_r").orderBy(F.col(score).desc(), key).limit(n)


def two_caps(rows: DataFrame, label: str, channel: str, key: str, per_channel: int, per_label: int) -> DataFrame:
    """First come: at most per_channel of a channel within a class, then at most per_label of the class."""
    a = F.row_number().over(W.partitionBy(label, channel).orderBy(key))
    b = F.row_number().over(W.partitionBy(label).orderBy(key))
    return rows.withColumn("_a", a).filter(F.col("_a") <= per_channel).withColumn("_b", b).filter(F.col("_b") <= per_label).drop("_a", "_b")


def head_cap(rows: DataFrame, label: str, key: str, share: float, least: int, seed: int = 0) -> DataFrame:
    """Of each class at most max(least, int(share * n)) rows in hash order."""
    limits = rows.groupBy(label).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * share)).cast("long").alias("_limit"))
    return first_by_hash(rows, label, key, limits, seed)


def within_budget(rows: DataFrame, size: str, order: list, budget: int, parts: str | None = None) -> DataFrame:
    """Longest prefix whose running size stays within the budget, in each part if one is named; a null size counts as 0."""
    return running(rows, order, parts, {"running": F.coalesce(F.col(size), F.lit(0))}).filter(F.col("running") <= budget)


def class_weights(rows: DataFrame, label: str, weight: str) -> DataFrame:
    """(label, rows, effective, class_weight): square root of the summed weights, over their mean."""
    g = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("effective"))
    mean = g.agg(F.avg(F.sqrt("effective")).alias("m"))
    return g.join(mean).select(label, "rows", "effective", (F.sqrt("effective") / F.col("m")).alias("class_weight"))  # one row


def gold_pick(candidates: DataFrame, labels: list[str], per_label: int = 12, evidence: float = 0.3) -> DataFrame:
    """candidates(clip, label, p): for each label in turn its likeliest clips, a clip used once.

    The loop is over the short menu of labels; each turn is an anti-join and a bounded top-k.
    """
    taken = None
    pool = candidates.filter(F.col("p") >= evidence)
    for label in labels:
        left = pool.filter(F.col("label") == label)
        if taken is not None:
            left = left.join(taken.select("clip"), "clip", "left_anti")
        best = left.orderBy(F.col("p").desc(), "clip").limit(per_label)
        taken = best if taken is None else taken.unionByName(best)
    return taken


def preference_pairs(takes: DataFrame, uid: str = "uid", take: str = "take", score: str = "score", gap: float = 1.0) -> DataFrame:
    """(uid, chosen, rejected, margin): the best take (least score) against every take worse by the gap or more."""
    best = takes.groupBy(uid).agg(F.min(F.struct(F.col(score).alias("s"), F.col(take).alias("t"))).alias("b"))
    j = takes.join(best, uid)
    margin = F.col(score) - F.col("b.s")
    return j.filter(margin >= gap).select(uid, F.col("b.t").alias("chosen"), F.col(take).alias("rejected"), margin.alias("margin"))


def held_out(pairs: DataFrame, share: float, uid: str = "uid", name: str = "split") -> DataFrame:
    """Adds split: ``held`` for the pairs of the first int(share * n) of the n identifiers in order, else ``train``."""
    placed = running(pairs.select(uid).distinct(), [uid])
    n = placed.agg(F.count(F.lit(1)).alias("_n"))  # one row
    side = F.when(F.col("place") <= F.floor(F.col("_n") * share), "held").otherwise("train")
    return pairs.join(placed.join(F.broadcast(n)).select(uid, side.alias(name)), uid)


def bag_scores(windows: DataFrame, bag: str, score: str, k: int = 3, background: Column | None = None) -> DataFrame:
    """(bag, n, score): mean of the bag's k best windows, of all its windows where ``background`` holds.

    Counts and means are sums; a bag's best windows are cut to k before they are shuffled.
    """
    r = F.row_number().over(W.partitionBy(bag).orderBy(F.col(score).desc()))
    best = windows.select(bag, score).withColumn("_r", r).filter(F.col("_r") <= k).groupBy(bag).agg(F.avg(score).alias("_best"))
    whole = F.coalesce(background, F.lit(False)) if background is not None else F.lit(False)
    # in a bag of which some windows are background, those count beside the best
    if background is None:
        return windows.groupBy(bag).agg(F.count(F.lit(1)).alias("n")).join(best, bag).select(bag, "n", F.col("_best").alias("score"))
    kept = windows.withColumn("_w", whole).withColumn("_r", r).filter((F.col("_r") <= k) & ~F.col("_w"))
    top = kept.groupBy(bag).agg(F.sum(score).alias("_s"), F.count(score).alias("_c"))
    sums = windows.groupBy(bag).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(whole, F.col(score))), F.lit(0.0)).alias("_bs"), F.count(F.when(whole, F.col(score))).alias("_bc"))
    total, count = F.col("_bs") + F.coalesce("_s", F.lit(0.0)), F.col("_bc") + F.coalesce("_c", F.lit(0))
    return sums.join(top, bag, "left").select(bag, "n", F.when(count > 0, total / count).alias("score"))


def overlap_slice(picked: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Adds annotators: 2 for n rows in hash order, which measure how far two people agree, else 1."""
    twice = picked.select(key).orderBy(hash_order(seed, F.col(key)), key).limit(n).withColumn("_two", F.lit(2))
    return picked.join(twice, key, "left").withColumn("annotators", F.coalesce("_two", F.lit(1))).drop("_two")


def keep_by_weight(rows: DataFrame, weight: str, key: str, seed: int = 0) -> DataFrame:
    """Each row with the probability of its weight (1 and more: always; null: never), by a hash of its key."""
    draw = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.filter(draw < F.coalesce(F.col(weight), F.lit(0.0)))


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("shard", (F.crc32(F.col(key).cast("string")) % n).cast("int"))


def tiered(rows: DataFrame, tier: Column, order: list, group: str) -> DataFrame:
    """Adds tier and, within it, a round-robin position over the groups."""
    t = rows.withColumn("tier", tier)
    return t.withColumn("position", F.row_number().over(W.partitionBy("tier", group).orderBy(*order)))


def stratified_sample(rows: DataFrame, label: str, creator: str, key: str, per_label: int, per_creator: int, uniform: int = 0, seed: int = 0) -> DataFrame:
    """per_label rows of each class, at most per_creator of a creator in it, and a uniform slice of the others. Adds slice."""
    h = hash_order(seed, F.col(key))
    a = F.row_number().over(W.partitionBy(label, creator).orderBy(h, key))
    b = F.row_number().over(W.partitionBy(label).orderBy(h, key))
    strata = rows.withColumn("_a", a).filter(F.col("_a") <= per_creator).withColumn("_b", b).filter(F.col("_b") <= per_label).drop("_a", "_b").withColumn("slice", F.lit("stratum"))
    rest = rows.join(strata.select(key), key, "left_anti").orderBy(hash_order(seed + 1, F.col(key)), key).limit(uniform).withColumn("slice", F.lit("uniform"))
    return strata.unionByName(rest)


def biggest_first(rows: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken round-robin over the classes, the biggest class first."""
    size = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    position = F.row_number().over(W.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key))
    return rows.withColumn("_p", position).filter(F.col("_p") <= n).join(size, label).orderBy("_p", F.col("_n").desc(), label).limit(n).drop("_p", "_n")


def voice_bank(rows: DataFrame, corpus: str, creator: str, kind: list[str], key: str, default: Column, n: int, seed: int = 0) -> DataFrame:
    """One recording a creator, the default set first within each kind, corpora in turn; at most n of a kind."""
    one = F.row_number().over(W.partitionBy(creator).orderBy(default.desc(), hash_order(seed, F.col(key)), key))
    single = rows.withColumn("_d", default).withColumn("_o", one).filter("_o = 1")
    turn = F.row_number().over(W.partitionBy(*kind, corpus).orderBy(F.col("_d").desc(), hash_order(seed, F.col(key)), key))
    rank = F.row_number().over(W.partitionBy(*kind).orderBy(F.col("_d").desc(), "_t", corpus, key))
    return single.withColumn("_t", turn).withColumn("rank", rank).filter(F.col("rank") <= n).drop("_d", "_o", "_t")
