"""Agreement, consensus, trust and quality of labellers.

Nothing here joins votes with votes of the same item: label sets are counted by
item first, and a labeller's own vote is taken off the counts, so the work grows
with the votes and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import running
from quillon.operators.relations import shared_peers

from quillon.functions.columns import clamp, jaccard, set_f1, smoothed_ratio


def clip_agreement(votes: DataFrame, item: str = "item", labels: str = "labels") -> DataFrame:
    """Mean pairwise Jaccard of an item's answers: (item, answers, agreement); null agreement below two answers.

    Equal label sets are counted once; pairs are formed between distinct sets only.
    """
    sets = votes.groupBy(item, labels).agg(F.count(F.lit(1)).alias("c"))
    each = sets.groupBy(item).agg(F.collect_list(F.struct(F.col(labels).alias("s"), "c")).alias("sets"), F.sum("c").alias("answers"))

    def paired(x: Column, i: Column) -> Column:
        """Pairs of x with itself and with the sets after it, weighted by how often both occur."""
        rest = F.slice("sets", i + 2, F.size("sets"))
        own = x["c"] * (x["c"] - 1) / 2.0
        return own + F.aggregate(rest, F.lit(0.0), lambda acc, y: acc + x["c"] * y["c"] * jaccard(x["s"], y["s"]))

    total = F.aggregate(F.transform("sets", paired), F.lit(0.0), lambda acc, x: acc + x)
    n = F.col("answers")
    return each.select(item, n.alias("answers"), F.when(n > 1, total / (n * (n - 1) / 2.0)).alias("agreement"))


def clip_consensus(votes: DataFrame, trust: DataFrame, floor: float = 0.15, evidence: int = 20, item: str = "item", who: str = "who") -> DataFrame:
    """Trust-weighted consensus: (item, voters, consensus).

    Mean over the labels anyone chose of |2 w_label / W - 1|; null below two voters
    or without weight, 1 if all chose nothing. Labellers under the trust floor with
    enough evidence, and weak ones, don't vote. trust(who, trust, evidence, weak).
    """
    counted = votes.join(trust, who).filter(((F.col("evidence") < evidence) | (F.col("trust") >= floor)) & ~F.col("weak"))
    totals = counted.groupBy(item).agg(F.count(F.lit(1)).alias("voters"), F.sum("trust").alias("total"))
    by_label = counted.withColumn("label", F.explode("labels")).groupBy(item, "label").agg(F.sum("trust").alias("w"))
    means = by_label.join(totals, item).groupBy(item).agg(F.avg(F.abs(2 * F.col("w") / F.nullif(F.col("total"), F.lit(0.0)) - 1)).alias("c"))
    value = F.when((F.col("voters") < 2) | (F.col("total") <= 0), F.lit(None).cast("double")).otherwise(F.coalesce("c", F.lit(1.0)))
    return totals.join(means, item, "left").select(item, "voters", value.alias("consensus"))


def peer_reference(votes: DataFrame, others: int, truth: DataFrame | None = None, weak: DataFrame | None = None, item: str = "item", who: str = "who") -> DataFrame:
    """votes with ``reference``: the truth of control items, else the labels that at least half of the other labellers chose.

    Rows with fewer than ``others`` other labellers (and no truth) go. Labellers
    in ``weak``(who) aren't counted for anyone.
    """
    flagged = votes.withColumn("_counts", F.lit(True))
    if weak is not None:
        flagged = votes.join(weak.select(who).distinct().withColumn("_weak", F.lit(True)), who, "left").withColumn("_counts", F.col("_weak").isNull()).drop("_weak")
    voters = flagged.filter("_counts").groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    counts = flagged.filter("_counts").withColumn("_label", F.explode("labels")).groupBy(item, "_label").agg(F.count(F.lit(1)).alias("c")).groupBy(item).agg(F.collect_list(F.struct("_label", "c")).alias("_by"))
    joined = flagged.join(voters, item, "left").join(counts, item, "left")
    own = F.col("_counts").cast("int")
    left = F.coalesce("_n", F.lit(0)) - own
    chosen = F.transform(
        F.filter(F.coalesce("_by", F.array().cast("array<struct<_label:string,c:bigint>>")), lambda x: (x["c"] - own * F.array_contains("labels", x["_label"]).cast("int") > 0) & (2 * (x["c"] - own * F.array_contains("labels", x["_label"]).cast("int")) >= left)),
        lambda x: x["_label"],
    )
    peers = F.when(left >= others, F.array_sort(chosen))
    if truth is not None:
        joined = joined.join(truth.select(item, F.col("labels").alias("_truth")), item, "left")
        peers = F.coalesce("_truth", peers)
    return joined.withColumn("reference", peers).filter(F.col("reference").isNotNull()).drop("_n", "_by", "_truth", "_counts")


def trust(first: DataFrame, retests: DataFrame, truth: DataFrame, prior: float = 5.0, rushed_ms: float = 2500.0) -> DataFrame:
    """(who, evidence, trust): agreement with the majority of at least four others, and twice that with controls and own retests.

    first(item, who, labels, unsure, listen_ms); retests(item, who, labels);
    truth(item, labels). Shrunk towards one half; times 0.7 if the median listening
    time is short.
    """
    sure = first.filter(~F.col("unsure")).select("item", "who", "labels")
    peers = peer_reference(sure, 4).select("who", F.lit(1.0).alias("w"), jaccard("labels", "reference").alias("j"))
    controls = sure.join(truth.select("item", F.col("labels").alias("reference")), "item").select("who", F.lit(2.0).alias("w"), jaccard("labels", "reference").alias("j"))
    again = first.select("item", "who", "labels").join(retests.select("item", "who", F.col("labels").alias("reference")), ["item", "who"]).select("who", F.lit(2.0).alias("w"), jaccard("labels", "reference").alias("j"))
    sums = peers.unionByName(controls).unionByName(again).groupBy("who").agg(F.sum("w").alias("evidence"), F.sum(F.col("w") * F.col("j")).alias("s"))
    listens = first.groupBy("who").agg(F.percentile("listen_ms", F.lit(0.5)).alias("listen"))
    joined = listens.join(sums, "who", "left").fillna(0.0, ["evidence", "s"])
    raw = smoothed_ratio(F.col("s"), F.col("evidence"), prior)
    return joined.select("who", "evidence", clamp(raw * F.when(F.col("listen") < rushed_ms, 0.7).otherwise(1.0)).alias("trust"))


FLAGS = ("follows others by chance", "follows others little", "rushing", "short listening", "steady pace", "same label every time", "disagrees with own retests", "unsure often", "shares a device")
#: Sums of at most a window's doubles are off by less; a figure that lies so near a limit stands at it, not under it.
ROUNDING = 1e-12


def labeller_quality(answers: DataFrame, truth: DataFrame | None = None, marks: DataFrame | None = None, weak: DataFrame | None = None, window: int = 400, shifts: int = 20, weak_follow: float = 0.1, watch_follow: float = 0.1) -> DataFrame:
    """Metrics, flags and status of every labeller.

    answers(item, who, attempt, labels, unsure, listen_ms, answer_s, at);
    marks(who, kind, value); weak(who): labellers found weak before, whose answers
    are no reference. A labeller's latest ``window`` referenced answers are
    compared with their references and with those of answers further on in a
    circle, which tells what agreement chance gives. Bounded arrays of at most
    ``window`` answers per labeller hold them; one with a single referenced answer
    has no such figures.
    """
    first = answers.filter("attempt = 1")
    sure = first.filter(~F.col("unsure")).select("item", "who", "labels", "at")
    newest = W.partitionBy("who").orderBy(F.col("at").desc(), F.col("item").desc())
    referenced = peer_reference(sure, 2, truth, weak).withColumn("i", F.row_number().over(newest)).filter(F.col("i") <= window)
    circle = referenced.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("i", "labels", "reference"))).alias("a")).withColumn("n", F.size("a"))

    def compared(x: Column, i: Column) -> Column:
        steps = F.sequence(F.lit(1), F.least(F.col("n") - 1, F.lit(shifts)))
        others = F.transform(steps, lambda k: F.get("a", F.pmod(i + k, F.col("n")))["reference"])
        mean = lambda of: F.aggregate(others, F.lit(0.0), lambda s, v: s + jaccard(of, v)) / F.size(steps)
        return F.struct(jaccard(x["labels"], x["reference"]).alias("jm"), mean(x["labels"]).alias("ju"), mean(x["reference"]).alias("jr"))

    rows = circle.filter("n > 1").select("who", "n", F.explode(F.transform("a", compared)).alias("c"))
    gain = F.col("c.jm") - F.col("c.ju")
    scale = F.greatest(F.lit(0.1), 1 - F.avg("c.jr"))
    follow = rows.groupBy("who").agg(F.count(F.lit(1)).alias("refs"), (F.avg(gain) / scale).alias("follow"), (F.coalesce(F.stddev_samp(gain), F.lit(0.0)) / F.sqrt(F.count(F.lit(1))) / scale).alias("se"))
    timing = answers.groupBy("who").agg(
        F.avg((F.col("answer_s") < 4).cast("int")).alias("rush_rate"),
        F.percentile("listen_ms", F.lit(0.5)).alias("median_listen"),
        (F.coalesce(F.stddev_samp("answer_s"), F.lit(0.0)) / F.nullif(F.avg("answer_s"), F.lit(0.0))).alias("cv"),
    )
    firsts = first.groupBy("who").agg(F.count(F.lit(1)).alias("answers"), F.avg(F.col("unsure").cast("int")).alias("unsure_rate"))
    per_label = first.withColumn("label", F.explode("labels")).groupBy("who", "label").agg(F.count(F.lit(1)).alias("c"))
    top = per_label.groupBy("who").agg(F.max("c").alias("top"))
    retest = first.select("item", "who", F.col("labels").alias("l1")).join(answers.filter("attempt = 2").select("item", "who", F.col("labels").alias("l2")), ["item", "who"])
    retests = retest.groupBy("who").agg(F.count(F.lit(1)).alias("retests"), F.avg(jaccard("l1", "l2")).alias("retest_agreement"))
    out = firsts.join(follow, "who", "left").join(timing, "who", "left").join(top, "who", "left").join(retests, "who", "left")
    if marks is not None:
        out = out.join(shared_peers(marks).select("who", F.col("peers").cast("int").alias("device_peers")), "who", "left")
    else:
        out = out.withColumn("device_peers", F.lit(0))
    out = out.fillna(0, ["refs", "retests", "device_peers", "top"]).withColumn("top_share", F.col("top") / F.col("answers"))
    c = F.col
    under = lambda x, limit: x < limit - ROUNDING
    chance = (c("refs") >= 15) & under(c("follow") + 1.645 * c("se"), weak_follow)
    tests = (
        chance,
        (c("refs") >= 15) & under(c("follow"), watch_follow) & ~chance,
        (c("answers") >= 20) & (c("rush_rate") > 0.3),
        (c("answers") >= 20) & (c("median_listen") < 3000),
        (c("answers") >= 30) & (c("cv") < 0.15),
        (c("answers") >= 20) & (c("top_share") > 0.85),
        (c("retests") >= 5) & (c("retest_agreement") < 0.3),
        (c("answers") >= 20) & (c("unsure_rate") > 0.5),
        c("device_peers") >= 1,
    )
    flags = F.array_compact(F.array(*(F.when(t, F.lit(f)) for t, f in zip(tests, FLAGS))))
    status = F.when(F.coalesce(chance, F.lit(False)) | (F.size("flags") >= 2), "weak").when(F.size("flags") == 1, "watch").when(c("refs") < 15, "too early").otherwise("ok")
    return out.withColumn("flags", flags).withColumn("status", status)


def refresh_quality(answers: DataFrame, passes: int = 2, **settings) -> DataFrame:
    """Quality in several passes: those weak in one are no reference in the next."""
    weak = None
    for _ in range(passes):
        found = labeller_quality(answers, weak=weak, **settings)
        weak = found.filter("status = 'weak'").select("who")
    return found


def multilabel_scores(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Micro precision, recall and F1, any-overlap, exact and mean Jaccard of two label sets per row; one row."""
    shared = F.size(F.array_intersect(truth, pred))
    per = pairs.select(shared.alias("tp"), (F.size(pred) - shared).alias("fp"), (F.size(truth) - shared).alias("fn"), jaccard(truth, pred).alias("j"), set_f1(truth, pred).alias("f"), (F.array_sort(truth) == F.array_sort(pred)).alias("same"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    one = lambda n: F.greatest(n, F.lit(1))
    return per.agg(
        F.count(F.lit(1)).alias("n"), (tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"), (2 * tp / one(2 * tp + fp + fn)).alias("f1"),
        F.avg((F.col("tp") > 0).cast("int")).alias("any_overlap"), F.avg(F.col("same").cast("int")).alias("exact"), F.avg("j").alias("mean_jaccard"), F.avg("f").alias("mean_f1"),
    )


def per_class_scores(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over the labels in either set."""
    rows = pairs.select(truth, pred, F.explode(F.array_union(truth, pred)).alias("label"))
    t, p = F.array_contains(truth, F.col("label")), F.array_contains(pred, F.col("label"))
    sums = rows.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    one = lambda n: F.greatest(n, F.lit(1))
    c = F.col
    return sums.withColumns({"precision": c("tp") / one(c("tp") + c("fp")), "recall": c("tp") / one(c("tp") + c("fn")), "f1": 2 * c("tp") / one(2 * c("tp") + c("fp") + c("fn"))})


def cohen_kappa(answers: DataFrame, item: str = "item", judge: str = "judge", answer: str = "answer") -> DataFrame:
    """Every pair of judges over their common items: (judge_a, judge_b, n, agreement, kappa); kappa null where chance agreement is 1.

    The join is on the item; judges are few. Marginals are taken over the common items.
    """
    a = answers.select(F.col(item).alias("i"), F.col(judge).alias("judge_a"), F.col(answer).alias("x"))
    b = answers.select(F.col(item).alias("i"), F.col(judge).alias("judge_b"), F.col(answer).alias("y"))
    cells = a.join(b, "i").filter("judge_a < judge_b").groupBy("judge_a", "judge_b", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    keys = ["judge_a", "judge_b"]
    total = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("x").alias("k")).agg(F.sum("c").alias("l"))
    right = cells.groupBy(*keys, F.col("y").alias("k")).agg(F.sum("c").alias("r"))
    chance = left.join(right, [*keys, "k"]).groupBy(*keys).agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    out = total.join(chance, keys, "left").withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.coalesce("lr", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select(*keys, "n", F.col("po").alias("agreement"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def pair_preferences(picks: DataFrame, least: int = 3) -> DataFrame:
    """picks(a, b, pick) with a < b -> (a, b, judges, wins_a, agree_pct); the percentage once enough judged."""
    g = picks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("judges"), F.count_if(F.col("pick") == F.col("a")).alias("wins_a"))
    top = F.greatest("wins_a", F.col("judges") - F.col("wins_a"))
    return g.withColumn("agree_pct", F.when(F.col("judges") >= least, F.round(100 * top / F.col("judges"))))


def fooled_percent(guesses: DataFrame, least: int = 5) -> DataFrame:
    """guesses(item, truth, guess) -> (item, n, fooled_pct)."""
    g = guesses.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") != F.col("guess")).alias("wrong"))
    return g.select("item", "n", F.when(F.col("n") >= least, F.round(100 * F.col("wrong") / F.col("n"))).alias("fooled_pct"))


#: Members of a mark that its summary names, the first ones in order; ``mark_members`` has all of them as rows.
NAMED = 20


def shared_marks(marks: DataFrame, who: str = "who", named: int = NAMED) -> DataFrame:
    """Marks that at least two accounts share: (kind, value, accounts, members: the first ``named`` of them).

    A mark that very many accounts share is counted, and no array grows with it.
    """
    each = marks.select("kind", "value", F.col(who).cast("string").alias("_w")).distinct()
    counts = each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("accounts")).filter("accounts >= 2")
    first = each.withColumn("_r", F.row_number().over(W.partitionBy("kind", "value").orderBy("_w"))).filter(F.col("_r") <= named)
    lists = first.groupBy("kind", "value").agg(F.array_sort(F.collect_list("_w")).alias("members"))
    return counts.join(lists, ["kind", "value"])


def mark_members(marks: DataFrame, who: str = "who") -> DataFrame:
    """(kind, value, accounts, who): a row for each account of each mark that at least two share."""
    each = marks.select("kind", "value", who).distinct()
    counts = each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("accounts")).filter("accounts >= 2")
    return each.join(counts, ["kind", "value"]).select("kind", "value", "accounts", who)


def class_gate(judged: DataFrame, admit: float = 0.5, doubt: float = 0.3, wrong: int = 3) -> DataFrame:
    """judged(label, judge, pred) -> (label, judges, hit, verdict, wrong_answers): mean hit rate of the judges decides."""
    by_judge = judged.groupBy("label", "judge").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("hit"))
    mean = by_judge.groupBy("label").agg(F.count(F.lit(1)).alias("judges"), F.avg("hit").alias("hit"))
    misses = judged.filter("pred <> label").groupBy("label", "pred").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.col("c").desc(), "pred"))
    tops = misses.withColumn("r", rank).filter(F.col("r") <= wrong).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "pred"))), lambda x: x["pred"]), ",").alias("wrong_answers"))
    verdict = F.when(F.col("hit") >= admit, "ADMIT").when(F.col("hit") >= doubt, "WEAK").otherwise("REJECT")
    return mean.withColumn("verdict", verdict).join(tops, "label", "left")


def judge_agreement(judged: DataFrame) -> DataFrame:
    """judged(label, item, judge, pred), a row for each judge and item -> (label, pairs, agree): mean over pairs of judges of
    how often they give the same answer on the items of a class that both have judged. Judges are few."""
    other = judged.select("label", "item", F.col("judge").alias("_j"), F.col("pred").alias("_p"))
    both = judged.join(other, ["label", "item"]).filter("judge < _j")
    rates = both.groupBy("label", "judge", "_j").agg(F.avg((F.col("pred") == F.col("_p")).cast("int")).alias("a"))
    return rates.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg("a").alias("agree"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "score", positive: str = "positive", key: str = "id") -> DataFrame:
    """(label, positives, ap): mean over positives of precision at their rank, best score first, ties by key; a class may span many tasks."""
    hit = F.coalesce(F.col(positive).cast("int"), F.lit(0))
    ranked = running(scored, [F.col(score).desc(), key], label, {"_r": F.lit(1).cast("long"), "_tp": hit})
    return ranked.groupBy(label).agg(F.sum(hit).alias("positives"), (F.sum(F.when(hit == 1, F.col("_tp") / F.col("_r")).otherwise(0.0)) / F.greatest(F.sum(hit), F.lit(1))).alias("ap"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], precision: float = 0.85, label: str = "label", score: str = "score", positive: str = "positive") -> DataFrame:
    """(label, threshold, recall): the threshold of most recall with at least this precision; null if none has it.

    The thresholds are a constant array per row, so there is no join.
    """
    rows = scored.select(label, positive, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), (F.col(score)).alias("_s"))
    p, t = F.col("_s") >= F.col("threshold"), F.col(positive)
    sums = rows.groupBy(label, "threshold").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t).alias("all"))
    ok = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)) >= precision
    best = sums.groupBy(label).agg(F.max(F.when(ok & (F.col("tp") > 0), F.struct((F.col("tp") / F.col("all")).alias("recall"), F.col("threshold")))).alias("b"))
    return best.select(label, F.col("b.threshold").alias("threshold"), F.col("b.recall").alias("recall"))
