"""Fusing noisy labellers: two Dawid-Skene estimators and vote merging.

Items with the same votes have the same posterior: rounds run over the distinct patterns
of votes with their counts, and posteriors are joined back to the items by pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import cut

PEOPLE_SENS, PEOPLE_SPEC = 0.8, 0.95


def vote_cells(votes: DataFrame, menu: list[str], uid: str = "item", labeller: str = "who", labels: str = "labels", offered: str | None = None, covers: dict[str, list[str]] | None = None) -> DataFrame:
    """(uid, labeller, label, yes): one row for each label a vote covers; unlisted labels of its menu are abstentions.

    ``offered`` names an array column with the vote's own menu; without it, all of ``menu``.
    ``covers`` lists the labels that a labeller can tell; those it doesn't name can tell all.
    """
    covered = F.array_intersect(F.col(offered), F.array(*map(F.lit, menu))) if offered else F.array(*map(F.lit, menu))
    for name, known in (covers or {}).items():
        covered = F.when(F.col(labeller) == name, F.array_intersect(covered, F.array(*map(F.lit, known)).cast("array<string>"))).otherwise(covered)
    return votes.select(F.col(uid).alias("uid"), F.col(labeller).alias("labeller"), labels, F.explode(covered).alias("label")).select("uid", "labeller", "label", F.array_contains(labels, F.col("label")).cast("int").alias("yes"))


#: Cells (a labeller's answer in a distinct pattern) up to which the rounds run on the driver. With more cells but no more patterns, tasks
#: hold the cells of their labellers and the driver the posteriors; beyond that each round is Spark jobs over the patterns.
DRIVER_CELLS = 1_000_000
#: Cells in a task, about; a labeller's lie in one and are no more than the patterns.
BLOCK_CELLS = 500_000


@dataclass(frozen=True)
class Patterns:
    """Votes of items on labels, each distinct pattern of (labeller, yes) once.

    ``every`` (uid, label, id) names the pattern of each item and label; ``patterns`` (id,
    label, w, n, p) has the items' weight, their number and the first posterior;
    ``cells`` (id, label, labeller, yes, k) the answers of a pattern. Items that nobody was asked
    about have patterns without cells.
    """

    every: DataFrame
    patterns: DataFrame
    cells: DataFrame


def vote_patterns(cells: DataFrame, people: DataFrame | None = None, unlabelled_weight: float = 0.0, items: DataFrame | None = None, menu: list[str] | None = None) -> Patterns:
    """The patterns of cells(uid, labeller, label, yes).

    people(labeller, k): labellers that are persons, with the strength of their prior
    counts; items without a person's vote weigh ``unlabelled_weight`` (1 if there are no
    people at all). ``items`` (uid) adds items without any cell, ``menu`` labels without any.
    A pattern is told by the sums of two 64-bit hashes of its answers, so that no
    item's votes are gathered in one row.
    """
    given = people.select("labeller", F.col("k").cast("double").alias("k")) if people is not None else None
    c = cells.join(given, "labeller", "left") if given is not None else cells.withColumn("k", F.lit(None).cast("double"))
    c = cut(c.select("uid", "label", "labeller", F.col("yes").cast("int").alias("yes"), "k"))
    human, yes = F.col("k").isNotNull(), F.col("yes")
    asked = c.groupBy("uid").agg(F.max(human).alias("person"))
    whole = items.select("uid").distinct().join(asked, "uid", "full") if items is not None else asked
    weight = F.lit(1.0) if people is None else F.when(F.coalesce("person", F.lit(False)), 1.0).otherwise(float(unlabelled_weight))
    uids = cut(whole.select("uid", weight.alias("w")))
    code = [F.sum(F.xxhash64(F.lit(seed), "labeller", "yes").cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    counts = [F.count_if(human).alias("hc"), F.sum(F.when(human, yes).otherwise(0)).alias("hy"), F.count_if(~human).alias("mc"), F.sum(F.when(~human, yes).otherwise(0)).alias("my")]
    voted = cut(c.groupBy("uid", "label").agg(*code, *counts).join(uids, "uid"))
    key = ["label", "w", "h1", "h2"]
    first = F.when(F.col("hc") > 0, (F.col("hy") + 0.5) / (F.col("hc") + 1)).otherwise((F.col("my") + 0.5) / (F.col("mc") + 1))
    told = cut(voted.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("one"), F.first(first).alias("p")).withColumn("id", F.monotonically_increasing_id()))
    labels = menu or sorted(r.label for r in c.select("label").distinct().collect())
    # nobody was asked: one pattern for each label and weight, with all items that are in none of the others
    total = {r.w: r.n for r in uids.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    covered = {(r.label, r.w): r.n for r in told.groupBy("label", "w").agg(F.sum("n").alias("n")).collect()}
    blank = [(-1 - i, l, w, n - covered.get((l, w), 0), 0.1) for i, (l, w, n) in enumerate((l, w, n) for l in labels for w, n in sorted(total.items()))]
    unasked = cells.sparkSession.createDataFrame(blank, "id long, label string, w double, n long, p double")
    all_pairs = uids.select("uid", "w", F.explode(F.array(*map(F.lit, labels)).cast("array<string>")).alias("label"))
    named = voted.join(told.select(*key, "id"), key).select("uid", "label", "id")
    every = all_pairs.join(named, ["uid", "label"], "left").join(F.broadcast(unasked.select("label", "w", F.col("id").alias("none"))), ["label", "w"]).select("uid", "label", F.coalesce("id", "none").alias("id"))
    own = c.join(told.select("label", F.col("one").alias("uid"), "id"), ["uid", "label"]).select("id", "label", "labeller", "yes", "k")
    return Patterns(every, cut(told.select("id", "label", "w", "n", "p").unionByName(unasked)), cut(own))


def _rounds_here(v: Patterns, pat: pd.DataFrame, cell: pd.DataFrame, rounds: int, shrink: float, pooled: dict[str, tuple[float, float]] | None) -> tuple[DataFrame, DataFrame]:
    """The rounds over all patterns in numpy."""
    spark = v.cells.sparkSession
    label, labels = pd.factorize(pat.label)
    at = pd.Series(np.arange(len(pat)), index=pat.id).reindex(cell.id).to_numpy()
    labellers, whos = pd.factorize(cell.labeller)
    both, pair = np.unique(label[at] * max(1, len(whos)) + labellers, return_inverse=True)
    of, who = np.divmod(both, max(1, len(whos)))  # of each pair that occurs its label and labeller
    k = np.full(len(both), np.nan)
    k[pair] = cell.k.to_numpy(float)
    yes, w, p = cell.yes.to_numpy(float), (pat.w * pat.n).to_numpy(float), pat.p.to_numpy(float)
    own = [(labels[a], whos[b].item() if isinstance(whos[b], np.generic) else whos[b]) for a, b in zip(of, who)]
    rate = [(pooled or {}).get(b) for _, b in own]
    s = np.array([shrink if r and np.isnan(kk) else 0.0 for r, kk in zip(rate, k)])
    se0, sp0 = (np.array([r[i] if r else 0.0 for r in rate]) for i in (0, 1))
    people = np.nan_to_num(k)
    summed = lambda x: np.bincount(pair, x, len(own))
    prior = sens = spec = None
    for _ in range(rounds):
        prior = (np.bincount(label, w * p, len(labels)) + 1) / (np.bincount(label, w, len(labels)) + 2)
        a, b = (w * p)[at], (w * (1 - p))[at]
        tp, fn = summed(a * yes) + people * PEOPLE_SENS + s * se0, summed(a * (1 - yes)) + people * (1 - PEOPLE_SENS) + s * (1 - se0)
        tn, fp = summed(b * (1 - yes)) + people * PEOPLE_SPEC + s * sp0, summed(b * yes) + people * (1 - PEOPLE_SPEC) + s * (1 - sp0)
        sens, spec = (tp + 1) / (tp + fn + 2), (tn + 1) / (tn + fp + 2)
        said = np.where(yes == 1, np.log(sens / (1 - spec))[pair], np.log((1 - sens) / spec)[pair])
        odds = np.log(prior / (1 - prior))[label] + np.bincount(at, said, len(pat))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    post = spark.createDataFrame(pd.DataFrame({"id": pat.id.astype("int64"), "p": p}), "id long, p double")
    rows = [(l, float(prior[o]), who, float(a), float(b)) for (l, who), o, a, b in zip(own, of, sens, spec)] if len(own) else []
    kind = v.cells.schema["labeller"].dataType.simpleString()
    return post, spark.createDataFrame(rows, f"label string, prior double, labeller {kind}, sens double, spec double")


def _with_pooled(v: Patterns, shrink: float, pooled: DataFrame | None) -> DataFrame:
    """The cells with se0, sp0 and s: the rates that a machine's are pulled towards, and by how much."""
    cells = v.cells
    if pooled is not None:
        cells = cells.join(pooled.select("labeller", F.col("sens").alias("se0"), F.col("spec").alias("sp0"), F.lit(float(shrink)).alias("s")), "labeller", "left")
    else:
        cells = cells.withColumns({c: F.lit(None).cast("double") for c in ("se0", "sp0", "s")})
    return cells.fillna(0.0, ["se0", "sp0", "s"]).withColumn("s", F.when(F.col("k").isNull(), F.col("s")).otherwise(0.0))


def _rounds_in_blocks(v: Patterns, pat: pd.DataFrame, blocks: int, rounds: int, shrink: float, pooled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The same rounds with the posteriors on the driver and the cells dealt by labeller.

    All cells of a labeller lie in one block, so its rates need no shuffle; a round is one
    pass over the blocks, which gives the evidence by pattern.
    """
    spark = v.cells.sparkSession
    label, labels = pd.factorize(pat.label)
    count, many = len(labels), len(pat)
    names = spark.createDataFrame(pa.table({"id": pa.array(pat.id, pa.int64()), "at": pa.array(np.arange(many), pa.int32()), "of": pa.array(label, pa.int32())}))
    cells = _with_pooled(v, shrink, pooled).select("id", "labeller", "yes", "k", "se0", "sp0", "s").filter("labeller IS NOT NULL")
    kind = v.cells.schema["labeller"].dataType.simpleString()
    rates = ("k", "se0", "sp0", "s")

    def pack(batches):
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        who = t["labeller"].combine_chunks().dictionary_encode()
        both, pair = np.unique(who.indices.to_numpy().astype(np.int64) * count + t["of"].to_numpy(), return_inverse=True)
        own = {}
        for c in rates:
            own[c] = np.zeros(len(both))
            own[c][pair] = t[c].fill_null(0.0).to_numpy()
        whos = who.dictionary.take(pa.array(both // count))
        given = {"at": t["at"].to_numpy().astype(np.int32), "yes": t["yes"].to_numpy().astype(np.int8), "pair": pair.astype(np.int32), "of": (both % count).astype(np.int32), **own}
        lists = pa.ListArray.from_arrays(pa.array([0, len(whos)], pa.int32()), whos)
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in given.values()), lists], names=[*given, "who"])

    dealt = cells.join(F.broadcast(names), "id").drop("id").repartition(blocks, "labeller")
    packed = cut(dealt.mapInArrow(pack, "at binary, yes binary, pair binary, of binary, k binary, se0 binary, sp0 binary, s binary, who array<" + kind + ">"))
    w = (pat.w * pat.n).to_numpy(float)

    def fitted(batches, p):
        """Of each block its row, its arrays, and the rates of its pairs."""
        for b in batches:
            for r in range(b.num_rows):
                x = {c: np.frombuffer(b[c][r].as_buffer(), t) for c, t in {"at": np.int32, "yes": np.int8, "pair": np.int32, "of": np.int32, **dict.fromkeys(rates, float)}.items()}
                at, yes, k, s = x["at"], x["yes"], x["k"], x["s"]
                summed = lambda v, pair=x["pair"], n=len(x["of"]): np.bincount(pair, v, n)
                a, z = (w * p)[at], (w * (1 - p))[at]
                tp, fn = summed(a * yes) + k * PEOPLE_SENS + s * x["se0"], summed(a * (1 - yes)) + k * (1 - PEOPLE_SENS) + s * (1 - x["se0"])
                tn, fp = summed(z * (1 - yes)) + k * PEOPLE_SPEC + s * x["sp0"], summed(z * yes) + k * (1 - PEOPLE_SPEC) + s * (1 - x["sp0"])
                yield b["who"][r].values, x, (tp + 1) / (tp + fn + 2), (tn + 1) / (tn + fp + 2)

    def evidence(p):
        def run(batches):
            for _, x, sens, spec in fitted(batches, p):
                pair, at = x["pair"], x["at"]
                said = np.where(x["yes"] == 1, np.log(sens / (1 - spec))[pair], np.log((1 - sens) / spec)[pair])
                found = np.flatnonzero(np.bincount(at, minlength=many))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.bincount(at, said, many)[found])], names=["at", "e"])

        return run

    def told(p, prior):
        def run(batches):
            for who, x, sens, spec in fitted(batches, p):
                yield pa.RecordBatch.from_arrays([pa.array(labels[x["of"]].tolist(), pa.string()), pa.array(prior[x["of"]]), who, pa.array(sens), pa.array(spec)], names=["label", "prior", "labeller", "sens", "spec"])

        return run

    p = pat.p.to_numpy(float)
    prior = last = None
    for _ in range(rounds):
        last, prior = p, (np.bincount(label, w * p, count) + 1) / (np.bincount(label, w, count) + 2)
        e = packed.mapInArrow(evidence(p), "at long, e double").groupBy("at").agg(F.sum("e").alias("e")).toArrow()
        odds = np.log(prior / (1 - prior))[label]
        odds[e["at"].to_numpy()] += e["e"].to_numpy()
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    post = spark.createDataFrame(pa.table({"id": pa.array(pat.id, pa.int64()), "p": pa.array(p)}))
    return post, packed.mapInArrow(told(last, prior), f"label string, prior double, labeller {kind}, sens double, spec double")


def _rounds_in_spark(v: Patterns, rounds: int, shrink: float, pooled: DataFrame | None, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """The same rounds as grouped sums over the patterns; lineage is cut reliably every few rounds."""
    cells = cut(_with_pooled(v, shrink, pooled).repartition("id"))
    post, rates = v.patterns.withColumn("w", F.col("w") * F.col("n")).drop("n"), None
    y, w, p, k, s = (F.col(x) for x in ("yes", "w", "p", "k", "s"))
    for number in range(rounds):
        prior = post.groupBy("label").agg(((F.sum(w * p) + 1) / (F.sum("w") + 2)).alias("prior"))
        joined = cells.join(post.select("id", "w", "p"), "id")
        sums = [F.sum(w * p * y).alias("tp"), F.sum(w * (1 - p) * y).alias("fp"), F.sum(w * p * (1 - y)).alias("fn"), F.sum(w * (1 - p) * (1 - y)).alias("tn")]
        counts = joined.groupBy("label", "labeller").agg(*(F.first(c).alias(c) for c in ("k", "s", "se0", "sp0")), *sums)
        add = {"tp": (PEOPLE_SENS, F.col("se0")), "fn": (1 - PEOPLE_SENS, 1 - F.col("se0")), "tn": (PEOPLE_SPEC, F.col("sp0")), "fp": (1 - PEOPLE_SPEC, 1 - F.col("sp0"))}
        filled = counts.withColumns({c: F.col(c) + F.coalesce(k * a, F.lit(0.0)) + s * b for c, (a, b) in add.items()})
        rates = cut(filled.join(prior, "label").select("label", "prior", "labeller", ((F.col("tp") + 1) / (F.col("tp") + F.col("fn") + 2)).alias("sens"), ((F.col("tn") + 1) / (F.col("tn") + F.col("fp") + 2)).alias("spec")))
        ratio = F.when(y == 1, F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        evidence = cells.select("id", "label", "labeller", "yes").join(rates.drop("prior"), ["label", "labeller"]).groupBy("id").agg(F.sum(ratio).alias("e"))
        odds = F.log(F.col("prior") / (1 - F.col("prior"))) + F.coalesce("e", F.lit(0.0))
        post = post.drop("p").join(prior, "label").join(evidence, "id", "left").select("id", "label", "w", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))).alias("p"))
        if number % every == every - 1 or number == rounds - 1:
            post = cut(post)
    return post.select("id", "p"), rates


def _em(v: Patterns, driver_cells: int) -> Callable[..., tuple[DataFrame, DataFrame]]:
    """What runs (rounds, shrink, pooled rates) over the patterns."""
    cells, patterns = v.cells.count(), v.patterns.count()
    if patterns > driver_cells:
        return lambda rounds, shrink=0.0, pooled=None: _rounds_in_spark(v, rounds, shrink, pooled)
    if cells + patterns > driver_cells:
        every = v.patterns.toArrow().to_pandas()
        blocks = max(v.cells.sparkSession.sparkContext.defaultParallelism, -(-cells // BLOCK_CELLS))
        return lambda rounds, shrink=0.0, pooled=None: _rounds_in_blocks(v, every, blocks, rounds, shrink, pooled)
    pat, cell = v.patterns.toArrow().to_pandas(), v.cells.toArrow().to_pandas()
    # a machine occurs in the cells, so there are no more of them than cells
    rates = lambda pooled: {r.labeller: (r.sens, r.spec) for r in pooled.collect()} if pooled is not None else None
    return lambda rounds, shrink=0.0, pooled=None: _rounds_here(v, pat, cell, rounds, shrink, rates(pooled))


def binary_em(cells: DataFrame, people: DataFrame | None = None, rounds: int = 30, unlabelled_weight: float = 0.0, shrink: float = 0.0, pooled: DataFrame | None = None, items: DataFrame | None = None, menu: list[str] | None = None, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, DataFrame]:
    """Binary Dawid-Skene for each label: (uid, label, p) and rates (label, prior, labeller, sens, spec).

    Items with the same votes on a label have the same posterior, so the rounds run over
    the distinct patterns of votes (see ``vote_patterns`` for the arguments). A label that
    nobody was asked about on an item keeps the label's prior there. ``pooled``
    (labeller, sens, spec): each machine's rates over all labels, towards which its rates on
    a label are pulled with ``shrink`` pseudo-counts.
    """
    v = vote_patterns(cells, people, unlabelled_weight, items, menu)
    post, rates = _em(v, driver_cells)(rounds, shrink, pooled)
    return v.every.join(post, "id").select("uid", "label", "p"), rates


def pooled_rates(rates: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Of each machine its prior-weighted mean sensitivity and specificity over its labels: (labeller, sens, spec)."""
    machines = rates.join(people, "labeller", "left_anti") if people is not None else rates
    negative = 1 - F.col("prior")
    return machines.groupBy("labeller").agg((F.sum(F.col("prior") * F.col("sens")) / F.sum("prior")).alias("sens"), (F.sum(negative * F.col("spec")) / F.sum(negative)).alias("spec"))


def fuse(cells: DataFrame, people: DataFrame | None = None, rounds: int = 30, shrink: float = 20.0, unlabelled_weight: float = 0.0, items: DataFrame | None = None, menu: list[str] | None = None, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, DataFrame]:
    """Two passes: plain rates, then each machine's shrunk towards its own over all labels. (uid, probs map, labels), rates.

    Probabilities have three digits; labels are those over one half. Every item has every label.
    """
    v = vote_patterns(cells, people, unlabelled_weight, items, menu)
    em = _em(v, driver_cells)
    post, rates = em(rounds)
    if shrink:
        post, rates = em(rounds, shrink, pooled_rates(rates, people))
    rounded = v.every.join(post.select("id", F.bround("p", 3).alias("p")), "id")
    out = rounded.groupBy("uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("probs"))
    return out.withColumn("labels", F.map_keys(F.map_filter("probs", lambda k, v: v > 0.5))), rates


def anchored_em(judged: DataFrame, calibration: DataFrame, classes: list[str], anchor: float = 20.0, rounds: int = 50) -> DataFrame:
    """K-class Dawid-Skene with one anchored judge: (uid, label, pred, fused, conf, confident, hard_negative).

    judged(uid, label: weak label, pred: judge's answer); calibration(truth, pred, n).
    Items with the same two answers have the same posterior, so the rounds run over the
    counts of distinct answer pairs: at most (classes + 1) squared numbers, which are all
    that reaches the driver; the result is joined back to the items.
    """
    other = "other"
    truths = [*classes, other]
    size, place = len(truths), {t: i for i, t in enumerate(truths)}
    known = lambda c: F.when(F.col(c).isin(*truths), F.col(c)).otherwise(other)
    cell = judged.withColumns({"pred": known("pred"), "label": known("label")})

    def counted(rows: DataFrame, first: str, n) -> np.ndarray:
        out = np.zeros((size, size))
        for r in rows.filter(F.col(first).isin(*truths) & F.col("pred").isin(*truths)).groupBy(first, "pred").agg(n.alias("n")).collect():
            out[place[r[0]], place[r[1]]] = r.n or 0
        return out

    flat = counted(calibration, "truth", F.sum("n"))
    flat[(flat.sum(axis=1) == 0) | (np.arange(size) == place[other])] = 1.0
    g0 = flat / flat.sum(axis=1, keepdims=True) * anchor + 0.5  # truth, answer
    pairs = counted(cell, "label", F.count(F.lit(1)))  # weak label, answer
    n = max(1.0, pairs.sum())
    g = g0 / g0.sum(axis=1, keepdims=True)
    c = np.where(np.eye(size, dtype=bool), 0.6, 0.4 / max(1, size - 1))  # truth, weak label
    prior = np.full(size, 1.0 / size)
    post = np.full((size, size, size), 1.0 / size)  # truth, weak label, answer
    for _ in range(rounds):
        post = prior[:, None, None] * c[:, :, None] * g[:, None, :]
        post /= post.sum(axis=0)
        weighed = post * pairs
        prior = weighed.sum(axis=(1, 2)) / n
        g = weighed.sum(axis=1) + g0
        g /= g.sum(axis=1, keepdims=True)
        c = weighed.sum(axis=2) + 0.5
        c /= c.sum(axis=1, keepdims=True)
    best = [
        (truths[l], truths[a], *max((float(post[k, l, a]), truths[k]) for k in range(size)), float(post[l, l, a]))
        for l in range(size)
        for a in range(size)
    ]
    table = judged.sparkSession.createDataFrame(best, "label string, pred string, conf double, fused string, weak double")
    done = cell.join(F.broadcast(table), ["label", "pred"])
    return done.select("uid", "label", "pred", "fused", "conf", ((F.col("conf") >= 0.8) & (F.col("fused") != other)).alias("confident"), (F.col("weak") <= 0.1).alias("hard_negative"))


def chapter_vote(label, title, menu: list[str], same: dict[str, str] | None = None, words: dict[str, str] | None = None, background: str = "__bg__"):
    """A chapter's vote: labels by a word of its title, else its own label if on the menu, none for background, null (no vote) otherwise."""
    named = label
    for a, b in (same or {}).items():
        named = F.when(label == a, b).otherwise(named)
    out = F.when(named.isin(*menu), F.array(named)).when(label == background, F.array().cast("array<string>"))
    for word, found in (words or {}).items():
        out = F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(word)), F.array(F.lit(found))).otherwise(out)
    return out


def merge_votes(ledgers: list[DataFrame], uid: str = "uid", labeller: str = "labeller") -> DataFrame:
    """Union of vote ledgers, one row per labeller and item: the last ledger wins, and in it the last row by ``at``."""
    parts = [d.withColumn("_order", F.lit(i)) for i, d in enumerate(ledgers)]
    every = parts[0]
    for d in parts[1:]:
        every = every.unionByName(d, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (uid, labeller, "_order")]
    last = every.groupBy(uid, labeller).agg(F.max_by(F.struct(*rest), F.struct("_order", "at")).alias("r"))
    return last.select(uid, labeller, *(F.col(f"r.{c}").alias(c) for c in rest))
