"""Comparisons of judges, models and people, and probes over stored embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import percentiles


def _one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def judge_calibration(judged: DataFrame, cost: str | None = None) -> DataFrame:
    """judged(item, judge, truth, pred[, cost]) -> by judge and class: n, recall, precision and mean cost."""
    hit = F.col("pred") == F.col("truth")
    by_truth = judged.groupBy("judge", F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("recall"), *([F.avg(cost).alias("cost")] if cost else []))
    by_pred = judged.groupBy("judge", F.col("pred").alias("label")).agg(F.avg(hit.cast("int")).alias("precision"))
    return by_truth.join(by_pred, ["judge", "label"], "left")


def judges_against_people(judged: DataFrame, people: DataFrame) -> DataFrame:
    """judged(item, judge, labels) and people(item, who, labels) -> (judge, label, tp, fp, fn, f1): against what most people ticked.

    A label is true of an item if more than half of its people ticked it. Classes that no item a judge
    saw has have no figures.
    """
    n = people.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    ticks = people.select("item", F.explode(F.array_distinct("labels")).alias("label")).groupBy("item", "label").agg(F.count(F.lit(1)).alias("_c"))
    most = ticks.join(n, "item").filter(2 * F.col("_c") > F.col("_n")).select("item", "label", F.lit(1).alias("_true"))
    both = judged.join(n.select("item"), "item", "left_semi")
    said = both.select("item", "judge", F.explode(F.array_distinct("labels")).alias("label"), F.lit(1).alias("_said"))
    due = both.select("item", "judge").join(most, "item")
    cells = said.join(due, ["item", "judge", "label"], "full")
    t, s = F.col("_true").isNotNull(), F.col("_said").isNotNull()
    sums = cells.groupBy("judge", "label").agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"))
    return sums.filter("tp + fn > 0").withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def system_comparison(rows: DataFrame, families: dict[str, str], reject: str = "reject") -> DataFrame:
    """rows(truth, first, second): one row with exact and same-family agreement of both systems, precision and recall of
    rejection, and how many items the second fixes and breaks."""
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    family = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
    out = [F.count(F.lit(1)).alias("n")]
    for s in ("first", "second"):
        said, right = F.col(s) == reject, F.col("truth") == reject
        out += [
            F.avg((F.col(s) == F.col("truth")).cast("int")).alias(f"{s}_exact"),
            F.avg((family(s) == family("truth")).cast("int")).alias(f"{s}_family"),
            (F.count_if(said & right) / _one(F.count_if(said))).alias(f"{s}_reject_precision"),
            (F.count_if(said & right) / _one(F.count_if(right))).alias(f"{s}_reject_recall"),
        ]
    a, b = F.col("first") == F.col("truth"), F.col("second") == F.col("truth")
    return rows.agg(*out, F.count_if(~a & b).alias("fixes"), F.count_if(a & ~b).alias("breaks"))


def external_accuracy(scored: DataFrame, accept: float = 0.5) -> DataFrame:
    """scored(truth, pred, score) -> by class: n, accuracy, and false accepts among rows of other classes."""
    took = F.col("score") >= accept
    right = scored.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((took & (F.col("pred") == F.col("truth"))).cast("int")).alias("accuracy"))
    wrong = scored.filter(took & (F.col("pred") != F.col("truth"))).groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("false_accepts"))
    return right.join(wrong, "label", "left").fillna(0, ["false_accepts"])


def model_against_people(votes: DataFrame, model: DataFrame, item: str = "item", who: str = "who") -> DataFrame:
    """(who, items, f1): micro F1 of the model's label sets against each person's. model(item, pred)."""
    j = votes.join(model, item).select(who, F.size(F.array_intersect("labels", "pred")).alias("tp"), (F.size("labels") + F.size("pred")).alias("both"))
    return j.groupBy(who).agg(F.count(F.lit(1)).alias("items"), (2 * F.sum("tp") / _one(F.sum("both"))).alias("f1"))


def people_against_people(votes: DataFrame, item: str = "item") -> DataFrame:
    """One row: micro F1 over all ordered pairs of people on an item, from label counts instead of pairs.

    A label chosen by c of an item's n people is shared by c (c - 1) ordered pairs;
    each set stands in 2 (n - 1) of them.
    """
    n = votes.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("labels")).alias("s"))
    c = votes.select(item, F.explode("labels").alias("l")).groupBy(item, "l").agg(F.count(F.lit(1)).alias("c"))
    shared = c.groupBy(item).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("tp"))
    j = n.join(shared, item, "left").filter("n > 1")
    return j.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), (2 * F.sum("tp") / _one(F.sum(2 * (F.col("n") - 1) * F.col("s")))).alias("f1"))


def timing_errors(found: DataFrame) -> DataFrame:
    """found(truth_start, truth_end, start, end) -> one row: n, median and 90th percentile of onset and offset errors, share that overlaps."""
    rows = found.select(F.abs(F.col("start") - F.col("truth_start")).alias("onset"), F.abs(F.col("end") - F.col("truth_end")).alias("offset"))
    over = (F.col("start") < F.col("truth_end")) & (F.col("truth_start") < F.col("end"))
    ranked = {f"{c}_{n}": F.lit(x).cast("double") for c in ("onset", "offset") for n, x in zip(("median", "p90"), percentiles(rows, c, [0.5, 0.9]))}
    sums = found.agg(F.count(F.lit(1)).alias("n"), F.avg(over.cast("int")).alias("overlaps"))
    return sums.select("n", *(x.alias(n) for n, x in ranked.items()), "overlaps")


def learnability(embeddings: DataFrame, cap: int = 200, folds: int = 4, repeats: int = 2, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(repeat, n, accuracy, majority): a linear softmax probe on balanced classes, trained on all but one fold; nothing for an empty table."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rank = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(key), key))
    rows = embeddings.withColumn("_r", rank).filter(F.col("_r") <= cap).select(F.col(key).alias("k"), F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    if rows.isEmpty():
        return embeddings.sparkSession.createDataFrame([], "repeat int, n long, accuracy double, majority double")
    out = None
    for repeat in range(repeats):
        fold = F.pmod(F.xxhash64(F.lit(repeat), "k"), F.lit(folds))
        model = LogisticRegression(maxIter=50, regParam=0.01).fit(rows.filter(fold != 0))
        test = model.transform(rows.filter(fold == 0)).select("label", "prediction")
        most = test.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("m"))
        score = test.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))
        one = score.join(most).select(F.lit(repeat).alias("repeat"), "n", "accuracy", (F.col("m") / F.col("n")).alias("majority"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def soft_probe_rows(fused: DataFrame, vectors: DataFrame, label: str) -> DataFrame:
    """Rows for a weighted probe of one class: (uid, y, w, embedding), each item as a positive of weight p and a negative of 1 - p."""
    p = F.coalesce(F.try_element_at("probs", F.lit(label)), F.lit(0.0))
    both = F.array(F.struct(F.lit(1.0).alias("y"), p.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - p).alias("w")))
    return fused.select("uid", F.explode(both).alias("r")).select("uid", "r.y", "r.w").filter("w > 0").join(vectors, "uid")
