"""The soft probe over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import probe
from quillon.plans.registry import query
from quillon.sources.tables import table


@query("soft_probe")
def soft_probe(spark, d):
    """Every vector's class by a probe fitted to softened labels: nine tenths on the label, the rest on the others; a tenth of rows weigh half."""
    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")
    classes = [r.label for r in e.select("label").distinct().orderBy("label").collect()]
    soft = F.array(*(F.when(F.col("label") == c, 0.9).otherwise(0.1 / max(1, len(classes) - 1)) for c in classes))
    fitted = probe.fit_soft_probe(e.select(F.col("embedding").alias("x"), soft.alias("y"), F.when(F.col("vec_id") % 10 == 0, 0.5).otherwise(1.0).alias("w")))
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, label int, pred string, p double")
    scored = probe.probe_scores(e, fitted, [str(c) for c in classes], ["vec_id", "label"])
    best = F.array_max(F.transform(F.map_entries("probs"), lambda x: F.struct(x["value"].alias("p"), x["key"].alias("k"))))
    return scored.select("vec_id", "label", best["k"].alias("pred"), F.round(best["p"], 4).alias("p"))
