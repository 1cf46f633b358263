"""The driver's tables, and annotation relations derived from them.

Stand-ins: an event is an answer of a labeller (user) on an item (props.k) with one
label (event type) and a listening time (value); documents carry transcripts, and
orders, customers and parts fill the boards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LABELS = ("click", "error", "purchase", "signup", "view")
CONTROL_ITEMS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, at, who, item, label, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("who"), F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("event_type").alias("label"), "value")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item and labeller: the set of labels ever ticked, sorted."""
    return events(spark, sf_dir).groupBy("item", "who").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min("at").alias("at"), F.avg("value").alias("value"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event as an answer: attempt counts a labeller's answers on an item."""
    order = W.partitionBy("item", "who").orderBy("at", "event_id")
    return events(spark, sf_dir).withColumn("attempt", F.row_number().over(order))
