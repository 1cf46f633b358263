"""Sinks that can be run again: resumed appends, deltas, packed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, key: str, schema_like: DataFrame | None = None) -> None:
    """Append the rows whose key the JSON ledger at path lacks, one for each key."""
    spark = rows.sparkSession
    from quillon.sources.readers import jsonl

    known = jsonl(spark, path, f"`{key}` {rows.schema[key].dataType.simpleString()}")
    rows.join(known.select(key).distinct(), key, "left_anti").dropDuplicates([key]).write.mode("append").json(path)


def export_delta(rows: DataFrame, index: DataFrame, key: str, path: str) -> None:
    """Write the rows that an index doesn't list."""
    rows.join(index.select(key).distinct(), key, "left_anti").write.mode("overwrite").json(path)


def pack(rows: DataFrame, path: str, split: str = "split", label: str = "label", seconds: str = "seconds", per_file: int = 100_000) -> DataFrame:
    """Write the dataset by split and return its report: (split, label, rows, hours)."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy(split).parquet(path)
    return rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"), (F.sum(seconds) / 3600).alias("hours"))


def expire(rows: DataFrame, at: str, days: int, now) -> DataFrame:
    """Rows no older than this many days."""
    return rows.filter(F.col(at) >= F.date_sub(now, days))


def tombstone(rows: DataFrame, gone: DataFrame, key: str, erase: list[str]) -> DataFrame:
    """Rows of keys in gone lose the personal columns and get deleted = true; the others stay."""
    j = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    lost = F.coalesce("_gone", F.lit(False))
    return j.select(*(F.when(~lost, F.col(c)).alias(c) if c in erase else F.col(c) for c in rows.columns), lost.alias("deleted"))


def rate_table(rates: DataFrame, path: str, keys: list[str]) -> None:
    """Write a short table of rates (bounded by labels and labellers) as one sorted JSON file."""
    rates.orderBy(*keys).coalesce(1).write.mode("overwrite").json(path)
