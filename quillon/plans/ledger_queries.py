"""Quota scans, byte-bounded shards and closed shortfalls over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import ledgers
from quillon.sources.shared import scratch
from quillon.sources.tables import LABELS, table


@query("quota_scan", "WITH q AS (SELECT count(*) // 20 AS n FROM events), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE value >= 5) SELECT event_id, event_type AS class FROM r, q WHERE k <= n")
def quota_scan(spark, d):
    """A twentieth of all events of each type, the first ones, from a folder of files in order; later files stay closed."""
    e = table(spark, d, "events")
    folder = scratch(spark, "event-files")
    e.repartitionByRange(16, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    files = [f"{folder}/{n}" for n in ledgers.listed(spark, folder) if n.endswith(".parquet")]
    quota = e.count() // 20
    found, _ = ledgers.scan_quotas(spark, files, e.schema, F.col("event_type"), dict.fromkeys(LABELS, quota), usable=F.col("value") >= 5)
    return found.select("event_id", "class")


@query(
    "byte_shards",
    "WITH f AS (SELECT page_id, strlen(html)::BIGINT AS bytes FROM pages WHERE html IS NOT NULL), s AS (SELECT *, bytes > 10000 AS big, sum(CASE WHEN bytes > 10000 THEN 0 ELSE bytes END) OVER w AS run, sum((bytes > 10000)::INT) OVER w AS n FROM f WINDOW w AS (ORDER BY page_id)),"
    " k AS (SELECT *, CASE WHEN big THEN 1 ELSE 0 END AS kind, CASE WHEN big THEN n ELSE (run - bytes) // 10000 END AS slot FROM s) SELECT page_id, bytes, dense_rank() OVER (ORDER BY kind, slot)::BIGINT - 1 AS shard FROM k",
)
def byte_shards(spark, d):
    """Pages in shards of at most 20,000 bytes."""
    p = table(spark, d, "pages").filter("html IS NOT NULL").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return ledgers.shard_numbers(p, 20_000, "page_id").select("page_id", "bytes", "shard")


@query("closed_shortfall", "WITH t AS (SELECT count(*) // 8 AS n FROM orders), r AS (SELECT o_orderkey AS key, o_orderpriority AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey % 10, o_orderkey) AS k FROM orders WHERE o_orderkey % 10 < 8) SELECT key, label FROM r, t WHERE k <= n")
def closed_shortfall(spark, d):
    """Orders of each priority up to an eighth of all, from a source that offers a tenth of its rows a round and is used up after eight."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("label"))
    targets = o.select("label").distinct().withColumn("target", F.lit(o.count() // 8))
    offered = lambda short, n: o.filter((F.col("key") % 10 == n) & F.lit(n < 8))
    found, _ = ledgers.close_shortfall(spark, scratch(spark, "ledger"), targets, offered, "key")
    return found if found is not None else o.limit(0)
