"""Exact deduplication as a stateful stream.

A ledger of digests (no texts) is published slice by slice to a streaming
aggregation whose state is keyed by digest, kept on disk by RocksDB and never
expires. The state retains for each digest the stable identifier of the row that
stays, and the locator (file and row) of the content first met under the digest.
Every micro-batch meets the state that the ones before have left; where it hits a
digest, the whole normalised bytes of its rows are compared with those at the
retained locator. Texts that differ under one digest are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, PLACE, at_places, cut, delete, located, scratch, table

WHITE_SPACE = "\t\n\x0b\x0c\r "
#: Micro-batches of a call, whatever the size of the table; the rows are dealt to them by a hash of their places.
MICRO_BATCHES = 3
#: State on disk: without preallocation, which takes megabytes for each of many small stores; closed when a micro-batch
#: has committed, so that an executor's memory doesn't hold the stores of batches that are over.
STATE_STORE = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
LEDGER = "id long, digest binary, n int, file_key long, row long, slice int"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    """Smallest is best: most code points, then smallest identifier (null last), then place."""
    return F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("file_key"), F.col("row"))


def stream_state(spark: SparkSession, ledger: str, checkpoint: str, changes: str, on_batch: Callable[[DataFrame], None] | None = None) -> None:
    """Let the stream take up the ledger files that are new since the last call with the same ``checkpoint``.

    Each micro-batch writes the rows of the state that it changed (digest, keep,
    first, group_size) below ``changes``, then calls ``on_batch`` with them.
    """
    state = (
        spark.readStream.schema(LEDGER)
        .parquet(ledger)
        .groupBy("digest")
        .agg(F.min(_best()).alias("keep"), F.min(F.struct("slice", "file_key", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )

    def changed(batch: DataFrame, number: int) -> None:
        # one folder for each micro-batch: a batch that is run again replaces its own rows
        folder = f"{changes}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        if on_batch:
            on_batch(spark.read.schema(batch.schema).parquet(folder))

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        run = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def last_state(spark: SparkSession, changes: str) -> DataFrame:
    """(digest, keep, first, group_size): of each digest what the latest micro-batch left."""
    best = "struct<less:int,no_id:boolean,id:bigint,file_key:bigint,row:bigint>"
    written = spark.read.schema(f"digest binary, keep {best}, first struct<slice:int,file_key:bigint,row:bigint>, group_size long, batch long").parquet(changes)
    return written.groupBy("digest").agg(F.max_by(F.struct("keep", "first", "group_size"), "batch").alias("s")).select("digest", "s.*")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept, _quillon_key, _quillon_row.

    Texts are equal when identical without ASCII white space; null and empty are
    equal. The row with the most code points stays, then the smallest identifier
    (null after all others), then the first place. Rows repeated in full are
    separate rows of one group. An empty table gives an empty result; columns
    other than the two named are not read, whatever their names.
    """
    return _groups(located(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), id_col, digest, micro_batches)


def _groups(rows: DataFrame, id_col: str, digest: Callable[[Column], Column] = sha256, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """exact_groups of located rows (id long, text, PLACE)."""
    spark = rows.sparkSession
    norm = normalised(F.col("text"))
    place = [F.col("_quillon_key").alias("file_key"), F.col("_quillon_row").alias("row")]
    entry = ["id", digest(norm).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), *place]
    staged, ledger, checkpoint, changes, clashes = (scratch(spark, f"dedup-{w}") for w in ("staged", "ledger", "stream", "state", "clashes"))
    rows.select(*entry, F.pmod(F.xxhash64("_quillon_key", "_quillon_row"), F.lit(micro_batches)).cast("int").alias("slice")).write.partitionBy("slice").parquet(staged)
    entries = spark.read.schema(LEDGER).parquet(staged)
    spark.createDataFrame([], "digest binary").write.parquet(clashes)

    def compare(changed: DataFrame, number: int) -> None:
        """Full bytes on hits: the new rows of digests met more than once against the content first met."""
        hits = changed.filter("group_size > 1")
        new = entries.filter(F.col("slice") == number).join(hits.select("digest"), "digest").select("file_key", "row")
        places = cut(new.unionByName(hits.select("first.file_key", "first.row")).distinct().toDF(*PLACE))
        # one copy of each text leaves a map task, however many rows have it
        texts = at_places(rows, places, inside=True).select(norm.alias("norm")).groupBy("norm").agg(F.count(F.lit(1)).alias("rows"))
        unlike = texts.select(digest(F.col("norm")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
        unlike.write.mode("append").parquet(clashes)  # a batch that is run again may add a digest twice

    for number in range(micro_batches):
        entries.filter(F.col("slice") == number).write.mode("append").parquet(ledger)  # what the next micro-batch takes up
        stream_state(spark, ledger, checkpoint, changes, lambda changed: compare(changed, number))  # noqa: B023  ended before the next
    state = cut(last_state(spark, changes))  # so that the join below is one that can split hot digests
    stays = ((F.col("keep.file_key") == F.col("file_key")) & (F.col("keep.row") == F.col("row"))).alias("kept")
    out = ["id", "digest", "n", "file_key", "row", F.col("keep.id").alias("keep_id"), "group_size", stays]
    joined = cut(entries.drop("slice").join(state.drop("first"), "digest").select(*out))
    clash = cut(spark.read.schema("digest binary").parquet(clashes).distinct())
    for folder in (staged, ledger, checkpoint, changes, clashes):
        delete(spark, folder)
    n_clash = clash.count()
    if n_clash:
        clash = F.broadcast(clash) if n_clash <= BROADCAST_ROWS else clash
        again = rows.select(*entry, norm.alias("norm")).join(clash, "digest", "left_semi")
        groups = again.groupBy("norm").agg(F.min(_best()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        joined = joined.join(clash, "digest", "left_anti").unionByName(again.join(groups, "norm").select(*out))
    return joined.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", "kept", F.col("file_key").alias(PLACE[0]), F.col("row").alias(PLACE[1]))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_groups drops.

    Of equal texts (null and empty are equal) one row stays, of rows repeated in
    full the first place. Columns of any name pass through; an empty table gives
    an empty result. Texts are not shuffled, however many rows go.
    """
    rows = located(docs)  # once: each call may write a copy with places of its own
    gone = cut(_groups(rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *PLACE), id_col).filter("not kept").select(*PLACE))
    return at_places(rows, gone, inside=False).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, staying row and digest of every document: doc_id, keep_id, group_size long, kept boolean, text_sha256.

    Null texts count as empty; repeated rows are rows of one group of which one is
    kept; an empty table gives an empty result; other columns are not read.
    """
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS norm, length(coalesce(text, '')) AS len
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS rn,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
