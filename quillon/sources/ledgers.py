"""Scans that stop at quotas, shards of bounded bytes, snapshots that age, and loops that close a shortfall.

What decides here is small and reaches the driver: counts by class, shard totals, a
manifest. Rows stay in tables and files of the shared store.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import running
from quillon.sources.shared import scratch


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    store, path = _store(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


# -- a scan that stops


def scan_quotas(spark: SparkSession, files: list[str], schema, label: Column, quotas: dict[str, int], form: str = "parquet", usable: Column | None = None) -> tuple[DataFrame, list[str]]:
    """The first rows of each class, up to its quota, in order of files and rows; and the files that were read.

    Groups of files are read one after another, each twice as large as the one before, for
    the classes that are still short; once none is, the rest isn't opened. ``label`` gives a row's class,
    ``usable`` (a condition) which rows count. The result is that of a scan of all files.
    """
    out, read, size = scratch(spark, "quotas"), [], 1
    short = dict(quotas)
    while short and len(read) < len(files):
        group = files[len(read) : len(read) + size]
        rank = {spark._jvm.org.apache.hadoop.fs.Path(f).getName(): i + len(read) for i, f in enumerate(group)}
        at = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
        rows = spark.read.schema(schema).format(form).load(group).select("*", F.element_at(at, F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("_file"), F.col("_metadata.row_index").alias("_row") if form == "parquet" else F.monotonically_increasing_id().alias("_row"))
        wanted = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
        rows = rows.withColumns({"_class": label, "_need": F.try_element_at(wanted, label)}).filter(F.col("_need").isNotNull() & (usable if usable is not None else F.lit(True)))
        first = W.partitionBy("_class").orderBy("_file", "_row")
        most = max(short.values())  # a bound that Spark applies before the shuffle
        taken = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).filter("_k <= _need")
        part = f"{out}/part={len(read)}"
        taken.drop("_need", "_k").write.parquet(part)
        for r in spark.read.parquet(part).groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect():
            short[r["_class"]] -= r.n
        short = {c: n for c, n in short.items() if n > 0}
        read, size = read + group, size * 2
    kind = spark.createDataFrame([], schema).withColumns({"_file": F.lit(0), "_row": F.lit(0).cast("long"), "_class": F.lit("")}).schema
    found = spark.read.schema(kind).parquet(*(f"{out}/part={i}" for i in _begins(len(read)))) if read else spark.createDataFrame([], kind)
    return found.withColumnRenamed("_class", "class").drop("_file", "_row"), read


def _begins(n: int) -> Iterator[int]:
    at, size = 0, 1
    while at < n:
        yield at
        at, size = at + size, size * 2


# -- shards of bounded bytes


def shard_numbers(files: DataFrame, limit: int, order: str = "name", size: str = "bytes") -> DataFrame:
    """files with shard long, from 0, in the order of a name: no shard has more than ``limit`` bytes, a single larger file apart.

    Files of over half the limit have a shard each. The others fill shards by their running sum:
    one begins with the first file that begins in another half limit, so each but the last of a kind holds
    about half the limit or more. No step looks at more than sums.
    """
    half = max(1, limit // 2)
    sized = files.withColumn("_big", F.col(size) > half)
    rows = running(sized, [order], sums={"_s": F.when(F.col("_big"), F.lit(0)).otherwise(F.col(size)).cast("long"), "_n": F.col("_big").cast("long")})
    slot = F.floor((F.col("_s") - F.col(size)) / half)
    keyed = rows.withColumn("_slot", F.when(F.col("_big"), F.struct(F.lit(1).alias("kind"), F.col("_n").alias("at"))).otherwise(F.struct(F.lit(0).alias("kind"), slot.cast("long").alias("at"))))
    slots = running(keyed.select("_slot").distinct(), ["_slot"])
    return keyed.join(slots.select("_slot", (F.col("place") - 1).alias("shard")), "_slot").drop("_slot", "_s", "_n", "_big")


def tar_shards(files: DataFrame, folder: str, limit: int, prefix: str = "part") -> DataFrame:
    """Write files(name, content) as tar archives of at most ``limit`` bytes of content each: (shard, path, files, bytes).

    Each archive is written by one task under a name of its own and then renamed, so none is
    ever there in part. Those that are there already are left alone: a run that was stopped goes on.
    """
    spark = files.sparkSession
    there = {n for n in listed(spark, folder) if n.endswith(".tar")}
    numbered = shard_numbers(files.select("name", "content", F.length("content").cast("long").alias("bytes")), limit)
    name = lambda n: f"{prefix}-{n:05d}.tar"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)
        shard, files_in, size, sink, tar, unnamed = None, 0, 0, None, None, ""

        def close() -> tuple:
            if tar is not None:
                tar.close()
                sink.close()
                fs.move(unnamed, f"{base}/{name(shard)}")
            return shard, f"{folder.rstrip('/')}/{name(shard)}", files_in, size

        done = []
        try:
            for batch in batches:
                for n, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                    if n != shard:
                        if shard is not None:
                            done.append(close())
                        shard, files_in, size, tar = n, 0, 0, None
                        if name(n) not in there:
                            unnamed = f"{base}/_{uuid.uuid4().hex}"
                            sink = fs.open_output_stream(unnamed)
                            tar = tarfile.open(fileobj=sink, mode="w|")
                    if tar is not None:
                        info = tarfile.TarInfo(path)
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
                    files_in, size = files_in + 1, size + len(content)
            if shard is not None:
                done.append(close())
        except BaseException:
            if tar is not None:
                sink.close()
                fs.delete_file(unnamed)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["shard", "path", "files", "bytes"])

    dealt = numbered.select("shard", "name", "content").repartition("shard").sortWithinPartitions("shard", "name")
    return dealt.mapInArrow(run, "shard long, path string, files long, bytes long")


# -- snapshots


def publish_snapshot(rows: DataFrame, folder: str, at: datetime) -> str:
    """Write a version of a snapshot, and then the manifest that names it; readers see either the version before or this one."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{version}")
    store, manifest = _store(spark, f"{folder}/manifest-{at.strftime('%Y%m%dT%H%M%S%f')}-{version}.json")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{version}.json")
    out = store.create(beside)
    out.write(bytearray(json.dumps({"version": version, "at": at.isoformat()}).encode()))
    out.close()
    store.rename(beside, manifest)
    return version


def last_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, datetime] | None:
    """The latest snapshot that was published in full and when, or None. Versions without a manifest are never seen."""
    names = [n for n in listed(spark, folder) if n.startswith("manifest-")]
    if not names:
        return None
    told = json.loads("".join(r.value for r in spark.read.text(f"{folder}/{names[-1]}").collect()))
    return spark.read.parquet(f"{folder}/{told['version']}"), datetime.fromisoformat(told["at"])


def snapshot_or_compute(spark: SparkSession, folder: str, compute: Callable[[], DataFrame], now: datetime, oldest: timedelta = timedelta(hours=2)) -> DataFrame:
    """The last snapshot, or, if there is none or it is older than ``oldest``, one computed and published now.

    Called by a clock it is the recompute job; called by readers it is the fallback for when that hasn't run.
    """
    last = last_snapshot(spark, folder)
    if last is None or now - last[1] >= oldest:
        publish_snapshot(compute(), folder, now)
        last = last_snapshot(spark, folder)
    return last[0]


# -- a loop that closes a shortfall


def missing(ledger: DataFrame | None, targets: DataFrame, label: str = "label") -> DataFrame:
    """targets(label, target) with ``missing``: how many of the target the ledger lacks; classes at their target are left out."""
    if ledger is None:
        return targets.withColumn("missing", F.col("target").cast("long")).filter("missing > 0")
    has = ledger.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return targets.join(has, label, "left").withColumn("missing", F.col("target") - F.coalesce("_n", F.lit(0))).drop("_n").filter("missing > 0")


def close_shortfall(spark: SparkSession, folder: str, targets: DataFrame, acquire: Callable[[DataFrame, int], DataFrame], key: str, label: str = "label", rounds: int = 100) -> tuple[DataFrame | None, int]:
    """Acquire rows round by round until every class has its target, a round brings nothing new, or the rounds are used up.

    ``acquire(short, number)`` gives candidates (key, label, ...) for the classes in short(label,
    target, missing); those known are left out, and no more are kept than are missing, smallest keys first.
    Each round is a folder of the ledger: one that was stopped goes on with the next round. Gives the ledger and
    the number of rounds it has.
    """

    def rounds_there() -> int:
        # a round without Spark's mark was broken off; it is done again
        return sum(_store(spark, f"{folder}/{n}/_SUCCESS")[0].exists(_store(spark, f"{folder}/{n}/_SUCCESS")[1]) for n in listed(spark, folder) if n.startswith("round="))

    def ledger(n: int) -> DataFrame | None:
        return spark.read.parquet(*(f"{folder}/round={i:05d}" for i in range(n))) if n else None

    number = rounds_there()
    while number < rounds:
        known = ledger(number)
        short = missing(known, targets, label)
        if short.isEmpty():
            break
        new = acquire(short, number).dropDuplicates([key])
        if known is not None:
            new = new.join(known.select(key), key, "left_anti")
        need = new.join(short.select(label, "missing"), label)
        place = running(need, [key], label)
        path = f"{folder}/round={number:05d}"
        place.filter("place <= missing").drop("missing", "place").write.mode("overwrite").parquet(path)
        if spark.read.parquet(path).isEmpty():
            store, p = _store(spark, path)
            store.delete(p, True)
            break
        number += 1
    return ledger(number), number
