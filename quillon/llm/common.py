"""What the operators of this subpackage share: tables, the shared folder, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Places (16 bytes each) are broadcast up to this number; beyond it each task reads those of its own files.
BROADCAST_ROWS = 2_000_000
#: Places in one folder of those written for tasks to read.
FOLDER_ROWS = 1_000_000
PLACE = ["_quillon_key", "_quillon_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by whatever file system ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests), a temporary folder is made
    and registered as the session's checkpoint directory; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


_shipped: set[str] = set()


#: Of an Arrow batch sent to Python: rows, so that a batch of very long texts stays small.
ARROW_ROWS = 500


def _trim() -> None:
    """Give freed memory back to the system: a worker process outlives its task and serves later stages."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Let the allocators return what is free; between batches too, where many short-lived texts and arrays leave holes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over small batches, with this package sent to the executors once per application."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="quillon-ship-")) / f"{root.name}.zip"  # the driver serves it
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def trimmed(batches):
        yield from function(batches)
        _trim()

    return df.mapInArrow(trimmed, schema)


def shrink_heaps(spark: SparkSession) -> None:
    """Collect the executors' garbage: their heaps shrink from what the last shuffles needed, and Python workers find that memory free."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that every executor has some
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def kept_columns(keep: list[str], results: list[str]) -> list[str]:
    """The columns to keep, each once; those named like a result are left out, so that no name stands twice."""
    return [c for c in dict.fromkeys(keep) if c not in results]


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def located(docs: DataFrame) -> DataFrame:
    """docs with PLACE: a hash of the file's path and the row's number in it.

    Needs the file metadata of a scan; rows from elsewhere are written to the
    shared folder first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
    except AnalysisException:  # no scan of files: rows in memory, unions, joins
        path = scratch(docs.sparkSession, "rows")
        docs.write.parquet(path)
        return located(docs.sparkSession.read.parquet(path))
    return docs.withColumns({"_quillon_key": F.xxhash64(meta["file_path"]), "_quillon_row": meta["row_index"]})


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder; plain paths and file: URIs are local or mounted ones."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_by_file(places: DataFrame, n: int) -> tuple[str, int]:
    """Store ``n`` rows with PLACE in the shared folder for tasks to look up: the folder and its number of parts.

    A part holds a range of file hashes, in order of file and row and in small row groups, so that a
    task that reads the rows of one file skips the others'.
    """
    parts = max(1, -(-n // FOLDER_ROWS))
    folder = scratch(places.sparkSession, "places")
    dealt = places.withColumn("part", F.pmod(F.col(PLACE[0]), F.lit(parts))).repartition("part").sortWithinPartitions("part", *PLACE)
    dealt.write.partitionBy("part").option("parquet.block.size", 1 << 20).parquet(folder)
    return folder, parts


def rows_of_file(folder: str, parts: int, key: int, columns: list[str]) -> pa.Table | None:
    """The stored rows of one file, or None if its part has no rows at all."""
    fs, base = filesystem(folder)
    part = f"{base}/part={key % parts}"
    if fs.get_file_info(part).type == pafs.FileType.NotFound:
        return None
    return pq.read_table(part, filesystem=fs, columns=columns, filters=[(PLACE[0], "=", key)], partitioning=None)


def at_places(rows: DataFrame, places: DataFrame, inside: bool) -> DataFrame:
    """The located rows that are (inside) or are not (otherwise) at one of the places (PLACE); no row is shuffled.

    ``places`` should be cut off, as it is counted. Few are broadcast. Many are
    written to the shared folder, a folder for each range of file hashes, and each
    task reads those of the files that its rows come from.
    """
    n = places.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(places), PLACE, "left_semi" if inside else "left_anti")
    folder, parts = write_by_file(places.select(*PLACE), n)
    key_at, row_at = (rows.columns.index(c) for c in PLACE)

    def run(batches):
        known, own = None, np.zeros(0, np.int64)
        for batch in batches:
            keys, numbers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (key_at, row_at))
            found = np.zeros(len(keys), bool)
            for key in np.unique(keys).tolist():
                if key != known:
                    there = rows_of_file(folder, parts, key, PLACE[1:])
                    own = there.column(0).to_numpy() if there is not None else own[:0]
                    known = key
                found |= (keys == key) & np.isin(numbers, own)
            yield batch.filter(pa.array(found if inside else ~found))

    return map_arrow(rows, run, rows.schema)


def slices(batch, columns: list[str], budget: int = 8 << 20, rows: int = 2048):
    """Cut an Arrow batch into pieces of bounded rows and text bytes, as Python lists."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    n = batch.num_rows
    if not n:
        return
    per_row = max(1, batch.nbytes // n)
    step = max(1, min(rows, budget // per_row))
    for i in range(0, n, step):
        yield [c.slice(i, step) for c in cols]
