"""Token identifiers in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Layout, all
integers little-endian:

    blocks   each: zstd frame of entries; an entry is
             varint shared | varint unshared | varint length of value | key suffix | value
             (shared: bytes in common with the key before, 0 at the start of a block)
    index    for each block: varint length of last key | last key | u64 offset | u32 size | u32 crc32 of the frame
    bloom    bit array; K probes by double hashing of XXH64
    footer   u64 index offset | u32 index size | u64 bloom offset | u32 bloom size | u32 blocks |
             u64 documents | u64 tokens | u32 crc32 of index and bloom | 8 bytes magic

A key is one byte (0: no identifier, 1: an identifier) and the identifier as
big-endian with its sign bit flipped, so that bytes sort as numbers do. A value
is one byte of width (2 or 4) and the identifiers of the tokens at that width.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import coder, default_vocabulary
from .common import filesystem, map_arrow, scratch, slices, table

MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QIQIIQQI8s")
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 64 << 20
BLOOM_BITS_PER_KEY, PROBES = 10, 7
END_ID = 1
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + _SIGN) % (1 << 64)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to a temporary name and renames it when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempt: str) -> None:
        self.fs, self.path, self.temporary = fs, path, f"{path}.{attempt}.tmp"
        self.out = fs.open_output_stream(self.temporary)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.size, self.last, self.keys = [], 0, b"", []
        self.index = bytearray()
        self.offset = self.blocks = self.documents = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        narrow = not len(ids) or int(ids.max()) < 65536
        value = (b"\2" + ids.astype("<u2").tobytes()) if narrow else (b"\4" + ids.astype("<u4").tobytes())
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + len(key)
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        frame = self.zip.compress(b"".join(self.block))
        self.out.write(frame)
        self.index += _varint(len(self.last)) + self.last + struct.pack("<QII", self.offset, len(frame), zlib.crc32(frame))
        self.offset += len(frame)
        self.blocks += 1
        self.block, self.size = [], 0

    def drop(self) -> None:
        """Give up: nothing stays."""
        self.out.close()
        self.fs.delete_file(self.temporary)

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8 * 8, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        index = bytes(self.index)
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(packed), self.blocks, self.documents, self.tokens, zlib.crc32(index + packed), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Reads a shard: binary search by identifier, or all entries block by block."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        index_at, index_size, bloom_at, bloom_size, blocks, self.documents, self.tokens, crc, magic = foot
        index, bloom = self._at(index_at, index_size), self._at(bloom_at, bloom_size)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = bloom[8:]
        self.last_keys, self.places, at = [], [], 0
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QII", index, at + n))
            at += n + 16

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, crc = self.places[number]
        frame = self._at(offset, size)
        if zlib.crc32(frame) != crc:
            raise ValueError(f"block {number} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(frame), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, f"<u{data[at]}", (length - 1) // data[at], at + 1)
            at += length

    def may_contain(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token identifiers of every document with this identifier."""
        key, found = key_of(doc_id), []
        if not self.may_contain(doc_id):
            return found
        for block in range(bisect_left(self.last_keys, key), len(self.last_keys)):
            for k, ids in self._block(block):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.places)):
            for key, ids in self._block(block):
                yield id_of(key), ids

    def close(self) -> None:
        self.file.close()


MANIFEST = "shard string, part int, number int, documents long, tokens long, first_id long, last_id long"
_MANIFEST = {"shard": pa.string(), "part": pa.int32(), "number": pa.int32(), "documents": pa.int64(), "tokens": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64()}
#: Tasks that read shards, for each core; a task may read several shards.
READERS = 8


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode whole texts and write them in ascending order of identifier; the manifest.

    One row per shard; also written to ``folder``/_manifest. Null texts count as
    empty (then only the end identifier is stored). Rows without an identifier
    come first; rows of one identifier, null included, lie in order of their texts'
    hashes, and however many they are, any number of tasks shares them. Other columns
    are not read. An empty table gives no shard and an empty manifest. Attempts that
    are repeated write the same shards under the same names; what broken ones leave
    is removed.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = coder(path), TaskContext.get()
        fs, base = filesystem(folder)
        part, attempt, number, out, first, last, written, rows = task.partitionId(), str(task.taskAttemptId()), 0, None, None, None, 0, []

        def close() -> None:
            nonlocal out, number, written
            out.close()
            rows.append((f"part-{part:06d}-{number:04d}.sst", part, number, out.documents, out.tokens, first, last))
            out, number, written = None, number + 1, 0

        try:
            for batch in batches:
                for keys, texts in slices(batch, ["id", "text"], 4 << 20):
                    ids, at = bpe.encode(texts.to_pylist())
                    for k, doc_id in enumerate(keys.to_pylist()):
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            out = ShardWriter(fs, f"{base}/part-{part:06d}-{number:04d}.sst", attempt)
                            first = doc_id
                        out.add(key_of(doc_id), np.concatenate([ids[at[k] : at[k + 1]], end]))
                        last = doc_id
                        written += 2 * int(at[k + 1] - at[k]) + 16
                        if written >= shard_bytes:
                            close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.drop()
            raise
        bpe.reset()
        columns = list(zip(*rows)) or [()] * len(_MANIFEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _MANIFEST.values())], names=list(_MANIFEST))

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("k"))
    order = [F.col("id").asc_nulls_first(), "h", "k"]  # k: rows that are the same in full can lie in several ranges, too
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    map_arrow(ordered, run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    fs, base = filesystem(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.path.endswith(".tmp"):  # of attempts whose executor was lost
                fs.delete_file(f.path)
    return docs.sparkSession.read.parquet(f"{folder}/_manifest")


def read_shards(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long[, ids binary]) of every document, read from the shards.

    start: number of identifiers of all documents before it. The driver holds one
    number per range partition, nothing per shard or document. Without shards the
    result is empty.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    manifest = spark.read.parquet(f"{folder}/_manifest")
    parts, start = [], 0
    for p in sorted(manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect(), key=lambda p: p.part):
        parts.append((p.part, start))
        start += p.tokens
    if not parts:
        return spark.createDataFrame([], schema)
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.withColumn("before", before).join(F.broadcast(spark.createDataFrame(parts, "part int, base long")), "part").select("shard", (F.col("base") + F.col("before")).alias("start"))
    tasks = min(manifest.count(), READERS * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for shard, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows, size = ShardReader(fs, f"{base}/{shard}"), [], 0
                for doc_id, ids in reader:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, at, len(ids), zlib.crc32(raw), raw)[: 4 + with_ids])
                    at += len(ids)
                    size += len(raw) * with_ids + 64
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                reader.close()

    return map_arrow(listed.repartition(tasks), run, schema)


def lookup(folder: str, manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """Token identifiers of every document with this identifier: shard range, Bloom filter, binary search."""
    fs, base = filesystem(folder)
    key, found = key_of(doc_id), []
    for m in manifest:
        if key_of(m["first_id"]) <= key <= key_of(m["last_id"]):
            reader = ShardReader(fs, f"{base}/{m['shard']}")
            found += reader.get(doc_id)
            reader.close()
    return found


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, read back from the shards: doc_id, start, n_tokens, ids_crc32 (long).

    Null texts count as empty and have the end identifier alone; documents without an
    identifier come first, repeated rows one after another; an empty table gives an
    empty result; other columns are not read.
    """
    folder = scratch(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder, with_ids=False)
