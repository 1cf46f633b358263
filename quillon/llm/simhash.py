"""SimHash near-duplicate detection.

Fingerprints are made in Python over Arrow batches (XXH64 of every word shingle,
bit majorities with numpy). Linking compares fingerprints exactly: distinct
fingerprints are dealt into cells by pairs of bit blocks; every cell, in order of
population count, is cut into tiles, and tile pairs are compared with exclusive-or
and bit counts, but for those whose population counts differ by more than the
radius, which are never formed. Cells too large for a task are cut into strips by
population count and hash first, and a task compares two strips tile by tile.
Links leave a task as a spanning forest, and components are found by distributed
star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, at_places, cut, located, map_arrow, slices, table
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints in one tile.
TILE = 8
#: Tile pairs compared at once.
TILE_PAIRS = 1 << 14
#: Least fingerprints of a strip, and most strips of a population count in one cell: larger cells have
#: larger strips, so that no more than STRIPS copies of a row for each near population count are shuffled.
STRIP, STRIPS = 1024, 64
#: Bit blocks of the 64 bits: 5 blocks, of which at most 3 can differ at distance 3, so 2 agree.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
AGREE = len(BLOCKS) - RADIUS


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one text; null, empty and wordless texts give 0."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        grams, m = iter([b" ".join(words)]), 1
    else:
        grams, m = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), n - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 65025):
        bits = np.unpackbits(hashes[i : i + 65025].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # 255 rows of bits fit the sum of a byte
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(bits):
            counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp long: one row per row of docs; whole texts."""
    own = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*own).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *kept, texts in slices(batch, batch.schema.names):
                fps = np.fromiter((fingerprint(t, shingle) for t in texts.to_pylist()), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=schema.names)

    return map_arrow(docs.select(*own, F.col(text_col).alias("_simhash_text")), run, schema)


def _cells(fp) -> list:
    """The cell keys of a fingerprint, one for each choice of AGREE blocks."""
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = []
    for c, chosen in enumerate(combinations(range(len(BLOCKS)), AGREE)):
        key = F.lit(c).cast("long")
        for b in chosen:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(part[b])
        keys.append(key)
    return keys


def _links(fp: np.ndarray, group: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left < right) of fingerprints within the radius in runs of equal group; fp sorted by population count within a run.

    Tiles are runs of up to ``tile`` rows of one group. A tile is paired with itself and
    with later tiles of its group, as long as their population counts come within the radius.
    """
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    bounds, sizes = bounds[:-1][sizes > 1], sizes[sizes > 1]
    tiles = -(-sizes // tile)
    of = np.repeat(np.arange(len(sizes)), tiles)
    first = bounds[of] + (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * tile
    last = np.minimum(first + tile, bounds[of] + sizes[of]) - 1
    pops = np.bitwise_count(fp).astype(np.int16)
    low, high = pops[first], pops[last]
    each = np.arange(tile)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ahead, a = 0, np.arange(len(of))
    while len(a):  # pairs of each tile with the one ``ahead`` tiles after it, until none is near enough
        b = a + ahead
        a = a[(b < len(of)) & (of[np.minimum(b, len(of) - 1)] == of[a])]
        a = a[low[a + ahead] - high[a] <= radius]
        for i in range(0, len(a), TILE_PAIRS):
            x, y = first[a[i : i + TILE_PAIRS]], first[a[i : i + TILE_PAIRS] + ahead]
            xs, ys = x[:, None] + each, y[:, None] + each
            x_in, y_in = xs <= last[a[i : i + TILE_PAIRS]][:, None], ys <= last[a[i : i + TILE_PAIRS] + ahead][:, None]
            near = np.bitwise_count(fp[np.minimum(xs, len(fp) - 1)][:, :, None] ^ fp[np.minimum(ys, len(fp) - 1)][:, None, :]) <= radius
            near &= x_in[:, :, None] & y_in[:, None, :]
            if not ahead:
                near &= each[:, None] < each[None, :]
            k, i_x, i_y = np.nonzero(near)
            left.append(xs[k, i_x])
            right.append(ys[k, i_y])
        ahead += 1
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(radius: int):
    def emit(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        left, right = _links(fp, group, radius)
        used, inverse = np.unique(np.r_[left, right], return_inverse=True)
        label = _forest(len(used), inverse[: len(left)], inverse[len(left) :])
        own = np.flatnonzero(label != np.arange(len(used)))
        node, root = fp[used[own]].view(np.int64), fp[used[label[own]]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held:
                now = [np.concatenate([h, x]) for h, x in zip(held.pop(), now)]
            key, lo, hi, _ = now
            last = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            at = last[-1] + 1 if len(last) else 0
            held.append([x[at:] for x in now])
            if at:
                yield emit(now[3][:at].view(np.uint64), np.cumsum(np.r_[0, np.isin(np.arange(1, at), last + 1)]))
        if held:
            fp = held[0][3].view(np.uint64)
            yield emit(fp, np.zeros(len(fp), np.int64))

    return run


def links(unique: DataFrame, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """unique(fp long, distinct) -> (u, v): a spanning forest, task by task, of the links."""
    fp = F.col("fp")
    keys = unique.select("fp", F.bit_count(fp).alias("pop"), F.explode(F.array(*_cells(fp))).alias("key"))
    sizes = keys.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    strips = F.least(F.ceil(F.col("n") / strip), F.lit(STRIPS)).cast("int")
    # One row for each cell that outgrows a strip; at most 65 population counts in each.
    large = cut(sizes.groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pop", strips))).alias("salts")).filter(F.col("all") > strip).select("key", "salts"))
    dealt = keys.join(large, "key", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce(F.try_element_at("salts", F.col("pop")), F.lit(1))).cast("int"))
    near = F.array(*(F.col("pop") + d for d in range(-radius, radius + 1)))
    partners = F.flatten(
        F.transform(
            F.filter(near, lambda p: F.map_contains_key(F.col("salts"), p)),
            lambda p: F.transform(F.sequence(F.lit(0), F.try_element_at("salts", p) - 1), lambda s: p * F.lit(1 << 22) + s),
        )
    )
    own = F.col("pop") * F.lit(1 << 22) + F.col("salt")
    paired = (
        dealt.withColumn("other", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(-1))).otherwise(partners)))
        .withColumn("own", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(own))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "pop")
    )
    dealt_out = paired.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "pop").select("key", "lo", "hi", "fp")
    return map_arrow(dealt_out, _compare(radius), "u long, v long")


def simhash_classes(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, strip: int = STRIP) -> tuple[DataFrame, DataFrame]:
    """(keep..., fp) of every row of docs, and (fp, root) of every distinct fingerprint.

    root is the smallest fingerprint reachable over links of at most ``radius``
    (0 to 3) differing bits. Null, empty and wordless texts have fingerprint 0 and
    link like others. An empty table gives empty results.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must be 0 to 3")
    prints = cut(fingerprints(docs, keep, text_col, shingle))
    unique = cut(prints.select("fp").distinct())
    found = cut(connected_components(links(unique, radius, strip)))
    return prints, unique.join(found, unique.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, strip: int = STRIP) -> DataFrame:
    """One row per row of docs: (id_col, fp long, component_id).

    component_id is the smallest identifier of the row's class (see
    ``simhash_classes``). Rows with the same text always share a component; null
    identifiers take part and get the component of their text. Columns other than
    the two named are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, classes = simhash_classes(own, ["id"], "text", shingle, radius, strip)
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    rooted = cut(classes.join(first, "fp"))
    low = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(rooted.join(low, "root").select("fp", "component_id"))
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class: that of the smallest identifier (null last), then of the first place.

    Null, empty and wordless texts are one class with whatever lies near fingerprint 0;
    rows repeated in full are one class, too. Columns of any name pass through; an empty
    table gives an empty result. Texts are not shuffled, however many rows go.
    """
    rows = located(docs)  # once: each call may write a copy with places of its own
    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *PLACE)
    prints, classes = simhash_classes(own, ["id", *PLACE])
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", *PLACE)
    least = cut(prints.groupBy("fp").agg(F.min(order).alias("best")).join(classes, "fp").groupBy("root").agg(F.min("best").alias("best")))
    stays = cut(classes.join(least, "root").select("fp", F.col("best._quillon_key").alias("k"), F.col("best._quillon_row").alias("r")))
    gone = cut(prints.join(stays, "fp").filter("NOT (k = _quillon_key AND r = _quillon_row)").select(*PLACE))
    return at_places(rows, gone, inside=False).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: doc_id, fingerprint string, component_id.

    Null and wordless texts have fingerprint zero and link like others; repeated rows
    are in one component; an empty table gives an empty result; other columns are not read.
    """
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
