"""Near copies: long SimHash fingerprints first, then an exact join for what they miss.

Texts are linked if their sets of word shingles (as XXH64) are alike to SIMILARITY or more: no
link is made below it and none is lost above it. SimHash finds most links and brings large
groups together; each of its links is checked on the sets. The rest comes from a prefix join:
of two sets so alike, the first 1 - SIMILARITY of either in one common order hold a common
shingle. Such cells are searched for pairs of different classes, which are checked, too.

Two texts whose word shingles are alike to a share s have fingerprints that differ in a
share acos(2 s / (1 + s)) / pi of their bits, give or take what so many bits allow: 64 of
them can't tell 0.8 from 0.6, BITS can tell it from 0.7. As such a radius is far too wide
for blocks that lose no link, fingerprints are dealt into cells by TABLES of randomly chosen
bits, so many that a pair at the threshold meets in one of them with probability RECALL.
The bits of a key grow with the logarithm of the table, so cells keep their size.

In a cell of SimHash, fingerprints in order of population count are compared tile by tile, with
exclusive-or and bit counts, but for those whose population counts differ by more than the
radius. Rows of one component are never compared with each other once they are known to be
of it, so a cell full of copies of one text costs little more than its rows.

The order of the prefix join is that of the hashes, but for shingles whose cells have more than
HOT rows: they come last, so a common passage is in few prefixes. In a cell, pairs go by sizes
and by the parities of their hashes, of which no more can differ than shingles do; both lose no
link. Large cells of several classes first try each row against one of the largest class, until
that brings no more together; then all pairs of different classes follow.

BITS parities tell nothing of large sets, which would all be checked. So a pair then goes by
as many parities as its sets have hashes, up to a power of two: what is far from alike leaves
before any set is read, and no link is lost by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import repeat
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, at_places, cut, located, map_arrow, slices
from .components import connected_components

SHINGLE = 5
SEED = 42
BITS = 512
WORDS = BITS // 64
#: Shingles alike to this share, of all that either text has, make near copies.
SIMILARITY = 0.8
#: Chance that a pair at this similarity shares a cell.
RECALL = 0.95
#: Standard deviations of the differing bits of such a pair that the radius allows for.
SLACK = 1.0
#: Fingerprints that a cell has by chance.
CELL = 256
#: Fingerprints compared with the others of a cell at once, and of these at a time.
TILE, OTHERS = 64, 2048
#: Larger cells are compared by pairs of strips; there are at most STRIPS of them, beyond which they grow.
STRIP, STRIPS = 200_000, 64
#: Shingles in more prefixes than this come last in the order of prefixes; it is settled in so many passes at most.
HOT, PASSES = 1000, 4
#: Cells of more rows and several classes are tried by single pivots first, so many times at most; smaller ones take fewer jobs without.
STAR, STARS = 4096, 4
#: Copies of a set, at most, among which the pairs that it is in are dealt when they are checked.
PARTS = 16
#: Odd factors that make a shingle's further hashes of its first one.
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts that are alike to this share of their shingles."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius(similarity: float = SIMILARITY, slack: float = SLACK) -> int:
    p = differing(similarity)
    return int(BITS * p + slack * (BITS * p * (1 - p)) ** 0.5)


def key_bits(n: int) -> int:
    """Bits of a cell's key for n fingerprints."""
    return min(32, max(4, ceil(log2(max(1, n / CELL)))))


def table_count(width: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Tables by which a pair at the similarity shares a cell with the recall."""
    return ceil(log(1 - recall) / log(1 - (1 - differing(similarity)) ** width))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's word shingles as ascending XXH64; empty for null, empty and wordless texts."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < shingle:
        grams, m = iter([b" ".join(words)]), 1
    else:
        grams, m = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), n - shingle + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, m))


def identity(hashes: np.ndarray) -> int:
    """The number of a set: equal sets have equal ones, and of 15 million different sets two share one with a chance below 0.00001."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def simhash(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255):  # so many rows of bits fit the sum of a byte
        mixed = hashes[i : i + 255, None] * _FACTORS
        mixed ^= mixed >> np.uint64(31)
        mixed *= _FACTORS[::-1]
        mixed ^= mixed >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The long SimHash of the set of a text's word shingles, as uint64 words; zeros for null, empty and wordless texts."""
    return simhash(shingles(text, shingle))


def parity(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities (a power of two) of the numbers of hashes that fall to each: of two sets they differ in no more bits than the sets in hashes."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """As many parities as there are hashes at least, BITS at least."""
    return parity(hashes, max(BITS, 1 << max(0, len(hashes) - 1).bit_length()))


def fold(parities: np.ndarray, words: int) -> np.ndarray:
    """The fewer parities of the same set, in so many words."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep``, and of each row's set of shingles fp (its identity), size, bits (SimHash), parity and wide (parities by its size); whole texts."""
    own = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*own).schema.add("fp", "long").add("size", "integer").add("bits", "binary").add("parity", "binary").add("wide", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *kept, texts in slices(batch, batch.schema.names):
                sets = [shingles(t, shingle) for t in texts.to_pylist()]
                ids, sizes = pa.array([identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())
                prints = [pa.array([of(s).tobytes() for s in sets], pa.binary()) for of in (simhash, parity, wide_parity)]
                yield pa.RecordBatch.from_arrays([*kept, ids, sizes, *prints], names=schema.names)

    return map_arrow(docs.select(*own, F.col(text_col).alias("_near_text")), run, schema)


def chosen_bits(width: int, tables: int) -> np.ndarray:
    """For each table the positions of its key's bits: permutations of all bits, cut into keys."""
    rng, rows = np.random.default_rng(SEED + width), []
    while len(rows) < tables:
        order = rng.permutation(BITS)
        rows += [order[i : i + width] for i in range(0, BITS - width + 1, width)]
    return np.array(rows[:tables])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def cells(unique: DataFrame, width: int, tables: int) -> DataFrame:
    """unique(id long, fp) -> (key long, pop int, id, fp): a row for each table."""
    bits = chosen_bits(width, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = _matrix(batch.column(1))
            pop = np.bitwise_count(fp).sum(axis=1).astype(np.int32)
            on = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(bits):
                key = (on[:, at].astype(np.int64) << np.arange(width)).sum(axis=1) + (t << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pop), batch.column(0), batch.column(1)], names=["key", "pop", "id", "fp"])

    return map_arrow(unique.select("id", "fp"), run, "key long, pop int, id long, fp binary")


def cell_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius that link what hangs together in one cell: a spanning forest. Rows of fp stand by population count.

    A tile of rows is compared with itself and with those left. Rows near to none are done.
    Of the others one begins a component, which is then followed to its end: what was found
    last, tile by tile, is compared with the rows left, never with those of the component.
    """
    n = len(fp)
    pops = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alive = np.ones(n, bool)

    def near(tile: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tile), len(rest)), bool)
        a, b = np.searchsorted(pops[rest], (pops[tile].min() - most, pops[tile].max() + most + 1))
        for k in range(a, b, OTHERS):
            some = rest[k : min(b, k + OTHERS)]
            out[:, k : k + len(some)] = np.bitwise_count(fp[tile][:, None, :] ^ fp[some][None, :, :]).sum(axis=2) <= most
        return out

    def take(pivots: np.ndarray, hits: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Link each row that is hit to the first pivot that hits it; they are no longer left."""
        hit = hits.any(axis=0)
        left.append(pivots[hits.argmax(axis=0)[hit]])
        right.append(rest[hit])
        alive[rest[hit]] = False
        return rest[hit]

    while len(rest := np.flatnonzero(alive)):
        tile = rest[:TILE]
        hits = near(tile, rest)  # the tile's own rows come first in it
        hits[np.arange(len(tile)), np.arange(len(tile))] = False
        some = hits.any(axis=1)
        alive[tile[~some]] = False
        if not some.any():
            continue
        first = int(some.argmax())
        alive[tile[first]] = False
        queue = take(tile[first : first + 1], hits[first : first + 1], rest)
        while len(queue):
            pivots, queue = queue[:TILE], queue[TILE:]
            rest = np.flatnonzero(alive)
            if len(rest):
                queue = np.concatenate([queue, take(pivots, near(pivots, rest), rest)])
    return np.concatenate(left), np.concatenate(right)


def by_cells(rows: DataFrame, sizes: DataFrame, strip: int, *columns: str) -> DataFrame:
    """rows(key, ...) of cells of sizes(key, n), cell by cell, in order of the first column: (key, lo, hi, columns...). Large cells are dealt by pairs of strips."""
    large = cut(sizes.filter(F.col("n") > strip).select("key", F.least(F.ceil(F.col("n") / strip), F.lit(STRIPS)).cast("int").alias("strips")))
    rows = rows.join(large, "key", "left") if large.count() else rows.withColumn("strips", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("strips")).cast("int")
    partners = F.when(F.col("strips").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("strips") - 1))
    paired = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(partners)).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns)
    return paired.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", columns[0])


def each_cell(ordered: DataFrame, compare: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v): the ids of the index pairs that ``compare`` gives for the columns of a cell; ``ordered`` comes from by_cells, with id second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None

        def emit() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            ids = columns[1]
            left, right = compare(*columns) if len(ids) > 1 else (np.zeros(0, int), np.zeros(0, int))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.column_stack([batch.column(k).to_numpy() for k in range(3)]).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
            columns = [_matrix(c) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns[3:]]
            for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
                this = tuple(cell[a])
                if held and this != now:
                    yield emit()
                now = this
                held.append([c[a:b] for c in columns])
        if held:
            yield emit()

    pairs = map_arrow(ordered, run, "u long, v long").filter("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(unique: DataFrame, width: int, tables: int, most: int, strip: int = STRIP) -> DataFrame:
    """unique(id, fp) -> (u, v): ids that hang together, cell by cell."""
    dealt = cells(unique, width, tables)  # twice, as that costs less than to store it
    ordered = by_cells(dealt, dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")), strip, "pop", "id", "fp")
    return each_cell(ordered, lambda pops, ids, fp: cell_links(fp, most))


def prefix(hashes: np.ndarray, hot: np.ndarray, share: Fraction) -> np.ndarray:
    """The first hashes, of which two sets alike to the share have one in common: those that aren't hot, ascending, then the hot ones."""
    n = len(hashes) - -(-share.numerator * len(hashes) // share.denominator) + 1
    late = np.isin(hashes, hot) if len(hot) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~late], hashes[late]])[:n]


def prefixes(docs: DataFrame, text_col: str, hot: np.ndarray, share: Fraction, shingle: int) -> DataFrame:
    """(key, id): every hash of the prefix of every row's set."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (texts,) in slices(batch, batch.schema.names):
                sets = [shingles(t, shingle) for t in texts.to_pylist()]
                first = [prefix(s, known.value, share) for s in sets]
                ids = np.repeat(np.array([identity(s) for s in sets], np.int64), [len(f) for f in first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return map_arrow(docs.select(F.col(text_col).alias("_near_text")), run, "key long, id long")


def prefix_cells(docs: DataFrame, text_col: str, share: Fraction, shingle: int) -> DataFrame:
    """(key, id) of the prefixes, without keys that only one row has. The order may be any, if it is one: passes only make it a better one."""
    hot = np.zeros(0, np.uint64)
    for left in reversed(range(PASSES)):
        rows = prefixes(docs, text_col, hot, share, shingle)
        common = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        found = np.array([r.key for r in common.filter(F.col("n") > HOT).select("key").collect()], np.int64).view(np.uint64)
        more = np.union1d(hot, found)
        if not left or len(more) == len(hot):
            break
        hot = more
    return cut(rows.join(common, "key", "left_semi").distinct())


def cell_candidates(sizes: np.ndarray, parities: np.ndarray, roots: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different roots in one cell that sizes and parities don't rule out. Rows stand by size."""
    _, label, counts = np.unique(roots, return_inverse=True, return_counts=True)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(counts) > 1:
        p, q = share.numerator, share.denominator
        sizes, pivots = sizes.astype(np.int64), np.flatnonzero(label != counts.argmax())
        for i in range(0, len(pivots), TILE):
            tile = pivots[i : i + TILE]
            a, b = np.searchsorted(sizes, (-(-p * int(sizes[tile[0]]) // q), q * int(sizes[tile[-1]]) // p + 1))
            for k in range(a, b, OTHERS):
                some = np.arange(k, min(b, k + OTHERS))
                both = sizes[tile][:, None] + sizes[some][None, :]
                fit = label[tile][:, None] != label[some][None, :]
                fit &= q * np.minimum(sizes[tile][:, None], sizes[some][None, :]) >= p * np.maximum(sizes[tile][:, None], sizes[some][None, :])
                x, y = np.nonzero(fit)
                apart = np.bitwise_count(parities[tile[x]] ^ parities[some[y]]).sum(axis=1, dtype=np.int64)
                close = (p + q) * apart <= (q - p) * both[x, y]
                left.append(tile[x[close]])
                right.append(some[y[close]])
    return np.concatenate(left), np.concatenate(right)


def candidates(index: DataFrame, unique: DataFrame, roots: DataFrame, share: Fraction, strip: int, step: int | None) -> DataFrame | None:
    """(u, v), or None: pairs of the cells that may be alike and are of different classes; at a ``step``, of large cells and with one pivot each."""
    mixed = index.join(roots, "id").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n"))
    mixed = cut(mixed.filter(F.col("a") < F.col("b")).filter(F.col("n") > (1 if step is None else STAR)).select("key", "n"))
    if not mixed.count():
        return None
    rows = index.join(mixed, "key", "left_semi").join(unique.select("id", "size", "parity"), "id").join(roots, "id")
    salt = np.int64(2 * (step or 0) + 1)

    def compare(sizes: np.ndarray, ids: np.ndarray, parities: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if step is None:
            return cell_candidates(sizes, parities, root, share)
        drawn = np.argsort(ids * salt)  # the same pivot in most cells of a group, another one at each step
        _, label, counts = np.unique(root, return_inverse=True, return_counts=True)
        pivot = drawn[label[drawn] == counts.argmax()][0]
        at = np.sort(np.r_[pivot, np.flatnonzero(label != label[pivot])])
        left, right = cell_candidates(sizes[at], parities[at], at == pivot, share)
        return at[left], at[right]

    return each_cell(by_cells(rows, mixed, strip, "size", "id", "parity", "root"), compare)


def possible(pairs: DataFrame, unique: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (u, v) that sizes and the parities by size don't rule out: all that are alike to the share, few others."""
    p, q = share.numerator, share.denominator
    u, v = (unique.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            apart = np.zeros(len(x), np.int64)
            for i, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                words = min(len(a), len(b)) // 8
                apart[i] = np.bitwise_count(fold(np.frombuffer(a, np.uint64), words) ^ fold(np.frombuffer(b, np.uint64), words)).sum(dtype=np.int64)
            fit = (q * np.minimum(x, y) >= p * np.maximum(x, y)) & ((p + q) * apart <= (q - p) * (x + y))
            yield batch.select([0, 1]).filter(pa.array(fit))

    return map_arrow(pairs.join(u, "u").join(v, "v").select("u", "v", "size_u", "size_v", "wide_u", "wide_v"), run, "u long, v long")


def alike(pairs: DataFrame, docs: DataFrame, text_col: str, unique: DataFrame, share: Fraction, shingle: int) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are alike to the share, by the sets themselves."""
    dealt = cut(possible(pairs, unique, share)).withColumn("part", F.pmod(F.xxhash64("u", "v"), F.lit(PARTS)))
    wanted = cut(dealt.select(F.col("u").alias("id"), "part").union(dealt.select("v", "part")).distinct())
    places = cut(unique.join(wanted.select("id").distinct(), "id", "left_semi").select("place.*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (texts,) in slices(batch, batch.schema.names):
                sets = [shingles(t, shingle) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "hashes"])

    texts = at_places(docs.select(F.col(text_col).alias("_near_text"), *PLACE), places, inside=True).select("_near_text")
    held = wanted.join(cut(map_arrow(texts, run, "id long, hashes array<long>")), "id")
    both = dealt.join(held.select(F.col("id").alias("u"), "part", F.col("hashes").alias("a")), ["u", "part"]).join(held.select(F.col("id").alias("v"), "part", F.col("hashes").alias("b")), ["v", "part"])
    counted = both.select("u", "v", (F.size("a") + F.size("b")).cast("long").alias("n"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))
    return cut(counted.filter(F.col("common") * share.denominator >= (F.col("n") - F.col("common")) * share.numerator).select("u", "v"))


def near_classes(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, strip: int = STRIP) -> tuple[DataFrame, DataFrame]:
    """(keep..., fp) of every row of docs, and (fp, root) of every distinct set of shingles: equal roots hang together by links of the similarity or more.

    ``recall`` is what SimHash is to find by itself; the result doesn't depend on it.
    Null, empty and wordless texts have one set, which is linked to none; texts of fewer words
    than a shingle have one shingle. An empty table gives empty results.
    """
    share = Fraction(str(similarity))
    docs = docs if set(PLACE) <= set(docs.columns) else located(docs)
    prints = cut(fingerprints(docs, list(dict.fromkeys([*keep, *PLACE])), text_col, shingle))
    unique = cut(prints.groupBy(F.col("fp").alias("id")).agg(F.min(F.struct(*PLACE)).alias("place"), *(F.first(c).alias(c) for c in ("size", "bits", "parity", "wide"))))
    width = key_bits(unique.count())
    found = links(unique.select("id", F.col("bits").alias("fp")), width, table_count(width, similarity, recall), radius(similarity), strip)
    edges = alike(found, docs, text_col, unique, share, shingle)

    def classes() -> DataFrame:
        nodes = connected_components(edges).withColumnRenamed("node", "id")
        return cut(unique.select("id").join(nodes, "id", "left").select("id", F.coalesce("root", "id").alias("root")))

    roots, index = classes(), prefix_cells(docs, text_col, share, shingle)
    for step in [*range(STARS), None]:
        if step and not more:  # the pivots before brought nothing together
            continue
        some = candidates(index, unique, roots, share, strip, step)
        joined = alike(some, docs, text_col, unique, share, shingle) if some else None
        more = joined.count() if joined else 0
        if more:
            edges = cut(edges.union(joined))
            roots = classes()
    return prints.select(*(F.col(f"`{c}`") for c in keep), "fp"), roots.withColumnRenamed("id", "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row of each class: that of the smallest identifier (null last), then of the first place.

    Rows repeated in full are one class. Columns of any name pass through; an empty table
    gives an empty result. Texts are not shuffled, however many rows go.
    """
    rows = located(docs)  # once: each call may write a copy with places of its own
    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *PLACE)
    prints, classes = near_classes(own, ["id", *PLACE], **options)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", *PLACE)
    least = cut(prints.groupBy("fp").agg(F.min(order).alias("best")).join(classes, "fp").groupBy("root").agg(F.min("best").alias("best")))
    stays = cut(classes.join(least, "root").select("fp", F.col("best._quillon_key").alias("k"), F.col("best._quillon_row").alias("r")))
    gone = cut(prints.join(stays, "fp").filter("NOT (k = _quillon_key AND r = _quillon_row)").select(*PLACE))
    return at_places(rows, gone, inside=False).select(*(F.col(f"`{c}`") for c in docs.columns))
