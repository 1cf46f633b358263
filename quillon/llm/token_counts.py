"""Edit-aware token counts with segment trees that are kept.

A document is cut at white space into segments, runs of pre-tokens. No token reaches
across white space, so the segments' counts add up to the document's. Each document
has a binary tree of sums over its segments: characters (to find where an edit
falls) and tokens. A store keeps the trees, a folder for each version: the first holds
all documents, each batch of edits adds the trees that it changed. An edit re-encodes the
segments it touches, and the one before them if the edit took the white space that
kept it apart; then only the sums above these segments change.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _SPACE, coder, default_vocabulary
from .common import BROADCAST_ROWS, PLACE, cut, delete, kept_columns, located, map_arrow, rows_of_file, scratch, slices, table, write_by_file

#: Characters after which a segment ends at the next white space.
SEGMENT = 192
#: A segment that edits have grown beyond this is cut anew, with the whole tree.
LARGEST = 8 * SEGMENT
EDITS = "array<struct<at:int,remove:int,insert:string>>"
#: A kept tree: the text of all segments, and the sums of characters and tokens as heaps (the root at place 1, the segments in the last half).
TREE = ["text", "chars", "tokens"]
_KINDS = {"text": pa.string(), "chars": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32())}


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in pieces; each but the first begins with white space."""
    out, at = [], 0
    while True:
        m = _SPACE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text) or not out:
        out.append(text[at:])
    return out


class SegmentTree:
    """Sums of characters and tokens over a document's segments, as two heaps of equal shape."""

    def __init__(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length() if len(leaves) > 1 else 1
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = counts
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int]) -> SegmentTree:
        """A tree as the store has it; nothing is counted."""
        tree = cls.__new__(cls)
        tree.chars, tree.tokens, tree.size = chars, tokens, len(chars) // 2
        ends = list(accumulate(chars[tree.size :]))
        ends = ends[: max(1, bisect_left(ends, len(text)) + 1)]  # empty segments at the end are none
        tree.leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds a character (the last one for the end), and the place in it."""
        at = min(at, self.length)
        if at == self.length:
            last = len(self.leaves) - 1
            return last, at - (self.length - len(self.leaves[last]))
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def put(self, leaf: int, text: str, count: int) -> None:
        """Change one segment and the sums above it."""
        self.leaves[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), count
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def build(texts: list[str], bpe) -> list[SegmentTree]:
    """Trees of several texts; their segments are encoded together."""
    cut = [segments(t) for t in texts]
    _, at = bpe.encode([s for ss in cut for s in ss])
    counts, k, out = (at[1:] - at[:-1]).tolist(), 0, []
    for ss in cut:
        out.append(SegmentTree(ss, counts[k : k + len(ss)]))
        k += len(ss)
    return out


def touched(tree: SegmentTree, at: int, remove: int, insert: str) -> tuple[int, int, str] | None:
    """First and last segment that an edit touches, boundary context included, and their text after it; None if it changes nothing.

    The edit replaces ``remove`` characters from ``at`` on by ``insert``; places beyond the text count as its end.
    """
    at = max(0, min(at, tree.length))
    remove = max(0, min(remove, tree.length - at))
    if not remove and not insert:
        return None
    first, inside = tree.find(at)
    last = first if not remove else max(first, tree.find(at + remove - 1)[0])
    region = "".join(tree.leaves[first : last + 1])
    region = region[:inside] + insert + region[inside + remove :]
    # boundary context: without white space in front, the segment before runs on into this one
    while first > 0 and not (region and _SPACE.match(region)):
        first -= 1
        region = tree.leaves[first] + region
        if tree.leaves[first] and _SPACE.match(tree.leaves[first]):
            break
    return first, last, region


def replaced(tree: SegmentTree, first: int, last: int, pieces: list[str], counts: list[int]) -> SegmentTree:
    """The tree with the touched segments replaced: their text in the first of them, or, if it was cut anew, a new tree."""
    if len(pieces) == 1:
        tree.put(first, pieces[0], counts[0])
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, "", 0)
        return tree
    own = tree.tokens[tree.size : tree.size + len(tree.leaves)]
    return SegmentTree(tree.leaves[:first] + pieces + tree.leaves[last + 1 :], own[:first] + counts + own[last + 1 :])


def edit_together(trees: list[SegmentTree], edits: list[tuple[int, int, str] | None], bpe) -> list[int]:
    """Apply one edit (at, remove, insert) to each tree that has one, in place; the touched regions of all are encoded
    in one call. How many characters each had encoded."""
    found = [None if e is None else touched(t, *e) for t, e in zip(trees, edits)]
    pieces = [[] if f is None else segments(f[2]) if len(f[2]) > LARGEST else [f[2]] for f in found]
    _, ends = bpe.encode([p for ps in pieces for p in ps])
    counts, k = (ends[1:] - ends[:-1]).tolist(), 0
    for i, (f, ps) in enumerate(zip(found, pieces)):
        if f is not None:
            trees[i] = replaced(trees[i], f[0], f[1], ps, counts[k : k + len(ps)])
            k += len(ps)
    return [0 if f is None else len(f[2]) for f in found]


def edit(tree: SegmentTree, at: int, remove: int, insert: str, bpe) -> tuple[SegmentTree, int]:
    """One edit of one tree: the tree and how many characters were encoded."""
    trees = [tree]
    return (n := edit_together(trees, [(at, remove, insert)], bpe)) and (trees[0], n[0])


def _of_trees(trees: list[SegmentTree]) -> list[pa.Array]:
    return [pa.array([getattr(t, c) for t in trees], k) for c, k in _KINDS.items()]


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, text, chars, tokens) per row of docs: whole texts, counted once.

    Null texts count as empty. Rows that repeat have a tree each. Other columns are
    not read; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for keys, texts in slices(batch, ["id", "text"], 4 << 20):
                yield pa.RecordBatch.from_arrays([keys, *_of_trees(build([t or "" for t in texts.to_pylist()], bpe))], names=["id", *TREE])
        bpe.reset()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "id long, text string, chars array<int>, tokens array<int>").withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, edits_col: str = "edits", keep: list[str] | None = None, vocabulary: str | None = None, by_file: tuple[str, int] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id), n_before, n_after, n_chars_encoded (long), and the tree after the edits.

    ``edits_col`` is an array of struct(at, remove, insert), applied in order; null
    or empty: no edit. Null parts of an edit count as 0 or empty. n_chars_encoded
    counts the characters that the edits had encoded anew; nothing else is. An empty
    table gives an empty result; of ``keep``, columns named like a result are left out.
    With ``by_file`` (see ``write_by_file``: PLACE and edits), the rows have PLACE instead of the
    column, each task looks up the edits of its own files, and rows without any go.
    """
    path = vocabulary or default_vocabulary()
    counts = ["n_before", "n_after", "n_chars_encoded"]
    keep = kept_columns(keep or ["doc_id"], [*counts, *TREE])
    own = [F.col(f"`{c}`") for c in keep]
    told = F.struct(*PLACE) if by_file else F.col(f"`{edits_col}`").cast(EDITS)
    rows = trees.select(*own, told.alias("_quillon_edits"), *TREE)
    schema = trees.select(*own, *(F.lit(0).cast("long").alias(c) for c in counts), *TREE).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches if by_file is None else _with_own_edits(batches, *by_file):
            for columns in slices(batch, batch.schema.names, 4 << 20):
                *kept, edits, texts, chars, tokens = columns
                some = [SegmentTree.kept(*t) for t in zip(texts.to_pylist(), chars.to_pylist(), tokens.to_pylist())]
                before, encoded = [t.total for t in some], [0] * len(some)
                wanted = [w or [] for w in edits.to_pylist()]
                # edits of a text come one after another; the n-th of all texts are taken together
                for number in range(max(map(len, wanted), default=0)):
                    now = [(e["at"] or 0, e["remove"] or 0, e["insert"] or "") if number < len(w) and (e := w[number]) is not None else None for w in wanted]
                    for k, n in enumerate(edit_together(some, now, bpe)):
                        encoded[k] += n
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in (before, [t.total for t in some], encoded)), *_of_trees(some)], names=schema.names)
        bpe.reset()

    return map_arrow(rows, run, schema)


def _with_own_edits(batches: Iterator[pa.RecordBatch], folder: str, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows that have edits in the folder, with these in the place of the rows' PLACE."""
    known: dict[int, dict] = {}
    for batch in batches:
        at = batch.schema.get_field_index("_quillon_edits")
        key, row = (c.to_pylist() for c in batch.column(at).flatten())
        for k in set(key) - known.keys():
            there = rows_of_file(folder, parts, k, [PLACE[1], "edits"])
            known[k] = dict(zip(*(c.to_pylist() for c in there.columns))) if there is not None else {}
        known = {k: known[k] for k in set(key)}  # of files that lie behind nothing is kept
        found = [known[k].get(r) for k, r in zip(key, row)]
        some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
        columns = [pa.array([f for f in found if f]) if i == at else c.take(some) for i, c in enumerate(batch.columns)]
        if len(some):
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


# -- the store: a folder of versions


def write_version(trees: DataFrame, folder: str, version: int) -> None:
    """One version; written again, it replaces what an attempt before has left."""
    trees.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/version={version}")


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")


def latest_trees(spark: SparkSession, folder: str, versions: int, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, the columns ``keep``, text, chars, tokens): of each identifier the rows of its last version of those before ``versions``.

    PLACE can be one of ``keep``.
    """
    out, later = None, None
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    for version in reversed(range(versions)):
        rows = located(read_version(spark, folder, version)).select(id_col, *(keep or []), *TREE)
        own = rows.select(id_col)
        if later is not None:
            rows = rows.join(few(cut(later.distinct())), id_col, "left_anti")
        out = rows if out is None else out.unionByName(rows)
        later = own if later is None else later.unionByName(own)
    return out


#: The column in which a store that keeps a history counts, by version, the characters that its batches had encoded.
HISTORY = "encoded"


def edit_batch(spark: SparkSession, folder: str, versions: int, edits: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Apply a table of edits (id, seq, at, remove, insert) to the store as its version number ``versions``; (id, n_before, n_after, n_chars_encoded) of the documents it changed.

    Only trees of documents with edits are read and written; of the others the
    identifiers. Edits of identifiers that the store doesn't have, and of null ones, change
    nothing. Columns ``keep`` of the store's versions are carried on, and if HISTORY is one of
    them, this batch's count is added to it.
    """
    keep = keep or []
    trees = latest_trees(spark, folder, versions, id_col, keep=[*keep, *PLACE])
    grouped = edits.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("_e"))
    steps = F.transform("_e", lambda e: F.struct(e["at"].alias("at"), e["remove"].alias("remove"), e["insert"].alias("insert"))).cast(EDITS)
    # identifiers and places are joined to the edits; trees stay where they are, and tasks look up the edits of their files
    found = cut(trees.select(id_col, *PLACE).join(grouped.select(id_col, steps.alias("edits")), id_col).select(*PLACE, "edits"))
    n = found.count()
    by_file = write_by_file(found, n)
    touched = trees.join(F.broadcast(found.select(*PLACE)), PLACE, "left_semi") if n <= BROADCAST_ROWS else trees
    done = edit_trees(touched, keep=[id_col, *keep], vocabulary=vocabulary, by_file=by_file)
    if HISTORY in keep:
        done = done.withColumn(HISTORY, F.map_concat(HISTORY, F.create_map(F.lit(versions), "n_chars_encoded")))
    write_version(done, folder, versions)
    delete(spark, by_file[0])
    return read_version(spark, folder, versions).select(id_col, "n_before", "n_after", "n_chars_encoded")


#: The query's batches: what each does, in order, to the documents it touches (characters to remove, what to insert).
BATCHES = (((12, "revised text"), (0, " an inserted passage, with punctuation."), (40, "")), ((0, " and again,"),))
#: A batch touches one document of so many, drawn by a hash of the identifier.
TOUCHED = 3


def scripted_edits(sizes: DataFrame, batch: int) -> DataFrame:
    """The query's edits (doc_id, seq, at, remove, insert) of a batch, at places drawn by hashes; sizes(doc_id, n): the documents and their characters."""
    drawn = lambda *seed: F.xxhash64(*map(F.lit, seed), "doc_id")
    chosen = sizes.filter(F.col("doc_id").isNotNull() & (F.pmod(drawn(batch), F.lit(TOUCHED)) == 0))
    place = lambda k: F.pmod(drawn(batch, k), F.col("n") + 1).cast("int")
    steps = [F.struct(F.lit(k).alias("seq"), place(k).alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert")) for k, (remove, insert) in enumerate(BATCHES[batch - 1])]
    return chosen.select("doc_id", F.explode(F.array(*steps)).alias("e")).select("doc_id", "e.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded, n_chars_encoded_again (long).

    The trees of all documents are built and kept as the store's first version; two
    batches of edits follow, each of which reads and writes the trees of the documents
    that it touches. n_tokens counts the text itself, the edited columns what the batches
    have made of it, and the last two the characters that each batch had encoded anew: 0 for
    documents left alone. Null texts count as empty; documents without an identifier are
    never edited, repeated ones alike; an empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    store, keep = scratch(spark, "token-trees"), ["n_tokens", HISTORY]
    size = F.get("chars", F.lit(1)).cast("long")
    built = build_trees(table(spark, sf_dir, "documents"))
    write_version(built.withColumns({"n_tokens": F.get("tokens", F.lit(1)).cast("long"), HISTORY: F.create_map().cast("map<int,bigint>")}), store, 0)
    for batch in range(1, len(BATCHES) + 1):
        sizes = latest_trees(spark, store, batch).groupBy("doc_id").agg(F.max(size).alias("n"))
        edit_batch(spark, store, batch, scripted_edits(sizes, batch), keep=keep)
    now = latest_trees(spark, store, len(BATCHES) + 1, keep=keep)
    again = [F.coalesce(F.try_element_at(HISTORY, F.lit(b)), F.lit(0)).alias(c) for b, c in enumerate(("n_chars_encoded", "n_chars_encoded_again"), 1)]
    return now.select("doc_id", "n_tokens", F.get("tokens", F.lit(1)).cast("long").alias("n_tokens_edited"), size.alias("n_chars_edited"), *again)
