"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs in no vocabulary token can never be inside a token, so a
cut between its two bytes is certain. Texts are cut there (white space is always
such a place, and so are many pairs within words), the fragments are encoded
independently of one another and their identifiers concatenated. Equal fragments
have equal identifiers, so each is encoded once and then looked up.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_arrow, slices, table

#: Characters that separate words: the property White_Space of Unicode.
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: str.split() also cuts at these four, which aren't white space to the tokenizer.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Cached fragments and their bytes, per Python worker; then the cache starts anew.
CACHE_ENTRIES = 120_000
CACHE_BYTES = 8 << 20
#: Bytes of the longest fragment that is merged in rounds with others of its length, as the cost of that grows with
#: the square of its length; longer ones are merged one by one with a queue. Both give the same identifiers.
LONG = 48
#: Bytes of text that ``encode_column`` encodes at once: identifiers and fragments of a slice, as Python's objects, take
#: many times its size.
SLICE_BYTES = 256 << 10


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or from 256 upward in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _unassigned() -> bytes:
    """Of each code point whether Python's Unicode tables don't know it. The library's may know some of these, and the regex package's may know others."""
    return bytes(unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1))


#: Below this every character is assigned.
_BEYOND = re.compile("[^\x00-\u0377]")


class _Store(dict):
    """text -> its number; new texts wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.bytes = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        self.bytes += len(key)
        return n


class _Ragged:
    """Growing lists of identifiers, by number."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.rows = 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        own = slice(self.rows, self.rows + len(lengths))
        self.lengths[own] = lengths
        self.starts[own] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.rows += len(lengths)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers in one array, and where each ends."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - lengths), lengths)
        return self.flat[where], ends


class _Merges:
    """Byte-pair merging of many fragments of equal length at a time.

    Every row merges its pair of lowest rank, leftmost first, one pair a round, so
    all rows that go on have the same number of symbols.
    """

    NONE = np.iinfo(np.int32).max
    BITS = 19

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 20 | vocab[b]
            h = int(self._hash(np.array([key]))[0])
            while self.keys[h] not in (-1, key):
                h = (h + 1) % len(self.keys)
            if self.keys[h] == -1:
                self.keys[h], self.ranks[h] = key, rank
        self.pairs: dict[int, tuple[int, int]] = {}

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20 | b).ravel()
        h = self._hash(keys)
        found = self.keys[h]
        out = np.where(found == keys, self.ranks[h], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            h[todo] = (h[todo] + 1) % len(self.keys)
            found = self.keys[h[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[h[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(a.shape)

    def queue(self, symbols: list[int]) -> list[int]:
        """Merge one long fragment: the pair of lowest rank, leftmost first, by a queue of pairs over a linked list."""
        if not self.pairs:
            self.pairs = {int(k): (int(r), int(self.result[r])) for k, r in zip(self.keys, self.ranks) if k >= 0}
        n, pairs = len(symbols), self.pairs
        own, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        todo = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(own, own[1:])) if (found := pairs.get(a << 20 | b))]
        heapq.heapify(todo)
        while todo:
            rank, i, a, b = heapq.heappop(todo)
            j = right[i]
            if own[i] != a or j >= n or own[j] != b:
                continue  # one of the two has gone into another symbol
            own[i], own[j], right[i] = pairs[a << 20 | b][1], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (found := pairs.get(own[x] << 20 | own[y])):
                    heapq.heappush(todo, (found[0], x, own[x], own[y]))
        return [s for s in own if s >= 0]

    def run(self, rows: np.ndarray, at: np.ndarray, out: np.ndarray, valid: np.ndarray) -> None:
        """rows: one fragment each; its identifiers go to out from place at on."""
        ranks = self.rank(rows[:, :-1], rows[:, 1:])
        while len(rows):
            n, size = rows.shape
            if size == 1:
                done = np.ones(n, bool)
            else:
                j = ranks.argmin(1)
                best = ranks[np.arange(n), j]
                done = best == self.NONE
            if done.any():
                where = at[done][:, None] + np.arange(size)
                out[where], valid[where] = rows[done], True
                if done.all():
                    return
                rows, ranks, at, j, best = (x[~done] for x in (rows, ranks, at, j, best))
            each, column = np.arange(len(rows)), np.arange(size - 1)[None, :]
            rows = np.take_along_axis(rows, column + (column > j[:, None]), 1)
            rows[each, j] = self.result[best]
            if size > 2:
                column = column[:, :-1]
                ranks = np.take_along_axis(ranks, column + (column > j[:, None]), 1)
                left, right = np.flatnonzero(j > 0), np.flatnonzero(j < size - 2)
                ranks[left, j[left] - 1] = self.rank(rows[left, j[left] - 1], rows[left, j[left]])
                ranks[right, j[right]] = self.rank(rows[right, j[right]], rows[right, j[right] + 1])


class ForcedBoundaryBpe:
    """Encoder and decoder for a tokenizer file with word-end BPE over byte symbols."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} is not a lower-casing BPE with word ends")
        self.suffix = model["end_of_word_suffix"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = _byte_symbols()
        to_byte = {c: b for b, c in enumerate(self.symbols)}
        size = max(max(model["vocab"].values()), *self.special.values(), 0) + 1
        self.pieces = [""] * size
        self.together = np.zeros((256, 256), bool)
        for token, i in model["vocab"].items():
            self.pieces[i] = token
            inner = [to_byte[c] for c in token.removesuffix(self.suffix)]
            if len(inner) > 1:
                self.together[inner[:-1], inner[1:]] = True
        for token, i in self.special.items():
            self.pieces[i] = token
        self.path, self._library = path, None
        self.unassigned = _unassigned()
        self.symbol = np.array([model["vocab"][c] for c in self.symbols], np.int64)
        self.final = np.array([model["vocab"][c + self.suffix] for c in self.symbols], np.int64)
        self.merges = _Merges(model["vocab"], model["merges"])
        self.reset()

    def reset(self) -> None:
        self.chunk_numbers, self.chunk_ids = _Store(), _Ragged()
        self.word_numbers, self.word_ids = _Store(), _Ragged()

    # -- encoding

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # character by character where the context of a sigma would matter
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        text = self.normalise(text)
        if any(c in text for c in _SEPARATORS):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def _by_library(self, text: str) -> np.ndarray:
        """Identifiers of a text with characters that only the library can tell letters, numbers and others of."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of non-empty pre-tokens, cut into fragments where no token can reach across."""
        data, lengths = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        n, ends = len(data), np.cumsum(lengths)
        begins = np.zeros(n + 1, bool)
        begins[1:n] = ~self.together[data[:-1], data[1:]]
        begins[ends] = begins[0] = True
        start = np.flatnonzero(begins[:n])
        size = np.diff(np.r_[start, n])
        symbols = self.symbol[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        out, valid = np.zeros(n, np.int64), np.zeros(n, bool)
        for length in np.unique(size):
            at = start[size == length]
            if length <= LONG:
                self.merges.run(symbols[at[:, None] + np.arange(length)], at, out, valid)
            else:
                for a in at.tolist():
                    ids = self.merges.queue(symbols[a : a + length].tolist())
                    out[a : a + len(ids)], valid[a : a + len(ids)] = ids, True
        return out[valid].astype(np.uint32), np.add.reduceat(valid, ends - lengths, dtype=np.int64)

    def _take_in_new(self) -> None:
        new, self.chunk_numbers.new = self.chunk_numbers.new, []
        split = [[c] if c.isascii() and c.isalpha() else self.words.findall(c) for c in new]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.word_numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.word_numbers.new:
            fresh, self.word_numbers.new = self.word_numbers.new, []
            self.word_ids.append(*self.encode_words([w.encode() for w in fresh]))
        flat, ends = self.word_ids.gather(codes)
        self.chunk_ids.append(flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]]))

    def _ids(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.fromiter(map(self.chunk_numbers.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if self.chunk_numbers.new:
            self._take_in_new()
        flat, ends = self.chunk_ids.gather(codes)
        return flat, np.r_[0, ends][np.r_[0, np.cumsum(counts)]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts in one uint32 array, and where each text's begin (one more than texts)."""
        if len(self.chunk_numbers) > CACHE_ENTRIES or self.chunk_numbers.bytes + 4 * self.chunk_ids.used > CACHE_BYTES:
            self.reset()
        odd = [i for i, t in enumerate(texts) if t and not t.isascii() and _BEYOND.search(t) and any(map(self.unassigned.__getitem__, map(ord, set(t))))]
        if odd:
            flat, at = self.encode([None if i in set(odd) else t for i, t in enumerate(texts)])
            parts = np.split(flat, at[1:-1])
            for i in odd:
                parts[i] = self._by_library(texts[i])
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        special = self.special_at
        if special is None or not any(t and "<|" in t and special.search(t) for t in texts):
            return self._ids([self.chunks(t) if t else [] for t in texts])
        parts = [special.split(t) if t else [""] for t in texts]  # odd places hold special tokens
        flat, at = self._ids([self.chunks(p) if k % 2 == 0 else [] for ps in parts for k, p in enumerate(ps)])
        out, lengths, n = [], [], 0
        for ps in parts:
            had = len(out)
            for k, p in enumerate(ps):
                out.append(flat[at[n] : at[n + 1]] if k % 2 == 0 else np.array([self.special[p]], np.uint32))
                n += 1
            lengths.append(sum(map(len, out[had:])))
        return np.concatenate(out) if out else flat, np.r_[0, np.cumsum(lengths)].astype(np.int64)

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The tokens' text, special ones too, joined as the library joins them without a decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))


_coders: dict[str, ForcedBoundaryBpe] = {}


def coder(path: str) -> ForcedBoundaryBpe:
    """One coder per file and Python process, with what it has learned so far."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryBpe(path)
    return _coders[path]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit[, decoded string]) per row of docs.

    Whole texts; null counts as empty and gives no tokens and empty text. Special
    tokens' strings in a text become those tokens, as the library does by default.
    ``ids_array`` turns the binary into an array. Other columns are not read; an
    empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for keys, texts in slices(batch, ["id", "text"], SLICE_BYTES):
                ids, at = bpe.encode(texts.to_pylist())
                blobs = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at * 4)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                out = [keys, pa.array(np.diff(at)), blobs.cast(pa.binary())]
                if decode:
                    every = ids.tolist()
                    out.append(pa.array([bpe.decode(every[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids", "decoded"][: len(out)])
            give_back()
        bpe.reset()  # the worker process may serve other stages next

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, run, "id long, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def decode_column(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, decoded string) from binary identifiers; null gives null."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for keys, blobs in slices(batch, ["id", "ids"], 4 << 20):
                texts = [None if b is None else bpe.decode(np.frombuffer(b, "<u4").tolist()) for b in blobs.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, run, "id long, decoded string").withColumnRenamed("id", id_col)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, n_tokens long, ids_sha256, decoded_sha256 string.

    Null and empty texts have no tokens and decode to an empty text; repeated rows are
    encoded each; an empty table gives an empty result; other columns are not read.
    """
    coded = encode_column(table(spark, sf_dir, "documents"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
