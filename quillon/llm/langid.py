"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows of WINDOW bytes, labels every byte
with posteriors of the learned languages, and the document's probabilities are
the mean over all its bytes. It is trained in numpy by backpropagation through
time on a bounded, hash-chosen sample of labelled rows, and applied to whole
texts in Arrow batches, many windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept_columns, map_arrow, slices, table

WINDOW = 128
HIDDEN = 8
#: Labelled rows used for training: at most one for each language and hash bucket.
SAMPLE_BUCKETS = 192
#: Windows taken from a sampled text for training, one from each of as many equal parts of the whole text.
WINDOWS_PER_TEXT = 4
EPOCHS = 14
#: Windows of a training step at most; a sixteenth of all where that is less, so that small samples get steps enough.
BATCH = 256
UNKNOWN = "und"
#: Windows run through the network together.
STRIP = 2048
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Weights of both directions (first axis: forward, backward), features before windows."""

    languages: list[str]
    inputs: np.ndarray  # 2, 3H, 256: what each byte adds to the gates, biases included
    recurrent: np.ndarray  # 2, 3H, H
    candidate_bias: np.ndarray  # 2, H, 1
    output: np.ndarray  # K, 2H
    output_bias: np.ndarray  # K, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def windows_of(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as rows of one window each, the last one filled up with zeros; and how many bytes of the text each row has."""
    n = -(-len(raw) // window)
    own = np.full(n, window, np.int64)
    own[n - 1 :] -= n * window - len(raw)
    return np.frombuffer(raw.ljust(n * window, b"\0"), np.uint8).reshape(n, window), own


def _forward(m: Model, x: np.ndarray, keep: bool = False):
    """x: T, B bytes -> states T, 2, H, B (backward ones at the byte they follow), and what training needs."""
    t, b = x.shape
    h = m.recurrent.shape[2]
    states = np.empty((t, 2, h, b), np.float32)
    tape = []
    state = np.zeros((2, h, b), np.float32)
    gates = np.empty((2, 3 * h, b), np.float32)
    for i in range(t):
        np.take(m.inputs[0], x[i], axis=1, out=gates[0], mode="clip")
        np.take(m.inputs[1], x[t - 1 - i], axis=1, out=gates[1], mode="clip")
        inner = np.matmul(m.recurrent, state)
        zr = gates[:, : 2 * h]
        zr += inner[:, : 2 * h]
        _sigmoid(zr)
        part = inner[:, 2 * h :] + m.candidate_bias
        c = gates[:, 2 * h :]
        c += zr[:, h:] * part
        np.tanh(c, out=c)
        new = c + zr[:, :h] * (state - c)
        if keep:
            tape.append((state, zr[:, :h].copy(), zr[:, h:].copy(), part, c.copy()))
        states[i, 0] = new[0]
        states[t - 1 - i, 1] = new[1]
        state = new
    return states, tape


def _posteriors(m: Model, states: np.ndarray) -> np.ndarray:
    """T, K, B: the posterior of each language at every byte."""
    t, _, h, b = states.shape
    logits = np.matmul(m.output, states.reshape(t, 2 * h, b))
    logits += m.output_bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def label_bytes(m: Model, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """windows: N, T bytes, of which the first ``sizes`` count -> N, K: sums over these bytes of the posteriors."""
    out = np.empty((len(windows), len(m.languages)), np.float32)
    for i in range(0, len(windows), STRIP):
        x = np.ascontiguousarray(windows[i : i + STRIP].T)
        p = _posteriors(m, _forward(m, x)[0])
        p *= (np.arange(len(x))[:, None] < sizes[None, i : i + STRIP])[:, None, :]
        out[i : i + STRIP] = p.sum(axis=0).T
    return out


def loss_and_gradient(m: Model, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of the labels at every byte of x (T, B bytes), and its gradient by backpropagation through time."""
    (t, b), h, k = x.shape, m.recurrent.shape[2], len(m.languages)
    states, tape = _forward(m, x, keep=True)
    delta = _posteriors(m, states)
    mask = (np.arange(t)[:, None] < sizes[None, :]).astype(np.float32) * weight
    mask /= max(1e-9, float(mask.sum()))
    loss = -float((np.log(np.maximum(delta[:, y, np.arange(b)], 1e-30)) * mask).sum())
    delta[:, y, np.arange(b)] -= 1
    delta *= mask[:, None, :]
    flat = states.reshape(t, 2 * h, b)
    g = {
        "output": np.einsum("tkb,thb->kh", delta, flat, optimize=True),
        "output_bias": delta.sum(axis=(0, 2))[:, None],
        "recurrent": np.zeros_like(m.recurrent),
        "candidate_bias": np.zeros_like(m.candidate_bias),
        "inputs": np.zeros_like(m.inputs),
    }
    back = np.matmul(m.output.T, delta).reshape(t, 2, h, b)
    carry = np.zeros((2, h, b), np.float32)
    gates = np.empty((t, 2, 3 * h, b), np.float32)
    for i in range(t - 1, -1, -1):
        state, z, r, part, c = tape[i]
        carry[0] += back[i, 0]
        carry[1] += back[t - 1 - i, 1]
        dc = carry * (1 - z) * (1 - c * c)
        dz = carry * (state - c) * z * (1 - z)
        dr = dc * part * r * (1 - r)
        dpart = dc * r
        gates[i, :, :h], gates[i, :, h : 2 * h], gates[i, :, 2 * h :] = dz, dr, dc
        inner = np.concatenate([dz, dr, dpart], axis=1)
        g["recurrent"] += np.matmul(inner, state.transpose(0, 2, 1))
        g["candidate_bias"] += dpart.sum(axis=2, keepdims=True)
        carry = carry * z + np.matmul(m.recurrent.transpose(0, 2, 1), inner)
    for d, bytes_ in enumerate((x, x[::-1])):
        onehot = np.zeros((256, t * b), np.float32)
        onehot[bytes_.ravel(), np.arange(t * b)] = 1
        g["inputs"][d] = gates[:, d].transpose(1, 0, 2).reshape(3 * h, -1) @ onehot.T
    return loss, g


def train(texts: list[str | bytes], labels: list[str], seed: int = 7, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Model:
    """Fit the network to all windows of the texts and their languages by backpropagation through time and Adam."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k, h = len(languages), hidden
    cut_up = [windows_of(t.encode() if isinstance(t, str) else t) for t in texts]
    x = np.concatenate([w for w, _ in cut_up]) if cut_up else np.zeros((0, WINDOW), np.uint8)
    sizes = np.concatenate([n for _, n in cut_up]) if cut_up else np.zeros(0, np.int64)
    y = np.repeat([languages.index(l) for l in labels], [len(w) for w, _ in cut_up]).astype(int)
    f32 = np.float32
    p = {
        "inputs": rng.normal(0, 0.3, (2, 3 * h, 256)).astype(f32),
        "recurrent": rng.normal(0, 0.5 / np.sqrt(h), (2, 3 * h, h)).astype(f32),
        "candidate_bias": np.zeros((2, h, 1), f32),
        "output": rng.normal(0, 0.3, (k, 2 * h)).astype(f32),
        "output_bias": np.zeros((k, 1), f32),
    }
    m = Model(languages, **p)
    if k < 2:
        return m
    first, second, step = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0
    share = np.bincount(y, minlength=k) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / k)[y].astype(f32)
    batch = min(BATCH, max(16, len(x) // 16))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, g = loss_and_gradient(m, np.ascontiguousarray(x[own].T), sizes[own], y[own], weight[own])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for n, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[n] += 0.1 * (v - first[n])
                second[n] += 0.001 * (v * v - second[n])
                w = getattr(m, n)
                w -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return m


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the identifier's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, buckets: int = SAMPLE_BUCKETS) -> list:
    """A bounded sample of labelled rows, (lang, doc_id, pieces): for each language and hash bucket the row of least hash.

    The ids are chosen by an aggregation that reads no text; then only pieces of the
    chosen rows' texts come to the driver, WINDOWS_PER_TEXT of WINDOW characters, one
    from each equal part of the whole text: at most ``buckets`` rows for each language.
    Of rows with one identifier and language the least pieces count.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    code = F.xxhash64("doc_id")
    chosen = cut(labelled.groupBy("lang", F.pmod(code, F.lit(buckets)).alias("bucket")).agg(F.min(F.struct(code.alias("h"), "doc_id")).alias("least")).select("lang", F.col("least.doc_id").alias("doc_id")))
    # bounded by languages x buckets
    text = F.coalesce("text", F.lit(""))
    part = F.greatest(F.lit(0), F.length(text) - WINDOW) / WINDOWS_PER_TEXT
    draw = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    pieces = F.array_distinct(F.array(*(F.substr(text, (part * (k + draw(k))).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS_PER_TEXT))))
    picked = labelled.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", pieces.alias("pieces"))
    return sorted(picked.groupBy("lang", "doc_id").agg(F.min("pieces").alias("pieces")).collect(), key=lambda r: (r.lang, r.doc_id))


def fit(docs: DataFrame) -> Model:
    """Train on documents(doc_id, text, lang); without labelled rows every prediction is ``und``."""
    # a window of inference may begin within a character: so does every second one of training
    pieces = [(p.encode()[k % 2 :][:WINDOW], r.lang) for r in training_rows(docs) for k, p in enumerate(r.pieces)]
    pieces = [(raw, lang) for raw, lang in pieces if raw]
    return train([raw for raw, _ in pieces], [lang for _, lang in pieces])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns ``keep`` (default: the id), then the language (string) and its score (double) under ``names``.

    Whole texts. Null, empty and letterless texts give ``und`` with score 0, and so
    do all texts if the model has learned no language; with one language it is
    predicted with score 1. Only the text is an input. Rows that repeat are predicted
    each; an empty table gives an empty result; of ``keep``, columns named like a
    result are left out.
    """
    keep = kept_columns(keep or [id_col], list(names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add(names[0], "string").add(names[1], "double")
    at = keep.index(text_col) if text_col in keep else len(keep)  # a kept text is sent once
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])))

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        m = shared.value
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not own or not m.languages:
            return langs, scores
        parts = [windows_of(texts[i].encode()) for i in own]
        counts = np.fromiter((len(w) for w, _ in parts), np.int64, len(parts))
        labelled = label_bytes(m, np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
        sums = np.add.reduceat(labelled, np.r_[0, np.cumsum(counts)[:-1]], axis=0)
        probs = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
        best = probs.argmax(axis=1)
        for i, b, p in zip(own, best.tolist(), probs.tolist()):
            langs[i], scores[i] = m.languages[b], min(1.0, p[b])
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in slices(batch, batch.schema.names, 4 << 20):
                langs, scores = judge(columns[at].to_pylist())
                yield pa.RecordBatch.from_arrays([*columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_arrow(rows, run, schema)


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """docs, all columns, without rows whose language is ``und`` or scored below min_score.

    With the default, null, empty and letterless texts go, and all texts if nothing is
    labelled; a text with letters always gets a learned language and stays. Rows that
    repeat are judged alike; columns of any name pass through; an empty table gives
    an empty result.
    """
    judged = predict(docs, fit(docs), keep=docs.columns, names=("_quillon_lang", "_quillon_score"))
    return judged.filter((F.col("_quillon_lang") != UNKNOWN) & (F.col("_quillon_score") >= min_score)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document: doc_id, held_out boolean, lang_pred string, score double.

    Null and letterless texts are ``und`` with score 0; a null identifier is not held
    out, and nothing is learned from it; repeated rows are predicted each; an empty
    table gives an empty result; columns other than doc_id, text and lang are not read.
    """
    docs = table(spark, sf_dir, "documents")
    judged = predict(docs, fit(docs))
    return judged.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
