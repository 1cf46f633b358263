"""Mixing sources to target weights with soft memberships.

A classifier fitted on a labelled table gives every document a posterior over
domains. Nonnegative document rates r then minimise

    sum_k (sum_d tokens_d p_dk r_d - target_k)^2 / (2 target_k) + RIDGE / 2 sum_d tokens_d (r_d - 1)^2

to convergence. At the minimum r_d = max(0, 1 - sum_k p_dk m_k / RIDGE), where the
multipliers m are the relative residuals: Newton steps with line search on the convex
dual of these K numbers find them, until the projected gradient of the rates (weighted
by tokens) is below TOLERANCE. A step needs one sum of K + K (K + 1) / 2 + 1 numbers
over all documents (a distributed aggregation), and a rate follows from the K
multipliers and the document's own posteriors, so nothing per document ever reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, kept_columns, map_arrow, slices, table

#: Labelled rows for training: at most one for each domain and hash bucket.
SAMPLE_BUCKETS = 512
#: Words of the classifier's vocabulary: of those in at least LEAST documents of the sample, the ones whose
#: documents are spread over the domains least as all documents are.
VOCABULARY, LEAST = 512, 3
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
#: Shapes of a text: symbols a word, share of words in capitals, share of words seen before, shortness.
SHAPES = 4
#: A longer training text counts by so many pieces of so many characters, spread evenly from its begin to its end.
PIECES, PIECE_CHARS = 8, 4096
#: Domains of the labelled table, and the share of all tokens each shall have.
TARGETS: dict[str, float] = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
#: Tokens of the mixture, as a multiple of the corpus.
BUDGET = 1.0
RIDGE = 1e-3
#: Largest projected gradient of a fit; a rate is within TOLERANCE / RIDGE of the minimum's.
TOLERANCE = 1e-8
#: Passes after which a fit that has not converged fails.
STEPS = 200


@dataclass
class Classifier:
    """Multinomial logistic regression over word frequencies of a bounded vocabulary and the text's shapes."""

    domains: list[str]
    words: dict[bytes, int]
    weights: np.ndarray  # words + SHAPES + 1, K; the last row is the bias
    scale: np.ndarray  # words


def _words(text: str | None) -> tuple[list[bytes], tuple[float, ...]]:
    """Lower-cased words without leading and trailing punctuation, and the text's shapes."""
    if not text:
        return [], (0.0,) * SHAPES
    raw = text.encode()
    own = raw.split()
    words = [w.strip(b".,;:!?\"'()[]|*#$%&") for w in raw.lower().split()]
    n = max(1, len(words))
    return words, (min(3.0, sum(map(raw.count, SYMBOLS)) / n), sum(map(bytes.isupper, own)) / n, 1 - len(set(words)) / n, 1 / (1 + n / 20))


def _vector(codes: np.ndarray, shapes: tuple[float, ...], size: int, scale: np.ndarray) -> np.ndarray:
    """Log-damped word frequencies per 100 words, weighted by rarity, and the shapes."""
    n = len(codes)
    hit = codes[codes >= 0]
    counts = np.bincount(hit, minlength=size)[:size].astype(np.float32)
    return np.r_[np.log1p(counts * (100.0 / max(20, n))) * scale, np.asarray(shapes, np.float32)]


def train(texts: list[str], labels: list[str], steps: int = 1000, rate: float = 0.5, decay: float = 3e-4) -> Classifier:
    """Fit by gradient descent with momentum on class-weighted cross-entropy; deterministic."""
    domains = sorted(set(labels))
    split = [_words(t) for t in texts]
    n, k = len(texts), len(domains)
    y = np.array([domains.index(d) for d in labels], np.int64)
    share = np.bincount(y, minlength=k) / max(1, n)
    seen: dict[bytes, np.ndarray] = {}
    for (ws, _), d in zip(split, y):
        for w in set(ws):
            seen.setdefault(w, np.zeros(k))[d] += 1
    # how far a word's documents of a domain exceed their expected number, in its standard deviations
    told = {w: float(((c - c.sum() * share) / np.sqrt(c.sum() * share + 1)).max()) for w, c in seen.items() if c.sum() >= LEAST}
    chosen = sorted(told, key=lambda w: (-told[w], w))[:VOCABULARY]
    words = {w: i for i, w in enumerate(chosen)}
    v = len(words)
    scale = np.log((1 + n) / (1 + np.array([seen[w].sum() for w in chosen], np.float32))).astype(np.float32) if v else np.zeros(0, np.float32)
    weights = np.zeros((v + SHAPES + 1, k), np.float32)
    if k > 1:
        x = np.stack([np.r_[_vector(np.array([words.get(w, -1) for w in ws], np.int64), shapes, v, scale), 1].astype(np.float32) for ws, shapes in split])
        # training weights keep the sample's class shares, damped, so posteriors stay usable for rare domains
        weight = (share**-0.5)[y].astype(np.float32)
        weight /= weight.sum()
        onehot = np.eye(k, dtype=np.float32)[y]
        momentum = np.zeros_like(weights)
        for _ in range(steps):
            z = x @ weights
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            grad = x.T @ ((p - onehot) * weight[:, None]) + decay * np.r_[weights[:-1], np.zeros((1, k), np.float32)]
            momentum = 0.9 * momentum - rate * grad
            weights += momentum
    return Classifier(domains, words, weights, scale)


def posterior(model: Classifier, words: list[bytes], shapes: tuple[float, ...]) -> np.ndarray:
    size = len(model.words)
    codes = np.fromiter((model.words.get(w, -1) for w in words), np.int64, len(words))
    z = _vector(codes, shapes, size, model.scale) @ model.weights[:-1] + model.weights[-1]
    p = np.exp(z - z.max())
    return p / p.sum()


def domain_of(quality, toxic):
    """The labelled table's domains: toxic, else good or poor by quality; null labels give none."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "good").when((toxic == 0) & (quality == 0), "poor")


def training_rows(docs: DataFrame, labels: DataFrame, buckets: int = SAMPLE_BUCKETS) -> list:
    """A bounded, hash-chosen sample of labelled documents: (domain, doc_id, text), at most ``buckets`` per domain.

    Of rows with one identifier the least text counts; of long texts PIECES over the whole of it.
    """
    code = F.xxhash64("doc_id")
    named = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain IS NOT NULL")
    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    chosen = cut(
        named.join(own.select("doc_id"), "doc_id", "left_semi").groupBy("domain", F.pmod(code, F.lit(buckets)).alias("bucket")).agg(F.min(F.struct(code.alias("h"), "doc_id")).alias("least")).select("domain", F.col("least.doc_id").alias("doc_id"))
    )
    # bounded by domains x buckets
    text = F.coalesce("text", F.lit(""))
    beyond = (F.length(text) - PIECE_CHARS) / (PIECES - 1)
    pieces = F.concat_ws(" ", *(F.substr(text, (beyond * k).cast("int") + 1, F.lit(PIECE_CHARS)) for k in range(PIECES)))
    bounded = F.when(F.length(text) <= PIECES * PIECE_CHARS, text).otherwise(pieces)
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("domain", "doc_id").agg(F.min(bounded).alias("text"))
    return sorted(rows.collect(), key=lambda r: (r.domain, r.doc_id))


def score(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("tokens", "posterior")) -> DataFrame:
    """The columns ``keep``, then tokens (long: white-space words of the whole text) and posterior (array<double>) under ``names``.

    Null and empty texts have no tokens and the prior as posterior; rows that repeat are
    scored each; an empty table gives an empty result; of ``keep``, columns named like a
    result are left out.
    """
    keep = kept_columns(keep, list(names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`") for c in keep]
    at = keep.index(text_col) if text_col in keep else len(keep)  # a kept text is sent once
    schema = docs.select(*own).schema.add(names[0], "long").add(names[1], T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.domains)
        for batch in batches:
            for columns in slices(batch, batch.schema.names, 4 << 20):
                kept, split = columns[: len(keep)], [_words(t) for t in columns[at].to_pylist()]
                flat = np.concatenate([posterior(m, *ws) for ws in split]) if split else np.zeros(0)
                posteriors = pa.ListArray.from_arrays(pa.array(np.arange(len(split) + 1, dtype=np.int32) * k), pa.array(flat.astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(ws) for ws, _ in split], pa.int64()), posteriors], names=schema.names)

    return map_arrow(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col]))), run, schema)


@dataclass
class Fit:
    """One multiplier a domain; a document's rate follows from them and its own posterior."""

    domains: list[str]
    ridge: float
    multipliers: list[float]
    totals: dict[str, float]
    targets: dict[str, float]
    steps: int = 0
    #: Bound of the projected gradient at these rates.
    gap: float = 0.0
    #: Largest rate.
    cap: float | None = None

    def rate(self, tokens: str = "tokens", posterior: str = "posterior") -> Column:
        """The fitted rate, for rows with tokens and posterior; 1 without tokens."""
        if not self.multipliers:
            return F.lit(1.0)
        return F.when(F.col(tokens) > 0, _rate([F.get(posterior, F.lit(i)) for i in range(len(self.domains))], self.multipliers, self.ridge, self.cap)).otherwise(F.lit(1.0))


def _free(posterior: list[Column], multipliers: list[float], ridge: float) -> Column:
    """The rate without bounds."""
    rate = F.lit(1.0)
    for p, m in zip(posterior, multipliers):
        rate = rate - p * F.lit(float(m) / ridge)
    return rate


def _rate(posterior: list[Column], multipliers: list[float], ridge: float, cap: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), _free(posterior, multipliers, ridge))
    return rate if cap is None else F.least(F.lit(float(cap)), rate)


def fit_rates(scored: DataFrame, domains: list[str], targets: dict[str, float] = TARGETS, budget: float | None = BUDGET, ridge: float = RIDGE, cap: float | None = None, rest: bool = False) -> Fit:
    """Fit rates to scored(tokens, posterior); the table should be cut off, as every step reads it.

    A domain that no document can be in keeps a target that cannot be met; targets
    of domains the classifier doesn't know are left out and the others rescaled. With
    ``rest``, targets are upper limits (a domain that has less keeps what it has), and domains
    without one share what is left as the corpus has them.
    Documents without tokens keep rate 1. With ``cap``, no rate is larger; budget None
    is then the largest at which each domain's target is at most cap times what the
    corpus has of it. Raises RuntimeError if the projected gradient doesn't come below
    TOLERANCE.
    """
    k = len(domains)
    known = {d: targets[d] for d in domains if targets.get(d, 0) > 0}
    total, share = float(scored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]), sum(known.values())
    if not total or not share:
        return Fit(domains, ridge, [], {}, {})
    own = scored.filter("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("w"), *(F.col("posterior")[i].alias(f"p{i}") for i in range(k)))
    wanted = np.array([known.get(d, 0.0) / share for d in domains])
    has = np.array(own.agg(*(F.sum(F.col("w") * F.col(f"p{i}")) for i in range(k))).first(), float)
    if rest:
        others = np.array([0.0 if d in known else x for d, x in zip(domains, has)])
        named = np.minimum([known.get(d, 0.0) for d in domains], has)
        wanted = named + max(0.0, 1 - named.sum()) * others / max(others.sum(), 1e-12)
        wanted /= wanted.sum()
    if budget is None:
        budget = float((cap or 1.0) * (has[wanted > 0] / wanted[wanted > 0]).min())
    target = wanted * budget  # as all sums below, in multiples of the corpus
    unit = np.maximum(target, 1e-6)
    posterior, upper = [F.col(f"p{i}") for i in range(k)], [(i, j) for i in range(k) for j in range(i, k)]

    def at(multipliers: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Totals at these multipliers; the dual function, its gradient and its generalised Hessian."""
        free, rate, w = F.col("free"), F.col("rate"), F.col("w")
        rated = own.withColumns({"free": _free(posterior, multipliers.tolist(), ridge), "rate": _rate(posterior, multipliers.tolist(), ridge, cap)})
        moves = F.when((free > 0) & (free <= F.lit(np.inf if cap is None else float(cap))), w).otherwise(0.0)
        row = rated.agg(F.sum(w * rate * (2 * free - rate)), *(F.sum(w * rate * p) for p in posterior), *(F.sum(moves * posterior[i] * posterior[j]) for i, j in upper)).first()
        totals, gram = np.array(row[1 : k + 1], float), np.zeros((k, k))
        for (i, j), q in zip(upper, row[k + 1 :]):
            gram[i, j] = gram[j, i] = q
        value = unit @ multipliers**2 / 2 + target @ multipliers + ridge / 2 * row[0]
        return totals, float(value), unit * multipliers + target - totals, np.diag(unit) + gram / ridge

    now, steps = np.zeros(k), 0
    totals, value, grad, hessian = at(now)
    # grad / unit is the multipliers less the residuals at their rates: no rate's projected gradient is larger
    while (gap := float(np.abs(grad / unit).max())) > TOLERANCE:
        root = np.sqrt(np.diag(hessian))  # scaled, as units may differ by a million
        move = -np.linalg.solve(hessian / np.outer(root, root), grad / root) / root
        size = 1.0
        while True:
            steps += 1
            if steps > STEPS:
                raise RuntimeError(f"rates not fitted after {STEPS} steps: projected gradient {gap:.1e}, tolerance {TOLERANCE:.0e}")
            then = at(now + size * move)
            # of a convex function; the last steps lower it by less than rounding
            if then[1] <= value + 1e-4 * size * float(grad @ move) + 1e-12 * (1 + abs(value)):
                break
            size /= 2
        now = now + size * move
        totals, value, grad, hessian = then
    return Fit(domains, ridge, now.tolist(), dict(zip(domains, (totals * total).tolist())), dict(zip(domains, (target * total).tolist())), steps, gap, cap)


def fit_mixture(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float] = TARGETS, budget: float | None = BUDGET, cap: float | None = None, rest: bool = False) -> tuple[Classifier, DataFrame, Fit]:
    """The classifier; the columns ``keep`` with tokens and posterior of every row, cut off; the fitted rates.

    Null and empty texts have no tokens; the classifier's prior is their posterior
    and their rate stays 1. Repeated rows are rated alike. Labels without a
    document, and null labels, are left out; without any labelled document all
    rates are 1. An empty table gives an empty result.
    """
    rows = training_rows(docs, labels)
    model = train([r.text for r in rows], [r.domain for r in rows]) if rows else Classifier(["good"], {}, np.zeros((SHAPES + 1, 1), np.float32), np.zeros(0, np.float32))
    scored = cut(score(docs, model, keep))
    return model, scored, fit_rates(scored, model.domains, targets if rows else {}, budget, cap=cap, rest=rest)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash of the key, right on average."""
    draw = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


#: Of the pipeline: the other domains share the rest as the corpus has them.
STAGE_TARGETS: dict[str, float] = {"toxic": TARGETS["toxic"]}


def mix_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, each row once or not at all, drawn by its rate.

    Rates are at most 1, so that no copy comes back after a de-duplication, and the
    budget is the largest at which the targets can be met so: toxic documents are
    thinned to their share, good and poor ones stay in theirs. The draw is a hash
    of the identifier: rows that repeat share its fate (null identifiers, one hash).
    Null and empty texts have no tokens and stay; columns of any name pass through;
    an empty table gives an empty result, and without labelled documents all stay.
    The fit works on tokens and posteriors alone. Whole rows are then scored again
    and rated by the fit's multipliers, which spares a shuffle of all texts.
    """
    names = docs.columns
    model, _, fit = fit_mixture(docs, labels, ["doc_id"], STAGE_TARGETS, budget=None, cap=1.0, rest=True)
    own = ("_quillon_tokens", "_quillon_posterior")
    n = copies(fit.rate(*own), F.coalesce(F.col("doc_id"), F.lit(-1)))
    return score(docs, model, names, names=own).filter(n > 0).select(*(F.col(f"`{c}`") for c in names))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, tokens long, p_good, p_poor, p_toxic (posteriors), rate double.

    Null and empty texts have no tokens and rate 1; repeated rows are rated alike; an
    empty table gives an empty result; columns other than doc_id and text are not read.
    """
    model, scored, fit = fit_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    shown = {d: F.col("posterior")[i] for i, d in enumerate(model.domains)}
    return scored.select("doc_id", "tokens", *(shown.get(d, F.lit(0.0)).alias(f"p_{d}") for d in sorted(TARGETS)), fit.rate().alias("rate"))
