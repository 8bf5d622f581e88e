"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a small network; no negative label is used.  With class prior ``pi``
and loss ``l`` the risk is ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` (Kiryo et al. 2017); while the second part
is negative, the step goes up it instead.  The prior is estimated from the same rows: the smallest ratio, over score
thresholds, of the unlabelled to the positive share above the threshold (best-bin estimate).

Features are shares of byte classes and simple word and line statistics of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat, sample

# Byte classes: every ASCII punctuation mark for itself, then digits, upper, lower, blank, line end, control, lead, trail.
_MARKS = [code for code in range(33, 127) if not chr(code).isalnum()]
_CLASS = np.full(256, len(_MARKS) + 5, np.uint8)
_CLASS[_MARKS] = np.arange(len(_MARKS))
_CLASS[48:58] = len(_MARKS)
_CLASS[65:91] = len(_MARKS) + 1
_CLASS[97:123] = len(_MARKS) + 2
_CLASS[[32, 9]] = len(_MARKS) + 3
_CLASS[[10, 13]] = len(_MARKS) + 4
_CLASS[192:] = len(_MARKS) + 6
_CLASS[128:192] = len(_MARKS) + 7
CLASSES = len(_MARKS) + 8
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Plan:
    """``positives`` and ``unlabelled`` bound the training sample."""

    positives: int = 6000
    unlabelled: int = 12000
    hidden: int = 24
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    seed: int = 7
    prior: float | None = None


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for every document, also for empty ones."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    shares = np.bincount(doc * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    hashes, owner = flat.word_hashes(data, offsets, lower=False)
    counts = np.bincount(owner, minlength=n)
    many = np.maximum(counts, 1)
    starts, ends, _ = flat.words(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    length = (ends - starts).astype(float)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = ((upper[ends] - upper[starts]) * 2 > length) & (length > 1)
    ragged = ~_WORDY[data[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
    bare = np.concatenate(([0], np.cumsum(_WORDY[data])))
    bare = (bare[ends] - bare[starts]) == 0

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n) / many

    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    first = np.concatenate(([0], np.cumsum(counts)))
    kinds = np.diff(flat.distinct(hashes, first)[1])
    pairs, bounds = flat.shingles(hashes, owner, n, 2)
    runs, run_bounds = flat.shingles(hashes, owner, n, 5)
    rare = np.diff(flat.distinct(pairs, bounds)[1]) / np.maximum(np.diff(bounds), 1)
    long_runs = np.diff(flat.distinct(runs, run_bounds)[1]) / np.maximum(np.diff(run_bounds), 1)
    average = mean(length)
    lines = shares[:, len(_MARKS) + 4] * size
    return np.column_stack((
        np.sqrt(shares), np.log1p(counts), np.log1p(size), average, np.sqrt(np.maximum(mean(length ** 2) - average ** 2, 0)),
        mean(shouted), mean(ragged), mean(bare), mean(same), kinds / many, np.log1p(kinds) / np.log(many + 2.0), rare, long_runs,
        np.log1p(lines), np.log1p(counts / (lines + 1)),
    ))


def _feature_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = flat.utf8(batch.column(at))
        for lo, hi in flat.runs(offsets):
            yield batch.slice(lo, hi - lo), features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


def _forward(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = weights
    inner = np.tanh(x @ w + b)
    return inner @ v + c[0], inner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _fit(x: np.ndarray, positive: np.ndarray, prior: float, plan: Plan) -> tuple[np.ndarray, ...]:
    """Adam on the non-negative risk with the logistic loss; ``x`` is standardised, ``positive`` marks trusted rows."""
    rng = np.random.default_rng(plan.seed)
    weights = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], plan.hidden)), np.zeros(plan.hidden),
        rng.normal(0, 1 / np.sqrt(plan.hidden), plan.hidden), np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    sure, rest = np.flatnonzero(positive), np.flatnonzero(~positive)
    step, half = 0, plan.batch // 2
    for _ in range(plan.epochs):
        order = rng.permutation(rest)
        for lo in range(0, len(order), half):
            u = order[lo:lo + half]
            p = rng.choice(sure, half)
            rows = np.concatenate((p, u))
            z, inner = _forward(x[rows], tuple(weights))
            zp, zu = z[:half], z[half:]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            slope = np.empty_like(z)
            # Derivatives of log(1 + exp(-z)) and log(1 + exp(z)).
            if negative >= 0:
                slope[:half] = -prior / half
                slope[half:] = _sigmoid(zu) / len(u)
            else:
                slope[:half] = prior * _sigmoid(zp) / half
                slope[half:] = -_sigmoid(zu) / len(u)
            back = slope[:, None] * weights[2] * (1 - inner ** 2)
            grads = (x[rows].T @ back, back.sum(0), inner.T @ slope, slope.sum(keepdims=True))
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * weights[k] * (k in (0, 2))
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                weights[k] = weights[k] - plan.rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(weights)


def estimate_prior(x: np.ndarray, positive: np.ndarray, plan: Plan) -> float:
    """Share of positives among the unlabelled rows: best bin of a score fitted on one half, read on the other."""
    half = np.random.default_rng(plan.seed).random(len(x)) < 0.5
    found = []
    for side in (half, ~half):
        if not (positive & side).any() or not (~positive & side).any() or not (positive & ~side).any() or not (~positive & ~side).any():
            continue
        z = _forward(x, _fit(x[side], positive[side], 0.5, Plan(hidden=8, epochs=15, seed=plan.seed)))[0]
        p, u = np.sort(z[positive & ~side]), np.sort(z[~positive & ~side])
        cuts = np.quantile(p, np.linspace(0.02, 0.98, 97))
        of_p = 1 - np.searchsorted(p, cuts) / len(p)
        of_u = 1 - np.searchsorted(u, cuts) / len(u)
        slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        at = np.argmin((of_u + slack) / np.maximum(of_p, 1e-9))
        found.append(of_u[at] / of_p[at])
    return float(np.clip(np.mean(found) if found else 0.5, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, plan: Plan = Plan()) -> Network | None:
    """Fit on a bounded sample of ``docs``; rows of ``labels`` (same id) with a 1 and no 0 are trusted positives.

    Returns None if there are no trusted positives or no other rows.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("low"))
    flagged = (
        docs.select(id_col).where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).join(marks, id_col, "left")
        .select(F.col(id_col).alias("id"), F.coalesce(F.col("low") == 1, F.lit(False)).alias("positive"))
    )
    counts = {row["positive"]: row["count"] for row in flagged.groupBy("positive").count().collect()}
    if not counts.get(True) or not counts.get(False):
        return None
    share = sample.share_of(F.col("id"))
    chosen = flagged.where(
        (F.col("positive") & (share < plan.positives / counts[True])) | (~F.col("positive") & (share < plan.unlabelled / counts[False]))
    )
    # The sample has about positives + unlabelled narrow rows at most, by construction.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _feature_batches(batches, 1):
            yield pa.record_batch({
                "id": batch.column(0), "positive": batch.column(2),
                "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.select("id", "text", "positive").mapInArrow(rows, f"id {kind}, positive boolean, x array<double>")
    found = found.dropDuplicates(["id"]).toArrow()
    found = found.take(pa.array(np.argsort(np.array(found["id"].to_pylist()), kind="stable")))
    x = np.array(found["x"].to_pylist())
    return fit(x, np.array(found["positive"].to_pylist(), dtype=bool), plan)


def fit(x: np.ndarray, positive: np.ndarray, plan: Plan = Plan()) -> Network:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    scaled = np.clip((x - mean) / scale, -8, 8)
    prior = plan.prior if plan.prior is not None else estimate_prior(scaled, positive, plan)
    return Network(mean, scale, _fit(scaled, positive, prior, plan), prior)


def score(docs: DataFrame, id_col: str, text_col: str, network: Network | None) -> DataFrame:
    """``(id, score)`` of every whole text; NULL counts as empty.  Without a network all scores are 0.5."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if network is None:
        return rows.select("id", F.lit(0.5).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch, x in _feature_batches(batches, 1):
            z = _forward(np.clip((x - net.mean) / net.scale, -8, 8), net.weights)[0]
            yield pa.record_batch({"id": batch.column(0), "score": pa.array(_sigmoid(z))})

    return rows.mapInArrow(scored, f"id {kind}, score double")


def keep(docs: DataFrame, text_col: str, network: Network | None, threshold: float) -> DataFrame:
    """Rows of ``docs`` whose score reaches ``threshold`` (all, without a network); only the text visits Python."""
    if network is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def good(texts: pa.Array) -> pa.Array:
        net = shipped.value
        data, offsets = flat.utf8(texts)
        kept = [np.zeros(0, dtype=bool)]
        for lo, hi in flat.runs(offsets):
            x = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            kept.append(_sigmoid(_forward(np.clip((x - net.mean) / net.scale, -8, 8), net.weights)[0]) >= threshold)
        return pa.array(np.concatenate(kept))

    return docs.where(F.arrow_udf(good, "boolean")(F.col(text_col)))
