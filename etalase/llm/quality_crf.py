"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its potential comes from measures of the line and of the lines beside it,
and neighbouring labels depend on each other. Forward-backward gives each line's chance of being
good; their mean, weighted by line length, is turned into the document's score by a fitted logistic.

The field is fitted on a bounded sample of labelled rows. Only documents are labelled, so lines start
with the label of their document; after a first fit the lines of bad documents that look good on their
own are called good, and the field is fitted again.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import documents_of
from etalase.llm.quality_rules import STOP_WORDS
from etalase.sources.workspace import ship_package

_SYMBOLS, _UPPER, _DIGITS, _STOPS = b"#*$%&|<>!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?"
_STOP = frozenset(w.encode() for w in STOP_WORDS)
MEASURES = 11
SEGMENT = 64


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the three lines' measures, two flags for the ends, and a constant
    change: np.ndarray  # potential of each pair of neighbouring labels
    slope: float
    bias: float


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures and byte lengths of the lines that have a word; none for a null or empty text."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        size, n = len(line), len(words)
        low = [w.lower() for w in words]
        rows.append(
            (
                np.log1p(n),
                size / n,
                (size - len(line.translate(None, _SYMBOLS))) / size,
                (size - len(line.translate(None, _UPPER))) / size,
                (size - len(line.translate(None, _DIGITS))) / size,
                sum(w in _STOP for w in low) / n,
                len(set(low)) / n,
                sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
                float(words[-1][-1] in _STOPS),
                float(line in seen),
                float(n < 4),
            )
        )
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.float32).reshape(-1, MEASURES), np.array(sizes, float)


def beside(rows: np.ndarray) -> np.ndarray:
    """Each line's standardised measures with those of its neighbours, flags for the ends, a constant."""
    if not len(rows):
        return np.empty((0, 3 * rows.shape[1] + 3), rows.dtype)
    none = np.zeros((1, rows.shape[1]), rows.dtype)
    flags = np.zeros((len(rows), 3), rows.dtype)
    flags[0, 0] = flags[-1, 1] = 1.0
    flags[:, 2] = 1.0
    return np.hstack([rows, np.vstack([none, rows[:-1]]), np.vstack([rows[1:], none]), flags])


def chances(score: np.ndarray, sizes: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``score``: potential of "good" against "bad" of all lines, chain after chain; ``sizes``: lines of
    each chain. Gives each line's chance of being good, the chance of each pair of labels of a line and
    the one before it (zero for the first line), and the chains' log partition sums.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    forward = np.zeros((len(score), 2))
    backward = np.zeros((len(score), 2))
    local = np.stack([np.zeros(len(score)), score], axis=1)
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            forward[at] = local[at]
        else:
            before = forward[at - 1]
            forward[at] = local[at] + np.logaddexp(before[:, :1] + change[0], before[:, 1:] + change[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = local[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((len(score), 2, 2))
    first = np.zeros(len(score), bool)
    first[starts[lengths > 0]] = True
    later = np.flatnonzero(~first)
    if len(later):
        joint = forward[later - 1][:, :, None] + change[None] + (local[later] + backward[later])[:, None, :]
        pairs[later] = np.exp(joint - total[later][:, None, None])
    sums = np.zeros(len(sizes))
    sums[order[lengths > 0]] = total[starts[lengths > 0]]
    return good, pairs, sums


def _fit_chains(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rounds: int = 150, penalty: float = 1e-3):
    """Weights and label changes of greatest conditional likelihood (gradient steps with adapted sizes)."""
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(y), bool)
    first[starts] = True
    later = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1], y[later]), 1.0)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        good, pairs, _ = chances(x @ theta[:-4], sizes, theta[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - good), (seen - pairs.sum(axis=0)).ravel()]) / len(y) - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _shares(x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, weights: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Length-weighted chance of good lines in each document; -1 for one without lines."""
    good, _, _ = chances(x @ weights, sizes, change)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.bincount(owner, lengths, len(sizes))
    return np.where(weight > 0, np.bincount(owner, lengths * good, len(sizes)) / np.maximum(weight, 1e-9), -1.0)


def fit(rows: list[np.ndarray], lengths: list[np.ndarray], good: np.ndarray, share: float) -> Model:
    """A model from documents' lines, their labels and the share of good ones among all labels."""
    sizes = np.array([len(r) for r in rows], np.int64)
    if not sizes.sum() or good.all() or not good.any():
        odds = (share + 0.01) / (1.01 - share)
        zeros = np.zeros(3 * MEASURES + 3)
        return Model(np.zeros(MEASURES), np.ones(MEASURES), zeros, np.zeros((2, 2)), 0.0, float(np.log(odds)))
    every = np.vstack(rows)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    x = np.vstack([beside((r - mean) / scale) for r in rows])
    label = np.repeat(good, sizes).astype(int)
    parts = [np.minimum(SEGMENT, n - SEGMENT * np.arange(-(-n // SEGMENT))) for n in sizes if n]
    segments = np.concatenate(parts)
    weights, change = _fit_chains(x, label, segments)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    again = np.where(~good[owner] & (x @ weights > 0), 1, label)
    worst = np.bincount(owner, again == 0, len(sizes)) == 0
    again = np.where(~good[owner] & worst[owner], 0, again)  # a bad document has a bad line somewhere
    weights, change = _fit_chains(x, again, segments)
    m = _shares(x, np.concatenate(lengths), sizes, weights, change)
    slope, bias = _logistic(m[sizes > 0], good[sizes > 0], share)
    return Model(mean, scale, weights, change, slope, bias)


def _logistic(m: np.ndarray, good: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias on the share of good lines (Newton steps); classes weigh as among all labels."""
    x = np.stack([m, np.ones(len(m))], axis=1)
    weight = np.where(good, share / max(good.mean(), 1e-9), (1 - share) / max(1 - good.mean(), 1e-9))
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2]) * len(m) ** 0.5
        theta = theta + np.linalg.solve(hessian, x.T @ (weight * (good - p)) - 1e-2 * len(m) ** 0.5 * theta)
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = 1500) -> Model:
    """Fit on at most ``bound`` labelled rows per class, taken in the order of a hash of the id.

    ``labels`` holds doc_id and quality (0 or 1; others and nulls are ignored); ``learn`` says, by doc_id,
    which rows may be learnt from. Only the sample is broadcast. Without both classes the score is constant.
    """
    ship_package(docs.sparkSession)
    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    shares = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, quality, text in documents_of(batch, "doc_id", "quality", "text"):
                found, sizes = measures(text)
                columns = [[doc_id], [quality], [found.astype("<f4").tobytes()], [sizes.astype("<f8").tobytes()]]
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "quality", "rows", "sizes"]
                )

    found = rows.mapInArrow(run, "doc_id long, quality int, rows binary, sizes binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.rows)))
    return fit(
        [np.frombuffer(r.rows, "<f4").reshape(-1, MEASURES) for r in found],
        [np.frombuffer(r.sizes, "<f8") for r in found],
        np.array([r.quality == 1 for r in found], bool),
        shares.get(1, 0) / max(sum(shares.values()), 1),
    )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and good_share of every row, repeated rows each; other columns are ignored.

    A text without words has no lines: its good_share is null and its score that of no good line.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [measures(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(r) for r, _ in found], np.int64)
            x = [beside((r - model.mean) / model.scale) for r, _ in found]
            x = np.vstack(x) if x else np.empty((0, 3 * MEASURES + 3))
            lengths = np.concatenate([n for _, n in found]) if found else np.empty(0)
            m = _shares(x, lengths, sizes, model.weights, model.change)
            z = model.slope * np.maximum(m, 0.0) + model.bias
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(m, mask=m < 0)], ["doc_id", "score", "good_share"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double, good_share double")
