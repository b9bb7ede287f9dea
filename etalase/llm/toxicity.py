"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

An n-gram counts once per text. Its weight is the log ratio of its shares in toxic and other
training texts, times a coefficient that a logistic regression learns on the scaled features
(Wang and Manning, 2012). The fit sees a bounded sample of labelled rows; the score reads
every whole text, on the executors, with one array of weights.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import PRIME, documents_of, fold
from etalase.sources.workspace import ship_package

ORDERS = (3, 4, 5)
BITS = 18
CHUNK = 1 << 20
SURE = 2.5  # standard errors


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(text: str | None) -> np.ndarray:
    """Places of the distinct n-grams of a text; a null or empty text has none.

    Lower case, with a blank at either end, in pieces of ``CHUNK`` characters that overlap.
    """
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = [_places(codes[i : i + CHUNK + max(ORDERS) - 1]) for i in range(0, len(codes), CHUNK)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _places(codes: np.ndarray) -> np.ndarray:
    hashes, h = [], codes
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * PRIME + codes[n - 1 :]
        if n in ORDERS:
            mix = h ^ (h >> np.uint64(29))
            hashes.append((mix * PRIME) >> np.uint64(64 - BITS))
    places = np.concatenate(hashes).astype(np.int64) if hashes else np.empty(0, np.int64)
    # The last writer of a place keeps it, so that each place stays once, without a sort.
    order = np.arange(len(places), dtype=np.int32)
    writer = np.empty(1 << BITS, np.int32)
    writer[places] = order
    return places[writer[places] == order]


def fit(
    sets: list[np.ndarray],
    toxic: np.ndarray,
    rounds: int = 200,
    penalty: float = 1e-4,
    alpha: float = 1.0,
    shift: float = 0.0,
) -> Model:
    """Log-count ratios, then logistic regression on the scaled features (accelerated gradient steps).

    ``shift`` is the log ratio of the true to the sampled odds where the sets are a sample by class; the bias
    is moved by it, so that scores mean the same at every size.
    """
    size = 1 << BITS
    if not sets or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(size, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    counts = np.full((2, size), alpha)
    for found, label in zip(sets, toxic, strict=True):
        counts[int(label), found] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Ratios that chance explains say nothing about new texts.
    ratio[np.abs(ratio) < SURE * np.sqrt(1 / counts[0] + 1 / counts[1])] = 0.0
    sets = [found[ratio[found] != 0] for found in sets]
    places = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = ratio[places]
    norm = np.bincount(row, values**2, len(sets))
    rate = 4.0 / max(float(np.percentile(norm, 90)), 1e-9)
    base = float(np.log(toxic.mean() / (1 - toxic.mean())))
    w, b = np.zeros(size), base
    vw, vb, target = np.zeros(size), 0.0, toxic.astype(float)
    for _ in range(rounds):
        look_w, look_b = w + 0.9 * vw, b + 0.9 * vb
        z = np.bincount(row, look_w[places] * values, len(sets)) + look_b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(sets)
        gradient = np.bincount(places, error[row] * values, size) + penalty * look_w
        vw = 0.9 * vw - rate * gradient
        vb = 0.9 * vb - error.sum()
        w, b = w + vw, b + vb
    return Model((w * ratio).astype(np.float32), float(b + shift))


def train(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = 1000) -> Model:
    """Fit on at most ``bound`` labelled rows per class, taken in the order of a hash of the id.

    ``labels`` holds doc_id and toxic (0 or 1; others and nulls are ignored); ``learn`` says,
    by doc_id, which rows may be learnt from. Only the sample is broadcast, so its size is bound.
    The sample may be richer in the rarer class; the bias is moved back to the odds of all labels that
    may be learnt from. Without both classes the score is constant.
    """
    ship_package(docs.sparkSession)
    known = labels.where(learn & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, toxic, text in documents_of(batch, "doc_id", "toxic", "text"):
                places = features(text).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id]), pa.array([toxic], pa.int32()), pa.array([places])], ["doc_id", "toxic", "places"]
                )

    found = rows.mapInArrow(run, "doc_id long, toxic int, places binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.places)))
    sets = [np.frombuffer(r.places, "<i4") for r in found]
    toxic = np.array([r.toxic == 1 for r in found], bool)
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    shift = math.log(size[1] / min(size[1], bound) / (size[0] / min(size[0], bound))) if len(size) == 2 and bound else 0.0
    return fit(sets, toxic, shift=shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row, repeated rows each; other columns are ignored."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def _scores(batch: pa.RecordBatch, model: Model) -> list[float]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    z = [model.bias + float(model.weights[features(t)].sum(dtype=np.float64)) for t in texts]
    return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in _scores(batch, shared.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(folds: int = 5) -> Column:
    """True for ids whose crc32 modulo ``folds`` is not 0."""
    return fold(F.col("doc_id"), folds) != 0
