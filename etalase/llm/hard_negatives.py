"""Hard negatives by exact inner products, with one-bit codes deciding which to work out.

A vector is turned by a fixed random rotation and kept as one bit per coordinate (the sign)
with its alignment, the inner product of the vector and its unit code. What the code leaves
is coded again in the next level with a rotation of its own; the length of the last rest is
stored. An anchor's coordinates are cut into bit planes, so its inner product with a code is
a few popcounts. By Cauchy-Schwarz the rest adds at most the product of two lengths, which
gives each score a certain interval. Only rows whose interval reaches the places still open
are scored, in integers.

Anchors and rows are dealt in blocks. Each block of anchors meets each block of rows in a
group of its own and gives back a few rows per anchor, so no pair ever becomes a row unless
it is among the best of its block.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalase.llm.common import stored

LEVELS = 4
BLOCK_ROWS = 8192
TILE = 128
# Bits of an anchor's coordinates besides the sign.
PLANE_BITS = 5
# A hundred times a score must fit a long.
LONGEST = 2.0**28
SEEDS = 8


def mined(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id long, label, vector array<long>. An anchor's positives are the ``positives``
    rows of its label with the highest inner product, ties by id; for each positive the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of
    the positive's come back, ranked from 1. Rows with a null id, label, vector or component
    take no part. Rows that share an anchor's id are neither its positives nor its negatives;
    an anchor that stands there twice is asked once, any other repeated row counts each time.
    A shorter vector counts as filled up with zeros; vectors longer than 2^28 are an error.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "vector", is_anchor.alias("_asks"))
    usable = F.forall("vector", lambda x: x.isNotNull())
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & usable)
    plain = stored(rows, "vectors")
    size, total, asking = plain.agg(F.max(F.size("vector")), F.count(F.lit(1)), F.count_if("_asks")).collect()[0]
    width = 1 << max((max(size or 1, 1) - 1).bit_length(), 3)
    coded = stored(_coded(plain, width), "codes")
    asked = coded.where("_asks").dropDuplicates(["id", "label", "vector"])
    anchors = asked.select(
        F.xxhash64("id", "label", "vector").alias("anchor"),
        # Names of their own: both sides of a cogroup come from one table.
        F.col("id").alias("anchor_id"),
        F.col("label").alias("own_label"),
        F.col("vector").alias("query"),
    )
    grid = (-(-asking // block_rows) or 1, -(-total // block_rows) or 1)

    near = _met(anchors.withColumn("wanted", F.lit(None).cast("array<long>")), coded, grid, positives, width, low, high)
    best = _first(near, ["anchor_id", "anchor"], positives).select("anchor_id", "anchor", "place", "id", "score")
    best = stored(best, "positives")
    # At most ``positives`` scores per anchor.
    scores = F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"])
    wanted = best.groupBy("anchor").agg(scores.alias("wanted"))
    far = _met(anchors.join(wanted, "anchor"), coded, grid, negatives, width, low, high)
    ranked = _first(far, ["anchor_id", "anchor", "slot"], negatives)
    return (
        best.withColumnsRenamed({"id": "positive_id", "score": "positive_score", "place": "slot"})
        .join(ranked.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"}), ["anchor_id", "anchor", "slot"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _first(hits: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# ---- codes


def rotated(vectors: np.ndarray, level: int) -> np.ndarray:
    """Signs drawn for the level, then a Walsh-Hadamard transform: an orthogonal map."""
    width = vectors.shape[1]
    turned = vectors * np.random.default_rng(level).choice([-1.0, 1.0], width)
    span = 1
    while span < width:
        halves = turned.reshape(-1, width // (2 * span), 2, span)
        turned = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(-1, width)
        span *= 2
    return turned / np.sqrt(width)


def unrotated(turned: np.ndarray, level: int) -> np.ndarray:
    """The inverse: the transform is its own inverse, the signs too."""
    width = turned.shape[1]
    signs = np.random.default_rng(level).choice([-1.0, 1.0], width)
    back, span = turned, 1
    while span < width:
        halves = back.reshape(-1, width // (2 * span), 2, span)
        back = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(-1, width)
        span *= 2
    return back / np.sqrt(width) * signs


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits (rows, levels, bytes), alignments (rows, levels) and the length of what is left."""
    rest, bits, aligned = vectors.astype("float64"), [], []
    root = np.sqrt(vectors.shape[1])
    for level in range(LEVELS):
        turned = rotated(rest, level)
        up = turned >= 0
        along = np.abs(turned).sum(axis=1) / root
        rest = rest - unrotated(np.where(up, 1.0, -1.0) / root * along[:, None], level)
        bits.append(np.packbits(up, axis=1, bitorder="little"))
        aligned.append(along)
    return np.stack(bits, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("int64")
    sizes = np.fromiter((len(x) for x in column), "int64", len(column)) if len(column) else np.empty(0, "int64")
    out = np.zeros((len(column), width), "int64")
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _coded(plain: DataFrame, width: int) -> DataFrame:
    """Each row with its codes, the vector as packed 64-bit integers."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), width)
            longest = float(np.linalg.norm(vectors.astype("float64"), axis=1).max())
            if longest > LONGEST:
                raise ValueError(f"a vector of length {longest:.3g}; integer scores hold up to {LONGEST:.3g}")
            bits, aligned, rest = codes(vectors)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    batch.column("_asks"),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([b.tobytes() for b in bits], pa.binary()),
                    pa.array([a.tobytes() for a in aligned], pa.binary()),
                    pa.array(rest),
                ],
                names=["id", "label", "_asks", "vector", "code", "aligned", "rest"],
            )

    return plain.mapInArrow(code, "id long, label string, _asks boolean, vector binary, code binary, aligned binary, rest double")


# ---- blocks


def _met(anchors: DataFrame, coded: DataFrame, grid: tuple[int, int], k: int, width: int, low: int, high: int) -> DataFrame:
    """Best ``k`` rows of each anchor (and wanted place) from every pair of blocks."""
    a_blocks, r_blocks = grid

    def dealt(df: DataFrame, key: list[str], own: str, count: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        block = F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")
        return df.withColumn(own, block).withColumn(other, every)

    left = dealt(anchors, ["anchor"], "ab", a_blocks, "rb", r_blocks)
    right = dealt(coded.drop("_asks"), ["id", "vector"], "rb", r_blocks, "ab", a_blocks)

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            block = _Block(held, width)
            for start in range(0, asked.num_rows, TILE):
                found.append(block.best(asked.slice(start, TILE), k, low, high))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, "int64")] * 5
        names = ["anchor_id", "anchor", "slot", "id", "score"]
        return pa.table([pa.array(c.astype("int64")) for c in columns], names=names)

    schema = "anchor_id long, anchor long, slot long, id long, score long"
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(best, schema)


def _packed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Block:
    """Rows of one block and what is certain about their scores."""

    def __init__(self, held: pa.Table, width: int):
        held = held.sort_by([("label", "ascending"), ("id", "ascending")])
        self.ids = held["id"].to_numpy()
        self.vectors = _packed(held["vector"], "int64")
        code = _packed(held["code"], "uint8").reshape(len(held), LEVELS, width // 8)
        # Whole machine words, so that one popcount takes 64 coordinates.
        self.code = _words(code)
        self.aligned = _packed(held["aligned"], "float64").astype("float64")
        self.rest = held["rest"].to_numpy()
        names, self.labels = np.unique(np.array(held["label"].to_pylist(), dtype=object), return_inverse=True)
        self.number = {name: i for i, name in enumerate(names)}
        self.width = width

    def intervals(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and how far, at most, the scores are from them."""
        length = np.linalg.norm(anchors, axis=1)
        code, aligned, rest = self.code[rows], self.aligned[rows], self.rest[rows]
        estimate = np.zeros((len(anchors), len(code)))
        doubt = length[:, None] * rest[None, :]
        for level in range(LEVELS):
            planes, step, lost = planes_of(rotated(anchors, level))
            inside = np.zeros((len(anchors), len(code)), "int32")
            for bit, plane in enumerate(planes):
                for word in range(code.shape[2]):
                    inside += np.bitwise_count(plane[:, word, None] & code[None, :, level, word]).astype("int32") << bit
            offset = 1 << PLANE_BITS
            # Each coordinate was raised by the offset; coordinates outside the code count negative.
            ones = np.bitwise_count(code[:, level]).sum(axis=1).astype("int32")
            whole = sum(np.bitwise_count(p).sum(axis=1).astype("int64") << b for b, p in enumerate(planes))
            signed = 2.0 * (inside - offset * ones[None, :]) - (whole - offset * self.width)[:, None]
            along = signed * (step[:, None] / np.sqrt(self.width))
            estimate += aligned[None, :, level] * along
            doubt += aligned[None, :, level] * lost[:, None]
        # Room for the rounding of the floats above.
        return estimate, doubt + 1e-9 * length[:, None] * (self.aligned[rows].sum(axis=1) + rest)[None, :] + 1e-3

    def best(self, asked: pa.Table, k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
        """anchor id, anchor, slot, row id and score of the best ``k`` per anchor and slot."""
        anchors = _packed(asked["query"], "int64")
        ids = asked["anchor_id"].to_numpy()
        labels = np.array([self.number.get(x, -1) for x in asked["own_label"].to_pylist()])
        keys, wanted = asked["anchor"].to_numpy(), asked["wanted"].to_pylist()
        out = []
        same = wanted[0] is None
        if same:
            # Rows are in label order, so an anchor's own label is one stretch.
            for label in np.unique(labels):
                begin, end = np.searchsorted(self.labels, [label, label + 1])
                mine = np.flatnonzero(labels == label)
                if end > begin:
                    estimate, doubt = self.intervals(anchors[mine], slice(begin, end))
                    for i, e, d in zip(mine, estimate, doubt, strict=True):
                        allowed = self.ids[begin:end] != ids[i]
                        rows, scores = self._top(anchors[i], e, d, allowed, begin, k)
                        out.append(_rows(ids[i], keys[i], 0, self.ids[rows], scores))
        else:
            estimate, doubt = self.intervals(anchors, slice(None))
            for i in range(len(anchors)):
                allowed = (self.labels != labels[i]) & (self.ids != ids[i])
                out += self._windows(anchors[i], estimate[i], doubt[i], allowed, wanted[i], k, low, high, ids[i], keys[i])
        if not out:
            return tuple(np.empty(0, "int64") for _ in range(5))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _top(self, anchor, estimate, doubt, allowed, begin, k):
        """Places and scores of the ``k`` best allowed rows, ties by id."""
        upper = np.where(allowed, estimate + doubt, -np.inf)
        bound = -np.inf
        if allowed.sum() > k:
            lower = np.where(allowed, estimate - doubt, -np.inf)
            seeds = np.argpartition(-estimate + np.where(allowed, 0, np.inf), k)[:k]
            bound = max(np.partition(lower, -k)[-k], (self.vectors[begin + seeds] @ anchor).min())
        rows = begin + np.flatnonzero(allowed & (upper >= bound))
        scores = self.vectors[rows] @ anchor
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def _windows(self, anchor, estimate, doubt, allowed, wanted, k, low, high, anchor_id, key):
        """The same within each slot's window of scores."""
        out = []
        upper, lower = 100 * (estimate + doubt), 100 * (estimate - doubt)
        known: dict[int, int] = {}
        for slot, positive in enumerate(wanted, 1):
            floor, ceiling = low * positive, high * positive
            able = np.flatnonzero(allowed & (upper >= floor) & (lower <= ceiling))
            if floor > ceiling or not len(able):
                continue
            # A few likely rows first: their scores lift the bound for all others.
            likely = able[estimate[able] * 100 <= ceiling]
            if len(likely) > SEEDS * k:
                likely = likely[np.argpartition(-estimate[likely], SEEDS * k)[: SEEDS * k]]
            sure = 100 * self._scores(anchor, likely, known)
            sure = np.sort(sure[(sure >= floor) & (sure <= ceiling)])
            if len(sure) >= k:
                able = able[upper[able] >= sure[-k]]
            scores = self._scores(anchor, able, known)
            inside = (100 * scores >= floor) & (100 * scores <= ceiling)
            able, scores = able[inside], scores[inside]
            order = np.lexsort((self.ids[able], -scores))[:k]
            out.append(_rows(anchor_id, key, slot, self.ids[able[order]], scores[order]))
        return out

    def _scores(self, anchor, rows, known):
        """Integer scores, each worked out once per anchor."""
        new = np.array([r for r in rows.tolist() if r not in known], "int64")
        if len(new):
            known.update(zip(new.tolist(), (self.vectors[new] @ anchor).tolist(), strict=True))
        return np.array([known[r] for r in rows.tolist()], "int64")


def _rows(anchor_id, key, slot, ids, scores):
    n = len(ids)
    return np.full(n, anchor_id), np.full(n, key), np.full(n, slot), ids, scores


def _words(code: np.ndarray) -> np.ndarray:
    """Bytes of the last axis as 64-bit words, filled up with zeros."""
    missing = -code.shape[-1] % 8
    if missing:
        code = np.concatenate([code, np.zeros((*code.shape[:-1], missing), "uint8")], axis=-1)
    return np.ascontiguousarray(code).view("uint64")


def planes_of(turned: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit planes of the coordinates, the size of a step, and the most that rounding can shift a product with a unit code."""
    top = np.abs(turned).max(axis=1)
    limit = (1 << PLANE_BITS) - 1
    step = np.where(top > 0, top / limit, 1.0)
    whole = np.rint(turned / step[:, None]).astype("int64")
    lost = np.abs(turned - whole * step[:, None]).sum(axis=1) / np.sqrt(turned.shape[1])
    raised = whole + (1 << PLANE_BITS)
    planes = [
        _words(np.packbits((raised >> bit & 1).astype(bool), axis=1, bitorder="little")) for bit in range(PLANE_BITS + 1)
    ]
    return planes, step, lost
