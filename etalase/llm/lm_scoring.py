"""Language-model scores: deleted interpolation of bigrams, unigrams and an even chance.

Each task turns a batch of documents into word numbers and asks for the counts of its distinct
words and word pairs. The questions, which carry the batch's own training counts, are dealt out by
hash; where a hash range meets, counts are added up and the totals go back to each batch. No table of
n-grams is ever in one place, and what is exchanged grows with the distinct n-grams of the batches.

The mixture weights depend on how often the context was seen (in powers of two). They are learnt by
expectation-maximisation on fold 1, with counts from the other training folds ("deleted" from fold
1's view); its documents come in as a histogram of (context class, bigram chance, word count).
Scores then use the counts of all training folds.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import PRIME, documents_of, fold, hashed_words, lowered, mixed, stored

FOLDS, HELD_OUT, DELETED = 10, 0, 1
BATCH_TOKENS = 1_500_000
PART_ENTRIES = 2_000_000
END = np.uint64(0xD1B54A32D192ED03)
CLASSES, STEPS, NONE = 64, 8, 511  # context classes; histogram steps per power of two; code of a zero

_TYPES = {
    "part": pa.int32(),
    "batch": pa.int64(),
    "pairs": pa.bool_(),
    "hashes": pa.binary(),
    "kept": pa.binary(),
    "all": pa.binary(),
    "ids": pa.list_(pa.int64()),
    "folds": pa.list_(pa.int32()),
    "sizes": pa.list_(pa.int32()),
    "tokens": pa.binary(),
    "vocabulary": pa.binary(),
    "word_counts": pa.binary(),
    "pair_counts": pa.binary(),
    "totals": pa.list_(pa.int64()),
    "bins": pa.list_(pa.int64()),
    "weights": pa.list_(pa.int64()),
}
_HEAD = "ids array<long>, folds array<int>, sizes array<int>, tokens binary, vocabulary binary"
ASKED = f"part int, batch long, pairs boolean, hashes binary, kept binary, `all` binary, {_HEAD}"
ANSWERED = f"part int, batch long, pairs boolean, kept binary, `all` binary, totals array<long>, {_HEAD}"
COUNTED = (
    "batch long, ids array<long>, folds array<int>, sizes array<int>, tokens binary,"
    " word_counts binary, pair_counts binary, totals array<long>, bins array<long>, weights array<long>"
)
SCORES = "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]


def _table(schema: str, rows: list[dict]) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], _TYPES[c]) for c in _names(schema)})


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of unsigned numbers, byte by byte, so that small numbers compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(_planes(values, 5), 1)


def _read_counts(raw: bytes) -> np.ndarray:
    return _numbers(zlib.decompress(raw), 5).astype(np.int64)


def _pairs(tokens: np.ndarray, words: int) -> np.ndarray:
    """Code of each token with the one before it; the first word of a text follows a closing token."""
    before = np.roll(tokens, 1)
    return before.astype(np.int64) * words + tokens


def _pair_hashes(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    return mixed(vocabulary[codes // len(vocabulary)] * PRIME + vocabulary[codes % len(vocabulary)])


def _dealt(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, and where each of the ranges that their first bits name ends."""
    part = (hashes >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(hashes), np.uint32)
    return np.argsort(hashes), np.cumsum(np.bincount(part, minlength=1 << bits))


def _steps_up(values: np.ndarray) -> np.ndarray:
    """Differences (modulo 2**64) of unsigned numbers; small where they ascend, so they compress."""
    return np.diff(values, prepend=np.uint64(0))


def _batch_rows(number: int, ids: list, folds: list[int], texts: list[np.ndarray], bits: int) -> Iterator[dict]:
    sizes = np.array([len(t) for t in texts], np.int64)
    vocabulary, tokens = np.unique(np.concatenate(texts), return_inverse=True)
    often = np.argsort(-np.bincount(tokens), kind="stable")  # common words get small numbers
    vocabulary, place = vocabulary[often], np.empty(len(often), np.int64)
    place[often] = np.arange(len(often))
    tokens = place[tokens]
    yield {
        "part": -1 - number % 1021,
        "batch": number,
        "ids": ids,
        "folds": folds,
        "sizes": sizes.tolist(),
        "tokens": zlib.compress(_planes(tokens, 4), 1),
        # Words that are equally common are in the order of their hashes.
        "vocabulary": zlib.compress(_planes(_steps_up(vocabulary), 8), 1),
    }
    which = np.repeat(np.array(folds), sizes)
    kept, known = (which != HELD_OUT) & (which != DELETED), which != HELD_OUT
    codes, at = np.unique(_pairs(tokens, len(vocabulary)), return_inverse=True)
    for pairs, hashes, places in (
        (False, mixed(vocabulary + np.uint64(1)), tokens),
        (True, _pair_hashes(codes, vocabulary), at),
    ):
        amounts = [np.bincount(places[mask], minlength=len(hashes)) for mask in (kept, known)]
        order, ends = _dealt(hashes, bits)
        rest = (hashes[order] << np.uint64(bits)) >> np.uint64(24)
        sorted_amounts, begin = [a[order] for a in amounts], 0
        for p, end in enumerate(ends.tolist()):
            if end > begin:
                yield {
                    "part": p,
                    "batch": number,
                    "pairs": pairs,
                    "hashes": _planes(_steps_up(rest[begin:end]), 5),
                    "kept": _counts(sorted_amounts[0][begin:end]),
                    "all": _counts(sorted_amounts[1][begin:end]),
                }
            begin = end


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        folds: list = []
        texts: list = []
        for rows in batches:
            for doc_id, part, text in documents_of(rows, "doc_id", "fold", "text"):
                ids.append(doc_id)
                folds.append(part)
                texts.append(np.append(hashed_words(lowered(text).split()), END))
                size += len(texts[-1])
                if size >= BATCH_TOKENS:
                    yield from _table(ASKED, list(_batch_rows(number, ids, folds, texts, bits))).to_batches()
                    number, size, ids, folds, texts = number + 1, 0, [], [], []
        if ids:
            yield from _table(ASKED, list(_batch_rows(number, ids, folds, texts, bits))).to_batches()

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Of one hash range: the total of each count, to every batch that asked."""
    part = group.column("part")[0].as_py()
    if part < 0:
        return _table(ANSWERED, group.to_pylist())
    rows = []
    for pairs in (False, True):
        asked = group.filter(pc.equal(group.column("pairs"), pairs)).select(["batch", "hashes", "kept", "all"])
        if not len(asked):
            continue
        hashes = [np.cumsum(_numbers(h, 5)) for h in asked.column("hashes").to_pylist()]
        ends = np.cumsum([len(h) for h in hashes])
        order = np.argsort(np.concatenate(hashes))
        hashes = np.concatenate(hashes)[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        repeats = np.diff(np.r_[first, len(order)])
        totals = {}
        for name in ("kept", "all"):
            values = np.concatenate([_read_counts(b) for b in asked.column(name).to_pylist()])[order]
            sums = np.add.reduceat(values, first)
            totals[name] = np.empty(len(order), np.int64)
            totals[name][order] = np.repeat(sums, repeats)
            if not pairs:
                rows.append({"part": part, "batch": -1, "totals": [int(name == "all"), int(sums.sum()), int((sums > 0).sum())]})
        begin = 0
        for batch, end in zip(asked.column("batch").to_pylist(), ends.tolist(), strict=True):
            answer = {name: _counts(t[begin:end]) for name, t in totals.items()}
            rows.append({"part": part, "batch": batch, "pairs": pairs} | answer)
            begin = end
    return _table(ANSWERED, rows)


def _placed(answers: list[dict], name: str, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    for row in answers:
        end = int(ends[row["part"]])
        begin = int(ends[row["part"] - 1]) if row["part"] else 0
        out[order[begin:end]] = _read_counts(row[name])
    return out


def context_class(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the floor of the binary logarithm."""
    return np.frexp(counts.astype(float))[1]


def _log_steps(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        found = np.abs(np.rint(STEPS * np.log2(values)))
    return np.where(values > 0, np.minimum(found, NONE - 1), NONE).astype(np.int64)


def _count(bits: int):
    """Of one batch: its tokens with the counts of their words and pairs, and fold 1's histogram."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["batch"] < 0:
            return _table(COUNTED, rows)
        (head,) = [r for r in rows if r["ids"] is not None]
        vocabulary = np.cumsum(_numbers(zlib.decompress(head["vocabulary"]), 8))
        tokens = _numbers(zlib.decompress(head["tokens"]), 4).astype(np.int64)
        codes, at = np.unique(_pairs(tokens, len(vocabulary)), return_inverse=True)
        found = {}
        for pairs, hashes in ((False, mixed(vocabulary + np.uint64(1))), (True, _pair_hashes(codes, vocabulary))):
            order, ends = _dealt(hashes, bits)
            answers = [r for r in rows if r["ids"] is None and r["pairs"] == pairs]
            for name in ("kept", "all"):
                found[pairs, name] = _placed(answers, name, order, ends)
        mask = np.repeat(np.array(head["folds"]), head["sizes"]) == DELETED
        words, context, both = tokens[mask], np.roll(tokens, 1)[mask], at[mask]
        seen = found[False, "kept"][context]
        share = found[True, "kept"][both] / np.maximum(seen, 1)
        bins = (context_class(seen) * 512 + _log_steps(share)) * 512 + _log_steps(found[False, "kept"][words])
        bins, weights = np.unique(bins, return_counts=True)
        row = {k: head[k] for k in ("batch", "ids", "folds", "sizes", "tokens")}
        row |= {"word_counts": _counts(found[False, "all"]), "pair_counts": _counts(found[True, "all"])}
        return _table(COUNTED, [row | {"bins": bins.tolist(), "weights": weights.tolist()}])

    return run


def mixture(bins: np.ndarray, weights: np.ndarray, tokens: int, words: int, rounds: int = 40) -> np.ndarray:
    """Weights of bigram, unigram and even chance for each context class, by expectation-maximisation.

    Classes without a token take the weights of the nearest class below, or above.
    """
    kind, two, one = bins >> 18, (bins >> 9) & 511, bins & 511
    chances = np.stack(
        [
            np.where(two == NONE, 0.0, 2.0 ** (-two / STEPS)),
            np.where(one == NONE, 0.0, 2.0 ** (one / STEPS) / max(tokens, 1)),
            np.full(len(bins), 1.0 / (words + 1)),
        ]
    )
    mix = np.full((3, CLASSES), 1 / 3)
    mass = np.bincount(kind, weights, CLASSES)
    for _ in range(rounds):
        joint = mix[:, kind] * chances
        share = joint / joint.sum(axis=0) * weights
        for k in range(3):
            mix[k] = np.where(mass > 0, np.bincount(kind, share[k], CLASSES) / np.maximum(mass, 1), mix[k])
    mix[:, mass == 0] = 0.0
    known = np.flatnonzero(mass)
    for k in np.flatnonzero(mass == 0):
        near = known[known < k][-1:] if (known < k).any() else known[:1]
        mix[:, k] = mix[:, near[0]] if len(near) else (0.5, 0.3, 0.2)
    if not mass[0]:  # an unseen context has no bigram
        mix[:, 0] = (0.0, 0.5, 0.5)
    return mix


def _score(mix: np.ndarray, tokens_seen: int, words_seen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, pairs = _read_counts(row["word_counts"]), _read_counts(row["pair_counts"])
                tokens = _numbers(zlib.decompress(row["tokens"]), 4).astype(np.int64)
                codes, at = np.unique(_pairs(tokens, len(words)), return_inverse=True)
                context, word = words[codes // len(words)], words[codes % len(words)]
                m = mix[:, context_class(context)]
                chance = m[0] * pairs / np.maximum(context, 1) + m[1] * word / max(tokens_seen, 1) + m[2] / (words_seen + 1)
                base = np.log10((words + 0.1) / (tokens_seen + 0.1 * (words_seen + 1)))
                sizes = np.array(row["sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                total = lambda values: np.add.reduceat(values, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(row["folds"], pa.int32()),
                        pa.array(sizes),
                        pa.array(total((words[tokens] > 0).astype(np.int64))),
                        pa.array(np.full(len(sizes), tokens_seen)),
                        pa.array(total(base[tokens])),
                        pa.array(total(np.log10(chance)[at])),
                    ],
                    _names(SCORES),
                )

    return run


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every row: doc_id, fold, n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are the words (A-Z lowered, split at blanks) and one closing token. Fold 0 is never learnt
    from. A null text is empty and has the closing token only; a null id is in fold 0. Repeated rows
    count and are scored each; other columns are ignored. The mixture sums to one over the known words
    and one place for all unknown ones.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long"), fold(F.col("doc_id"), FOLDS).alias("fold"), F.col("text").cast("string")
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = max(0, min(20, (int(size / 8 / PART_ENTRIES)).bit_length()))
    answered = narrow.mapInArrow(_ask(bits), ASKED).groupBy("part").applyInArrow(_answer, ANSWERED)
    counted = stored(answered.groupBy("batch").applyInArrow(_count(bits), COUNTED), "lm-counts")

    totals = counted.where("batch < 0").groupBy(F.col("totals")[0].alias("all"))
    totals = totals.agg(F.sum(F.col("totals")[1]).alias("tokens"), F.sum(F.col("totals")[2]).alias("words")).collect()
    found = {bool(r["all"]): (r["tokens"], r["words"]) for r in totals}
    kept, every = found.get(False, (0, 0)), found.get(True, (0, 0))
    pairs = counted.where("batch >= 0").select(F.explode(F.arrays_zip("bins", "weights")).alias("x"))
    # At most one row per class and two steps of a logarithm, however large the corpus.
    histogram = pairs.groupBy("x.bins").agg(F.sum("x.weights").alias("n")).collect()
    mix = mixture(np.array([r["bins"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], float), *kept)
    return counted.where("batch >= 0").mapInArrow(_score(mix, *every), SCORES)
