"""Benchmark decontamination: items found in documents within an edit distance, by CGK embedding and LSH.

Distances are counted in words (lower case, ASCII marks left out). The CGK embedding walks along a word
sequence: at each step it writes down the present word and, by a random bit of step and word, stays or
moves on. Sequences a few edits apart mostly write the same, so edit distance becomes Hamming distance.
Each repetition draws its own walk and its own steps; windows of an item's size that agree with the item
on the drawn steps are candidates. The number of repetitions follows, size by size, from the recall asked
for at the greatest distance and from simulated walks of insertions, deletions and substitutions. The exact
edit distance of the item to the nearest passage that starts with the window then decides.

Only windows that can be near an item are embedded: one with at most k edits keeps all but 2k of the
item's word pairs, and a run of the item's words, moved by k places at most. So an item's windows are
those around its runs in the text. This drops no match.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import documents_of
from etalase.sources.workspace import ship_package

EDITS = 0.2  # of an item's words, rounded down
RECALL = 0.95
DRAWN = 3  # steps drawn by a repetition
TRIALS, WALKS, MOST = 60, 8, 4096  # simulated pairs of each kind of edit, walks of a pair; repetitions at most
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
SLICE = 4_000_000  # numbers that a step of the search holds in one array
CHUNK_WORDS = 300_000
STRETCH = 3  # steps of a walk for each word
MATCHES = "doc_id long, item_id long, distance int, start_word long, n_words int"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PAIR_BITS = 22


def normal(text: str | None) -> list[bytes]:
    """Words of a text as they are compared; a null text has none."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def _edits(size: int, share: float) -> int:
    return int(share * size + 1e-9)


def _spread(words: np.ndarray) -> np.ndarray:
    h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _factors(seed: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and addend of a repetition's multiply-shift hash at each step."""
    a, b = _spread(np.arange(1, 2 * steps + 1) + seed * 2_000_006).reshape(steps, 2).T
    return a | np.uint64(1), b


def _bits(factors: tuple[np.ndarray, np.ndarray], step: int, spread: np.ndarray) -> np.ndarray:
    """The walk's bit (0 or 1) of each spread word at a step."""
    return ((spread * factors[0][step] + factors[1][step]) >> np.uint64(63)).view(np.int64)


def _agreeing(size: int, edits: int, kind: int, walk: int) -> np.ndarray:
    """Share of steps where walks of an item and of a copy with so many edits write the same, by trial.

    ``kind`` is 0 for substitutions, 1 for insertions, 2 for deletions. Every trial has words of its own.
    """
    random = np.random.default_rng([size, edits, kind])
    pair = np.zeros((2, TRIALS, STRETCH * size + 1), np.int64)
    fresh = iter(range(2 * size * TRIALS + 1, 1 << 62))
    for trial in range(TRIALS):
        item = [trial * size + i + 1 for i in range(size)]
        copy = list(item)
        if kind == 1:
            for at in random.integers(0, size, edits).tolist():
                copy.insert(at, next(fresh))
        else:
            for at in sorted(random.choice(size, edits, replace=False).tolist(), reverse=True):
                copy[at : at + 1] = [next(fresh)] if kind == 0 else []
        copy += [next(fresh) for _ in range(size - len(copy))]
        pair[0, trial, :size], pair[1, trial, :size] = item, copy[:size]
    rows, at = np.arange(TRIALS), np.zeros((2, TRIALS), np.int64)
    same, factors = np.zeros(TRIALS), _factors(walk, STRETCH * size)
    for step in range(STRETCH * size):
        seen = [pair[i, rows, at[i]] for i in (0, 1)]
        same += seen[0] == seen[1]
        for i in (0, 1):
            at[i] += _bits(factors, step, _spread(seen[i]))
    return same / (STRETCH * size)


@cache
def repetitions(size: int, share: float = EDITS, recall: float = RECALL, drawn: int = DRAWN) -> int:
    """Repetitions that find an item of ``size`` words at its greatest distance, whatever the kind of edit.

    Sizes above 64 words are rounded up to three to four bits, as they need about the same number.
    """
    if size > 64:
        unit = 1 << (size.bit_length() - 4)
        size = -(-size // unit) * unit
    k = _edits(size, share)
    # Each repetition walks anew, so a pair's chance is its mean over walks.
    chances = [np.mean([_agreeing(size, k, kind, w) ** drawn for w in range(WALKS)], axis=0) for kind in range(3)]
    enough = lambda times: all(np.mean(1 - (1 - c) ** times) >= recall for c in chances)
    found = next((times for times in range(1, MOST + 1) if enough(times)), None)
    if found is None:
        raise ValueError(f"more than {MOST} repetitions would be needed for items of {size} words; draw fewer steps")
    return found


@dataclass
class Index:
    """A block of items, ready for the search."""

    ids: list[int | None]
    items: list[np.ndarray]
    words: dict[bytes, int]
    edits: float
    pairs: np.ndarray  # bit per hash of a pair of neighbouring words of an item
    runs: dict[int, "Runs"]  # by the number of words in a row that every match shares with its item
    classes: dict[int, list[int]]  # items by size
    seed: int  # of the walks
    steps: dict[int, np.ndarray] = field(repr=False)  # drawn steps by size: repetition, number
    keys: dict[int, np.ndarray] = field(repr=False)  # keys by size: repetition, item


@dataclass
class Runs:
    """Runs of words of items, sorted by hash, each with the sizes of its items and its places there."""

    bits: np.ndarray  # bit per hash, which most runs of a text fail
    codes: np.ndarray
    sizes: np.ndarray
    places: np.ndarray


def _pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(
        64 - _PAIR_BITS
    )


def _run_codes(text: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """64-bit hashes of the runs of words that begin at ``at``."""
    code = np.zeros(len(at), np.uint64)
    for i in range(run):
        code = (code + text[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(32)
    return code * np.uint64(0xC2B2AE3D27D4EB4F)


def _runs(items: list[np.ndarray], run: int) -> Runs:
    found = np.concatenate(
        [
            np.stack([_run_codes(x, at, run), np.full(len(at), len(x), np.uint64), at.astype(np.uint64)], axis=1)
            for x in items
            for at in [np.arange(len(x) - run + 1)]
        ]
    )
    codes, sizes, places = np.unique(found, axis=0).T
    bits = np.zeros(1 << _PAIR_BITS, bool)
    bits[codes >> np.uint64(64 - _PAIR_BITS)] = True
    return Runs(bits, np.ascontiguousarray(codes), sizes.astype(np.int64), places.astype(np.int64))


def build(rows: list[tuple[int | None, str | None]], edits: float = EDITS, recall: float = RECALL, seed: int = 7) -> Index:
    """An index of (item_id, text) rows; items without a word are left out."""
    words: dict[bytes, int] = {}
    ids, items = [], []
    for item_id, text in rows:
        found = [words.setdefault(w, len(words) + 1) for w in normal(text)]
        if found:
            ids.append(item_id)
            items.append(np.array(found, np.int64))
    classes: dict[int, list[int]] = {}
    pairs = np.zeros(1 << _PAIR_BITS, bool)
    by_run: dict[int, list[np.ndarray]] = {}
    for i, item in enumerate(items):
        classes.setdefault(len(item), []).append(i)
        pairs[_pair_code(item[:-1], item[1:])] = True
        k = _edits(len(item), edits)
        by_run.setdefault(-(-(len(item) - k) // (k + 1)), []).append(item)
    runs = {run: _runs(members, run) for run, members in sorted(by_run.items())}
    random = np.random.default_rng(seed)
    steps = {n: random.integers(0, STRETCH * n, (repetitions(n, edits, recall), DRAWN)) for n in sorted(classes)}
    index = Index(ids, items, words, edits, pairs, runs, classes, seed << 16, steps, {})
    for n, members in classes.items():
        texts = np.concatenate([items[i] for i in members])
        keys = []
        for part in _slices(np.arange(len(members)) * n, STRETCH * n):
            written = embedded(texts, part, index, STRETCH * n, len(steps[n]))
            keys.append(np.stack([_keys(w, steps[n][r], n) for r, w in enumerate(written)]))
        index.keys[n] = np.concatenate(keys, axis=1)
    return index


def _slices(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``rows`` in parts that make at most ``SLICE`` numbers of ``width`` each."""
    size = max(1, SLICE // max(width, 1))
    for begin in range(0, len(rows), size):
        yield rows[begin : begin + size]


def embedded(
    text: np.ndarray, starts: np.ndarray, index: Index, steps: int, times: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each repetition the words written from each start, and how far the walk was; step by start."""
    padded = np.append(text, np.zeros(steps + 1, np.int64))
    spread = _spread(padded)
    for r in range(times):
        at = np.zeros((steps, len(starts)), np.int32)
        word = np.zeros((steps, len(starts)), np.int32)
        here, factors = starts.copy(), _factors(index.seed + r, steps)
        for t in range(steps):
            at[t], word[t] = here - starts, padded[here]
            here += _bits(factors, t, spread[here])
        yield word, at


def _keys(
    written: tuple[np.ndarray, np.ndarray], steps: np.ndarray, sizes: np.ndarray | int, which: np.ndarray | slice = slice(None)
) -> np.ndarray:
    """What windows of ``sizes`` wrote at the drawn steps, as one number; past the window nothing is written."""
    key = np.zeros(1, np.uint64)
    for t in steps:
        word = np.where(written[1][t, which] < sizes, written[0][t, which] + 1, 0).astype(np.uint64)
        key = (key + word) * np.uint64(0x9E3779B97F4A7C15)
    return key


def distances(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``items`` to the nearest beginning of the same row of ``windows``.

    Word 0 of a window equals nothing.
    """
    across = np.arange(windows.shape[1] + 1, dtype=np.int32)
    last = np.tile(across, (len(items), 1))
    for i in range(items.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (windows != items[:, i : i + 1]))
        last = np.minimum.accumulate(now - across, axis=1) + across
    return last.min(axis=1)


def search(texts: list[str | None], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, distance, start) of the nearest passage for each item found in a text."""
    begin = 0
    while begin < len(texts) and index.items:
        parts, owners, size, end = [], [], 0, begin
        while end < len(texts) and (size < CHUNK_WORDS or end == begin):
            get = index.words.get
            parts.append(np.array([get(w, 0) for w in normal(texts[end])] + [0], np.int64))
            size += len(parts[-1])
            owners.append(size)
            end += 1
        yield from ((begin + t, *rest) for t, *rest in _search(np.concatenate(parts), np.array(owners), index))
        begin = end


def _search(text: np.ndarray, ends: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    both = (text[:-1] > 0) & (text[1:] > 0)
    known = np.zeros(len(text), bool)
    at = np.flatnonzero(both)
    known[at] = index.pairs[_pair_code(text[at], text[at + 1])]
    counted = np.concatenate([[0], np.cumsum(known)])
    able, room = {}, _room(ends)
    for n, starts in _starts(text, known, index):
        # A passage may be longer or shorter than its item by the edits.
        k, left = _edits(n, index.edits), room(starts)
        pairs = counted[starts + np.maximum(np.minimum(n + k, left) - 1, 0)] - counted[starts]
        able[n] = starts[(pairs >= n - 1 - 2 * k) & (left >= n - k) & (left > 0)]
    candidates = {n: [np.empty(0, np.int64)] for n in able}
    # Sizes up to twice each other are walked together, each group for its own windows only.
    for band in sorted({n.bit_length() for n in able}):
        mine = {n: starts for n, starts in able.items() if n.bit_length() == band}
        steps = 1 + max(int(index.steps[n].max()) for n in mine)
        times = max(len(index.steps[n]) for n in mine)
        for part in _slices(np.unique(np.concatenate(list(mine.values()))), steps):
            inside = {n: rows[(rows >= part[0]) & (rows <= part[-1])] for n, rows in mine.items()}
            which = {n: np.searchsorted(part, rows) for n, rows in inside.items() if len(rows)}
            sizes = {n: np.minimum(n, room(inside[n])) for n in which}
            for r, written in enumerate(embedded(text, part, index, steps, times)):
                for n, places in which.items():
                    if r < len(index.steps[n]):
                        # A text's closing 0 and what follows are past the window, as in an item's own walk.
                        keys = _keys(written, index.steps[n][r], sizes[n], places)
                        hit, item = _equal(keys, index.keys[n][r])
                        candidates[n].append(inside[n][hit] * len(index.classes[n]) + item)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for n, found in candidates.items():
        k = _edits(n, index.edits)
        for part in _slices(np.unique(np.concatenate(found)), n + k):
            starts, item = np.divmod(part, len(index.classes[n]))
            inside = np.arange(n + k) < room(starts)[:, None]
            places = np.where(inside, starts[:, None] + np.arange(n + k), 0)
            windows = np.where(inside, text[places], 0).astype(np.int32)
            items = np.stack([index.items[index.classes[n][i]] for i in item.tolist()]).astype(np.int32)
            far = np.concatenate([distances(w, x) for w, x in _parts(windows, items)])
            owners = np.searchsorted(ends, starts, "right").tolist()
            for owner, i, d, s in zip(owners, item.tolist(), far.tolist(), starts.tolist(), strict=True):
                if d <= k:
                    key = (owner, index.classes[n][i])
                    first = int(ends[owner - 1]) if owner else 0
                    best[key] = min(best.get(key, (1 << 30, 0)), (d, s - first))
    for (owner, i), (d, start) in sorted(best.items()):
        yield owner, i, d, start


def _room(ends: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Words from a start to the end of its text."""
    return lambda starts: ends[np.searchsorted(ends, starts, "right")] - 1 - starts


def _starts(text: np.ndarray, known: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray]]:
    """For each size of item the places where a match may start.

    A match holds a run of its item, moved by the edits at most. ``known`` tells where a pair of an item stands.
    """
    lines: dict[int, list[np.ndarray]] = {}
    chain, length = text > 0, 1  # where so many words in a row may be a run
    for run, table in index.runs.items():
        for length in range(length + 1, run + 1):
            chain = chain & _shifted(known, length - 2)
        length = run
        anchors = np.flatnonzero(chain)
        codes = _run_codes(text, anchors, run)
        ours = table.bits[codes >> np.uint64(64 - _PAIR_BITS)]
        anchors, codes = anchors[ours], codes[ours]
        for part in _slices(np.arange(len(anchors)), 64):
            hit, entry = _equal(codes[part], table.codes)
            begin, sizes = anchors[part][hit] - table.places[entry], table.sizes[entry]
            for n in np.unique(sizes).tolist():
                lines.setdefault(n, []).append(np.unique(begin[sizes == n]))
    for n, found in lines.items():
        k = _edits(n, index.edits)
        starts = np.unique(np.unique(np.concatenate(found))[:, None] + np.arange(-k, k + 1))
        yield n, starts[(starts >= 0) & (starts < len(text) - 1)]


def _shifted(flags: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([flags[by:], np.zeros(by, bool)])


def _equal(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all equal pairs."""
    order = np.argsort(others, kind="stable")
    low, high = (np.searchsorted(others[order], keys, side) for side in ("left", "right"))
    size = high - low
    hit = np.repeat(np.arange(len(keys)), size)
    within = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)
    return hit, order[low[hit] + within]


def _parts(windows: np.ndarray, items: np.ndarray, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for begin in range(0, len(items), rows):
        yield windows[begin : begin + rows], items[begin : begin + rows]


def indexes(benchmark: DataFrame, edits: float, recall: float) -> Iterator[Index]:
    """Indexes of blocks of about ``BLOCK_ITEMS`` items or ``BLOCK_WORDS`` words, which is what a task holds at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.words or 0) // BLOCK_WORDS))
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield build(sorted(((r.item_id, r.text) for r in mine.collect()), key=repr), edits, recall)


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The nearest passage for every item in every document that holds it within ``edits`` of its words.

    Rows: doc_id, item_id, distance, start_word and n_words (the item's). Null texts match nothing, items
    without words are ignored, repeated rows have rows of their own, null ids stay. An empty table gives no
    rows. Items are searched in blocks, each against all documents.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for index in indexes(benchmark, edits, recall):
        part = narrow.mapInArrow(_matching(docs, index), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def _matching(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, ids = shared.value, batch.column(0).to_pylist()
            rows = [
                (ids[t], index.ids[i], d, s, len(index.items[i])) for t, i, d, s in search(batch.column(1).to_pylist(), index)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            names = ["doc_id", "item_id", "distance", "start_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    ship_package(docs.sparkSession)
    for index in indexes(benchmark, edits, recall):
        docs = docs.mapInArrow(_clean(docs, index), docs.schema)
    return docs


def _clean(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            dirty = {t for t, *_ in search(texts, shared.value)}
            yield batch.filter(pa.array([i not in dirty for i in range(len(texts))], pa.bool_()))

    return run
