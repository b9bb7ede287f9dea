"""Spelling variants: words one edit apart, found by their pivotal bigrams.

Bigrams have one global order, rare ones first. A word's prefix is its three rarest bigrams
(and whatever ties with the third); among them at least two are disjoint, and the pivots are
the two disjoint ones that are rarest together. One edit cannot touch both, so of two words
one edit apart, the one whose prefix ends earlier has a pivot that the other holds in its
prefix, moved by one place at most. (With grams of two and one edit, three grams are the
prefix that guarantees it.)

The edit lies in one of four zones around the shared gram: the near or the far half of what
stands before it or behind it. So an index entry is the gram's place with one zone left out,
and a lookup is the same of a pivot, for each of the three lengths the other word can have.
A frequent gram is thereby many small keys, and no group of words is compared all with all.
What meets is checked for exactly one edit.
"""

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
# Two disjoint bigrams need four characters.
LEAST_LENGTH = 5
LEAST_COUNT = 3
# Bigrams are counted by hash, which bounds the table every task holds.
GRAM_BUCKETS = 1 << 16
# A form is twice as frequent as its word, and counts are longs: no chain is longer.
DOUBLINGS = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, doc_id: Column, every: int) -> Column:
    """``run`` less one character where ``every`` divides its hash (crc32 of id and run)."""
    code = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = (code % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(code % every == 0, shorter).otherwise(run)


def words(docs: DataFrame, every: int | None = None) -> DataFrame:
    """(word, n): letter runs of all texts with A-Z lowered, long and frequent enough.

    A null text has none. With ``every``, about one occurrence in so many lacks a letter
    (see ``damaged``; a null id counts as empty). Copies of a document count each.
    """
    found = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # Shorter runs only get shorter.
    found = found.where(F.length("run") >= LEAST_LENGTH)
    # Most runs have no capital letter; those skip the character-wise step.
    run = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    word = found.select("doc_id", run.alias("run"))
    word = word.select((damaged(F.col("run"), F.col("doc_id"), every) if every else F.col("run")).alias("word"))
    counted = word.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def grouped(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n).

    Near words differ by exactly one inserted, deleted or replaced character. ``form``: the
    near word of largest n (ties: first in code-point order) if that is at least twice the
    word's n, else null; ``root``: where following forms ends. Repeated words are added up;
    null words, null counts and words under five characters are left out.
    """
    clean = counts.where(F.col("n").isNotNull() & (F.length("word") >= LEAST_LENGTH))
    clean = stored(clean.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = stored(near(clean), "near-words")
    flipped = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # A word has at most as many near words as edits, so this group is bounded by its length.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    linked = pairs.unionByName(flipped).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = clean.join(_by_merge(linked), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"),
    )
    chosen = stored(chosen.select("word", "to.form", "n", "n_near", "to.form_n"), "forms")
    roots = _roots(chosen.where("form is not null").select("word", F.col("form").alias("root")))
    found = chosen.join(_by_merge(roots), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form_n").cast("long").alias("form_n"))


def variants(docs: DataFrame, every: int | None = None) -> DataFrame:
    """The words of all texts with their forms and roots (see ``words`` and ``grouped``)."""
    return grouped(words(docs, every))


def _by_merge(side: DataFrame) -> DataFrame:
    """``side`` is never sent whole to the driver and every task.

    Spark sizes it by the stored words it comes from, a few MB. Their keys take some twenty rows a
    word, and all sides here grow with the words.
    """
    return side.hint("merge")


def _roots(steps: DataFrame) -> DataFrame:
    """Follow every chain to its end; each round doubles the distance covered."""
    for _ in range(DOUBLINGS):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(_by_merge(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        steps = moved.drop("moved")
        if not moved.where("moved").limit(1).collect():
            break
    return steps


# ---- near words


def near(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair one edit apart, once, in one of its two directions."""
    rank = counts.sparkSession.sparkContext.broadcast(_order(counts))

    def keys(kind):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    found = [kind(word, rank.value) for word in part.column(0).to_pylist()]
                    at = np.repeat(np.arange(part.num_rows), [len(k) for _, k in found])
                    ends = np.array([end for end, _ in found], "int32")
                    key = np.array([k for _, ks in found for k in ks], "uint64").view("int64")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), *[c.take(pa.array(at)) for c in part.columns], pa.array(ends[at])],
                        names=["key", "word", "n", "last"],
                    )

        return counts.mapInArrow(run, "key long, word string, n long, last int")

    asked = keys(lookups)
    held = keys(entries).withColumnsRenamed({"word": "near", "n": "near_n", "last": "near_last"})
    met = asked.join(_by_merge(held), "key").where((F.col("last") <= F.col("near_last")) & (F.col("word") != F.col("near")))
    met = met.where(F.levenshtein("word", "near", 1) == 1)
    # Either direction may find a pair, by several keys.
    first = F.col("word") < F.col("near")
    swap = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return met.select(
        swap("word", "near").alias("word"),
        swap("n", "near_n").alias("n"),
        swap("near", "word").alias("near"),
        swap("near_n", "n").alias("near_n"),
    ).distinct()


def _bucket(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % GRAM_BUCKETS


def _order(counts: DataFrame) -> np.ndarray:
    """Place of every gram bucket in the global order, from the number of words that hold it."""
    starts = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.crc32(F.substring("word", i, F.lit(2)).cast("binary")) % GRAM_BUCKETS))
    # One row per bucket, GRAM_BUCKETS at most.
    held = counts.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("words"))
    frequency = np.zeros(GRAM_BUCKETS, "int64")
    for bucket, n in held.collect():
        frequency[bucket] = n
    rank = np.empty(GRAM_BUCKETS, "int32")
    rank[np.argsort(frequency, kind="stable")] = np.arange(GRAM_BUCKETS)
    return rank


def prefix(word: str, rank: np.ndarray) -> list[tuple[int, int]]:
    """(rank, place) of the three rarest bigrams and of all that tie with the third, by place."""
    grams = [(int(rank[_bucket(word[i : i + 2])]), i) for i in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint grams with the least sum of ranks.

    Dynamic programming from left to right: the best single gram that ends before a place,
    then the best pair that ends with the gram there.
    """
    singles: list[tuple[int, int]] = []
    pair = None
    for rank, place in grams:
        before = bisect_right([p for _, p in grams], place - 2)
        if before:
            total = singles[before - 1][0] + rank
            if pair is None or total < pair[0]:
                pair = (total, singles[before - 1][1], place)
        singles.append(min(singles[-1], (rank, place)) if singles else (rank, place))
    return pair[1], pair[2]


def _zones(place: int, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The halves before the gram at ``place`` and those behind it, as (start, end)."""
    half, behind = place // 2, place + 2
    middle = behind + (length - behind) // 2
    return [(0, half), (half, place)], [(behind, middle), (middle, length)]


def _key(place: int, zone: tuple[int, int], length: int, front: str, back: str) -> int:
    head = f"{place} {zone[0]} {zone[1]} {length} "
    return xxhash.xxh3_64_intdigest((head + front + "\x00" + back).encode("utf-8", "surrogatepass"))


def entries(word: str, rank: np.ndarray) -> tuple[int, set[int]]:
    """Rank of the prefix's end, and a key for each gram of the prefix and each zone."""
    grams, length = prefix(word, rank), len(word)
    found = set()
    for _, place in grams:
        for zone in sum(_zones(place, length), []):
            found.add(_key(place, zone, length, word[: zone[0]], word[zone[1] :]))
    return max(grams)[0], found


def lookups(word: str, rank: np.ndarray) -> tuple[int, set[int]]:
    """The same for the pivots, as the entry of a word with one edit in a zone would have it."""
    grams, length = prefix(word, rank), len(word)
    found = set()
    for pivot in pivots(grams):
        for other in (length - 1, length, length + 1):
            # An edit before the gram moves it, an edit behind it does not.
            for side, place in enumerate((pivot + other - length, pivot)):
                if place < 0 or place + 2 > other:
                    continue
                for zone in _zones(place, other)[side]:
                    after = length - (other - zone[1])
                    if after >= zone[0]:
                        found.add(_key(place, zone, other, word[: zone[0]], word[after:]))
    return max(grams)[0], found
