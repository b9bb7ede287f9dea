"""Byte-level BPE by a table of ranks: whole texts to ids, and ids back to bytes.

A text is cut by a pattern, and each piece ("word") is merged on its own: it starts as single
bytes, and the two neighbours whose joined bytes have the lowest rank become one, the
leftmost first, until no joined pair has a rank.

The frequent words of the corpus are counted, and each is merged once, by a fold of Spark's
array functions over its bytes; the ranks are a literal in the query. Their ids, a bounded
table, go to the tasks that read the texts. A word that is not in it is merged where it
stands, by the same rule (``merged``), once for as long as the task remembers it. Decoding
joins the bytes of the ids.
"""

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalase.llm.common import stored

# Words merged ahead of the texts, at most; others are merged in place, so it changes no result.
FREQUENT_WORDS = 1 << 17
# Longer words are not kept in tables.
KEPT_BYTES = 64
REMEMBERED = 500_000
_SLOTS = 1 << 16
_ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no rank for the bytes {missing[:5]}; every text must have ids")
    if len(set(ranks.values())) != len(ranks):
        raise ValueError("two tokens share a rank")
    return ranks


_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# For patterns that let a word begin with one blank and keep other white space apart: stretches
# between blanks. Such a pattern cuts each stretch alike, whatever stands around it.
STRETCHES = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

# Stretches that such a pattern leaves whole where it takes letters together: Latin letters only.
LETTERS = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"


def encoded(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    out: str = "ids",
    frequent: int = FREQUENT_WORDS,
    coarse: str | None = None,
    plain: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in ``out``, row by row.

    A null text counts as empty and has no ids. All other columns stay; a column that is
    called like ``out`` is replaced. ``path``: a rank file; ``pattern``: what one word is,
    in the syntax of the regex package; words cover the text that the pattern covers.
    ``coarse``: a faster pattern of the re package that cuts the text into stretches which
    ``pattern`` cuts the same way alone as within the text (``STRETCHES`` for the usual ones).
    ``plain``: a pattern of the re package for stretches that are one word as a whole (``LETTERS``).
    """
    context = docs.sparkSession.sparkContext
    ranks = read_ranks(path)
    table = frequent_words(docs.select(F.col(text).alias("text")), ranks, pattern, frequent) if frequent else {}
    shared = context.broadcast((ranks, table))
    others = [c for c in docs.columns if c != out]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(coarse) if coarse else regex.compile(pattern)
        known = Words(*shared.value, regex.compile(pattern) if coarse else None, plain and re.compile(plain))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = part.column(part.schema.get_field_index("_text")).to_pylist()
                found = [b"".join(map(known.__getitem__, cut.findall(t or ""))) for t in texts]
                sizes = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
                columns = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != "_text"]
                lists = pa.ListArray.from_arrays(pa.array(sizes.astype("int32")), ids)
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*others, out])

    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encode, f"{fields}, `{out}` array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for in ``out``; null ids give no bytes.

    ``ids`` goes, all other columns stay. An id without a token, or a null among the ids, is an error.
    """
    ranks = read_ranks(path)
    tokens = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    others = [c for c in rows.columns if c not in (out, ids)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = joined(part.column(part.schema.get_field_index("_ids")), known)
                columns = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != "_ids"]
                yield pa.RecordBatch.from_arrays([*columns, texts], names=[*others, out])

    taken = rows.select(*[F.col(f"`{c}`") for c in others], F.col(ids).cast("array<int>").alias("_ids"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken.schema.fields[:-1])
    return taken.mapInArrow(decode, f"{fields}`{out}` binary")


def joined(lists: pa.ListArray, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each list of ids. Taken tokens stand one after the other, so only the ends are new."""
    taken = tokens.take(lists.flatten())
    if taken.null_count:
        raise ValueError("an id without a token")
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
    places = np.array([0], "<i4")
    if len(taken):
        places = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1, 4 * taken.offset)
    content = taken.buffers()[2] or pa.py_buffer(b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(places[ends].tobytes()), content])


# ---- words in the tasks


class Words(dict):
    """Ids of words as little-endian 32-bit bytes: the frequent ones, and some that came by.

    With a pattern, what is asked for is a stretch of words, and the pattern cuts it.
    """

    def __init__(self, ranks: dict[bytes, int], frequent: dict[str, bytes], pattern: regex.Pattern | None = None, plain: re.Pattern | None = None):
        super().__init__(frequent)
        self.ranks, self.frequent, self.pattern, self.plain = ranks, frequent, pattern, plain
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}

    def __missing__(self, stretch: str) -> bytes:
        whole = self.pattern is None or self.plain and self.plain.fullmatch(stretch)
        words = [stretch] if whole else self.pattern.findall(stretch)
        # A word is remembered by itself too, as it comes with other marks around it.
        packed = self.word(stretch) if words == [stretch] else b"".join(map(self.__getitem__, words))
        if len(stretch) <= KEPT_BYTES:
            if len(self) >= REMEMBERED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[stretch] = packed
        return packed

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        return self.packed.get(raw) or b"".join(map(self.packed.__getitem__, merged(raw, self.ranks)))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one word. A heap holds the joinable pairs, so long words take no square of steps."""
    if len(word) <= KEPT_BYTES:
        return _merged_short(word, ranks)
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    pairs = [(ranks[pair], i, i + 2) for i in range(len(word) - 1) if (pair := word[i : i + 2]) in ranks]
    heapq.heapify(pairs)
    # ends[i]: where the token that starts at i ends, 0 if none starts there any more.
    while pairs:
        _, start, end = heapq.heappop(pairs)
        middle = ends[start]
        if not middle or middle >= len(word) or ends[middle] != end:
            continue
        ends[start], ends[middle] = end, 0
        if end < len(word):
            before[end] = start
            if (rank := ranks.get(word[start : ends[end]])) is not None:
                heapq.heappush(pairs, (rank, start, ends[end]))
        if (left := before[start]) >= 0 and (rank := ranks.get(word[left:end])) is not None:
            heapq.heappush(pairs, (rank, left, end))
    return [word[i:e] for i, e in enumerate(ends) if e]


def _merged_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    tokens, rank, never = [word[i : i + 1] for i in range(len(word))], ranks.get, float("inf")
    joined = [rank(word[i : i + 2], never) for i in range(len(word) - 1)]
    while joined and (best := min(joined)) != never:
        at = joined.index(best)
        tokens[at] += tokens.pop(at + 1)
        del joined[at]
        if at:
            joined[at - 1] = rank(tokens[at - 1] + tokens[at], never)
        if at < len(joined):
            joined[at] = rank(tokens[at] + tokens[at + 1], never)
    return tokens


# ---- frequent words, in Spark


def frequent_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = FREQUENT_WORDS) -> dict[str, bytes]:
    """Ids of the most frequent words of all texts, at most ``most`` of at most 64 bytes each.

    Counted over the whole corpus. Words enter by steps of their count, so that only a short
    histogram and the chosen words come to the driver.
    """
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit("(?U)" + pattern), F.lit(0))
    words = texts.select(F.explode(found).alias("word")).where(F.octet_length("word") <= KEPT_BYTES)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Sixteen steps for each doubling of the count: 1,024 rows at most.
    counted = stored(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")), "word-counts")
    room, least = most, None
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, step
    if least is None:
        return {}
    chosen = counted.where(F.col("step") >= least).select("word")
    rows = with_ids(chosen, ranks).collect()
    return {r.word: np.array(r.ids, "<i4").tobytes() for r in rows}


def with_ids(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) of distinct words, merged by a fold of array functions with the ranks as a literal."""
    table = rank_literal(words.sparkSession, ranks)
    word = F.col("word").cast("binary")
    return words.select("word", _let(table, lambda t: word_ids(t, word)).alias("ids"))


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranks as a constant: an array of slots by crc32 of the token, each with its few tokens."""
    slots: list[list[dict]] = [[] for _ in range(_SLOTS)]
    for token, rank in ranks.items():
        slots[zlib.crc32(token) % _SLOTS].append({"k": base64.b64encode(token).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<k:binary,r:int>>>")


def word_ids(table: Column, word: Column) -> Column:
    """Ids of one binary ``word``.

    The fold's state has, for each token, the rank of joining it to the next one (null: no
    rank) and its first byte. There are fewer joins than bytes, and once nothing can be
    joined the state stays as it is.
    """
    size = F.octet_length(word)
    single = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(F.when(i < size, _rank(table, F.substring(word, i, F.lit(2)))).alias("r"), i.alias("s")),
    )
    tokens = F.aggregate(F.sequence(F.lit(1), size), single, lambda state, _: _joined(table, word, size, state))
    starts = F.transform(tokens, lambda t: t["s"])
    ids = F.zip_with(
        starts,
        F.slice(starts, 2, size),
        lambda s, e: _rank(table, F.substring(word, s, F.coalesce(e, size + 1) - s)),
    )
    return F.when(size > 0, ids).otherwise(F.array().cast("array<int>"))


def _joined(table: Column, word: Column, size: Column, state: Column) -> Column:
    """One step: the lowest rank's leftmost pair becomes one token."""
    start = lambda i: F.coalesce(F.get(state, i)["s"], size + 1)

    def at(i: Column) -> Column:
        behind = start(i + 1)
        left = F.struct(_rank(table, F.substring(word, start(i - 2), behind - start(i - 2))).alias("r"), start(i - 2).alias("s"))
        here = _rank(table, F.substring(word, start(i - 1), start(i + 2) - start(i - 1)))
        here = F.struct(F.when(behind <= size, here).alias("r"), start(i - 1).alias("s"))
        return F.concat(
            F.slice(state, 1, F.greatest(i - 2, F.lit(0))),
            F.when(i > 1, F.array(left, here)).otherwise(F.array(here)),
            F.slice(state, i + 2, F.greatest(F.size(state) - i - 1, F.lit(0))),
        )

    best = F.array_min(F.filter(state, lambda t: t["r"].isNotNull()))
    return F.when(best.isNull(), state).otherwise(_let(F.array_position(state, best).cast("int"), at))


def _rank(table: Column, token: Column) -> Column:
    slot = F.get(table, (F.crc32(token) % _SLOTS).cast("int"))
    return F.aggregate(slot, F.lit(None).cast("int"), lambda found, e: F.when(e["k"] == token, e["r"]).otherwise(found))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once however often it is named there."""
    return F.transform(F.array(value), use)[0]
