"""Packing of token pieces into windows, by minimum bin slack.

The tokenizer runs where the text is; only narrow piece rows travel on. Documents longer
than a window are cut into full windows and one rest. Rests are dealt into groups of
bounded size, and each group fills one window after the other: the longest rest opens the
window, a subset-sum over the multiset of the remaining lengths (a bitset per step) finds
the fill closest to the capacity, and walking the bitsets back gives how many pieces of each
length it takes. The same fill is repeated as long as the counts allow.
"""

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import documents_of, stored

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# How the given vocabulary's file says texts are made even and cut.
_EVEN = ["NFC", "Replace", "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_at_blanks(path: str) -> bool:
    """Whether a tokenizer's file has the rules that let words be encoded one by one."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    even = (rules.get("normalizer") or {}).get("normalizers", [])
    cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in even] == _EVEN
        and (even[1]["pattern"], even[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": _CUT}, "Removed", True)
        and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"])
        and rules.get("post_processor") is None
        and rules["model"]["type"] == "BPE"
    )


class PieceIds(dict):
    """Ids of one blank-separated word, as little-endian 32-bit bytes.

    White space never lies inside a piece of the given vocabulary, so a text's ids are those of
    its words in turn. A tokenizer with other rules encodes whole texts. A full table becomes
    the older one, from which words still in use come back; both bound the memory.
    """

    LIMIT = 200_000
    MARK = "\x01"
    LETTERS = re.compile("[a-zß-öø-ÿ]+")  # runs of these are one piece before merging, and even

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.by_word = self.tokenizer, _cuts_at_blanks(path)
        if self.by_word:
            (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        return self.whole(word.decode("utf-8"))

    def learn(self, words: set[bytes]) -> None:
        """Encode the words not yet in the tables, in two calls: those of letters only, and all others."""
        new = [w for w in words if w not in self and len(w) <= 64]
        if len(self) + len(new) > self.LIMIT:
            self.older = dict(self)
            self.clear()
            new = [w for w in words if len(w) <= 64]
        letters, others = ([], []), ([], [])
        for word in new:
            if word in self.older:
                self[word] = self.older[word]
                continue
            text = word.decode("utf-8")
            lower = text.lower()
            keys, texts, text = (*letters, lower) if self.LETTERS.fullmatch(lower) else (*others, text)
            keys.append(word)
            texts.append(text)
        self._learn(self.plain, *letters)
        self._learn(self.tokenizer, *others)

    def _learn(self, tokenizer, words: list[bytes], texts: list[str]) -> None:
        """Encode ``texts`` in one call, kept apart by a mark that no word holds."""
        if not words:
            return
        joined = f" {self.MARK} ".join(texts)
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        raw, begin = ids.tobytes(), 0
        for word, end in zip(words, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
            self[word] = raw[4 * begin : 4 * end]
            begin = end + 1

    # ASCII marks (no apostrophe) between a letter and white space are always tokens of their own.
    TAIL = re.compile(rb"(?<=[a-z])([!-&(-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D])")

    def words(self, text: str) -> list[bytes] | None:
        """Words that are encoded one by one; None if the text must be encoded as a whole."""
        raw = text.encode("utf-8", "surrogatepass")
        if not self.by_word or b"<|" in raw or b"\x01" in raw:  # may hold reserved tokens, which count before any word does
            return None
        if b"\xcc" not in raw and b"\xcd" not in raw:  # no accents that stand alone: lowering first is the same
            raw = raw.lower()
        return self.TAIL.sub(rb" \1", raw).split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; the new words of all of them are learnt together."""
        cut = [self.words(t) for t in texts]
        self.learn(set().union(*(c for c in cut if c)))
        for text, words in zip(texts, cut, strict=True):
            yield self.whole(text) if words is None else b"".join(map(self.__getitem__, words))


@cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def _encoded(rows: Iterator[tuple], table: PieceIds, characters: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Ids of the texts, about a million characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= characters:
            yield from zip(ids, table.encode(texts), strict=True)
            ids, texts, size = [], [], 0
    yield from zip(ids, table.encode(texts), strict=True)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full windows and the rest.

    A null or empty text has one piece, the closing id. Null ids and repeated rows are kept as
    they are: each row is a document of its own. Other columns are ignored.
    """
    step = 4 * capacity
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_ids(tokenizer_path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, raw in _encoded(documents_of(batch, "doc_id", "text"), table):
                raw += closing
                for begin in range(0, len(raw), step):
                    piece = raw[begin : begin + step]
                    for column, value in zip(
                        rows, (doc_id, begin // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4), strict=True
                    ):
                        column.append(value)
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _fill(first: int, left: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the lengths that, with ``first``, come closest to ``capacity``."""
    room = capacity - first
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length, count in left.items():
        if length > room:
            continue
        count = min(count - (length == first), room // length)
        part = 1
        while count > 0 and not reach & full:  # 1, 2, 4, ... copies at a time
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            count -= part
            part *= 2
        if reach & full:
            break
    sought, used = reach.bit_length() - 1, {first: 1}
    for length, part, before in reversed(steps):
        if not before >> sought & 1:
            sought -= length * part
            used[length] = used.get(length, 0) + part
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fills (count by length) and how often each is used, until no length is left."""
    left = dict(sorted(counts.items(), reverse=True))
    while left:
        used = _fill(next(iter(left)), left, capacity)
        times = min(left[length] // n for length, n in used.items())
        yield used, times
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and the offset there; no sequence exceeds ``capacity``.

    An empty table gives no rows. Texts of any length are cut, never dropped. Pieces of the same
    length are taken in the order of (doc_id, start), so a repeated run gives the same result.
    Each group of about ``GROUP_PIECES`` pieces leaves at most one window with real slack.
    """
    pieces = stored(cut(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, round(pieces.count() / GROUP_PIECES))

    def run(group: pa.Table) -> pa.Table:
        doc, start, length = (group.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "length"))
        order = np.lexsort((group.column("ids_crc32").to_numpy(), start, np.nan_to_num(doc.astype(float), nan=-1), length))
        values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
        following = dict(zip(values.tolist(), first.tolist(), strict=True))
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number = 0
        for used, times in minimum_bin_slack(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity):
            at = 0
            for size, n in used.items():
                begin = following[size]
                rows = order[begin : begin + n * times]
                following[size] = begin + n * times
                sequence[rows] = number + np.repeat(np.arange(times), n)
                offset[rows] = at + size * np.tile(np.arange(n), times)
                at += size * n
            number += times
        base = group.column("group")[0].as_py() << 32
        out = group.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    # Rows without an id have no key of their own; copies of one would all meet in a group.
    copy = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", copy), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
