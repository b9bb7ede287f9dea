"""What the operators of this folder share: words, ids, folds and packed arrays."""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalase.sources.workspace import ship_package, work_dir

# A word, as Java, Python and DuckDB patterns.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read back, so its lineage is cut."""
    ship_package(df.sparkSession)
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``. A null id falls into fold 0, which nobody learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(n)), F.lit(0)).cast("int")


def documents_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of the named columns."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered and nothing else changed; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class WordHashes(dict):
    """64-bit hash of each word, kept while the table is small."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


@cache
def word_hashes() -> WordHashes:
    """One table for the life of a Python worker."""
    return WordHashes()


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of a public 64-bit mixer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


PRIME = np.uint64(0x9E3779B97F4A7C15)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes."""
    if len(words) < n:
        return words[:0]
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h *= PRIME
        h += words[i : len(words) - n + 1 + i]
    return mixed(h)
