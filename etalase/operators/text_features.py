"""Feature vectors from product texts."""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.sources.workspace import materialize

DIMENSIONS = 64


def text_features(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(product_id, features_vector)`` from ``product_id`` and ``text``, row by row.

    Words are hashed into ``dimensions`` places; a place holds the number of its
    words times the logarithm of how rare the place is among the texts. A text
    without words gets the zero vector. Each row is a text of its own, also where
    an id repeats. Only one count per place is exchanged between tasks.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def place(word: Column) -> Column:
        prefix = F.substring(F.md5(word.cast("binary")), 1, 8)
        return F.pmod(F.conv(prefix, 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")

    placed = texts.select("product_id", F.transform(found, place).alias("places"))
    places = F.coalesce("places", F.array().cast("array<int>"))
    placed = placed.select("product_id", places.alias("places"))
    placed = placed.select("product_id", F.sort_array("places").alias("places"))
    counts = _dense(_runs("places"), dimensions)
    # Stored, because the texts are cut up once for the counts and the vectors.
    counted = materialize(placed.select("product_id", counts.alias("counts")), "word-places")

    # One row with one number per place.
    held = counted.agg(F.count("*"), *[F.count_if(F.col("counts")[i] > 0) for i in range(dimensions)])
    total, *spread = held.collect()[0]
    rarity = F.array(*[F.lit(math.log((total + 1) / (n + 1))) for n in spread])
    weights = F.zip_with("counts", rarity, lambda n, r: n * r)
    return counted.select("product_id", weights.alias("features_vector"))


def _runs(places: str) -> Column:
    """(place, n) of each distinct value of a sorted array, in one pass over neighbours."""
    numbered = F.transform(places, lambda p, i: F.struct(p.alias("place"), (i + 1).alias("end")))
    # A run ends where the next value is another one, or none.
    ends = F.zip_with(
        numbered,
        F.slice(places, 2, F.size(places)),
        lambda a, b: F.when(b.isNull() | (b != a["place"]), a),
    )

    def lengths(runs: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
        counted = F.zip_with(
            runs, before, lambda r, b: F.struct(r["place"].alias("place"), (r["end"] - b).alias("n"))
        )
        return F.slice(counted, 1, F.size(runs))

    return _let(F.array_compact(ends), lengths)


def _dense(runs: Column, dimensions: int) -> Column:
    """One number per place, 0 where the place has no run."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return _let(
        F.map_from_entries(runs),
        lambda found: F.transform(places, lambda p: F.coalesce(F.try_element_at(found, p), F.lit(0))),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once however often a function inside names it."""
    return F.transform(F.array(value), use)[0]
