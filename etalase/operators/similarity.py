"""Products most similar to one product."""

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalase.functions.vectors import cosine
from etalase.operators.neighbours import _matrix
from etalase.schemas import SIMILAR
from etalase.sources.workspace import materialize

# Vectors of one product that the query names as constants, where the other rows are read.
FEW = 16
# Rows of a block, and of a tile that is compared at a time.
BLOCK_ROWS = 16_384
TILE_ROWS = 1024


def similar_products(
    features: DataFrame, details: DataFrame, product_id: str, k: int = 10
) -> DataFrame:
    """The ``k`` products closest to ``product_id`` that have a detail row.

    Order: similarity, rating, units sold (all descending), then id. An unknown
    id gives no rows. Vectors without a direction are no neighbours. Ids that repeat in
    either table multiply, as in a join.
    """
    # Rank on the narrow columns first, then fetch the wide ones of the winners.
    winners = _nearest(features, product_id, k, details).drop("rating", "jumlah_terjual").distinct()
    # At most k rows, so the broadcast has a fixed size bound.
    return _ranked(F.broadcast(winners), details, k).select(*SIMILAR)


def similar_topk_first(
    features: DataFrame, details: DataFrame, product_id: str, k: int = 10
) -> DataFrame:
    """The ``k`` closest vectors first, then their details.

    A neighbour without a detail row still takes one of the ``k`` places, so
    fewer rows may come back.
    """
    top = _nearest(features, product_id, k, None).select("product_id", "cosine_similarity")
    # At most k rows.
    return (
        details.select("product_id", "product_price", "product_name")
        .join(F.broadcast(top), "product_id")
        .orderBy(F.desc("cosine_similarity"), F.asc("product_id"))
    )


def _nearest(features: DataFrame, product_id: str, k: int, details: DataFrame | None) -> DataFrame:
    """The ``k`` best pairs of another row and one of the product's vectors, narrow columns only.

    A product with a few vectors meets the others where they are read; one with many, which
    may be a third of the table, meets them block by block. With ``details`` a pair needs a
    detail row and ranks by its columns too. ``_row`` and ``_pair`` tell equal pairs apart.
    """
    mine = features.where((F.col("product_id") == product_id) & F.col("features_vector").isNotNull())
    first = mine.select(F.col("features_vector").cast("array<double>").alias("vector")).limit(FEW + 1).collect()
    if not first:
        # Nothing to compare with; the columns stay.
        features = features.limit(0)
    if len(first) <= FEW:
        pairs = score(features, product_id, [row.vector for row in first], k)
        pairs = pairs.withColumns({"_row": F.monotonically_increasing_id(), "_pair": F.lit(0).cast("long")})
        pairs = _with_keys(pairs, details)
    else:
        pairs = _block_pairs(features, product_id, k, details)
    return _top(pairs, k)


def _with_keys(rows: DataFrame, details: DataFrame | None) -> DataFrame:
    if details is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in ("rating", "jumlah_terjual")})
    return rows.join(details.select("product_id", "rating", "jumlah_terjual"), "product_id")


def _block_pairs(features: DataFrame, product_id: str, k: int, details: DataFrame | None) -> DataFrame:
    """The ``k`` best pairs of every block of other rows and block of the product's vectors."""
    vector = F.col("features_vector").cast("array<double>").alias("vector")
    rows = features.select("product_id", vector).where(F.col("vector").isNotNull())
    same = F.col("product_id") == product_id
    copies = F.least(F.count("*"), F.lit(k)).cast("long").alias("copies")
    targets = rows.where(same).groupBy("vector").agg(copies)
    targets = materialize(targets.withColumn("target", F.monotonically_increasing_id()), "target-vectors")
    low, high, others = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count_if(~same)).collect()[0]
    if low != high:
        raise ValueError(f"vectors of different size: {low} and {high}")
    t_blocks, o_blocks = (max(1, -(-n // BLOCK_ROWS)) for n in (targets.count(), others))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, every)

    held = rows.where(~same).withColumn("_row", F.monotonically_increasing_id())
    held = _with_keys(held, details).withColumns(
        {c: F.col(c).cast("double") for c in ("rating", "jumlah_terjual")}
    )
    left = dealt(targets, "target", "tb", t_blocks, "ob", o_blocks).groupBy("tb", "ob")
    right = dealt(held, "_row", "ob", o_blocks, "tb", t_blocks).groupBy("tb", "ob")

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _best_pairs(asked, held, k)

    return left.cogroup(right).applyInArrow(best, _PAIR)


_PAIR = "product_id string, cosine_similarity float, rating double, jumlah_terjual double, _row long, _pair long"


def _best_pairs(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """Best pairs of two blocks, tile by tile; only the ``k`` best so far are kept."""
    rating = pc.if_else(pc.is_nan(held["rating"]), float("inf"), held["rating"])
    order = pc.sort_indices(
        pa.table([rating, held["jumlah_terjual"], held["product_id"]], names=["rating", "sold", "id"]),
        sort_keys=[("rating", "descending"), ("sold", "descending"), ("id", "ascending")],
        null_placement="at_end",
    )
    held = held.take(order)
    best = np.empty(0, "float32"), np.empty(0, "int64"), np.empty(0, "int64")
    if asked.num_rows and held.num_rows:
        ours, theirs = _matrix(asked["vector"]), _matrix(held["vector"])
        lengths = np.linalg.norm(ours, axis=1), np.linalg.norm(theirs, axis=1)
        for i in range(0, len(ours), TILE_ROWS):
            for j in range(0, len(theirs), TILE_ROWS):
                mine, other = slice(i, i + TILE_ROWS), slice(j, j + TILE_ROWS)
                with np.errstate(all="ignore"):
                    tile = ours[mine] @ theirs[other].T
                    tile = (tile / np.outer(lengths[0][mine], lengths[1][other])).astype("float32").ravel()
                able = np.flatnonzero(np.isfinite(tile))
                if len(able) > k:
                    least = np.partition(tile[able], len(able) - k)[len(able) - k]
                    able = able[tile[able] >= least]
                width = len(theirs[other])
                best = [np.concatenate(c) for c in zip(best, (tile[able], j + able % width, i + able // width), strict=True)]
                first = np.lexsort((best[2], best[1], -best[0]))[:k]
                best = [c[first] for c in best]
    # A vector that the product has several times counts as often.
    again = np.repeat(np.arange(len(best[0])), asked["copies"].to_numpy()[best[2]])[:k]
    similarity, row, target = (c[again] for c in best)
    copy = np.arange(len(again)) - np.searchsorted(again, again)
    chosen = held.take(pa.array(row))
    columns = [
        chosen["product_id"],
        pa.array(similarity),
        chosen["rating"],
        chosen["jumlah_terjual"],
        chosen["_row"],
        pa.array(asked["target"].to_numpy()[target] * k + copy),
    ]
    return pa.table(columns, names=[f.split()[0] for f in _PAIR.split(", ")])


def score(features: DataFrame, product_id: str, vectors: list[list[float]], k: int = 10) -> DataFrame:
    """Similarity of the other feature rows to the given few vectors of one product.

    One row per other row and given vector; copies of a vector beyond ``k`` cannot change a
    list of ``k`` rows and are left out. Any other row whose vector has a different size is an
    error, whether or not it has a detail row.
    """
    copies = Counter(map(tuple, vectors))
    targets = [
        F.struct(
            F.array(*map(F.lit, vector)).cast("array<double>").alias("vector"),
            F.lit(_norm(vector)).alias("norm"),
            F.lit(min(n, k)).alias("copies"),
        )
        for vector, n in copies.items()
    ]
    rows = features.where(F.col("product_id") != product_id)
    rows = rows.withColumn("_target", F.explode(F.array(*targets))) if targets else rows.withColumn(
        "_target", F.lit(None).cast("struct<vector:array<double>,norm:double,copies:int>")
    )
    similarity = cosine(F.col("_target.vector"), F.col("features_vector"), F.col("_target.norm"))
    scored = rows.select("product_id", similarity.alias("cosine_similarity"), "_target.copies")
    again = F.explode(F.sequence(F.lit(1), "copies"))
    return scored.select("product_id", "cosine_similarity", again.alias("_copy")).drop("_copy")


def _norm(vector: Iterable[float]) -> float:
    """As the column expression adds it up: from left to right, in double precision."""
    total = 0.0
    for x in vector:
        total += math.nan if x is None else x * x
    return math.sqrt(total)


def _ranked(scored: DataFrame, details: DataFrame, k: int) -> DataFrame:
    return _top(scored.join(details, "product_id"), k)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    return (
        pairs.orderBy(
            F.desc_nulls_last("cosine_similarity"),
            F.desc_nulls_last("rating"),
            F.desc_nulls_last("jumlah_terjual"),
            F.asc("product_id"),
        )
        .limit(k)
        # Nulls rank last; filtered here, the similarity is worked out only once.
        .where(F.col("cosine_similarity").isNotNull())
    )
