"""Nearest neighbours of many vectors at once, exact.

The cost of an exact answer is the number of vector pairs compared. Pairs are
never rows: they exist only as matrix products within a pair of bounded blocks,
and each block pair gives back its best ``k`` per query. Cells around sampled
pivots let parts of blocks, and whole blocks, be skipped by the triangle
inequality of angles. How often a vector is sent depends on the blocks alone,
however small the cells are.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etalase.functions.vectors import unit
from etalase.sources.workspace import materialize

# Corpus rows that are compared, or skipped, at a time; with a tile of queries about 100 MB.
BLOCK_ROWS = 2048
# Queries that are compared at a time.
TILE_ROWS = 2048
# Numbers of the vectors that travel together, 16 MB: it bounds a task's memory.
SENT_NUMBERS = 2**21
CELL_ROWS = 32_768
# Pivots that every task holds; beyond MAX_PIVOTS * CELL_ROWS vectors cells grow.
MAX_PIVOTS = 4096
# Similarities are compared as floats, so a bound must allow for their rounding.
SLACK = 1e-6

_HIT = "query string, c float, rating double, sold double, product_id string"


def similar_all(
    features: DataFrame,
    details: DataFrame,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """The ``k`` most similar products of every product, ranked from 1.

    Same order as ``similar_products``: similarity, rating, units sold, id. Both
    tables must have one row per product id; a repeated id is an error.
    """
    keys = materialize(tie_keys(details), "tie-keys")
    _require_unique(keys)
    _require_unique(features)
    rows = features.select("product_id", unit(F.col("features_vector")).alias("unit"))
    rows = rows.where(F.col("unit").isNotNull()).withColumns(_print())
    # Copies of a vector have the same neighbours up to themselves: look up each
    # distinct vector once, with one spare place for the product itself.
    distinct = rows.groupBy(*_PRINT).agg(
        F.min("product_id").alias("query"), F.min_by("unit", "product_id").alias("unit")
    )
    distinct = materialize(distinct, "distinct-vectors")
    corpus = rows.drop(*_PRINT).join(keys, "product_id")
    lists = nearest(distinct.select("query", "unit"), corpus, k + 1, block_rows, cell_rows, max_pivots)
    asked = rows.drop("unit").join(distinct.drop("unit"), list(_PRINT)).drop(*_PRINT)
    others = F.filter("hits", lambda hit: hit.product_id != F.col("product_id"))
    return (
        asked.join(lists, "query")
        .select("product_id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
        .select(
            F.col("product_id").alias("query_id"),
            (F.col("place") + 1).alias("rank"),
            F.col("hit.product_id").alias("product_id"),
            F.col("hit.c").alias("cosine_similarity"),
        )
    )


# Two hashes stand for a vector where rows meet by it: 128 bits instead of the numbers.
_PRINT = ("_print", "_print2")


def _print() -> dict[str, Column]:
    return {_PRINT[0]: F.xxhash64("unit"), _PRINT[1]: F.xxhash64(F.lit(1), "unit")}


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``(query, hits)``: the best ``k`` corpus rows of every query, best first.

    ``queries`` has a text ``query`` and a unit vector ``unit``; ``corpus`` has
    ``product_id``, ``unit``, ``rating`` and ``sold``.
    """
    # No query needs more than k rows with the same vector. The rank limit is
    # applied before the shuffle too, so a much repeated vector stays small.
    same_vector = Window.partitionBy(*_PRINT).orderBy(*_ties())
    corpus = corpus.select("product_id", "unit", "rating", "sold").withColumns(_print())
    corpus = corpus.withColumn("_n", F.row_number().over(same_vector)).where(F.col("_n") <= k)
    corpus = materialize(corpus.drop("_n", *_PRINT), "corpus")
    rows = corpus.count()
    pivots = _pivots(corpus, min(max(1, -(-rows // cell_rows)), max_pivots))
    if not len(pivots):
        return _best(corpus.select(F.lit("").alias("query"), F.lit(0.0).cast("float").alias("c"), "*"), k)

    unknown = F.lit(None).cast("float").alias("worst")
    if len(pivots) == 1:
        # One cell holds all, so there is no other to look in.
        cell = F.lit(0).alias("cell")
        homed, asking = corpus.select("*", cell), queries.select("*", cell)
        held, asked = np.array([rows]), np.array([queries.count()])
        radii = np.array([np.pi])
    else:
        homed = materialize(_with_cell(corpus, pivots), "corpus-cells")
        asking = materialize(_with_cell(queries, pivots), "query-cells")
        # Cells number at most MAX_PIVOTS, so their radii and sizes are a bounded result.
        held, radii = _sizes(homed, len(pivots))
        asked, _ = _sizes(asking, len(pivots))

    sent = _sent_rows(homed.sparkSession, max(held.sum(), asked.sum()), pivots.shape[1], block_rows)
    order = _chain(pivots)
    places = _layout(held, order, sent)
    homed = _dealt(homed, places, "cb", "product_id", "unit")
    asking = _placed(_dealt(asking, _layout(asked, order, sent), "qb", "query"), places)
    own = F.sequence("_first", F.col("_first") + F.col("_parts") - 1).alias("blocks")
    near = _compare(asking.select("query", "unit", "qb", unknown, own), homed, k, block_rows, pivots, radii)
    if len(pivots) == 1:
        return _best(near, k)

    near = materialize(_top(near, k).drop("place"), "near")
    # The k-th best so far bounds how far away a better one can be.
    reach = near.groupBy("query").agg(F.count("*").alias("_found"), F.min("c").alias("_worst"))
    reach = reach.select("query", F.when(F.col("_found") >= k, F.col("_worst")).alias("worst"))
    # Which query must look in which block; a block has whole cells or a part of one.
    bounded = asking.select("query", "unit", "cell", "qb").join(reach, "query", "left")
    away = materialize(_other_cells(bounded, pivots, radii, places), "away")
    far = _compare(away, homed, k, block_rows, pivots, radii)
    return _best(near.unionByName(far), k)


def _sizes(df: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and widest angle of every cell."""
    rows, radii = np.zeros(cells, "int64"), np.full(cells, -np.inf)
    for cell, count, radius in df.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
        rows[cell], radii[cell] = count, radius
    return rows, radii


def _sent_rows(spark: SparkSession, rows: int, size: int, block_rows: int) -> int:
    """Rows per block: enough pairs of blocks for all cores, within what a task may hold."""
    side = int(np.ceil(np.sqrt(3 * spark.sparkContext.defaultParallelism)))
    return int(max(1, min(SENT_NUMBERS // max(size, 1), max(block_rows, -(-rows // side)))))


def _chain(pivots: np.ndarray) -> list[int]:
    """The cells, each followed by the nearest one left, so that blocks hold neighbours."""
    order, free = [0], np.ones(len(pivots), bool)
    for _ in range(len(pivots) - 1):
        free[order[-1]] = False
        order.append(int(np.where(free, pivots @ pivots[order[-1]], -np.inf).argmax()))
    return order


def _layout(rows: np.ndarray, order: list[int], sent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and the number of its blocks.

    Small cells share a block, a large one has several for itself.
    """
    parts = np.maximum(1, -(-rows // sent))
    first = np.zeros(len(rows), "int64")
    block = filled = 0
    for cell in order:
        if filled and filled + rows[cell] > sent:
            block, filled = block + 1, 0
        first[cell] = block
        filled += rows[cell]
        if parts[cell] > 1:
            block, filled = block + parts[cell], 0
    return first, parts


def _placed(df: DataFrame, places: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with the first block of their cell and the number of its blocks."""
    rows = [(n, int(first), int(parts)) for n, (first, parts) in enumerate(zip(*places, strict=True))]
    if len(rows) == 1:
        return df.withColumns({"_first": F.lit(rows[0][1]), "_parts": F.lit(rows[0][2])})
    # One row per cell, so at most MAX_PIVOTS rows are broadcast.
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, "cell int, _first int, _parts int")), "cell")


def _dealt(df: DataFrame, places: tuple[np.ndarray, np.ndarray], name: str, *key: str) -> DataFrame:
    """Rows with the number of their block."""
    part = F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")
    return _placed(df, places).withColumn(name, F.col("_first") + part).drop("_first", "_parts")


def tie_keys(details: DataFrame) -> DataFrame:
    """What ranks equally similar products; NaN counts as the highest rating."""
    rating = F.nanvl(F.col("rating").cast("double"), F.lit(float("inf")))
    return details.select(
        "product_id", rating.alias("rating"), F.col("jumlah_terjual").cast("double").alias("sold")
    )


def _require_unique(df: DataFrame) -> None:
    """Stop on a repeated id; reads the id column only."""
    repeated = df.groupBy("product_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated product_id: {repeated[0].product_id}")


def _ties() -> list[Column]:
    return [F.desc_nulls_last("rating"), F.desc_nulls_last("sold"), F.asc("product_id")]


def _top(hits: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query").orderBy(F.desc("c"), *_ties())
    return hits.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """At most k rows per query are left when they are collected into a list."""
    top = _top(hits.select("query", "c", "rating", "sold", "product_id"), k)
    listed = F.sort_array(F.collect_list(F.struct("place", "product_id", "c")))
    return top.groupBy("query").agg(listed.alias("hits"))


def _pivots(corpus: DataFrame, wanted: int) -> np.ndarray:
    """Vectors spread like the data; at most MAX_PIVOTS, so the driver can hold them."""
    picked = corpus.orderBy(F.xxhash64("product_id"), "product_id").select("unit").limit(wanted)
    return np.unique(np.array([row.unit for row in picked.collect()]), axis=0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different size: {sorted(sizes.to_pylist())}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _slices(batches, rows: int = 1024):
    """Smaller batches: each row meets every pivot in one matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in _slices(batches):
            cosines = _matrix(batch.column("unit")) @ shared.value.T
            cell = cosines.argmax(axis=1)
            best = np.clip(cosines[np.arange(len(cell)), cell], -1.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("int32")), pa.array(np.arccos(best))],
                names=[*batch.schema.names, "cell", "angle"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(assign, f"{fields}, cell int, angle double")


def _may_hold(units: np.ndarray, worst: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which query (row) could have a better hit in which cell (column)."""
    limit = np.where(np.isnan(worst), -1.0, np.maximum(worst - SLACK, -1.0))
    angles = np.arccos(np.clip(units @ centres.T, -1.0, 1.0))
    return angles - radii <= np.arccos(np.minimum(limit, 1.0))[:, None] + SLACK


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype("float64")


def _other_cells(
    df: DataFrame, pivots: np.ndarray, radii: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """Each query that could have a better hit in another cell, with the blocks of such cells.

    Blocks of its own cell are left out: there it has been compared with every row. Without
    ``places`` each cell is a block.
    """
    places = places or (np.arange(len(pivots)), np.ones(len(pivots), "int64"))
    shared = df.sparkSession.sparkContext.broadcast((pivots, radii, *places))
    columns = [c for c in df.columns if c != "cell"]

    def choose(batches):
        centres, radius, first, parts = shared.value
        # For each block a cell of it; a block with several cells has a run in this list.
        cells = np.repeat(np.arange(len(parts)), parts)
        block = np.repeat(first, parts) + np.arange(len(cells)) - np.repeat(np.cumsum(parts) - parts, parts)
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        numbers = block[order][starts].astype("int32")
        for batch in _slices(batches, 256):
            may = _may_hold(_matrix(batch.column("unit")), _doubles(batch.column("worst")), centres, radius)
            own = batch.column("cell").to_numpy(zero_copy_only=False)
            wanted = np.logical_or.reduceat(may[:, cells[order]], starts, axis=1)
            done = (numbers >= first[own][:, None]) & (numbers < (first + parts)[own][:, None])
            wanted &= ~done
            some = np.flatnonzero(wanted.any(axis=1))
            row, place = np.nonzero(wanted[some])
            ends = np.searchsorted(row, np.arange(len(some) + 1)).astype("int32")
            blocks = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[place]))
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], blocks], names=[*columns, "blocks"])

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.mapInArrow(choose, f"{fields}, blocks array<int>")


def _compare(
    queries: DataFrame, corpus: DataFrame, k: int, block_rows: int, pivots: np.ndarray, radii: np.ndarray
) -> DataFrame:
    """Best ``k`` of every query within each of its corpus blocks.

    ``queries`` has its block ``qb``, the corpus ``blocks`` to look in and the ``worst``
    similarity that may still count; ``corpus`` has its block ``cb`` and its ``cell``.
    """
    left = queries.select("qb", F.explode("blocks").alias("cb"), "query", "unit", "worst")
    # One row per pair of blocks.
    pairs = F.broadcast(left.select("qb", "cb").distinct().toDF("qb", "cb"))
    right = corpus.select("cb", "product_id", "unit", "rating", "sold", "cell").join(pairs, "cb")
    shared = queries.sparkSession.sparkContext.broadcast((pivots, radii))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _block_best(asked, held, k, block_rows, *shared.value)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(best, _HIT)


def _block_best(
    asked: pa.Table, held: pa.Table, k: int, block_rows: int, pivots: np.ndarray, radii: np.ndarray
) -> pa.Table:
    names = ["query", "c", "rating", "sold", "product_id"]
    types = [pa.string(), pa.float32(), pa.float64(), pa.float64(), pa.string()]
    if not asked.num_rows or not held.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    order = pc.sort_indices(
        held.select(["rating", "sold", "product_id"]),
        sort_keys=[("rating", "descending"), ("sold", "descending"), ("product_id", "ascending")],
        null_placement="at_end",
    ).to_numpy()
    size = held.num_rows
    place = np.empty(size, "int64")
    place[order] = np.arange(size)
    cell = held["cell"].to_numpy()
    by_cell = np.argsort(cell, kind="stable")
    ours, theirs = _matrix(asked["unit"]), _matrix(held["unit"])[by_cell]
    if ours.shape[1] != theirs.shape[1]:
        raise ValueError(f"vectors of different size: {ours.shape[1]} and {theirs.shape[1]}")
    cells, starts = np.unique(cell[by_cell], return_index=True)
    worst = _doubles(asked["worst"])
    top = min(k, size)
    found = []
    for i in range(0, len(ours), TILE_ROWS):
        tile, floor = ours[i : i + TILE_ROWS], worst[i : i + TILE_ROWS]
        may = None
        if not np.isnan(floor).all():
            may = _may_hold(tile, floor, pivots[cells], radii[cells])
        floor = np.where(np.isnan(floor), -np.inf, floor).astype("float32")
        found.append(_tile_best(tile, theirs, place[by_cell], top, block_rows, floor, may, starts))
    keys = np.concatenate(found)
    row, column = np.nonzero(keys != _NONE)
    keys = keys[row, column]
    chosen = held.select(["rating", "sold", "product_id"]).take(pa.array(order[size - 1 - keys % size]))
    columns = [
        asked["query"].take(pa.array(row)).cast(types[0]),
        pa.array(_as_cosine(keys // size), types[1]),
        chosen["rating"].cast(types[2]),
        chosen["sold"].cast(types[3]),
        chosen["product_id"].cast(types[4]),
    ]
    return pa.table(columns, names=names)


# Below every key.
_NONE = np.iinfo("int64").min


def _tile_best(
    ours: np.ndarray,
    theirs: np.ndarray,
    place: np.ndarray,
    top: int,
    block_rows: int,
    floor: np.ndarray,
    may: np.ndarray | None,
    starts: np.ndarray,
) -> np.ndarray:
    """The ``top`` best of ``theirs`` for each of ``ours``, as keys, or ``_NONE``.

    A key is one integer per pair that sorts like (cosine, place in tie order). Cosines below
    ``floor`` do not count. ``may`` tells which of ours need look at which cell of theirs,
    the cells beginning at ``starts``.
    """
    size = len(theirs)
    best = np.full((len(ours), top), _NONE)
    floor = floor.copy()
    for begin in range(0, size, block_rows):
        end = min(begin + block_rows, size)
        rows = np.arange(len(ours))
        if may is not None:
            since = np.searchsorted(starts, begin, "right") - 1
            rows = np.flatnonzero(may[:, since : np.searchsorted(starts, end)].any(axis=1))
            if not len(rows):
                continue
        whole = len(rows) == len(ours)
        cosines = ((ours if whole else ours[rows]) @ theirs[begin:end].T).astype("float32") + np.float32(0)
        least = floor[rows]
        if end - begin >= top and np.isneginf(least).any():
            # The k-th best of these alone is a bound already.
            least = np.maximum(least, np.partition(cosines, end - begin - top, axis=1)[:, end - begin - top])
        row, column = np.nonzero(cosines >= least[:, None])
        if not len(row):
            continue
        bits = cosines[row, column].view("int32").astype("int64")
        bits = np.where(bits >= 0, bits, -1 - (bits & 0x7FFFFFFF))
        keys = bits * size + (size - 1 - place[begin + column])
        better, row, counts = np.unique(row, return_inverse=True, return_counts=True)
        added = np.full((len(better), counts.max()), _NONE)
        added[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = keys
        merged = np.concatenate([best[rows[better]], added], axis=1)
        merged = np.partition(merged, added.shape[1], axis=1)[:, added.shape[1] :]
        best[rows[better]] = merged
        last = merged[:, 0]
        bound = np.where(last == _NONE, np.float32(-np.inf), _as_cosine(np.where(last == _NONE, 0, last) // size))
        floor[rows[better]] = np.maximum(floor[rows[better]], bound)
    return best


def _as_cosine(bits: np.ndarray) -> np.ndarray:
    """Back from the sortable integers to the floats they stand for."""
    signed = np.where(bits >= 0, bits, (-1 - bits) | 0x80000000)
    return signed.astype("uint32").view("float32")
