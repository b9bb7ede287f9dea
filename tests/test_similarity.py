import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from etalase.functions.vectors import cosine, unit
from etalase.operators import similarity
from etalase.operators.neighbours import nearest, similar_all
from etalase.operators.similarity import similar_products, similar_topk_first

FEATURES = "product_id string, features_vector array<double>"
DETAILS = (
    "product_id string, product_name string, product_price long, stok long, jumlah_terjual long,"
    " rating double, image_srcset string, kategori string, description string"
)


def details(spark, rows):
    """Rows of (id, rating, sold)."""
    full = [(i, f"name {i}", 1, 1, sold, rating, None, "k", "text") for i, rating, sold in rows]
    return spark.createDataFrame(full, DETAILS)


def brute(features, ranks, target, k):
    """Reference ranking in plain Python for unique ids."""
    u = np.array(features[target], dtype="float64")
    found = []
    for other, v in features.items():
        v = np.array(v, dtype="float64")
        lengths = np.linalg.norm(u) * np.linalg.norm(v)
        if other == target or other not in ranks or not lengths:
            continue
        rating, sold = ranks[other]
        c = float(np.float32(u @ v / lengths))
        null_last = (-math.inf if rating is None else rating, -math.inf if sold is None else sold)
        found.append((-c, -null_last[0], -null_last[1], other))
    return [(other, c) for c, _, _, other in sorted(found)[:k]]


def test_cosine_edges(spark):
    rows = [
        ([1.0, 2.0], [2.0, 4.0], 1.0),
        ([1.0, 0.0], [0.0, 3.0], 0.0),
        ([1.0, 1.0], [-1.0, -1.0], -1.0),
        ([0.0, 0.0], [1.0, 1.0], None),
        (None, [1.0, 1.0], None),
        ([float("nan"), 1.0], [1.0, 1.0], None),
    ]
    df = spark.createDataFrame(rows, "u array<double>, v array<double>, c double")
    for row in df.select(cosine(F.col("u"), F.col("v")).alias("got"), "c").collect():
        assert row.got == (None if row.c is None else pytest.approx(row.c))
    units = [r[0] for r in df.select(unit(F.col("u"))).collect()]
    assert units[1] == [1.0, 0.0] and units[3:] == [None, None, None]


def test_cosine_of_different_sizes_fails(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "u array<double>, v array<double>")
    with pytest.raises(PySparkException, match="different size: 1 and 2"):
        df.select(cosine(F.col("u"), F.col("v"))).collect()


def test_ties_go_by_rating_then_sold_then_id(spark):
    ids = ["t", "a", "b", "c", "d", "e"]
    features = spark.createDataFrame([(i, [1.0, 1.0]) for i in ids], FEATURES)
    ranked = details(
        spark, [("a", None, 9), ("b", 4.0, 1), ("c", 4.0, 2), ("d", 4.0, 2), ("e", 5.0, None)]
    )
    got = [r.product_id for r in similar_products(features, ranked, "t").collect()]
    assert got == ["e", "c", "d", "b", "a"]
    every = similar_all(features, ranked).where("query_id = 't'").orderBy("rank")
    assert [r.product_id for r in every.collect()] == got


def test_unknown_id_zero_vector_and_missing_details(spark):
    features = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("x", [2.0, 0.0])],
        FEATURES,
    )
    known = details(spark, [("a", 1.0, 1), ("b", 1.0, 1), ("z", 1.0, 1), ("n", 1.0, 1)])
    assert similar_products(features, known, "nobody").collect() == []
    assert similar_products(features, known, "z").collect() == []
    # x has no details, z and n no direction.
    assert [r.product_id for r in similar_products(features, known, "a").collect()] == ["b"]
    # x takes one of the two places and is lost.
    first = similar_topk_first(features, known, "a", k=2).collect()
    assert [r.product_id for r in first] == ["b"]


def test_repeated_rows_multiply(spark):
    features = spark.createDataFrame(
        [("t", [1.0, 0.0]), ("t", [1.0, 0.0]), ("a", [1.0, 0.1]), ("b", [1.0, 0.2])], FEATURES
    )
    ranked = details(spark, [("a", 1.0, 1), ("a", 2.0, 1), ("b", 1.0, 1)])
    got = [(r.product_id, r.rating) for r in similar_products(features, ranked, "t").collect()]
    assert got == [("a", 2.0)] * 2 + [("a", 1.0)] * 2 + [("b", 1.0)] * 2
    assert len(similar_products(features, ranked, "t", k=3).collect()) == 3


@pytest.mark.parametrize("name", ["products", "topk_first"])
def test_blocks_give_the_same_rows(spark, monkeypatch, name):
    rng = np.random.default_rng(7)
    vectors = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(40)] + [None]
    rows = [(f"p{i % 50}", vectors[rng.integers(41)]) for i in range(160)]
    rows += [("t", vectors[rng.integers(41)]) for _ in range(14)]
    features = spark.createDataFrame(rows, FEATURES)
    known = [(f"p{i}", [None, 4.0, float("nan")][i % 3], i % 4) for i in range(0, 50, 2)] + [("p0", 1.0, 1)]
    ranked = details(spark, known)
    ask = {"products": similar_products, "topk_first": similar_topk_first}[name]
    got = []
    for few, block, tile in ((16, 16_384, 1024), (0, 16_384, 1024), (0, 50, 7)):
        for what, value in (("FEW", few), ("BLOCK_ROWS", block), ("TILE_ROWS", tile)):
            monkeypatch.setattr(similarity, what, value)
        rows = ask(features, ranked, "t", k=25).drop("rating").collect()
        got.append([tuple(r) for r in rows])
    assert got[0] == got[1] == got[2] and len(got[0]) > 10


def test_a_third_of_the_rows_under_one_id(spark):
    vector = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(F.col("id") * 0.37 + i * (F.col("id") % 11 + 1)))
    name = F.when(F.col("id") % 3 == 0, F.lit("t")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string")))
    features = spark.range(60_000).select(name.alias("product_id"), vector.alias("features_vector"))
    ranked = features.where("product_id <> 't'").select(
        "product_id", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in DETAILS.split(", ")[1:]]
    )
    assert similar_products(features, ranked, "t").count() == 10


def test_blocks_refuse_vectors_of_different_size(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 0)
    features = spark.createDataFrame([("t", [1.0]), ("a", [1.0, 2.0])], FEATURES)
    with pytest.raises(ValueError, match="different size: 1 and 2"):
        similar_topk_first(features, details(spark, []), "t")


def test_target_with_many_vectors_ranks_each_of_them(spark):
    rng = np.random.default_rng(5)
    rows = [("t", [float(x) for x in rng.normal(size=4)]) for _ in range(60)]
    rows += [(f"p{i}", [float(x) for x in rng.normal(size=4)]) for i in range(30)] + [rows[0]]
    features = spark.createDataFrame(rows, FEATURES)
    known = {f"p{i}": (float(i % 3), i) for i in range(0, 30, 2)}
    ranked = details(spark, [(i, *v) for i, v in known.items()])

    def cosine_of(u, v):
        return float(np.float32(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))))

    pairs = [(cosine_of(u, v), i) for t, u in rows if t == "t" for i, v in rows if i != "t"]
    wanted = sorted(((c, *known[i], i) for c, i in pairs if i in known), key=lambda x: (-x[0], -x[1], -x[2], x[3]))
    full = similar_products(features, ranked, "t", k=40).collect()
    assert [r.product_id for r in full] == [x[3] for x in wanted[:40]]
    first = similar_topk_first(features, ranked, "t", k=40).collect()
    top = sorted(pairs, key=lambda x: (-x[0], x[1]))[:40]
    assert [r.product_id for r in first] == [i for _, i in top if i in known]


def test_a_row_without_details_and_another_size_is_an_error(spark):
    features = spark.createDataFrame([("t", [1.0, 0.0]), ("a", [1.0, 1.0]), ("x", [1.0])], FEATURES)
    with pytest.raises(PySparkException, match="different size"):
        similar_products(features, details(spark, [("a", 1.0, 1)]), "t").collect()


def clustered(rng, count, size):
    centres = rng.normal(size=(6, size))
    vectors = centres[rng.integers(0, 6, count)] + 0.05 * rng.normal(size=(count, size))
    # A third of all rows are copies of one vector, and some are scaled copies.
    vectors[rng.random(count) < 0.34] = vectors[0]
    vectors[1] = 3 * vectors[0]
    return {f"p{i:04d}": [float(x) for x in v] for i, v in enumerate(vectors)}


@pytest.mark.parametrize(("block_rows", "cell_rows"), [(1000, 10**6), (16, 10**6), (16, 40), (7, 20)])
def test_similar_all_equals_brute_force(spark, block_rows, cell_rows):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 300, 8)
    vectors["zero"] = [0.0] * 8
    ranks = {
        i: (float(rng.integers(0, 3)) if n % 7 else None, int(rng.integers(0, 3)))
        for n, i in enumerate(vectors)
        if n % 11
    }
    features = spark.createDataFrame(list(vectors.items()), FEATURES)
    known = details(spark, [(i, *r) for i, r in ranks.items()])
    got = {}
    for row in similar_all(features, known, 5, block_rows, cell_rows).orderBy("rank").collect():
        got.setdefault(row.query_id, []).append((row.product_id, row.cosine_similarity))
    assert set(got) == set(vectors) - {"zero"}
    for target, rows in got.items():
        wanted = brute(vectors, ranks, target, 5)
        # Cosines that differ in the last bit may change places; values may not.
        assert [c for _, c in rows] == pytest.approx([-c for _, c in wanted], abs=2e-7)
        exact = [i for i, c in rows if c < 0.999]
        assert exact == [i for i, c in wanted if -c < 0.999]


def test_copies_are_ranked_by_ties_in_cells_too(spark):
    vectors = {f"p{i:03d}": [1.0, 0.0] if i % 3 else [0.0, 1.0 + i] for i in range(120)}
    ranks = {i: (float(n % 5), n) for n, i in enumerate(vectors)}
    features = spark.createDataFrame(list(vectors.items()), FEATURES)
    known = details(spark, [(i, *r) for i, r in ranks.items()])
    got = {}
    for row in similar_all(features, known, 4, 8, 10).orderBy("rank").collect():
        got.setdefault(row.query_id, []).append(row.product_id)
    for target in vectors:
        assert got[target] == [i for i, _ in brute(vectors, ranks, target, 4)]


def test_far_cells_are_skipped(spark):
    from etalase.operators import neighbours

    centres = np.eye(8)
    rng = np.random.default_rng(1)
    vectors = centres[np.arange(400) % 8] + 0.01 * rng.normal(size=(400, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    queries = spark.createDataFrame(
        [(f"q{i}", v.tolist(), int(i % 8), 0.99) for i, v in enumerate(vectors)],
        "query string, unit array<double>, cell int, worst double",
    )
    away = neighbours._other_cells(queries, centres, np.full(8, 0.1))
    assert away.count() == 0


def test_a_vector_is_sent_once_per_block_however_small_the_cells(spark):
    from etalase.operators import neighbours

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    cells = 60
    homes = (vectors @ vectors[:cells].T).argmax(axis=1)
    rows = np.bincount(homes, minlength=cells)
    order = neighbours._chain(vectors[:cells])
    first, parts = neighbours._layout(rows, order, 100)
    assert sorted(order) == list(range(cells)) and max(rows[first == b].sum() for b in set(first)) <= 100
    queries = spark.createDataFrame(
        [(f"q{i}", v.tolist(), int(homes[i]), None) for i, v in enumerate(vectors)],
        "query string, unit array<double>, cell int, worst double",
    )
    away = neighbours._other_cells(queries, vectors[:cells], np.full(cells, np.pi), (first, parts)).collect()
    blocks = set(first.tolist())
    assert len(away) == 400 and len(blocks) <= 8
    for row in away:
        assert set(row.blocks) == blocks - {int(first[homes[int(row.query[1:])]])}


@pytest.mark.parametrize(("tile", "block_rows"), [(2048, 2048), (7, 5), (16, 300)])
def test_a_pair_of_blocks_equals_brute_force(monkeypatch, tile, block_rows):
    from etalase.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
    rng = np.random.default_rng(5)
    unit = rng.integers(-2, 3, size=(120, 4)).astype(float)  # few directions, so many ties
    unit = unit[np.linalg.norm(unit, axis=1) > 0]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    pivots = unit[:6]
    cell = (unit @ pivots.T).argmax(axis=1)
    radii = np.array([np.arccos(np.clip((unit @ pivots.T)[cell == c, c], -1, 1)).max() for c in range(6)])
    names = [f"p{i:03d}" for i in range(len(unit))]
    rating = [None if i % 7 == 0 else float(i % 3) for i in range(len(unit))]
    held = pa.table({"product_id": names, "unit": unit.tolist(), "rating": rating, "sold": [float(i % 2) for i in range(len(unit))], "cell": pa.array(cell, pa.int32())})
    cosines = (unit @ unit.T).astype("float32")
    worst = [None if i % 3 == 0 else float(np.sort(cosines[i])[-4]) for i in range(len(unit))]
    asked = pa.table({"query": names, "unit": unit.tolist(), "worst": pa.array(worst, pa.float32())})
    got = {}
    for row in neighbours._block_best(asked, held, 4, block_rows, pivots, radii).to_pylist():
        got.setdefault(row["query"], []).append((round(row["c"], 5), row["product_id"]))
    for i, name in enumerate(names):
        order = sorted(range(len(unit)), key=lambda j: (-round(float(cosines[i, j]), 5), rating[j] is None, -(rating[j] or 0), -(j % 2), j))
        least = -2 if worst[i] is None else worst[i]
        wanted = [round(float(cosines[i, j]), 5) for j in order[:4] if cosines[i, j] >= least - 1e-6]
        assert sorted((c for c, _ in got[name]), reverse=True) == pytest.approx(wanted, abs=2e-5)


def test_a_pair_of_full_blocks_needs_little_memory():
    import tracemalloc

    from etalase.operators import neighbours

    rng = np.random.default_rng(6)
    rows = neighbours.SENT_NUMBERS // 64
    unit = rng.normal(size=(rows, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), 64).cast(pa.list_(pa.float64()))
    names = pa.array([str(i) for i in range(rows)])
    zeros = pa.array(np.zeros(rows))
    held = pa.table({"product_id": names, "unit": vectors, "rating": zeros, "sold": zeros, "cell": pa.array(np.zeros(rows, "int32"))})
    asked = pa.table({"query": names, "unit": vectors, "worst": pa.nulls(rows, pa.float32())}).slice(0, rows // 8)
    tracemalloc.start()
    found = neighbours._block_best(asked, held, 11, neighbours.BLOCK_ROWS, unit[:1], np.array([np.pi]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 11 * (rows // 8) and peak < 200e6
    assert pc.max(found["c"]).as_py() == pytest.approx(1.0)


def test_large_cells_have_blocks_of_their_own():
    from etalase.operators import neighbours

    first, parts = neighbours._layout(np.array([5, 250, 0, 30, 80]), [0, 1, 2, 3, 4], 100)
    assert first.tolist() == [0, 1, 4, 4, 5] and parts.tolist() == [1, 3, 1, 1, 1]


def test_similar_all_refuses_repeated_ids(spark):
    features = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], FEATURES)
    with pytest.raises(ValueError, match="repeated product_id: a"):
        similar_all(features, details(spark, []))


def test_similar_all_on_small_tables(spark):
    none = details(spark, [])
    features = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], FEATURES)
    known = details(spark, [("a", float("nan"), 1), ("b", 5.0, 1), ("c", 5.0, 1)])
    assert similar_all(features, none).collect() == []
    assert similar_all(features.where("false"), known).collect() == []
    pairs = [(r.query_id, r.rank, r.product_id) for r in similar_all(features, known).collect()]
    assert sorted(pairs) == [("a", 1, "b"), ("b", 1, "a")]


def test_nan_rating_ranks_first_in_both(spark):
    features = spark.createDataFrame([(i, [1.0, 1.0]) for i in "tabc"], FEATURES)
    known = details(spark, [("a", 5.0, 1), ("b", float("nan"), 1), ("c", None, 1)])
    one = [r.product_id for r in similar_products(features, known, "t").collect()]
    every = similar_all(features, known).where("query_id = 't'").orderBy("rank").collect()
    assert one == [r.product_id for r in every] == ["b", "a", "c"]


def test_similar_all_of_different_sizes_fails(spark):
    features = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], FEATURES)
    with pytest.raises(PySparkException, match="different size"):
        similar_all(features, details(spark, [("a", 1.0, 1), ("b", 1.0, 1)])).collect()


def test_nearest_keeps_k_of_equal_rows(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, unit array<double>")
    corpus = spark.createDataFrame(
        [("a", [1.0, 0.0], None, None)] * 5 + [("b", [0.0, 1.0], 1.0, 1.0)],
        "product_id string, unit array<double>, rating double, sold double",
    )
    hits = nearest(queries, corpus, 3).collect()[0].hits
    assert [h.product_id for h in hits] == ["a", "a", "a"]
