import random
import string

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from etalase.operators import catalog
from etalase.schemas import DETAIL, SUMMARY
from etalase.sources.files import as_records
from plans import plan_text

TYPES = (
    "product_id string, product_name string, product_price long, stok long, jumlah_terjual long,"
    " rating double, image_srcset string, kategori string, brand string, min_pembelian long,"
    " berat_satuan long, dimensi_ukuran string, dikirim_dari string, penjual string,"
    " description string"
)


def products(spark, names):
    rows = [(i, name, 1, 2, None, 4.5, None, "k", "b", 1, 1, "d", "f", "p", "t") for i, name in names]
    return spark.createDataFrame(rows, TYPES)


@pytest.fixture(scope="module")
def ten(spark):
    return products(spark, [(f"p{i}", f"Item {i}") for i in range(10)])


def ids(df):
    return [r.product_id for r in df.collect()]


def test_columns(ten):
    assert catalog.load_catalog(ten).columns == DETAIL
    assert catalog.all_products(ten).columns == SUMMARY


def test_pages_joined_are_the_catalogue(ten):
    pages = [ids(catalog.page(ten, 3, n)) for n in range(1, 6)]
    assert sum(pages, []) == ids(catalog.all_products(ten))
    assert [len(p) for p in pages] == [3, 3, 3, 1, 0]


def test_page_bounds(ten):
    assert ids(catalog.page(ten, 0, 1)) == []
    assert len(ids(catalog.page(ten))) == 10
    for limit, number in [(3, 0), (3, -1), (-5, 1)]:
        with pytest.raises(ValueError):
            catalog.page(ten, limit, number)


def test_page_after_walks_the_catalogue(ten):
    seen, last = [], None
    while rows := ids(catalog.page_after(ten, last, 4)):
        seen += rows
        last = rows[-1]
    assert seen == ids(catalog.all_products(ten))


def test_page_index_with_one_id_on_a_third_of_the_rows(spark):
    names = [(f"p{i:03d}", "x") for i in range(200)] + [("p050", f"copy {i}") for i in range(100)]
    index = catalog.page_index(products(spark, names), 7).orderBy("position").collect()
    assert [r.position for r in index] == list(range(300))
    assert [r.product_id for r in index] == sorted(i for i, _ in names)
    assert all(r.page == r.position // 7 + 1 for r in index)


def test_lookup(ten, spark):
    assert ids(catalog.product_by_id(ten, "p3")) == ["p3"]
    assert ids(catalog.product_by_id(ten, "nobody")) == []
    for missing in ("", None):
        with pytest.raises(ValueError):
            catalog.product_by_id(ten, missing)
    wanted = spark.createDataFrame([("p1",), ("p1",), ("nobody",)], "product_id string")
    assert ids(catalog.products_by_ids(ten, wanted)) == ["p1"]
    assert sorted(ids(catalog.fetch_by_ids(ten, ["p2", "p5", "p5"]))) == ["p2", "p5"]


def test_search_is_a_literal_substring(spark):
    df = products(
        spark,
        [("1", "T-Shirt"), ("2", "cool t-shirt"), ("3", "100% wool"), ("4", None), ("5", ""), ("6", "a_b")],
    )
    assert ids(catalog.search_name(df, "T-SHIRT")) == ["1", "2"]
    assert ids(catalog.search_name(df, "%")) == ["3"]
    assert ids(catalog.search_name(df, "_")) == ["6"]
    assert ids(catalog.search_name(df, "zzz")) == []
    with pytest.raises(ValueError):
        catalog.search_name(df, "")


def matches(names, terms):
    return sorted(
        (term, i) for i, name in names for term in set(terms) if term and name and term.lower() in name.lower()
    )


def test_search_terms_equals_brute_force(spark):
    rng = random.Random(4)
    letters = "abÇ%_é 𝕏"
    names = [(str(i), "".join(rng.choices(letters, k=rng.randint(0, 9)))) for i in range(150)]
    names += [(f"n{i}", "aab") for i in range(80)] + [("null", None)]
    terms = ["".join(rng.choices(letters, k=rng.randint(0, 5))) for _ in range(60)] + [None, "a", "A"]
    df = catalog.search_terms(
        products(spark, names), spark.createDataFrame([(t,) for t in terms], "term string")
    )
    assert sorted((r.term, r.product_id) for r in df.collect()) == matches(names, terms)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(string.ascii_letters + "%_ .\\", max_size=8), min_size=1, max_size=8),
    st.lists(st.text(string.ascii_letters + "%_ .\\", max_size=4), min_size=1, max_size=5),
)
def test_search_terms_property(spark, names, terms):
    named = [(str(i), n) for i, n in enumerate(names)]
    df = catalog.search_terms(
        products(spark, named), spark.createDataFrame([(t,) for t in terms], "term string")
    )
    assert sorted((r.term, r.product_id) for r in df.collect()) == matches(named, terms)


def test_records_keep_nulls(ten):
    record = as_records(catalog.summary(ten).where("product_id = 'p0'")).collect()[0].record
    assert record == (
        '{"product_id":"p0","product_name":"Item 0","product_price":1,"stok":2,'
        '"jumlah_terjual":null,"rating":4.5,"image_srcset":null,"kategori":"k"}'
    )


def test_published_catalogue_is_pruned_by_id(spark, ten, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.publish_catalog(ten, path)
    stored = spark.read.parquet(path)
    assert "PushedFilters: [IsNotNull(product_id), EqualTo(product_id,p3)]" in plan_text(
        catalog.product_by_id(stored, "p3")
    )
    assert "In(product_id, [p1,p2])" in plan_text(catalog.fetch_by_ids(stored, ["p1", "p2"]))
    plan = plan_text(catalog.page(stored, 5, 2))
    assert "TakeOrderedAndProject" in plan and "description" not in plan
    assert "GreaterThan(product_id,p4)" in plan_text(catalog.page_after(stored, "p4"))
    assert ids(catalog.load_catalog(stored)) == [f"p{i}" for i in range(10)]


@pytest.mark.parametrize("chunk, chunks", [(64, 4096), (3, 2)])
def test_requested_pages(ten, spark, monkeypatch, chunk, chunks):
    monkeypatch.setattr(catalog, "CHUNK", chunk)
    monkeypatch.setattr(catalog, "CHUNKS", chunks)
    requests = [
        ("default", None, None),
        ("second", " 4 ", "2"),
        ("past", "4", "9"),
        ("none", "0", "1"),
        ("huge", "99999999999", "1"),
        ("far", "9000000000000000000", "9000000000000000000"),
        ("zero", "4", "0"),
        ("negative", "-5", "1"),
        ("word", "ten", "1"),
        ("empty", "", "1"),
        ("over", "1" * 30, "1"),
        ("sum", "10", "5000000000000000000"),
        ("edge", "9223372036854775807", "1"),
        ("next", "9223372036854775807", "2"),
    ]
    df = spark.createDataFrame(requests, "request_id string, limit string, page string")
    got = {}
    for r in catalog.requested_pages(ten, df).orderBy("position").collect():
        got.setdefault(r.request_id, []).append(r.product_id)
    everything = [f"p{i}" for i in range(10)]
    assert got == {"default": everything, "huge": everything, "edge": everything, "second": everything[4:8]}
    assert dict(map(tuple, catalog.refused_pages(df).collect())) == {
        "zero": "out_of_range",
        "negative": "out_of_range",
        "word": "not_a_number",
        "empty": "not_a_number",
        "over": "out_of_range",
    }


def test_deep_pages_come_from_the_index(ten, monkeypatch):
    monkeypatch.setattr(catalog, "DEEP", 4)
    for number in (1, 2, 3, 4, 5):
        assert ids(catalog.page(ten, 3, number)) == [f"p{i}" for i in range(10)][3 * number - 3 : 3 * number]


def test_page_after_a_row_of_a_repeated_id(ten):
    twice = ten.unionByName(ten.withColumn("stok", F.lit(77).cast("bigint")))
    seen, last = [], (None, None)
    while True:
        rows = catalog.page_after(twice, last[0], 3, last[1]).withColumn("key", catalog.row_key()).collect()
        if not rows:
            break
        seen += [(r.product_id, r.key) for r in rows]
        last = seen[-1]
    assert len(seen) == len(set(seen)) == 20 and [i for i, _ in seen] == sorted(i for i, _ in seen)


def test_pages_of_one_repeated_id_meet_at_every_depth(spark, monkeypatch):
    """Each row comes once, whichever way a page is cut."""
    names = [("same", f"Item {i}") for i in range(30)]
    random.Random(1).shuffle(names)
    table = products(spark, names).repartition(7)
    monkeypatch.setattr(catalog, "DEEP", 12)
    got = [r.product_name for n in range(1, 7) for r in catalog.page(table, 5, n).collect()]
    assert sorted(got) == sorted(name for _, name in names)
    wanted = table.orderBy("product_id", catalog.row_key()).collect()
    assert got == [r.product_name for r in wanted]
