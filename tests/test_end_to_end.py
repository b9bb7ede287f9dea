"""From shop pages to similar products and comparisons, on the test tables."""

from pyspark.sql import functions as F

from etalase.operators import catalog, cleaning, comparison, extraction, neighbours, similarity
from etalase.operators.text_features import text_features
from etalase.plans import views
from etalase.schemas import DETAIL
from etalase.sources import files
from etalase.sources.workspace import work_dir

SF = "/root/testdata/sf0.001"


def test_pages_become_a_catalogue_that_answers(spark):
    path = work_dir(spark, "captures")
    pages = views.product_pages(spark, SF)
    for _ in range(2):
        files.append_raw(extraction.good_rows(extraction.product_rows(pages)), path)
    captures = files.read_raw(spark, path)
    assert captures.count() == 2 * pages.count()

    products = cleaning.clean_products(cleaning.latest_rows(captures)).cache()
    assert catalog.load_catalog(products).columns == DETAIL
    source = {r.product_id: r for r in views.products(spark, SF).collect()}
    assert products.count() == len(source)
    for row in products.collect():
        origin = source[row.image_srcset.removeprefix("/img/").removesuffix(".jpg 1x")]
        for name in set(DETAIL) - {"product_id", "description"}:
            assert getattr(row, name) == getattr(origin, name), name

    # Rounded, because the order of a sum may change the last bit between runs.
    features = text_features(products.select("product_id", F.col("description").alias("text")))
    target = products.agg(F.min("product_id")).collect()[0][0]
    found = similarity.similar_products(features, products, target).collect()
    every = neighbours.similar_all(features, products).where(F.col("query_id") == target)
    listed = every.orderBy("rank").collect()
    assert len(found) == len(listed) == 10
    assert [round(r.cosine_similarity, 5) for r in found] == [
        round(r.cosine_similarity, 5) for r in listed
    ]

    ids = [target, found[0].product_id]
    asked = spark.createDataFrame([("r", ids)], "request_id string, product_ids array<string>")
    groups = comparison.comparison_groups(comparison.request_items(asked), products)
    assert [p.product_id for p in groups.collect()[0].products] == ids


def test_one_list_of_all_equals_the_single_query(spark):
    features, products = views.features(spark, SF), views.products(spark, SF)
    every = neighbours.similar_all(features, products, k=10, block_rows=64, cell_rows=50).cache()
    assert every.groupBy("query_id").count().where("count <> 10").count() == 0
    for target in ("0", "7", "123"):
        one = [r.product_id for r in similarity.similar_products(features, products, target).collect()]
        rows = every.where(F.col("query_id") == target).orderBy("rank").collect()
        assert [r.product_id for r in rows] == one
    every.unpersist()
