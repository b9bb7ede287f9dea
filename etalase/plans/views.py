"""The catalogue's tables, derived by Spark from the test tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalase.operators.extraction import PRODUCT_FIELDS
from etalase.sources.files import to_raw


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean product table: attributes of ``part``, sales of ``lineitem``."""
    sales = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum("l_quantity").cast("long").alias("sold"),
            F.count("*").alias("lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.min("l_suppkey").alias("seller"),
        )
    )
    score = F.floor((5.0 - 4.0 * F.col("returned") / F.col("lines")) * 10) / 10
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    return (
        table(spark, sf_dir, "part")
        .join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            key.alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.floor("p_retailprice").alias("product_price"),
            F.col("p_size").cast("long").alias("stok"),
            F.coalesce("sold", F.lit(0)).alias("jumlah_terjual"),
            score.alias("rating"),
            F.concat(F.lit("/img/"), key, F.lit(".jpg 1x")).alias("image_srcset"),
            F.col("p_type").alias("kategori"),
            F.col("p_brand").alias("brand"),
            (1 + F.col("p_size") % 5).cast("long").alias("min_pembelian"),
            (F.col("p_size") * 100).cast("long").alias("berat_satuan"),
            F.concat(size, F.lit(" cm x "), size, F.lit(" cm")).alias("dimensi_ukuran"),
            F.concat(F.lit("NATION_"), (F.col("seller") % 25).cast("string")).alias("dikirim_dari"),
            F.concat(F.lit("Supplier#"), F.col("seller").cast("string")).alias("penjual"),
            F.concat_ws(" ", "p_brand", "p_type", "p_name", size).alias("description"),
        )
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("product_id"),
        F.col("embedding").alias("features_vector"),
    )


def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks to compare the parts on it, in line order.

    Part keys are moved up by five, so some requests name an unknown product.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_partkey") + 5).cast("string").alias("product_id"),
    )


def responses(groups: DataFrame) -> DataFrame:
    """Model answers to the comparison groups, in five wordings."""
    key = F.col("request_id").cast("long")
    chosen = F.element_at("products", (key % F.size("products") + 1).cast("int"))
    name = chosen["product_name"]
    start, middle = F.lit("Saya rekomendasikan "), F.lit(" Untuk anda beli Karena ")
    answer = (
        F.when(key % 5 == 0, F.concat(start, F.lit("**"), name, F.lit("**"), middle, F.lit("murah.")))
        .when(key % 5 == 1, F.concat(start, F.lit("produk "), F.upper(name), middle, F.lit("bagus")))
        .when(key % 5 == 2, F.lit("Tidak ada pilihan."))
        .when(key % 5 == 3, F.concat(start, F.lit("**Produk lain**"), middle, name))
        .otherwise(F.concat(start, F.lit("**"), name, F.lit("** saja")))
    )
    text = F.concat(F.lit("Hallo!\n\n"), answer, F.lit("\n\nTerima Kasih"))
    message = F.struct(F.struct(text.alias("content")).alias("message"))
    return groups.select(
        "request_id", F.to_json(F.struct(F.array(message).alias("choices"))).alias("response_json")
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop page per product, with tags left out where the product has no value."""

    def tag(name: str, classes: str, content: Column) -> Column:
        return F.concat(F.lit(f'<{name} class="{classes}"> '), content, F.lit(f" </{name}>"))

    def row(label: str, *values: Column) -> Column:
        cells = [tag("div", "font-[500] text-sm", value) for value in values]
        name = tag("div", "text-sm text-[#8C9197]", F.lit(label))
        return F.concat(F.lit("<tr><td>"), name, F.lit("<td>"), *cells)

    def own(name: str, content: Column, depth: int = 0) -> Column:
        tag_name, wanted = PRODUCT_FIELDS[name].path[depth]
        return tag(tag_name, wanted["cls"], content)

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    def said(*pieces: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    seller = own("Penjual", F.col("penjual"), 2)
    description = own("Description", said(F.col("description"), "<br> &amp; lainnya"), 1)
    stock = said(own("Stok", F.lit("Stok"), 1), own("Stok", text("stok"), 1))
    parts = [
        F.lit("<!DOCTYPE html><html><head><script>var t='<h1>no</h1>';</script></head><body>"),
        said('<div id="product-images"><img src=x><img srcset="', F.col("image_srcset"), '"></div>'),
        own("Product_Name", F.col("product_name")),
        own("Product_Price", said("Rp", text("product_price"))),
        own("Jumlah_Terjual", said("Terjual ", text("jumlah_terjual"))),
        own("Rating", text("rating")),
        own("Dikirim_Dari", F.col("dikirim_dari")),
        own("Penjual", said("<a href='/s'>", seller, "</a>")),
        own("Description", description),
        own("Stok", stock),
        F.lit("<table><tbody>"),
        row("Kategori", F.lit("lama")),
        row("Brand", F.col("brand")),
        row("Kategori"),
        row("Kategori", F.col("kategori")),
        row("Min Pembelian", text("min_pembelian")),
        row("Berat Satuan", text("berat_satuan")),
        row("Dimensi Ukuran", said(text("stok"), " cm"), said("x ", text("stok"), " cm")),
        F.lit("</table></body></html>"),
    ]
    # A page is far larger than the row it is made from, so spread the rows first.
    spread = products(spark, sf_dir).repartition(
        spark.sparkContext.defaultParallelism, "product_id"
    )
    return spread.select(
        F.col("product_id").cast("long").alias("page_id"),
        F.concat(F.lit("/product/"), "product_id").alias("url"),
        F.concat(*[F.coalesce(part, F.lit("")) for part in parts]).alias("html"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured product rows, all text: each line item is one capture of its part."""
    amount = F.translate(F.format_number(F.floor("l_extendedprice"), 0), ",", ".")
    line = F.col("l_linenumber").cast("string")
    quantity = F.col("l_quantity").cast("long").cast("string")
    key = F.col("l_partkey").cast("string")
    sold = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Terjual "), quantity))
    rating = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("4,"), line))
    origin = (F.col("l_suppkey") % 25).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("  Part "), key, F.lit(" ")).alias("Product_Name"),
        F.concat(F.lit("Rp"), amount).alias("Product_Price"),
        F.concat(F.lit("Stok "), line).alias("Stok"),
        sold.otherwise("Belum terjual").alias("Jumlah_Terjual"),
        rating.alias("Rating"),
        F.concat(F.lit("/img/"), key, F.lit(".jpg 1x")).alias("Image_Srcset"),
        F.col("l_returnflag").alias("Kategori"),
        F.col("l_linestatus").alias("Brand"),
        F.lit("1 pcs").alias("Min_Pembelian"),
        F.concat(quantity, F.lit("00 gram")).alias("Berat_Satuan"),
        F.concat(line, F.lit(" cm x "), line, F.lit(" cm")).alias("Dimensi_Ukuran"),
        F.concat(F.lit("NATION_"), origin).alias("Dikirim_Dari"),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("Penjual"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("Description"),
        F.concat(F.lit("/product/"), key).alias("URL"),
        F.col("l_shipdate").alias("Update"),
    )
    return to_raw(rows)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing categories: one per brand and type of ``part``."""
    slug = F.lower(F.concat_ws("-", "p_type", F.translate("p_brand", "#", "-")))
    return table(spark, sf_dir, "part").select(slug.alias("category")).distinct()


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks for a page; some leave the limit or the page out."""
    limit, page = F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 50).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.when(F.col("c_custkey") % 7 != 0, limit).alias("limit"),
        F.when(F.col("c_custkey") % 11 != 0, page).alias("page"),
    )


def many_vectors(spark: SparkSession, sf_dir: str, product_id: str) -> DataFrame:
    """The features, with every 25th vector once more under one product id."""
    rows = table(spark, sf_dir, "embeddings")
    more = rows.where(F.col("vec_id") % 25 == 0).select(
        F.lit(product_id).alias("product_id"), F.col("embedding").alias("features_vector")
    )
    return features(spark, sf_dir).unionByName(more)


def request_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for a list of products: none, too many, repeated, unknown or good ones."""
    key = 1 + F.col("o_orderkey") % 199

    def ids(*numbers: Column) -> Column:
        return F.array(*[n.cast("string") for n in numbers])

    kind = F.col("o_orderkey") % 9
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.when(kind == 0, F.array().cast("array<string>"))
        .when(kind == 1, F.lit(None).cast("array<string>"))
        .when(kind == 2, ids(key, key))
        .when(kind == 3, ids(F.lit(50), F.lit(-1)))
        .when(kind == 4, ids(key))
        .when(kind == 5, ids(key, key + 1, key + 2, key + 3, key + 4))
        .when(kind == 6, ids(key, F.lit(None)))
        .when(kind == 7, ids(key, key + 1))
        .otherwise(ids(key + 2, key + 1, key))
        .alias("product_ids"),
    )


def listed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products, every 50th of them twice."""
    rows = products(spark, sf_dir)
    return rows.unionByName(rows.where(F.col("product_id").cast("long") % 50 == 0))


def rough_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured rows whose numbers are hard to read, some without an address."""
    order = F.substring("Description", 7, 20).cast("long")
    sold = [F.lit(t) for t in ("1,2 rb terjual", "10rb+", "Terjual 1.234", "Terjual 12.34", "3 terjual", "")]
    weight = [F.lit(t) for t in ("2.5 kg", "2 kg", "1.500 gram", "500 gram", "10 x 20 gram", "-5 gram")]
    rating = [F.lit(t) for t in ("4,5", "4.5/5", "5", "4,5,6", "belum ada", "Rating 3.9 bintang")]

    def one_of(texts: list[Column]) -> Column:
        return F.element_at(F.array(*texts), (order % len(texts) + 1).cast("int"))

    return raw_rows(spark, sf_dir).withColumns(
        {
            "Jumlah_Terjual": one_of(sold),
            "Berat_Satuan": one_of(weight),
            "Rating": one_of(rating),
            "URL": F.when(order % 7 != 0, F.col("URL")),
        }
    )


def rough_page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page requests with numbers beyond every bound; one asks for the whole catalogue."""
    key = F.col("c_custkey")
    limit = (
        F.when(key == 1, "9223372036854775807")
        .when(key % 6 == 0, "99999999999999999999")
        .when(key % 6 == 1, "ten")
        .when(key % 6 == 2, "-1")
        .when(key % 6 == 3, "9223372036854775807")
        .otherwise("3")
    )
    page = F.when(key == 1, "1").when(key % 6 == 4, "5000000000000000000").otherwise("2")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("request_id"), limit.alias("limit"), page.alias("page")
    )


def faulty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product pages, some missing and some without a seller's name."""
    html = F.col("html")
    nameless = F.replace(html, F.lit('<span class="text-base'), F.lit('<b class="text-base'))
    kind = F.col("page_id") % 10
    return product_pages(spark, sf_dir).withColumn(
        "html", F.when(kind == 3, None).when(kind == 4, nameless).otherwise(html)
    )
