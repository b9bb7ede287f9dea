"""Column sets and schemas shared by the operators."""

from pyspark.sql import types as T

# The column names and types of the stored tables.
RAW = T.StructType(
    [
        T.StructField("Product_Name", T.StringType()),
        T.StructField("Product_Price", T.StringType()),
        T.StructField("Stok", T.StringType()),
        T.StructField("Jumlah_Terjual", T.StringType()),
        T.StructField("Rating", T.StringType()),
        T.StructField("Image_Srcset", T.StringType()),
        T.StructField("Kategori", T.StringType()),
        T.StructField("Brand", T.StringType()),
        T.StructField("Min_Pembelian", T.StringType()),
        T.StructField("Berat_Satuan", T.StringType()),
        T.StructField("Dimensi_Ukuran", T.StringType()),
        T.StructField("Dikirim_Dari", T.StringType()),
        T.StructField("Penjual", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("URL", T.StringType()),
        T.StructField("Update", T.TimestampType()),
    ]
)

DETAIL = [
    "product_id",
    "product_name",
    "product_price",
    "stok",
    "jumlah_terjual",
    "rating",
    "image_srcset",
    "kategori",
    "brand",
    "min_pembelian",
    "berat_satuan",
    "dimensi_ukuran",
    "dikirim_dari",
    "penjual",
    "description",
]

SUMMARY = DETAIL[:8]

SIMILAR = [
    "product_id",
    "product_name",
    "product_price",
    "stok",
    "description",
    "jumlah_terjual",
    "rating",
    "image_srcset",
    "kategori",
    "cosine_similarity",
]

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
