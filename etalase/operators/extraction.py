"""Shop pages to product rows."""

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalase.functions.html import Node, parse
from etalase.functions.tags import attribute, tags
from etalase.schemas import RAW


class Field(NamedTuple):
    """Where a value is: tags from the outside in, each ``(tag, attributes)``.

    If the first tag is absent the value is null; if a later one is absent the
    page is faulty. ``nth`` counts matches of the last tag; ``take`` is an
    attribute name, or None for the text.
    """

    path: list[tuple[str, dict]]
    take: str | None = None
    nth: int = 0


# The tags and class texts of the shop's product page.
PRODUCT_FIELDS = {
    "Image_Srcset": Field(
        [("div", {"id": "product-images"}), ("img", {"srcset": True})], take="srcset"
    ),
    "Product_Name": Field(
        [("h1", {"cls": "text-sm md:text-base font-medium text-paletteText-primary font-ubuntu mb-1 capitalize"})]
    ),
    "Product_Price": Field(
        [("label", {"cls": "font-bold text-base md:text-2xl text-paletteText-primary font-ubuntu"})]
    ),
    "Jumlah_Terjual": Field(
        [("div", {"cls": "text-sm flex-nowrap text-paletteText-primary font-ubuntu"})]
    ),
    "Rating": Field(
        [("div", {"cls": "text-xs flex-nowrap text-paletteText-primary font-ubuntu font-medium pr-1"})]
    ),
    "Dikirim_Dari": Field([("div", {"cls": "text-paletteText-primary text-sm font-[500]"})]),
    "Penjual": Field(
        [
            ("div", {"cls": "flex-1 flex-col"}),
            ("a", {}),
            ("span", {"cls": "text-base font-semibold block text-paletteText-primary cursor-pointer h-[24px] overflow-hidden"}),
        ]
    ),
    "Description": Field(
        [
            ("div", {"cls": "space-y-3 px-0 text-paletteText-primary font-ubuntu"}),
            ("p", {"cls": "break-words whitespace-pre-line w-full"}),
        ]
    ),
    "Stok": Field(
        [
            ("div", {"cls": "flex items-center text-paletteText-inactive text-sm"}),
            ("span", {"cls": "text-[#444B55]"}),
        ],
        nth=1,
    ),
}
ROW_LABEL = ("div", {"cls": "text-[#8C9197]"})
ROW_VALUE = ("div", {"cls": "font-[500]"})
# Label of a table row, its column, and how many values of the row it joins.
ROW_COLUMNS = {
    "Kategori": ("Kategori", 1),
    "Brand": ("Brand", 1),
    "Min Pembelian": ("Min_Pembelian", 1),
    "Berat Satuan": ("Berat_Satuan", 1),
    "Dimensi Ukuran": ("Dimensi_Ukuran", 2),
}
LISTING_PAGES = 200
PRODUCT_MARKER = "/product/"


def listing_frontier(categories: DataFrame, host: str, pages: int = LISTING_PAGES) -> DataFrame:
    """Addresses of the listing pages of every category in ``category``."""
    number = F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page")
    url = F.format_string("%s/c/%s?page=%d", F.lit(host), F.col("category"), F.col("page"))
    return categories.select("category", number).withColumn("url", url)


def page_links(pages: DataFrame, marker: str = PRODUCT_MARKER) -> DataFrame:
    """``(page_url, place, href)``: every link of a page whose target has the marker.

    Repeats are kept, in page order. Comments and scripts hold no links. Built-in functions
    only, one row in and its links out.
    """
    targets = F.transform(tags(F.col("html"), "a"), lambda inside: attribute(inside, "href"))
    links = pages.select(
        F.col("url").alias("page_url"), F.posexplode(F.array_compact(targets)).alias("place", "href")
    )
    return links.where(F.contains("href", F.lit(marker)))


def absolute(href: Column, host: Column) -> Column:
    """Host plus path; a link that names its own host stays as it is."""
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*://"), href).otherwise(F.concat(host, href))


def page_fields(pages: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """Each page with the given fields and an ``error``, null for a good page.

    A page is one row in and one row out, so nothing is shuffled.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*fields, "error")])

    def read(page: Node) -> dict:
        return {name: _value(page, field) for name, field in fields.items()}

    found = _page_reader(read, schema)(F.col("html"))
    return pages.withColumn("_found", found).select(*pages.columns, "_found.*").drop("html")


def product_rows(pages: DataFrame) -> DataFrame:
    """The raw product columns of every product page, and its ``error``."""
    names = [f.name for f in RAW.fields if f.name not in ("URL", "Update")]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*names, "error")])

    def read(page: Node) -> dict:
        values = {name: _value(page, field) for name, field in PRODUCT_FIELDS.items()}
        return values | _row_values(page)

    found = _page_reader(read, schema)(F.col("html"))
    return (
        pages.select(F.col("url").alias("URL"), found.alias("_found"))
        .select("_found.*", "URL", F.current_timestamp().alias("Update"))
        .select(*[f.name for f in RAW.fields], "error")
    )


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull()).drop("error")


def faulty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select("URL", "error", "Update")


def counted(rows: DataFrame, progress: Observation | str = "ingest") -> DataFrame:
    """Count stored and faulty pages while another action runs."""
    bad = F.col("error").isNotNull()
    return rows.observe(
        progress, F.count_if(~bad).alias("stored"), F.count_if(bad).alias("faulty")
    )


def _page_reader(read, schema: T.StructType):
    """A pandas UDF from page text to a struct; a fault in one page stays with it."""
    nothing = dict.fromkeys(schema.names)

    def attempt(page):
        if page is None:
            return nothing | {"error": "no page"}
        try:
            return nothing | read(parse(page))
        except Exception as fault:
            return nothing | {"error": f"{type(fault).__name__}: {fault}"}

    def rows(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attempt(page) for page in pages], columns=schema.names, dtype=object)

    # Spark copies a deterministic call into filters on its result and would
    # parse every page twice.
    return F.pandas_udf(rows, schema).asNondeterministic()


def _value(page: Node, field: Field) -> str | None:
    node = page
    for depth, (tag, wanted) in enumerate(field.path):
        last = depth == len(field.path) - 1
        matches = list(node.all(tag, **wanted)) if last and field.nth else None
        if matches is not None:
            node = matches[field.nth] if field.nth < len(matches) else None
        else:
            node = node.first(tag, **wanted)
        if node is None and depth == 0:
            return None
        if node is None:
            raise LookupError(f"no {tag} below {field.path[depth - 1][0]}")
    return node.text() if field.take is None else node.attrs[field.take]


def _row_values(page: Node) -> dict:
    """Values of the labelled table rows; of equal labels the last row counts."""
    values = {}
    for row in page.all("tr"):
        label = row.first(ROW_LABEL[0], **ROW_LABEL[1])
        texts = [node.text() for node in row.all(ROW_VALUE[0], **ROW_VALUE[1])]
        column, joined = ROW_COLUMNS.get(label.text() if label else None, (None, 0))
        if column and len(texts) >= joined:
            values[column] = " ".join(texts[:joined])
    return values
