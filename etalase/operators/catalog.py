"""Catalogue reads: load, page, look up, search, validate."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalase.functions.text import grams, present, strip
from etalase.schemas import DETAIL, SUMMARY
from etalase.sources.workspace import materialize


# Characters of a search term that names are looked up by.
LONGEST_PIECE = 3
# Positions are looked up by chunks of this size, and chunks listed so many at a time.
CHUNK = 64
CHUNKS = 4096
# Pages whose end lies deeper are cut from the page index.
DEEP = 100_000


def detail(products: DataFrame) -> DataFrame:
    return products.select(*DETAIL)


def summary(products: DataFrame) -> DataFrame:
    return products.select(*SUMMARY)


def load_catalog(products: DataFrame) -> DataFrame:
    """The detail columns of every product in id order."""
    return detail(products).orderBy(F.asc_nulls_first("product_id"))


def publish_catalog(products: DataFrame, path: str) -> None:
    """Store the catalogue sorted by id for later sessions.

    Sorted files keep narrow id ranges in their Parquet statistics, so lookups
    and id lists skip most row groups.
    """
    load_catalog(products).write.mode("overwrite").parquet(path)


def all_products(products: DataFrame) -> DataFrame:
    return summary(products).orderBy(F.asc_nulls_first("product_id"))


def product_by_id(products: DataFrame, product_id: str) -> DataFrame:
    """The product with this id, or no row."""
    if not product_id:
        raise ValueError("product_id is missing")
    return detail(products).where(F.col("product_id") == product_id).limit(1)


def products_by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Every product whose id occurs in the ``product_id`` column of ``ids``."""
    return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def fetch_by_ids(products: DataFrame, ids: Sequence[str]) -> DataFrame:
    """All columns of the products in a short list; the filter reaches the source."""
    return products.where(F.col("product_id").isin(list(ids)))


def page(products: DataFrame, limit: int = 10, number: int = 1) -> DataFrame:
    """One page in id order; past the end it is empty.

    Each task keeps ``number * limit`` rows at most, ``DEEP`` of them in all; a page
    beyond is cut from ``page_index``. ``page_after`` goes on from a known id.
    """
    if number < 1 or limit < 0:
        raise ValueError("number must be at least 1 and limit at least 0")
    if number * limit > DEEP:
        place = F.col("position")
        wanted = (place >= (number - 1) * limit) & (place < number * limit)
        return page_index(products).where(wanted).orderBy("position").select(*SUMMARY)
    # The order of the index, so that rows of one id keep their places at every depth.
    rows = summary(products).orderBy(F.asc_nulls_first("product_id"), row_key())
    return rows.offset((number - 1) * limit).limit(limit)


def page_after(
    products: DataFrame, last_id: str | None, limit: int = 10, last_key: int | None = None
) -> DataFrame:
    """The page that follows ``last_id``; None starts at the beginning.

    The id bound is pushed to the source, so the cost does not depend on how
    deep the page is. Where ids repeat, pass the ``row_key`` of the last row too;
    without it the rest of its group is skipped.
    """
    if limit < 0:
        raise ValueError("limit must be at least 0")
    rows = summary(products)
    if last_id is not None and last_key is None:
        rows = rows.where(F.col("product_id") > last_id)
    elif last_id is not None:
        same = (F.col("product_id") == last_id) & (row_key() > last_key)
        rows = rows.where((F.col("product_id") >= last_id) & ((F.col("product_id") > last_id) | same))
    return rows.orderBy(F.asc_nulls_first("product_id"), row_key()).limit(limit)


def row_key() -> Column:
    """Orders rows of the same id: a hash of the summary columns."""
    return F.xxhash64(*SUMMARY)


def page_index(products: DataFrame, limit: int = 10) -> DataFrame:
    """Every product with its place in id order and its page number.

    Rows are split by id range and sorted within each range; a place is the
    row's place in its range plus the size of the ranges before it. The row key lets
    a range boundary fall inside a group of equal ids.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    ranged = (
        summary(products)
        .withColumn("_key", row_key())
        .repartitionByRange(F.asc_nulls_first("product_id"), F.asc("_key"))
        .sortWithinPartitions(F.asc_nulls_first("product_id"), F.asc("_key"))
        .drop("_key")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # Stored, because the counts and the rows must come from the same ranges.
    ranged = materialize(ranged, "page-index")
    # One row per range: a few thousand at most, whatever the catalogue size.
    ranges = ranged.groupBy("_range").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    position = F.col("_offset") + F.col("_row") - F.col("_first")
    return (
        ranged.join(F.broadcast(ranges.drop("_size")), "_range")
        .withColumn("position", position)
        .withColumn("page", F.floor(F.col("position") / limit) + 1)
        .select("page", "position", *SUMMARY)
    )


def requested_pages(products: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of many page requests at once.

    ``requests`` holds ``request_id`` and the texts ``limit`` and ``page``; a
    missing text means 10 and 1. Each asked position is looked up in the page
    index. ``refused_pages`` lists the requests that ask for nothing sensible.
    """
    index = page_index(products).drop("page")
    asked = _page_request(requests).where(F.col("reason").isNull() & (F.col("limit") > 0))
    # A limit beyond the catalogue asks for positions that do not exist.
    last = index.agg(F.max("position")).scalar()
    end = F.coalesce(F.try_add("start", F.col("limit") - 1), last)
    asked = asked.withColumn("end", F.least(end, last)).where(F.col("start") <= F.col("end"))

    # Whole chunks are looked up, listed in two steps so that no row holds a long list.
    first, final = F.floor(F.col("start") / CHUNK), F.floor(F.col("end") / CHUNK)
    stretch = F.explode(F.sequence(F.floor(first / CHUNKS), F.floor(final / CHUNKS)))
    listed = asked.select("request_id", "start", "end", stretch.alias("_stretch"))
    low = F.greatest(first, F.col("_stretch") * CHUNKS)
    high = F.least(final, F.col("_stretch") * CHUNKS + (CHUNKS - 1))
    chunks = listed.select("request_id", "start", "end", F.explode(F.sequence(low, high)).alias("_chunk"))
    held = index.withColumn("_chunk", F.floor(F.col("position") / CHUNK))
    return (
        chunks.join(held, "_chunk")
        .where(F.col("position").between(F.col("start"), F.col("end")))
        .drop("_chunk", "start", "end")
    )


def refused_pages(requests: DataFrame) -> DataFrame:
    """``(request_id, reason)`` of the page requests that cannot be served."""
    refused = _page_request(requests).where(F.col("reason").isNotNull())
    return refused.select("request_id", "reason")


def _page_request(requests: DataFrame) -> DataFrame:
    def text(name: str, default: int) -> Column:
        return F.when(F.col(name).isNull(), F.lit(str(default))).otherwise(strip(F.col(name)))

    whole = "^[+-]?[0-9]+$"
    read = requests.select("request_id", text("limit", 10).alias("_limit"), text("page", 1).alias("_page"))
    numbers = F.col("_limit").rlike(whole) & F.col("_page").rlike(whole)
    read = read.select(
        "request_id",
        numbers.alias("_numbers"),
        *[F.when(numbers, F.col(f"_{c}").try_cast("bigint")).alias(c) for c in ("limit", "page")],
    )
    # A number that no long holds is null here.
    fits = (F.col("page") >= 1) & (F.col("limit") >= 0)
    reason = F.when(~F.col("_numbers"), "not_a_number").when(~F.coalesce(fits, F.lit(False)), "out_of_range")
    start = F.try_multiply(F.col("page") - 1, F.col("limit"))
    return read.select("request_id", "limit", "page", reason.alias("reason"), start.alias("start"))


def search_name(products: DataFrame, term: str) -> DataFrame:
    """Products whose name contains the term, in id order, ignoring case.

    The term is taken literally: ``%`` and ``_`` are no wildcards.
    """
    if not term:
        raise ValueError("the search term is missing")
    hit = F.contains(F.lower("product_name"), F.lower(F.lit(term)))
    return all_products(products.where(present(F.col("product_name")) & hit))


def search_terms(products: DataFrame, terms: DataFrame) -> DataFrame:
    """All (term, product) matches of the ``term`` column of ``terms``.

    A name that contains a term also contains every short piece of it, so names
    and terms meet in an equi-join on the piece of the term that the fewest
    names have, and the full test runs on those pairs only.
    """
    wanted = (
        terms.select("term")
        .where(present(F.col("term")))
        .distinct()
        .withColumn("_needle", F.lower("term"))
    )
    wanted = wanted.withColumn("_long", F.least(F.length("_needle"), F.lit(LONGEST_PIECE)))
    # At most LONGEST_PIECE rows: names are cut into pieces of these lengths only.
    lengths = sorted(row[0] for row in wanted.select("_long").distinct().collect())
    lengths = lengths or [LONGEST_PIECE]
    pieces = wanted.select("*", F.explode(grams(F.col("_needle"), lengths)).alias("_gram"))
    pieces = pieces.where(F.length("_gram") == F.col("_long"))

    # Copies of a name are cut up and tested once. (The lower-case name is a column
    # of its own, so that it is made once per row.)
    named = products.where(present(F.col("product_name"))).select(
        *SUMMARY, F.lower("product_name").alias("_name")
    )
    cut = named.select("_name").distinct()
    cut = cut.select("_name", F.explode(grams(F.col("_name"), lengths)).alias("_gram"))
    spread = cut.groupBy("_gram").agg(F.count("*").alias("_names"))
    rarest = (
        pieces.join(spread, "_gram")
        .groupBy("term", "_needle")
        .agg(F.min_by("_gram", F.struct("_names", "_gram")).alias("_gram"))
    )
    hits = cut.join(rarest, "_gram").where(F.contains("_name", "_needle")).select("term", "_name")
    return named.join(hits, "_name").select("term", *SUMMARY)
