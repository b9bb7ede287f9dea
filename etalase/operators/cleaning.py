"""Raw product rows to the clean product table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.functions.text import present, strip
from etalase.sources.workspace import materialize

WHOLE_NUMBERS = ["product_price", "stok", "jumlah_terjual", "min_pembelian", "berat_satuan"]
TEXTS = [
    "product_name",
    "image_srcset",
    "kategori",
    "brand",
    "dimensi_ukuran",
    "dikirim_dari",
    "penjual",
    "description",
]


def latest_rows(raw: DataFrame, key: str = "URL") -> DataFrame:
    """The newest row per key; among equally new rows the greatest.

    One partial result per key and task is shuffled, however often it was
    captured. Rows without a key cannot be told apart, so all of them stay.
    Rows that may be the newest are found first, from keys and times, and stored.
    """
    others = [c for c in raw.columns if c not in (key, "Update")]
    newest = F.max(F.struct("Update", *others)).alias("_newest")
    recent = materialize(_without_old(raw.where(F.col(key).isNotNull()), key), "recent-rows")
    keyed = recent.groupBy(key).agg(newest)
    keyed = keyed.select(key, "_newest.*").select(*raw.columns)
    return keyed.unionByName(raw.where(F.col(key).isNull()))


# Hash places that old rows are told by; so many bounds are broadcast at most (some 60 MB).
# With several keys to a place the least of their times tells fewer rows, so places are many.
PLACES = 2**22
# Places of a block: a block is one row of the broadcast, which takes less room than a row per place.
BLOCK_PLACES = 64


def _without_old(rows: DataFrame, key: str) -> DataFrame:
    """All rows but such as are older than the newest row of every key of their hash place.

    Spark sorts whole rows before it takes the greatest of them; most need not get there.
    The newest time per key is worked out of the two columns, without a sort.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES)).cast("int")
    places = [F.floor(place / BLOCK_PLACES).cast("int").alias("_block"), (place % BLOCK_PLACES).alias("_slot")]
    newest = rows.groupBy(key).agg(F.max("Update").alias("_time")).select(*places, "_time")
    # A key without any time leaves its place without a bound.
    bound = F.when(F.count("_time") == F.count("*"), F.min("_time")).alias("_bound")
    bounds = newest.repartition("_block").groupBy("_block", "_slot").agg(bound).where("_bound is not null")
    by_slot = F.map_from_entries(F.collect_list(F.struct("_slot", "_bound"))).alias("_bounds")
    blocks = bounds.groupBy("_block").agg(by_slot)
    placed = rows.select("*", *places).join(F.broadcast(blocks), "_block", "left")
    oldest = F.element_at("_bounds", F.col("_slot"))
    recent = placed.where(oldest.isNull() | (F.col("Update") >= oldest))
    return recent.drop("_block", "_slot", "_bounds")


def clean_products(raw: DataFrame) -> DataFrame:
    """Typed product columns; ``problems`` lists the columns that held no clear number.

    The id is the MD5 of the address, so later captures keep it; without an address
    it is null and ``problems`` names it.
    """
    kinds = dict.fromkeys(WHOLE_NUMBERS, "bigint") | {"rating": "double"}
    # In steps, so that Spark searches each text once for the value and the check.
    found = raw.select(
        F.md5(F.col("URL").cast("binary")).alias("product_id"),
        *[strip(F.col(c)).alias(c) for c in TEXTS],
        *[whole_number(F.col(c)).alias(c) for c in WHOLE_NUMBERS],
        decimal_number(F.col("rating")).alias("rating"),
        # A function over an array keeps this step out of whole-stage code. In there it would be
        # one method, too long for the JVM to optimize, and would take several times as long;
        # outside, Spark cuts the expressions into short methods.
        F.array_compact(F.array(F.when(F.col("URL").isNull(), F.lit("product_id")))).alias("_missing"),
    )
    typed = found.select(
        "product_id",
        *TEXTS,
        *[F.when(F.col(c) != "", F.col(c).try_cast(kind)).alias(c) for c, kind in kinds.items()],
        *[F.col(c).alias(f"_{c}") for c in kinds],
        "_missing",
    )
    problems = [
        F.when(F.col(f"_{c}").isNotNull() & F.col(c).isNull(), F.lit(c)) for c in kinds
    ]
    problems = F.concat(F.array_compact(F.array(*problems)), "_missing")
    return typed.select("product_id", *TEXTS, *kinds, problems.alias("problems"))


# Words behind a number that change what it counts.
MULTIPLIERS = "rb|ribu|jt|juta|k|kg|m"


def whole_number(text: Column) -> Column:
    """Digits of the only number of a text, dots taken as marks between groups of three.

    Empty if a text holds no number, several, decimals, a sign or a multiplier ("10rb+",
    "2.5 kg"); null if there is no text. (The caller casts: a cast that fails costs far
    more than an empty text.)
    """
    number = r"([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)(?![0-9.,])"
    clear = rf"(?i)^[^0-9+-]*{number}\s*+(?!(?:{MULTIPLIERS})\b)[^0-9+]*$"
    return F.when(present(text), F.replace(F.regexp_extract(text, clear, 1), F.lit("."), F.lit("")))


def decimal_number(text: Column) -> Column:
    """The first number of a text, a comma or a dot before its decimals; else as above.

    More than one mark ("4,5,6") is not clear.
    """
    number = F.regexp_extract(text, r"^[^0-9]*([0-9]+(?:[.,][0-9]+)?+)(?![0-9.,]*[0-9])", 1)
    return F.when(present(text), F.replace(number, F.lit(","), F.lit(".")))
