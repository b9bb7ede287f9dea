"""Comparison of two or three products: requests, prompts, answers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalase.functions.prompt import BLOCK, BOLD_NAME, RECOMMENDATION, Template, template
from etalase.functions.text import present, shown, words

FEWEST, MOST = 2, 3


def request_items(requests: DataFrame) -> DataFrame:
    """``(request_id, product_ids)`` as one row per asked product.

    A request with an empty list, or none, keeps a row without a place.
    """
    return requests.select("request_id", F.posexplode_outer("product_ids").alias("pos", "product_id"))


def validate_requests(items: DataFrame, products: DataFrame) -> DataFrame:
    """``(request_id, valid, reason)`` for every request.

    A request is valid if it names two or three different products and each is
    in the catalogue once.
    """
    asked = _asked(items)
    refused = asked.where(F.col("reason").isNotNull()).select("request_id", "reason")
    judged = _judged(asked, products, []).select("request_id", "reason").unionByName(refused)
    return judged.select("request_id", F.col("reason").isNull().alias("valid"), "reason")


def comparison_groups(
    items: DataFrame, products: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """``(request_id, products)``: the products of every valid request, in request order.

    A product has its id and ``columns``: those of the prompt if none are named. Answers are
    read with ``product_name`` alone.
    """
    columns = [c for _, c in BLOCK] if columns is None else columns
    judged = _judged(_asked(items), products, columns)
    return judged.where(F.col("reason").isNull()).select("request_id", "products")


def comparison_prompts(groups: DataFrame, text: Template | None = None) -> DataFrame:
    """``(request_id, messages)``: the chat messages that ask for each comparison."""
    text = text or template()
    blocks = F.array_join(F.transform("products", product_block), "")
    prompt = F.concat(F.lit(text.head), blocks, F.lit(text.tail))
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return groups.select("request_id", F.array(message).alias("messages"))


def product_block(product: Column) -> Column:
    lines = [F.concat(F.lit(label), shown(product[c]), F.lit("\n")) for label, c in BLOCK]
    return F.concat(*lines, F.lit("\n"))


def answer_text(response_json: Column) -> Column:
    return F.get_json_object(response_json, "$.choices[0].message.content")


def comparison_answers(groups: DataFrame, responses: DataFrame) -> DataFrame:
    """``(request_id, comparison_result, best_product_id)`` per answered request.

    ``responses`` holds ``request_id`` and the model's ``response_json``.
    """
    answered = groups.join(responses.select("request_id", "response_json"), "request_id")
    read = answered.withColumn("comparison_result", answer_text(F.col("response_json")))
    line = F.regexp_extract("comparison_result", RECOMMENDATION, 0)
    bold = F.regexp_extract("comparison_result", BOLD_NAME, 1)
    read = read.withColumn("_line", F.lower(line)).withColumn("_bold", bold)
    return read.select(
        "request_id",
        "comparison_result",
        F.coalesce(
            _named(F.col("products"), F.col("_bold")),
            _best_match(F.col("products"), F.col("_line")),
        ).alias("best_product_id"),
    )


def _judged(asked: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """``(request_id, reason, products)`` of the requests whose own ids are no reason against them.

    A valid one has no reason. Both the answer to "is it valid" and the products come from the
    same rows, so they cannot differ. ``products`` has one entry per place of the request.
    """
    columns = ["product_id", *columns]
    listed = products.groupBy("product_id").agg(
        F.count("*").alias("_rows"), F.max(F.struct(*columns)).alias("_product")
    )
    looked_up = (
        asked.where(F.col("reason").isNull())
        .select("request_id", F.posexplode("ids").alias("place", "product_id"))
        .join(listed, "product_id", "left")
    )
    # At most MOST places per request are collected.
    entry = F.struct("place", *[F.col("_product")[c].alias(c) for c in columns])
    return looked_up.groupBy("request_id").agg(
        F.when(F.count_if(F.col("_rows").isNull()) > 0, "unknown_id")
        .when(F.count_if(F.col("_rows") > 1) > 0, "repeated_product")
        .alias("reason"),
        F.sort_array(F.collect_list(entry)).alias("products"),
    )


def _asked(items: DataFrame) -> DataFrame:
    """Ids per request with a reason to refuse it, if its own ids give one."""
    listed = _first_rows(items, ["pos", "product_id"], MOST + 1)
    # A row without a place stands for an empty request; nulls are not collected.
    entry = F.when(F.col("pos").isNotNull(), F.struct("place", "product_id"))
    ids = F.sort_array(F.collect_list(entry))["product_id"]
    grouped = listed.groupBy("request_id").agg(ids.alias("ids"))
    size = F.size("ids")
    reason = F.when(~size.between(FEWEST, MOST), "size").when(
        F.size(F.array_distinct("ids")) < size, "duplicate_id"
    )
    return grouped.withColumn("reason", reason)


def _first_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows per request, so what is collected later is bounded.

    Spark applies the rank limit before the shuffle too: a request of any size
    sends at most ``most`` rows per task.
    """
    ranked = Window.partitionBy("request_id").orderBy(*order)
    return (
        df.withColumn("_n", F.row_number().over(ranked))
        .where(F.col("_n") <= most)
        .withColumn("place", F.col("_n"))
        .drop("_n")
    )


def _named(products: Column, name: Column) -> Column:
    """Id of the first product with exactly this name; null if none or no name."""
    same = F.filter(products, lambda p: p["product_name"] == name)
    return F.when(present(name), F.try_element_at(same, F.lit(1))["product_id"])


def _best_match(products: Column, line: Column) -> Column:
    """Id of the product whose name has the most words in the line; null if none has any.

    The first of equally good names wins; among products of that name, the last.
    """

    def scored(p: Column) -> Column:
        hits = F.size(F.filter(words(p["product_name"]), lambda w: F.contains(line, w)))
        return F.struct(
            hits.alias("hits"), (-p["place"]).alias("first"), p["product_name"].alias("name")
        )

    named = F.filter(products, lambda p: p["product_name"].isNotNull())
    best = F.array_max(F.filter(F.transform(named, scored), lambda s: s["hits"] > 0))
    same = F.filter(products, lambda p: p["product_name"] == best["name"])
    return F.try_element_at(same, F.lit(-1))["product_id"]
