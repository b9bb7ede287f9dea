"""URL filters: a sort-merge range join of addresses and nested rules, by built-ins only.

A host is turned round (``www.example.org`` becomes ``org.example.www.``), so that a rule's host
and all its subdomains are one interval of keys, and intervals are nested or apart. Rules become
two events: where an interval begins, the stack of rules then active, and where it ends, the stack
without that rule. Events and addresses are sorted together and cut into ranges; inside a range
the last event before an address holds its stack, and each range starts with the last event of the
ranges before it. A second sweep does the same for the paths of the rules of one host. A busy host
is cut like any other run of keys, as the row number is part of the order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalase.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z lowered; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def turned(name: Column) -> Column:
    """Labels in reverse order, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def swept(points: DataFrame, events: DataFrame) -> DataFrame:
    """``points`` with ``stack``, the state after the last event at or before their ``key``.

    ``points`` has ``key`` (binary) and ``row`` (unique); ``events`` has ``key`` and ``stack``, an array.
    Both go into one order. What each range hands to the next is one row per range.
    """
    columns = [c for c in points.columns if c != "key"]
    typed = points.schema
    rows = points.select("key", F.lit(1).alias("turn"), F.lit(None).cast("array<string>").alias("stack"), *columns)
    marks = events.select(
        "key", F.lit(0).alias("turn"), "stack", *[F.lit(None).cast(typed[c].dataType).alias(c) for c in columns]
    )
    ranges = rows.unionByName(marks).repartitionByRange("key", "turn", "row")
    ranges = stored(ranges.withColumn("range", F.spark_partition_id()), "url-ranges")

    last = ranges.where("turn = 0").groupBy("range").agg(F.max_by("stack", F.struct("key", "stack")).alias("stack"))
    every = ranges.select("range").distinct().join(last, "range", "left")
    # One row per range, of which there are as many as shuffle partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("range", F.last("stack", ignorenulls=True).over(before).alias("carried"))

    inside = Window.partitionBy("range").orderBy("key", "turn", "row").rowsBetween(Window.unboundedPreceding, 0)
    known = ranges.withColumn("seen", F.last("stack", ignorenulls=True).over(inside)).where("turn = 1")
    known = known.join(F.broadcast(carried), "range", "left")
    nothing = F.array().cast("array<string>")
    return known.select("key", F.coalesce("seen", "carried", nothing).alias("stack"), *columns)


def _events(intervals: DataFrame) -> DataFrame:
    """Begin and end of each interval; ``stack`` holds the names around it, itself last."""
    outer = F.slice("stack", 1, F.size("stack") - 1)
    return intervals.select(
        F.inline(
            F.array(
                F.struct(F.col("key").alias("key"), F.col("stack").alias("stack")),
                # No UTF-8 text holds this byte, so this comes after every key with the prefix.
                F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), outer.alias("stack")),
            )
        )
    )


def host_events(rules: DataFrame) -> DataFrame:
    """Events of the rules' hosts. A host's stack are the rules' hosts it lies in, widest first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    around = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), ".")
    )
    pairs = hosts.select("host", F.explode(around).alias("outer"))
    found = pairs.join(hosts.select(F.col("host").alias("outer")), "outer", "left_semi")
    stacks = found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.length("outer"), "outer"))).alias("s"))
    return _events(stacks.select(turned(F.col("host")).cast("binary").alias("key"), F.col("s.outer").alias("stack")))


def path_key(name: Column, route: Column) -> Column:
    return F.concat(turned(name).cast("binary"), F.lit(b"\x00"), route.cast("binary"))


def path_events(rules: DataFrame) -> DataFrame:
    """Events of the rules' paths within their host; a stack holds the paths, shortest first."""
    known = rules.select("host", "path").distinct()
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left(F.col("path"), n))
    pairs = known.select("host", "path", F.explode(starts).alias("outer"))
    found = pairs.join(known.select("host", F.col("path").alias("outer")), ["host", "outer"], "left_semi")
    stacks = found.groupBy("host", "path").agg(
        F.array_sort(F.collect_list(F.struct(F.length("outer"), "outer"))).alias("s")
    )
    return _events(stacks.select(path_key(F.col("host"), F.col("path")).alias("key"), F.col("s.outer").alias("stack")))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page row.

    ``rules`` has host, path and action. A rule fits its host and all subdomains where the path
    starts with its path; the longest (host and path together, then the longer host) wins. Of
    rules alike in both, ``block`` wins. Rules with a null are ignored. A page without a rule
    has a null rule and the verdict ``default``. Null ids, null addresses and repeated rows
    stay as they are; other columns of ``pages`` are ignored. Without rules every page gets ``default``.
    """
    rules = rules.where("host is not null and path is not null and action is not null")
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # "block" after "allow"
    first = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    first = first.withColumn("row", F.monotonically_increasing_id())
    first = first.withColumn("key", turned(F.col("host")).cast("binary"))
    by_host = swept(first, host_events(rules))

    # One row for each rule host around the page, of which a host has as many as labels at most.
    second = by_host.select("page_id", "host", "path", F.col("row").alias("page"), F.explode_outer("stack").alias("outer"))
    second = second.withColumn("row", F.monotonically_increasing_id())
    second = second.withColumn("key", F.coalesce(path_key(F.col("outer"), F.col("path")), F.lit(b"")))
    by_path = swept(second, path_events(rules))

    top = F.when(F.col("outer").isNotNull() & (F.size("stack") > 0), F.element_at("stack", -1))
    hits = by_path.withColumn("rule_path", top)
    best = F.when(
        F.col("rule_path").isNotNull(),
        F.struct(
            (F.length("outer") + F.length("rule_path")).alias("size"),
            F.length("outer").alias("width"),
            F.col("outer").alias("host"),
            F.col("rule_path").alias("path"),
        ),
    )
    chosen = hits.groupBy("page", "page_id", "host", "path").agg(F.max(best).alias("best"))
    actions = rules.select(
        F.col("host").alias("best_host"), F.col("path").alias("best_path"), "action"
    )
    verdicts = chosen.select(
        "page_id", "host", "path", F.col("best.host").alias("best_host"), F.col("best.path").alias("best_path")
    ).join(actions, ["best_host", "best_path"], "left")
    return verdicts.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("action").isNotNull(), F.concat("best_host", "best_path")).alias("rule"),
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
