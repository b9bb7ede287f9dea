"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order models over the characters of tokens are counted from labelled samples of the
corpus: what the fixed patterns found is random, long runs of letters are ordinary, and so are tokens
with marks or digits that stand in several different texts outside fixed values. A long token
whose log-likelihood ratio of the two models passes the threshold is a secret too. Everything is
built-ins; what reaches the driver are the two tables of character pairs, whose size is fixed.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, pattern, captured group whose length counts, least length.
KINDS: tuple[tuple[str, str, int, int], ...] = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # A run that is too short fails whole, so the least length can stand in the pattern.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
METHOD = "random"
# What stands before the value of an assignment.
NAME = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{12,}(?![A-Za-z0-9+/_=-])"
# Tokens with a mark or digit (identifiers, paths, dates), ordinary if they stand in so many different texts.
JOINED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z]*[0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
COMMON = 3
SMOOTHING = 0.5
# Least log-likelihood ratio of a token: random strings are rarer than one token in 100,000.
LEAST_RATIO = 12.0
BLOCK = 512

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _let(value: Column, kind: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once however often it is named there."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: use(v))


def running(numbers: Column) -> Column:
    """Sums up to and with each place, in blocks, so that long arrays are not copied for each place."""
    within = lambda part: F.aggregate(
        part,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
        lambda b: within(F.slice(numbers, b * BLOCK + 1, BLOCK)),
    )
    joined = F.aggregate(
        blocks,
        F.struct(F.array().cast("array<array<int>>").alias("parts"), F.lit(0).alias("sum")),
        lambda acc, part: F.struct(
            F.concat(acc["parts"], F.array(F.transform(part, lambda x: x + acc["sum"]))).alias("parts"),
            (acc["sum"] + F.element_at(part, -1)).alias("sum"),
        ),
        lambda acc: F.flatten(acc["parts"]),
    )
    return F.when(F.size(numbers) > 0, joined).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, rank: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, rank, kind, end) in code points.

    The texts between the matches and the matches themselves give the places. A match whose
    ``group`` is shorter than ``least`` is dropped after it has taken its room.
    """
    regex = F.lit(pattern)
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: gap + F.length(m))
        return F.zip_with(
            running(steps),
            found,
            lambda end, m: F.struct(
                (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")
            ),
        )

    every = _let(F.regexp_extract_all(text, regex, F.lit(0)), f"array<{SPAN}>", placed)
    if group:
        sizes = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), F.length)
        every = F.array_compact(F.zip_with(every, sizes, lambda s, n: F.when(n >= least, s)))
    return F.when(text.rlike(pattern), every).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and then kind."""
    return F.array_sort(
        F.concat(*[spans(text, p, rank, kind, group, least) for rank, (kind, p, group, least) in enumerate(KINDS)])
    )


def cut_out(text: Column, found: Column) -> Column:
    return F.transform(found, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def _apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` that touch none of ``base``."""
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _joined(rows: DataFrame) -> DataFrame:
    """(label, token, n) of the joined tokens of ``COMMON`` different texts, outside base spans.

    n is the number of those texts, so that copies of a text with a secret tell nothing.
    """
    tokens = cut_out(F.col("text"), _apart(spans(F.col("text"), JOINED, 0, METHOD), F.col("found")))
    each = rows.select(F.xxhash64("text").alias("of"), F.explode(tokens).alias("token")).distinct()
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return counted.select(F.lit(0).alias("label"), "token", "n")


def _pairs(tokens: DataFrame, joined: DataFrame) -> DataFrame:
    """Counts of neighbouring characters by label; equal tokens are added up first."""
    counted = tokens.groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")).unionByName(joined)
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pairs = counted.where(F.length("token") > 1).select("label", "n", "token", at.alias("at"))
    return pairs.groupBy("label", F.substring("token", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """log P(random) - log P(ordinary) of each pair of characters, row by row of ``ALPHABET``.

    All documents are read. The counts that come to the driver are at most two per pair of
    characters. Without samples of a kind its model is even, and nothing long enough is missed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).select("text", base_spans(F.col("text")).alias("found"))
    value = lambda s: F.regexp_replace(s, NAME, "")
    random = rows.where(F.size("found") > 0).select(
        F.lit(1).alias("label"), F.explode(F.transform(cut_out(F.col("text"), F.col("found")), value)).alias("token")
    )
    ordinary = rows.select(
        F.lit(0).alias("label"), F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token")
    )
    place = {c: i for i, c in enumerate(ALPHABET)}
    n = len(place)
    counts = [[SMOOTHING] * (n * n) for _ in range(2)]
    for row in _pairs(random.unionByName(ordinary), _joined(rows)).collect():
        if row.pair[0] in place and row.pair[1] in place:
            counts[row.label][place[row.pair[0]] * n + place[row.pair[1]]] += row.n
    sums = [[sum(c[i * n : i * n + n]) for i in range(n)] for c in counts]
    return [
        math.log(counts[1][i] / sums[1][i // n]) - math.log(counts[0][i] / sums[0][i // n]) for i in range(n * n)
    ]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ``ALPHABET``'s characters."""
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in model)), ",").cast("array<double>")
    n, letters = len(ALPHABET), F.lit(ALPHABET)
    places = F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1)
    return _let(
        places,
        "double",
        lambda p: F.aggregate(
            F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.get(weights, a * n + b)),
            F.lit(0.0),
            lambda total, x: total + x,
        ),
    )


def scanned(docs: DataFrame, model: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``base`` and ``found`` (base and method): arrays of (start, rank, kind, end).

    A token that touches a base span is left to it. A null or empty text has no spans. Repeated
    rows and null ids stay; columns of ``docs`` named base or found are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("base", base_spans(text))
    tokens = spans(text, TOKEN, len(KINDS), METHOD)
    likely = lambda s: ratio(F.substring(text, s["start"] + 1, s["end"] - s["start"]), model) >= least
    more = F.filter(_apart(tokens, F.col("base")), likely)
    return rows.withColumn("found", F.array_sort(F.concat("base", more)))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, model: list[float], least: float = LEAST_RATIO, instead: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced; other columns and clean texts stay as they are.

    Overlapping spans are replaced as one. ``n_chars``, where there is one, follows the text.
    """
    # The columns travel as one, so that none of them can share a name with the spans.
    rows = scanned(docs.select("text", F.struct(*docs.columns).alias("row")), model, least)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    new = F.aggregate(
        "found",
        begin,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]),
                F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(instead)),
            )
            .otherwise(acc["text"])
            .alias("text"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    hit = F.size("found") > 0
    rows = rows.select("row", hit.alias("hit"), F.when(hit, new).otherwise(F.col("text")).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("hit"), size).otherwise(F.col("row")["n_chars"])
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
