"""Quality rules: one table of thresholds, compiled into one Spark projection of built-ins."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import BLANKS

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from or"
    " le la les de des un une et en que pour dans est sur qui ou elle par pas au"
    " der die das und den von zu mit sich ist im dem nicht ein eine auf"
    " el los las del una y se con no su para como más lo"
).split()

SYMBOLS = "#*$%&|<>"

# metric, lowest and highest value that passes; None: no bound.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_length", 2.0, 14.0),
    ("symbols_per_word", None, 0.2),
    ("stop_words_per_word", 0.02, None),
    ("duplicate_line_share", None, 0.35),
    ("shouted_word_share", None, 0.4),
)


def _windows(width: int) -> Column:
    """The words' runs of ``width``, as hashes."""
    starts = F.sequence(F.lit(1), F.size("words") - (width - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get("word_hashes", i + (k - 1)) for k in range(width)]))
    return F.when(F.size("words") >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(width: int) -> Column:
    """Words covered by runs that occur twice or more, compared word for word.

    Sorted runs with an equal neighbour are the repeated ones; each covers ``width`` words,
    less what the next one covers too.
    """
    starts = F.sequence(F.lit(1), F.size("words") - (width - 1))
    runs = F.array_sort(
        F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice("words", i, width), " ").alias("run"), i.alias("at"))
        )
    )
    return _let(
        runs,
        lambda s: _let(
            _with_equal_neighbour(s),
            lambda at: F.aggregate(
                F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        ),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once however often it is named there; an int."""
    return F.aggregate(F.array(value), F.lit(0), lambda _, v: use(v))


def _with_equal_neighbour(runs: Column) -> Column:
    """Sorted places of the runs that equal the one before or behind them in sorted ``runs``."""
    pairs = F.zip_with(
        runs,
        F.slice(runs, 2, F.size(runs)),
        lambda r, n: F.struct(r["at"].alias("at"), F.coalesce(r["run"] == n["run"], F.lit(False)).alias("same")),
    )
    before = F.concat(F.array(F.lit(False)), F.transform(pairs, lambda p: p["same"]))
    return F.array_sort(F.array_compact(F.zip_with(pairs, before, lambda p, b: F.when(p["same"] | b, p["at"]))))


def measured(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and the counts of every text; a null text counts as empty. Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    base = docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id",
        F.length(F.translate("text", blank, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = base.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("runs", _windows(width))
    bare = lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("runs")) == F.size("runs"), 0)
        .otherwise(_repeated_words(width))
        .cast("long")
        .alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: bare(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", loud)).cast("long").alias("n_loud_words"),
    )
    # Given out by a generator, which no filter on the counts passes: it would be worked out
    # below, once for every use of a word inside the functions above.
    return hashed.select("doc_id", F.inline(F.array(counts)))


def metrics() -> dict[str, Column]:
    """Ratios by name, from the counts; null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return {
        "n_words": F.col("n_words"),
        "mean_word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_words_per_word": share("n_stop_words", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "shouted_word_share": share("n_loud_words", "n_words"),
    }


def passes(thresholds: tuple = THRESHOLDS) -> Column:
    """All thresholds as one condition; a ratio that does not exist passes."""
    known, result = metrics(), F.lit(True)
    for name, low, high in thresholds:
        for bound, fails in ((low, lambda m, b: m < b), (high, lambda m, b: m > b)):
            if bound is not None:
                result = result & ~F.coalesce(fails(known[name], F.lit(bound)), F.lit(False))
    return result


def judged(docs: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every row, repeated rows each.

    ``base_failed``: under ten words, or more than a fifth of the words in repeated runs of five.
    ``kept``: not failed there, and within all ``thresholds``.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = measured(docs).withColumn("base_failed", failed)
    return counted.withColumn("kept", ~F.col("base_failed") & passes(thresholds))
