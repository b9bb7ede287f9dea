"""Text helpers that treat every Unicode blank as white space."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)[\s\x1c-\x1f]"
# The same set, character by character.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    # Most texts have plain characters at both ends; those skip the character-wise trim.
    first, last = F.ascii(text), F.ascii(F.right(text, F.lit(1)))
    plain = first.between(33, 126) & last.between(33, 126)
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(_BLANKS)))


def words(text: Column) -> Column:
    """Distinct lower-case words, split at runs of white space."""
    parts = F.split(strip(F.lower(text)), f"{_BLANK}+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def present(text: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return text.isNotNull() & (text != "")


def shown(value: Column) -> Column:
    """A value as it appears in a prompt; null reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def grams(text: Column, lengths: Iterable[int]) -> Column:
    """Distinct substrings of the given lengths."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))
