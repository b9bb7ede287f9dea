"""Tags and character references of page text, as column expressions."""

import json
from collections.abc import Callable
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as Python's patterns know them.
_SPACE = r"\s\x1c-\x1f"
# What may stand in a tag behind its name. A ">" in quotes does not end the tag, unless the
# quote stays open. All repeats are possessive: Java runs those as loops, while an ordinary
# repeated group would recurse once per attribute.
_INSIDE = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)"""
_SKIPPED = rf"<!--.*?(?:-->|\z)|<[!?][^>]*+>|<((?i:script|style|title|textarea))(?=[{_SPACE}/>]){_INSIDE}>.*?(?=</(?i:\1)[{_SPACE}]*+>|\z)"
_ATTRIBUTE = rf"""([^{_SPACE}"'>/=]++)(?:[{_SPACE}]*+=[{_SPACE}]*+("[^"]*+"|'[^']*+'|[^{_SPACE}"'>]++))?+"""


def tags(html: Column, name: str) -> Column:
    """The inside of every start tag of a name that has one, in page order; null for no page.

    Comments, declarations and the content of scripts, styles, titles and text areas hold no
    tags. A tag that the page leaves open is none.
    """
    letters = "".join(f"[{c.lower()}{c.upper()}]" for c in name)
    wanted = rf"<{letters}(?=[{_SPACE}/>])({_INSIDE})>"
    token = rf"(?sU){_SKIPPED}|{wanted}|</?[a-zA-Z][^{_SPACE}/>]*+{_INSIDE}>"
    # Nothing that counts ends behind the last ">"; an open rest would be read again and again.
    closed = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    inside = F.regexp_extract_all(closed, F.lit(token), F.lit(2))
    return F.when(html.isNotNull(), F.filter(inside, lambda x: x != ""))


def attribute(inside: Column, name: str) -> Column:
    """Value of the first attribute of a name, references decoded; empty without a value, null if absent."""
    names = F.transform(F.regexp_extract_all(inside, F.lit(f"(?U){_ATTRIBUTE}"), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inside, F.lit(f"(?U){_ATTRIBUTE}"), F.lit(2))
    raw = F.get(values, F.array_position(names, name).cast("int") - 1)
    quoted = F.left(raw, F.lit(1)).isin("'", '"')
    return unescaped(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def unescaped(text: Column) -> Column:
    """Character references decoded by the rules of the HTML standard."""
    parts = F.split(text, "&")
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_reference(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def _reference(part: Column) -> Column:
    """Text that followed an ampersand, with the reference at its start decoded."""
    decimal, hexadecimal = r"(?s)^#([0-9]++);?+(.*)$", r"(?s)^#[xX]([0-9a-fA-F]++);?+(.*)$"
    named = r"^[^\t\n\f <&#;]{1,32}+;?+"
    return (
        F.when(part.rlike("^#[0-9]"), F.concat(_character(_number(part, decimal, 10)), F.regexp_extract(part, decimal, 2)))
        .when(part.rlike("^#[xX][0-9a-fA-F]"), F.concat(_character(_number(part, hexadecimal, 16)), F.regexp_extract(part, hexadecimal, 2)))
        .when(F.startswith(part, F.lit("amp;")), F.concat(F.lit("&"), F.substring(part, F.lit(5), F.length(part))))
        .when(part.rlike(named), _let(F.regexp_extract(part, named, 0), lambda name: _named(part, name)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def _number(part: Column, pattern: str, base: int) -> Column:
    digits = F.ltrim(F.regexp_extract(part, pattern, 1), F.lit("0"))
    # Beyond any character, whatever the digits are; an empty rest is zero.
    return F.when(F.length(digits) > 8, F.lit(1 << 32)).otherwise(
        F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint")
    )


def _character(number: Column) -> Column:
    """The character of a number; numbers that stand for none follow the standard's replacements."""
    low = F.array(*[F.lit(unescape(f"&#{n};")) for n in range(160)])
    lost = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    none = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(number < 160, F.get(low, number.cast("int")))
        .when(lost, F.lit("\ufffd"))
        .when(none, F.lit(""))
        .otherwise(char)
    )


def _named(part: Column, name: Column) -> Column:
    """The longest known name that ``name`` starts with, decoded; as it was if there is none."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def looked_up(known: Column) -> Column:
        sizes = F.sequence(F.length(name), F.least(F.length(name), F.lit(2)), F.lit(-1))
        found = F.filter(sizes, lambda n: F.try_element_at(known, F.left(name, n)).isNotNull())
        best = F.get(found, 0)
        rest = F.substring(part, best + 1, F.length(part))
        return F.when(best.isNull(), F.concat(F.lit("&"), part)).otherwise(
            F.concat(F.try_element_at(known, F.left(name, best)), rest)
        )

    return _let(table, looked_up)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, worked out once however often it is named there."""
    return F.transform(F.array(value), use)[0]
