"""Database tables. Connection options always come from the caller."""

import os
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BYTES = 7  # of an id that are compared as a number at a time


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def id_ranges(column: str, boundaries: Sequence[str], binary: str = "{}") -> list[str]:
    """Non-overlapping WHERE clauses that together cover every row.

    ``boundaries`` are ascending split points of a text id. ``n`` points make
    ``n + 1`` partitions; rows with a null id go to the first one. The points are in
    byte order, so the column must be compared that way too: ``binary`` is the database's
    expression for it, such as ``CAST({} AS BINARY)`` or ``{} COLLATE "C"``. It may be left
    out where all ids are written in one case of letters and digits.
    """
    points = list(boundaries)
    if points != sorted(set(points)):
        raise ValueError("boundaries must be ascending and distinct")
    if not points:
        return ["1 = 1"]
    if binary.count("{}") != 1:
        raise ValueError("binary must hold {} once, where the column goes")
    plain = all(p.isascii() and p.isalnum() and p == p.lower() for p in points)
    if binary == "{}" and not plain:
        raise ValueError("split points with capitals or marks need a binary comparison")
    value = binary.format(column)
    inner = [
        f"{value} >= {_quoted(low)} AND {value} < {_quoted(high)}"
        for low, high in zip(points, points[1:])
    ]
    return [
        f"{value} < {_quoted(points[0])} OR {column} IS NULL",
        *inner,
        f"{value} >= {_quoted(points[-1])}",
    ]


def hash_parts(expression: str, partitions: int) -> list[str]:
    """WHERE clauses for any kind of id: ``expression`` is the database's non-negative hash of it.

    Rows whose hash is null go to the first part.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    parts = [f"MOD({expression}, {partitions}) = {i}" for i in range(partitions)]
    return [f"{parts[0]} OR ({expression}) IS NULL", *parts[1:]]


def hex_boundaries(partitions: int, digits: int = 4) -> list[str]:
    """Evenly spaced split points for ids that start with hexadecimal digits."""
    space = 16**digits
    if not 1 <= partitions <= space:
        raise ValueError(f"partitions must be between 1 and {space}")
    return [f"{space * i // partitions:0{digits}x}" for i in range(1, partitions)]


class _Range(NamedTuple):
    """Rows of the ids from ``low`` to ``high``, both of which occur."""

    low: str
    high: str
    rows: int

    @property
    def shared(self) -> int:
        """Bytes that all ids of the range begin with."""
        return len(os.path.commonprefix([self.low.encode(), self.high.encode()]))

    def cuts(self, points: Sequence[int]) -> list[int]:
        """Numbers to split at: the points, and behind each, so that a frequent number stands alone."""
        first, last = (
            int.from_bytes(i.encode()[self.shared :][:_BYTES].ljust(_BYTES, b"\0")) for i in (self.low, self.high)
        )
        return sorted({c for p in points for c in (p, p + 1) if first < c <= last})


def _spec(ranges: list[_Range], cuts: list[list[int]]) -> Column:
    """The range that holds ``id``, with its split numbers."""
    specs = [
        F.struct(
            F.lit(r.low).alias("low"),
            F.lit(r.high).alias("high"),
            F.lit(r.shared).alias("shared"),
            F.array(*map(F.lit, c)).cast("array<bigint>").alias("cuts"),
        )
        for r, c in zip(ranges, cuts, strict=True)
    ]
    return F.get(F.filter(F.array(*specs), lambda s: (s["low"] <= F.col("id")) & (F.col("id") <= s["high"])), 0)


def _numbered(ids: DataFrame, ranges: list[_Range], cuts: list[list[int]]) -> DataFrame:
    """Rows of the ranges, with the bytes behind the range's shared ones as a number."""
    rest = F.substring(F.encode("id", "utf-8"), F.col("range.shared") + 1, F.lit(_BYTES))
    number = F.conv(F.rpad(F.hex(rest), 2 * _BYTES, "0"), 16, 10).cast("bigint")
    return ids.withColumn("range", _spec(ranges, cuts)).where("range is not null").withColumn("number", number)


def quantile_boundaries(ids: DataFrame, column: str, partitions: int) -> list[str]:
    """Split points that give about ``partitions`` even parts, from a stored column of ids.

    No part of ``id_ranges`` over these points holds more than a share of the rows, but for an id
    that alone has more; there are at most twice as many parts, and one. Quantile sketches of the
    ids' next bytes, merged over the tasks, split every range that is too large until none is. The
    driver holds a number of ranges that goes with ``partitions``. Null ids are left out.
    Ids that differ in closing zero bytes only stay together.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    ids = ids.select(F.col(column).cast("string").alias("id")).where("id is not null")
    measures = F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows")
    whole = _Range(*ids.agg(*measures).first())
    share, done, large = whole.rows / partitions, [], [whole]
    while large:
        done += [r for r in large if r.rows <= share or r.low == r.high]
        large = [r for r in large if r.rows > share and r.low < r.high]
        if large:
            parts = _split(ids, large, partitions, measures)
            done += [r for r in parts if r in large]
            large = [r for r in parts if r not in large]
    points, filled = [], 0
    for r in sorted(done):
        if filled and filled + r.rows > share:
            points.append(r.low)
            filled = 0
        filled += r.rows
    return points


def _split(ids: DataFrame, ranges: list[_Range], partitions: int, measures: tuple[Column, ...]) -> list[_Range]:
    shares = [i / partitions for i in range(1, partitions)]
    sketch = F.percentile_approx("number", shares, 10 * partitions).alias("points")
    sketched = _numbered(ids, ranges, [[] for _ in ranges]).groupBy(F.col("range.low").alias("low")).agg(sketch)
    points = {r.low: r.points for r in sketched.collect()}
    cuts = [r.cuts(points[r.low]) for r in ranges]
    part = F.size(F.filter("range.cuts", lambda c: c <= F.col("number")))
    parts = _numbered(ids, ranges, cuts).groupBy(F.col("range.low").alias("begin"), part.alias("part")).agg(*measures)
    return [_Range(r.low, r.high, r.rows) for r in parts.collect()]


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    *,
    id_column: str = "product_id",
    boundaries: Sequence[str] | None = None,
    binary: str = "{}",
    hashed: str | None = None,
    numeric_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    one_task: bool = False,
    fetch_rows: int = 10_000,
) -> DataFrame:
    """Scan a table in parallel.

    Text ids are split at ``boundaries`` (see ``id_ranges``) or by a hash expression into
    ``partitions`` parts; a numeric column is split evenly between ``lower`` and ``upper``.
    Without a split, ``one_task`` must say that one task may read it all. ``fetch_rows``
    bounds what a connection holds at a time.
    """
    properties = {"fetchsize": str(fetch_rows), **properties}
    clauses = None
    if boundaries is not None:
        clauses = id_ranges(id_column, boundaries, binary)
    elif hashed is not None:
        clauses = hash_parts(hashed, partitions or 1)
    if clauses is not None:
        return spark.read.jdbc(url, table, predicates=clauses, properties=properties)
    if numeric_column is not None:
        return spark.read.jdbc(
            url,
            table,
            column=numeric_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            properties=properties,
        )
    if not one_task:
        raise ValueError("give boundaries, a hash or a numeric column to split by, or one_task=True")
    return spark.read.jdbc(url, table, properties=properties)


def append_table(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str],
    *,
    partitions: int = 16,
    batch_rows: int = 10_000,
) -> None:
    """Append all rows in one job, ``partitions`` connections at a time."""
    options = {**properties, "batchsize": str(batch_rows), "numPartitions": str(partitions)}
    df.write.jdbc(url, table, mode="append", properties=options)
