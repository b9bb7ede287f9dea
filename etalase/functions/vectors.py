"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def cosine(u: Column, v: Column, u_norm: Column | None = None) -> Column:
    """Cosine similarity as a float; ``u_norm`` saves work where it is known.

    Null where either vector is null or has no direction (length zero or not finite).
    Vectors of different size are an error.
    """
    mismatch = F.raise_error(
        F.format_string("vectors of different size: %s and %s", F.size(u), F.size(v))
    ).cast("double")
    lengths = (norm(u) if u_norm is None else u_norm) * norm(v)
    similarity = F.try_divide(dot(u, v), lengths)
    similarity = F.when(F.size(u) != F.size(v), mismatch).otherwise(similarity)
    return F.nullif(similarity, F.lit(float("nan"))).cast("float")


def unit(u: Column) -> Column:
    """The vector scaled to length one; null if its length is zero or not finite."""

    def scaled(length: Column) -> Column:
        by_length = F.transform(u, lambda x: x.cast("double") / length)
        return F.when((length > 0) & (length < float("inf")), by_length)

    # The length is the variable of an outer step, or it would be summed again for
    # every element.
    return F.transform(F.array(norm(u)), scaled)[0]
