"""Parquet tables and JSON records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalase.schemas import RAW


def read_features(
    spark: SparkSession,
    path: str,
    *,
    id_column: str = "product_id",
    vector_column: str = "features_vector",
) -> DataFrame:
    """Feature table as ``product_id`` and an array ``features_vector``.

    Array columns and MLlib vector columns (dense or sparse) are both accepted.
    """
    df = spark.read.parquet(path)
    return df.select(
        F.col(id_column).cast("string").alias("product_id"),
        as_array(df, vector_column).alias("features_vector"),
    )


def as_array(df: DataFrame, column: str) -> Column:
    """The vector column as an array, whatever its stored type."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


def to_raw(df: DataFrame) -> DataFrame:
    """Rows cast to the fixed raw schema, in its column order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])


def append_raw(df: DataFrame, path: str) -> None:
    """Append rows to the raw product table in one job."""
    to_raw(df).write.mode("append").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(path)


def as_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept, for any text sink."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias("record"))
