"""Pages as they arrive, appended as product rows.

Every page gives one row whatever else arrives, so the stream keeps no state and
needs no watermark.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from etalase.schemas import PAGES


def stream_pages(
    spark: SparkSession,
    path: str,
    glob: str = "*.parquet",
    files: int = 1000,
    size: str | None = None,
) -> DataFrame:
    """Parquet files of pages that appear under ``path``.

    A batch takes at most ``files`` files, or files up to ``size`` ("10g") where that is given,
    so a backlog comes in many batches.
    """
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", glob)
    if size is not None:
        reader = reader.option("maxBytesPerTrigger", size)
    else:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def append_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table; its commit log makes each row count once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_batches(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand each batch and its number to ``write``, for instance a database append.

    A batch that fails half-way is written again under the same number, so a writer that
    notes the number can leave it out; otherwise ``latest_rows`` folds the repeats.
    """
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
