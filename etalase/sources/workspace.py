"""Where intermediate tables go.

A job that reads an intermediate result more than once writes it as Parquet to
the folder the cluster shares, so a lost executor costs a re-read and not a
recomputation.
"""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not _one_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="etalase-")
        spark.sparkContext.setCheckpointDir(root)
    _require_shared(spark, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _require_shared(spark: SparkSession, root: str) -> None:
    """Stop if the folder is one that every machine has for itself.

    Each executor would write to its own disk, and a later read would miss rows without an
    error. So a small table is written once per application and must come back whole.
    """
    context = spark.sparkContext
    if _one_machine(context.master) or not is_local(root) or _shared.get(root) == context.applicationId:
        return
    rows = 4 * max(context.defaultParallelism, 4)
    path = f"{root.rstrip('/')}/shared-{uuid.uuid4().hex}"
    spark.range(0, rows, 1, rows).write.parquet(path)
    try:
        found = spark.read.schema("id long").parquet(path).count()
    except PySparkException:  # the driver does not even see the folder, or a task misses its file
        found = 0
    if found != rows:
        raise RuntimeError(f"spark.checkpoint.dir is {root}, which the machines do not share")
    _shared[root] = context.applicationId


def is_local(path: str) -> bool:
    """Whether a path is in the file system of the machine that opens it, as far as its text tells."""
    return ":" not in path.removeprefix("file:").split("/")[0]


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back with its lineage cut."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run.

    Not needed where the package is installed on the executors.
    """
    context = spark.sparkContext
    if _shipped.get("application") != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="etalase-")) / package.name
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped["application"] = context.applicationId


_shipped: dict[str, str] = {}
_shared: dict[str, str] = {}
