"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "1000"  # whole documents: a batch is held by the JVM and by the Python worker at once
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers, once per application.

    The registered queries and the pipeline call it.  Who calls operators with
    Python parts directly calls it once, or installs the package on the executors.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def for_documents(spark: SparkSession) -> SparkSession:
    """Arrow batches that suit long texts, unless the session has its own; for applications, the library's operators leave the session alone."""
    if spark.conf.get(BATCH, None) in (None, "10000"):  # Spark's own choice
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the folder that spark.checkpoint.dir names; only a local session may leave it unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewell-"))
    return df.checkpoint()
