"""Session settings and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "4m"  # bytes of an Arrow batch; 10,000 rows of long texts would else be one


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g",
                  name: str = "sparkcast") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without it (tests, a laptop) gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="sparkcast-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to a table in the shared folder and go on from there.

    For frames that several branches or rounds read: the work before is done once, a lost executor
    does not bring it back, and later readers still prune columns.
    """
    path = f"{scratch_folder(df.sparkSession)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for the Python workers, once per Spark application.

    Batches for the workers are bounded by their bytes, not only by their rows, unless the session has a bound of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)
    if getattr(context, "_sparkcast_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="sparkcast-package-"), "sparkcast")
    context.addPyFile(shutil.make_archive(base, "zip", root, "sparkcast"))
    context._sparkcast_shipped = True
