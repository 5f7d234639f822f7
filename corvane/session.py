"""A session with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers, once for each context, so that none needs it on its path."""
    context = spark.sparkContext
    if not getattr(context, "_corvane_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"  # read by the driver alone, which serves it
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._corvane_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A session that has none gets a temporary one if it runs on one machine; on a cluster that would be
    another folder for each executor, so there the setting is required.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes to the application's part of the shared folder and reads back, which cuts the plan and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Lowers the session's Arrow batches to ``rows``, for whole texts go through Python in them.

    With the usual 10,000 rows, texts of some kilobytes make batches of tens of megabytes, which are
    held several times over in the executor and its workers. A lower setting stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return df


def session(app: str = "corvane", master: str | None = None, shuffle_gb: float | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, skew joins split. ``shuffle_gb`` sizes shuffle partitions to about 128 MB."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    if shuffle_gb is not None:
        settings["spark.sql.shuffle.partitions"] = str(max(8, round(shuffle_gb * 8)))
    return ship(b.config(map=settings | conf).getOrCreate())
