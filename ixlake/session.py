"""Session helpers: settings the engine relies on, and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Generated methods above 8000 bytes of bytecode are never compiled by the JVM's JIT, so
# wide decode projections must fall back to split methods rather than one huge one.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    HUGE_METHOD[0]: HUGE_METHOD[1],
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ixlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED = "spark.ixlake.shipped"


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session fit for the engine.

    Pins the time zone, since zone-less times are read as UTC everywhere, bounds the size
    of generated methods, and ships this package to the Python workers once per application.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(*HUGE_METHOD)
    if spark.conf.get(_SHIPPED, None) != spark.sparkContext.applicationId:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ixlake-package-")) / "ixlake_package.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for source in sorted(package.rglob("*.py")):
                bundle.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so lost executors cost no recomputation.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a
    local one is made, which only a local master can share with its executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not _is_local(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ixlake-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, for tables between steps."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not _is_local(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ixlake-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, as a table in the shared folder; its readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")
