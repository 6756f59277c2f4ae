"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("latentia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: their workers may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_latentia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="latentia-")) / "latentia.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(path))
    context._latentia_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Only where the session names none (tests on one machine) a temporary folder takes its place.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="latentia-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/latentia-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables this application cut; results not yet computed lose what they read."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, what: str = "step", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, executors may be lost.

    The table is columnar and compressed, so later steps read only the columns they need; partitioned ``by`` columns,
    only the rows.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``cut`` returned; nothing that is still to be computed may read it."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def data_dir(sf: str = "sf0.001") -> str:
    return os.environ.get("LATENTIA_DATA", f"/root/testdata/{sf}")
