"""Spark session and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "scalarscape", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; ``conf`` overrides any setting.

    Without ``master`` the submit-time setting holds (a cluster), else the given one (tests, bench).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_scalarscape_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "scalarscape.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    context._scalarscape_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written under the checkpoint folder and read again: the form to iterate on.

    Unlike a checkpoint its size is known anew each round; inherited estimates of joins
    multiply from round to round until planning takes longer than the work. The files go
    when the application ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    read = spark.read.schema(df.schema).parquet(path)
    read._scalarscape_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` gave and that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_scalarscape_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    """Number of tasks that explicit repartitioning aims at: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the application has cores: for long computations on few or unsplittable files."""
    spark = df.sparkSession
    wanted = min(partitions_for(spark), spark.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
