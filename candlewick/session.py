"""Session helpers: local sessions, the shared work folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "candlewick", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may take a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="candlewick-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def stage_counted(df: DataFrame, name: str, **facts: str) -> tuple[DataFrame, dict]:
    """`stage`, and aggregates over the rows, name=SQL text, taken while they are written."""
    seen = Observation(name)
    rows = stage(df.observe(seen, *[F.expr(f"{value} AS {fact}") for fact, value in facts.items()]), name)
    return rows, seen.get


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the work folder and read it back.

    Used where a result is scanned several times (ranking, repeated fits): it cuts the lineage,
    survives the loss of executors, and stays columnar, so later scans read only their columns.
    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
