"""Session helpers: a local session for tests and benchmarks, and durable intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by the tests and ``bench.py``; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parlor")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors must reach.

    It is named by ``spark.checkpoint.dir``; where that is unset and all tasks run on the driver's machine, a folder
    beside the warehouse tables is taken. On a cluster that folder may be a machine's own, so the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several later jobs read. Runs a job at once."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
