"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


# Generated methods over 8000 bytes are never compiled by the JVM. Past this limit Spark splits
# them into small ones instead, which makes wide feature projections several times faster.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to an existing session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the context has, or the one ``spark.checkpoint.dir`` names.

    A machine-local folder is only ever used when the master itself is local.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="spark-tickloom-", dir="/tmp")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged side that was counted to be small, else no hint.

    ``staged`` must already be cut from its lineage, so that counting it is cheap. Without the
    hint the planner joins by shuffle and splits skewed partitions.
    """
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged
