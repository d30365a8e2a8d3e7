"""Session defaults shared by tests, the bench and notebooks.

On a cluster the submitter owns the session; nothing here is applied to a session that
already exists.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for one machine, with the SQL settings the jobs are written against."""
    memory = os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, label: str) -> str:
    """Fresh folder path for a job's own state (streaming checkpoints, landed tables).

    The folder the cluster names in ``spark.checkpoint.dir`` is visible to every executor.
    Only where that setting is absent (tests on one machine) is a private one used.
    """
    import uuid

    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """The frame stored as a table in the shared folder and read back.

    Cuts the lineage of a frame that several passes read, model fits above all, with something that
    outlives the executors it was computed on.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
