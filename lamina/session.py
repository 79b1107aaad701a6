"""Session helpers: a local test session and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "lamina", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", os.environ.get("LAMINA_SHARED") or tempfile.mkdtemp(prefix="lamina-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder comes from ``spark.checkpoint.dir``. Only a session within one process, which
    has no other machine to share with, may fall back to a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # local-cluster starts executors of their own, so it is no exception.
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lamina-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name next to the checkpoints, for tables a job hands on."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        settle(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Cells that one task lists.
CELLS_A_TASK = 1 << 20


def tasks_for(cells: int) -> int:
    """How many tasks list ``cells`` rows if each lists a bounded number."""
    return max(1, -(-int(cells) // CELLS_A_TASK))


def by_cells(rows: DataFrame, cells: Column, *keys: str) -> DataFrame:
    """Deal ``rows``, each of which will be expanded to ``cells`` rows, by ``keys`` to tasks of bounded output.

    The number of tasks is given to Spark, which would else merge the small rows into one task.
    """
    total = rows.agg(F.sum(cells)).first()[0] or 0
    return rows.repartition(tasks_for(total), *keys)
