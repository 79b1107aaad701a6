"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import shared_folder

#: A side of at most this many estimated bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    Unlike a checkpoint the copy is columnar, so later steps read only the columns they use.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`keep` wrote and that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of ended jobs now: its cleaner only learns of them when the driver collects garbage."""
    spark._jvm.System.gc()


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcasting only if its counted ``rows`` stay under the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def whole_text(column: str = "text") -> Column:
    """The text, an empty one where it is null."""
    return F.coalesce(F.col(column), F.lit(""))
