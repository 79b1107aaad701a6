"""Scoring of prediction tables as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina import model as M
from lamina.operators.score import case_score
from lamina.session import settle

SCHEMA = "volume_id STRING, z INT, y INT, x INT"
ANNOUNCED = "volume_id STRING, n_rows BIGINT"


def _existing(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing or empty table means nothing was scored
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def announce(predictions: DataFrame, volumes: DataFrame, path: str) -> None:
    """Append the row count of every volume's prediction to the manifest; a volume without rows counts 0."""
    counts = predictions.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = volumes.select("volume_id").join(counts, "volume_id", "left").na.fill(0, ["n_rows"])
    rows.write.mode("append").parquet(path)


def score_incrementally(
    spark,
    incoming: str,
    manifest: str,
    labels: DataFrame,
    volumes: DataFrame,
    results: str,
    checkpoint: str,
    tolerance: float = M.SURFACE_TOLERANCE,
) -> StreamingQuery:
    """Score every volume once all rows that ``manifest`` announces for it have landed; append to ``results``.

    Rows of a volume may land in any number of files and triggers, before or after its announcement; the counts seen
    so far are the stream's state, one small entry a volume. A volume announced with 0 rows is scored as an empty
    prediction. Volumes that already have a result are skipped, so a batch that is replayed after a restart adds
    nothing twice. Call again to pick up later files; the query stops when all present files are counted.
    """
    stream = lambda schema, path: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
    none = F.lit(None).cast("long")
    landed = stream(SCHEMA, incoming).select("volume_id", F.lit(1).cast("long").alias("landed"), none.alias("announced"))
    told = stream(ANNOUNCED, manifest).select("volume_id", F.lit(0).cast("long").alias("landed"), F.col("n_rows").alias("announced"))
    counts = landed.unionByName(told).groupBy("volume_id").agg(
        F.sum("landed").alias("landed"), F.max("announced").alias("announced"))

    def score_batch(batch: DataFrame, _: int) -> None:
        ready = batch.filter("landed >= announced").select("volume_id")
        done = _existing(spark, results)
        if done is not None:
            ready = ready.join(done.select("volume_id").distinct(), "volume_id", "left_anti")
        ready = settle(ready)
        if ready.isEmpty():
            return
        here = lambda df: df.join(ready, "volume_id", "left_semi")
        rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(incoming)
        scored = case_score(here(rows).distinct(), here(labels), here(volumes), tolerance)
        scored.write.mode("append").parquet(results)

    return (
        counts.writeStream.outputMode("update").foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
