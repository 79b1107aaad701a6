"""Append-only score tables: reading, pairing and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a stored case score.
SCORE_SCHEMA = (
    "case_id STRING, scroll_id STRING, score DOUBLE, topo_score DOUBLE, surface_dice DOUBLE, voi_score DOUBLE,"
    " voi_split DOUBLE, voi_merge DOUBLE, topo_f1_dim0 DOUBLE, topo_f1_dim1 DOUBLE, topo_f1_dim2 DOUBLE,"
    " n_foreground DOUBLE, seconds DOUBLE"
)


def load_scores_latest(spark: SparkSession, path: str) -> DataFrame:
    """Scores from JSON lines: unknown keys ignored, broken lines dropped, the last line per case kept."""
    raw = spark.read.option("mode", "DROPMALFORMED").schema(SCORE_SCHEMA).json(path)
    place = F.struct(
        F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"), F.monotonically_increasing_id(),
    )
    return latest(raw.withColumn("__place", place).filter("case_id IS NOT NULL"), "__place")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The row with the largest ``order`` per case."""
    rest = [c for c in rows.columns if c not in ("case_id", order)]
    return (
        rows.groupBy("case_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("case_id", "r.*")
    )


def score_pairs(
    predictions: DataFrame, labels: DataFrame, done: DataFrame | None = None, cases: DataFrame | None = None
) -> DataFrame:
    """What is to be done with each case of a condition, from shape tables ``volume_id, d, h, w``.

    ``cases`` names the requested ones; without it they are those with a prediction. ``status`` is ``done``,
    ``missing_prediction``, ``missing`` (no label), ``shape_mismatch`` or ``score``.
    """
    p = predictions.select("volume_id", *[F.col(c).alias(f"p{c}") for c in "dhw"])
    t = labels.select("volume_id", "d", "h", "w")
    asked = (predictions if cases is None else cases).select("volume_id").distinct()
    rows = asked.join(p, "volume_id", "left").join(t, "volume_id", "left")
    if done is not None:
        rows = rows.join(done.select("volume_id", F.lit(True).alias("was")).distinct(), "volume_id", "left")
    else:
        rows = rows.withColumn("was", F.lit(None).cast("boolean"))
    same = (F.col("pd") == F.col("d")) & (F.col("ph") == F.col("h")) & (F.col("pw") == F.col("w"))
    return rows.select(
        "volume_id",
        F.when(F.col("was"), "done").when(F.col("pd").isNull(), "missing_prediction").when(F.col("d").isNull(), "missing")
        .when(~same, "shape_mismatch").otherwise("score").alias("status"),
    )


def append_scores(scores: DataFrame, path: str, condition: str) -> None:
    """Append scored volumes as case rows of a condition, which :func:`load_scores_latest` reads back."""
    known = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
    rows = scores.withColumnRenamed("volume_id", "case_id").withColumn("condition", F.lit(condition))
    rows.select("condition", *[c for c in known if c in rows.columns]).write.mode("append").partitionBy("condition").json(path)
