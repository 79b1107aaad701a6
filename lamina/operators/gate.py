"""Keep a proposed edit of a volume only where the score does not get worse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M


def metric_gate(
    counts: DataFrame, control: DataFrame, proposed: DataFrame, metric: str, min_delta: float = 0.0
) -> DataFrame:
    """One verdict per volume.

    ``counts`` holds ``volume_id, n_components, n_candidates, n_edits``. A volume
    without edits has no scores and is never accepted; a change of exactly
    ``min_delta`` is accepted.
    """
    edited = F.col("n_edits") > 0
    side = lambda df, s: df.select("volume_id", F.col("score").alias(f"{s}_score"), F.col(metric).alias(f"{s}_{metric}"))
    rows = counts.join(side(control, "control"), "volume_id", "left").join(side(proposed, "proposed"), "volume_id", "left")
    for c in ("control_score", "proposed_score", f"control_{metric}", f"proposed_{metric}"):
        rows = rows.withColumn(c, F.when(edited, F.col(c)))
    delta = F.col("proposed_score") - F.col("control_score")
    return rows.select(
        "volume_id",
        "n_components",
        "n_candidates",
        "n_edits",
        F.coalesce(delta >= min_delta, F.lit(False)).alias("accepted"),
        "control_score",
        "proposed_score",
        delta.alias("score_delta"),
        f"control_{metric}",
        f"proposed_{metric}",
        (F.col(f"proposed_{metric}") - F.col(f"control_{metric}")).alias(f"{metric}_delta"),
    )


def gated_masks(verdicts: DataFrame, control: DataFrame, proposed: DataFrame) -> DataFrame:
    """The proposed mask of accepted volumes and the control mask of all others."""
    accepted = verdicts.filter("accepted").select("volume_id")
    kept = control.select(*M.VOXEL).join(accepted, "volume_id", "left_anti")
    return kept.unionByName(proposed.select(*M.VOXEL).join(accepted, "volume_id", "left_semi"))


def gate_summary(verdicts: DataFrame, metric: str) -> DataFrame:
    """Totals over all volumes; the means cover the scored ones."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_volumes"),
        F.count_if(F.col("n_candidates") > 0).alias("n_with_candidates"),
        F.count_if("accepted").alias("n_accepted"),
        F.avg("score_delta").alias("mean_score_delta"),
        F.avg(f"{metric}_delta").alias(f"mean_{metric}_delta"),
    )
