"""Metric-gated edits from masks to scores: propose, score what changed, keep what does not lose."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.operators import bridge, unmerge
from lamina.operators.gate import gated_masks, metric_gate
from lamina.operators.score import case_score
from lamina.session import settle


class GatedRun(NamedTuple):
    """What a gated run leaves: the mask of every volume, a verdict and a score of each, by condition."""

    masks: DataFrame
    verdicts: DataFrame
    scores: DataFrame


def gated_run(
    control: DataFrame,
    labels: DataFrame,
    volumes: DataFrame,
    settings: M.UnmergeSettings | M.BridgeSettings,
    tolerance: float = M.SURFACE_TOLERANCE,
) -> GatedRun:
    """Cut or bridge every volume of the ``control`` mask and keep an edit only where the score does not fall.

    Proposals are made once. Only volumes with a proposal are scored a second time; a volume without one keeps its
    control mask and score. ``scores`` holds two rows a volume, of the conditions ``control`` and ``accepted``.
    """
    control = settle(control.select(*M.VOXEL).distinct())
    if isinstance(settings, M.UnmergeSettings):
        metric = "voi_merge"
        proposed, info = unmerge.propose_cuts(control, volumes, settings)
        counts = unmerge.cut_counts(info, volumes)
    else:
        metric = "voi_split"
        proposed, counts = bridge.propose_bridges(control, volumes, settings)
    proposed, counts = settle(proposed), settle(counts)
    edited = counts.filter("n_edits > 0").select("volume_id")
    here = lambda df: df.join(edited, "volume_id", "left_semi")
    before = settle(case_score(control, labels, volumes, tolerance))
    after = settle(case_score(here(proposed), here(labels), here(volumes), tolerance))
    verdicts = settle(metric_gate(counts, before, after, metric, settings.min_score_delta))
    won = verdicts.filter("accepted").select("volume_id")
    kept = before.join(won, "volume_id", "left_anti").unionByName(after.join(won, "volume_id", "left_semi"))
    scores = before.withColumn("condition", F.lit("control")).unionByName(kept.withColumn("condition", F.lit("accepted")))
    return GatedRun(gated_masks(verdicts, control, proposed), verdicts, scores)
