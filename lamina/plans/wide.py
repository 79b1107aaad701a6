"""Neighbourhood queries on volumes that reach over several words and tiles along every axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import stencils as S
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators import score
from lamina.operators.distance import distance_transform
from lamina.plans import fixtures as X
from lamina.plans.catalog import nearest_gap_sql
from lamina.plans.registry import query
from lamina.plans.scoring import MASKS, dilate_sql, erode_sql, scored_masks, voi_sql

_TRUTH = f"{MASKS}, {X.WIDE_SQL}, {X.wide_sql('wide', 'truth')}"
TILE = 8


def _truth(spark, folder):
    return X.wide(X.truth(spark, folder)), X.wide_volumes(spark, folder)


@query(
    "connected_components_wide",
    f"""{_TRUTH}, {X.component_sql('cc', 'wide', 26, X.WIDTH)} SELECT f.volume_id, f.z, f.y, f.x, CAST(lab AS BIGINT) AS component FROM cc JOIN cc_f f USING (volume_id, id)""",
    derive_once=True,
)
def connected_components_wide(spark, folder):
    return C.connected_components(*_truth(spark, folder), 26, tile=TILE)


@query(
    "closing_wide",
    f"{_TRUTH}, {dilate_sql('grown', 'wide', 2, width=X.WIDTH)}, {erode_sql('shut', 'grown', 2)} SELECT * FROM shut",
    derive_once=True,
)
def closing_wide(spark, folder):
    return P.close(*_truth(spark, folder), S.ball_spans(2))


@query(
    "voi_wide",
    f"""{MASKS.split(',' + chr(10) + 'truth AS')[0]}, {X.wide_sql('truth', '(FROM vox WHERE label = 1)')}, {X.wide_sql('pred', '(FROM vox WHERE prob >= 0.5 AND label <> 2)')}, {X.WIDE_SQL},
{voi_sql(X.WIDTH)} SELECT volume_id, n_foreground, round(voi_split, 6) AS voi_split, round(voi_merge, 6) AS voi_merge, round(voi_score, 6) AS voi_score FROM voi""",
    derive_once=True,
)
def voi_wide(spark, folder):
    runs = [C.label_runs(C.to_runs(X.wide(m), tile=TILE), tile=TILE) for m in scored_masks(spark, folder)]
    out = score.voi(*runs, X.wide_volumes(spark, folder))
    return out.select("volume_id", "n_foreground", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("voi")])


@query(
    "distance_transform_wide",
    f"{_TRUTH}, {dilate_sql('grown', 'wide', 1, width=X.WIDTH)}, {nearest_gap_sql('grown', X.WIDTH)} SELECT volume_id, z, y, x, CAST(d2 AS BIGINT) AS d2 FROM gaps",
    derive_once=True,
)
def distance_transform_wide(spark, folder):
    mask, volumes = _truth(spark, folder)
    return distance_transform(P.dilate(mask, volumes, S.cross_spans()), volumes)
