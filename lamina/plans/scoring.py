"""Component, morphology and scoring queries."""

from __future__ import annotations

from lamina.functions import stencils as S
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators import score
from lamina.plans import fixtures as X
from lamina.plans.registry import query

BASE = f"WITH RECURSIVE {X.VOX_SQL}, {X.VOLUMES_SQL}"
MASKS = f"""{BASE},
truth AS MATERIALIZED (SELECT volume_id, z, y, x FROM vox WHERE label = 1),
guess AS MATERIALIZED (SELECT volume_id, z, y, x FROM vox WHERE prob >= 0.5),
pred AS MATERIALIZED (SELECT volume_id, z, y, x FROM vox WHERE prob >= 0.5 AND label <> 2)"""


def _ball(r: int) -> str:
    axis = f"(SELECT UNNEST(range(-{r}, {r + 1})) AS d)"
    return (
        f"(SELECT CAST(a.d AS INT) AS dz, CAST(b.d AS INT) AS dy, CAST(c.d AS INT) AS dx"
        f" FROM {axis} a, {axis} b, {axis} c WHERE a.d*a.d + b.d*b.d + c.d*c.d <= {r * r})"
    )


def dilate_sql(name: str, source: str, r: int, keys: str = "volume_id", width: int = X.SIDE) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT DISTINCT {keys}, z + dz AS z, y + dy AS y, x + dx AS x FROM {source}, {_ball(r)} o
  WHERE z + dz BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 AND x + dx BETWEEN 0 AND {width - 1})"""


def erode_sql(name: str, source: str, r: int, keys: str = "volume_id") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, z - dz AS z, y - dy AS y, x - dx AS x FROM {source}, {_ball(r)} o
  GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {_ball(r)}))"""


def surface_sql(name: str, source: str) -> str:
    return f"""{erode_sql(name + '_core', source, 1)},
{name} AS MATERIALIZED (SELECT * FROM {source} ANTI JOIN {name}_core USING (volume_id, z, y, x))"""


DICE_SQL = f"""{surface_sql('sp', 'pred')}, {surface_sql('st', 'truth')},
{dilate_sql('np', 'sp', 2)}, {dilate_sql('nt', 'st', 2)},
dice_counts AS (SELECT volume_id,
  (SELECT count(*) FROM sp WHERE sp.volume_id = v.volume_id) AS n_pred,
  (SELECT count(*) FROM st WHERE st.volume_id = v.volume_id) AS n_truth,
  (SELECT count(*) FROM sp SEMI JOIN nt USING (volume_id, z, y, x) WHERE sp.volume_id = v.volume_id) AS pred_matched,
  (SELECT count(*) FROM st SEMI JOIN np USING (volume_id, z, y, x) WHERE st.volume_id = v.volume_id) AS truth_matched
  FROM volumes v),
dice AS MATERIALIZED (SELECT *, CAST(CASE WHEN n_pred + n_truth = 0 THEN 1 WHEN n_pred = 0 OR n_truth = 0 THEN 0
  ELSE CAST(pred_matched + truth_matched AS DOUBLE) / (n_pred + n_truth) END AS DOUBLE) AS surface_dice FROM dice_counts)"""


def scored_masks(spark, folder):
    """Predicted and true surface with the ignored region taken out."""
    v = X.voxels(spark, folder)
    ignore = v.filter("label = 2")
    return score.apply_ignore(X.predicted(spark, folder), ignore), X.truth(spark, folder)


@query("apply_ignore", f"{MASKS} SELECT * FROM pred")
def apply_ignore(spark, folder):
    return scored_masks(spark, folder)[0]


@query("surface_dice", f"{MASKS}, {DICE_SQL} SELECT * FROM dice", derive_once=True)
def surface_dice(spark, folder):
    pred, truth = scored_masks(spark, folder)
    return score.surface_dice(pred, truth, X.volumes(spark, folder))


for _n in (6, 18, 26):

    @query(
        f"connected_components_{_n}",
        f"""{MASKS}, {X.component_sql('cc', 'truth', _n)}
SELECT f.volume_id, f.z, f.y, f.x, CAST(lab AS BIGINT) AS component,
       CAST(dense_rank() OVER (PARTITION BY f.volume_id ORDER BY lab) AS INT) AS component_no
FROM cc JOIN cc_f f USING (volume_id, id)""",
    )
    def connected(spark, folder, _n=_n):
        # A small tile makes the volumes of the test data span several of them.
        found = C.connected_components(X.truth(spark, folder), X.volumes(spark, folder), _n, tile=8)
        return found.join(C.rank_components(found), ["volume_id", "component"])


@query("dilate", f"{MASKS}, {dilate_sql('d', 'truth', 2)} SELECT * FROM d")
def dilate(spark, folder):
    return P.dilate(X.truth(spark, folder), X.volumes(spark, folder), S.ball_spans(2))


@query("erode", f"{MASKS}, {dilate_sql('d', 'truth', 2)}, {erode_sql('e', 'd', 1)} SELECT * FROM e")
def erode(spark, folder):
    grown = P.dilate(X.truth(spark, folder), X.volumes(spark, folder), S.ball_spans(2))
    return P.erode(grown, S.ball_spans(1))


@query("surface_voxels", f"{MASKS}, {dilate_sql('d', 'truth', 2)}, {surface_sql('s', 'd')} SELECT * FROM s")
def surface_voxels(spark, folder):
    grown = P.dilate(X.truth(spark, folder), X.volumes(spark, folder), S.ball_spans(2))
    return P.surface_voxels(grown)


# Corners (V), edges (E), faces (F) and cubes (C) in doubled coordinates: a cell is a cube iff all
# three coordinates are odd, and every even coordinate flips the sign.
def euler_sql(name: str, source: str) -> str:
    return f"""{name}_cells AS MATERIALIZED (SELECT DISTINCT volume_id, 2*z+1+dz AS z, 2*y+1+dy AS y, 2*x+1+dx AS x
  FROM {source}, (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM (SELECT UNNEST([-1,0,1]) AS d) a,
  (SELECT UNNEST([-1,0,1]) AS d) b, (SELECT UNNEST([-1,0,1]) AS d) c) o),
{name} AS MATERIALIZED (SELECT v.volume_id, CAST(coalesce(sum(CASE WHEN (z%2 + y%2 + x%2) % 2 = 1 THEN -1 ELSE 1 END), 0) AS BIGINT) AS euler
  FROM volumes v LEFT JOIN {name}_cells c ON c.volume_id = v.volume_id GROUP BY 1)"""


def holes_sql(name: str, source: str, volumes: str = "volumes", width: int = X.SIDE) -> str:
    """Enclosed 6-connected background voxels of ``source`` as ``name(volume_id, z, y, x, lab)``.

    Floods the background from the faces; only what the flood misses is labelled.
    """
    return f"""{name}_grid AS (SELECT volume_id, CAST(a.z AS INT) AS z, CAST(b.y AS INT) AS y, CAST(c.x AS INT) AS x
  FROM {volumes} CROSS JOIN (SELECT UNNEST(range(24)) AS z) a CROSS JOIN (SELECT UNNEST(range(24)) AS y) b
  CROSS JOIN (SELECT UNNEST(range({width})) AS x) c),
{name}_bg AS MATERIALIZED (SELECT *, (z*24+y)*{width}+x AS id FROM {name}_grid ANTI JOIN {source} USING (volume_id, z, y, x)),
{name}_e AS MATERIALIZED (SELECT a.volume_id, a.id AS s, b.id AS t FROM {name}_bg a,
  (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx), {name}_bg b
  WHERE b.volume_id = a.volume_id AND b.z = a.z+dz AND b.y = a.y+dy AND b.x = a.x+dx),
{name}_flood(volume_id, id) AS (
  SELECT volume_id, id FROM {name}_bg WHERE z IN (0, 23) OR y IN (0, 23) OR x IN (0, {width - 1})
  UNION SELECT e.volume_id, e.t FROM {name}_flood f JOIN {name}_e e ON e.volume_id = f.volume_id AND e.s = f.id),
{name}_shut AS MATERIALIZED (SELECT volume_id, z, y, x FROM {name}_bg ANTI JOIN {name}_flood USING (volume_id, id)),
{X.component_sql(name + '_cc', name + '_shut', 6, width)},
{name} AS MATERIALIZED (SELECT volume_id, z, y, x, lab FROM {name}_cc JOIN {name}_cc_f f USING (volume_id, id))"""


def betti_sql(name: str, source: str) -> str:
    return f"""{X.component_sql(name + '_fg', source, 26)},
{holes_sql(name + '_h', source)},
{euler_sql(name + '_x', source)},
{name} AS MATERIALIZED (SELECT v.volume_id, b0, CAST(greatest(0, b0 - euler + b2) AS BIGINT) AS b1, b2 FROM (
  SELECT volume_id, (SELECT count(DISTINCT lab) FROM {name}_fg c WHERE c.volume_id = v.volume_id) AS b0,
    (SELECT count(DISTINCT lab) FROM {name}_h c WHERE c.volume_id = v.volume_id) AS b2 FROM volumes v) v
  JOIN {name}_x USING (volume_id))"""


@query("euler_characteristic", f"{MASKS}, {euler_sql('e', 'truth')} SELECT * FROM e")
def euler(spark, folder):
    return score.euler_characteristic(X.truth(spark, folder), X.volumes(spark, folder))


@query("betti_numbers", f"{MASKS}, {betti_sql('b', 'guess')} SELECT * FROM b", derive_once=True)
def betti(spark, folder):
    return score.betti_numbers(X.predicted(spark, folder), X.volumes(spark, folder))


def voi_sql(width: int = X.SIDE) -> str:
    return f"""{X.component_sql('pc', 'pred', 26, width)}, {X.component_sql('tc', 'truth', 26, width)},
cont AS MATERIALIZED (SELECT volume_id, coalesce(p.lab, -1) AS p, coalesce(t.lab, -1) AS t, count(*) AS n
  FROM pc p FULL JOIN tc t USING (volume_id, id) GROUP BY ALL),
frac AS (SELECT volume_id, p, t, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY volume_id) AS pij,
  CAST(sum(n) OVER (PARTITION BY volume_id, p) AS DOUBLE) / sum(n) OVER (PARTITION BY volume_id) AS pi,
  CAST(sum(n) OVER (PARTITION BY volume_id, t) AS DOUBLE) / sum(n) OVER (PARTITION BY volume_id) AS pj, n FROM cont),
voi AS MATERIALIZED (SELECT volume_id, CAST(sum(n) AS BIGINT) AS n_foreground, -sum(pij * log2(pij / pi)) AS voi_split,
  -sum(pij * log2(pij / pj)) AS voi_merge, CASE WHEN max(p) < 0 OR max(t) < 0 THEN 0.0::DOUBLE
  ELSE 1 / (1 + 0.3::DOUBLE * -sum(pij * log2(pij / pi) + pij * log2(pij / pj))) END AS voi_score
  FROM frac GROUP BY 1)"""


VOI_SQL = voi_sql()


@query(
    "voi",
    f"""{MASKS}, {VOI_SQL} SELECT volume_id, n_foreground, round(voi_split, 6) AS voi_split,
round(voi_merge, 6) AS voi_merge, round(voi_score, 6) AS voi_score FROM voi""",
    derive_once=True,
)
def voi(spark, folder):
    from pyspark.sql import functions as F

    pred, truth = scored_masks(spark, folder)
    runs = [C.label_runs(C.to_runs(m)) for m in (pred, truth)]
    out = score.voi(*runs, X.volumes(spark, folder))
    return out.select("volume_id", "n_foreground", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("voi")])
