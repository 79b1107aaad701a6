"""Patch, channel, probability and target queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import columns as K
from lamina.operators import channels as H
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators import patches as T
from lamina.operators import score
from lamina.functions.stencils import cross_spans
from lamina.model import PatchSettings
from lamina.plans import fixtures as X
from lamina.plans.catalog import DENSE, PATCH, PATCHES, VOX
from lamina.plans.registry import query
from lamina.sources.catalog import densify


def _rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query(
    "patch_origins",
    f"""{VOX}, o AS (SELECT CAST(UNNEST([0, 7, 14]) AS INT) AS o)
SELECT volume_id, 24 AS d, 24 AS h, 24 AS w, a.o AS pz, b.o AS py, 0 AS px FROM volumes CROSS JOIN o a CROSS JOIN (SELECT CAST(UNNEST([0, 10, 14]) AS INT) AS o) b""",
)
def patch_origins(spark, folder):
    return T.patch_origins(X.volumes(spark, folder), PatchSettings(size=(10, 10, 32), stride=(7, 10, 5)))


@query("patch_index", f"{DENSE}, {PATCHES} SELECT * FROM patches WHERE labeled_ratio >= 0.88 AND foreground_ratio >= 0.1")
def patch_index(spark, folder):
    return T.patch_index(X.voxels(spark, folder), X.volumes(spark, folder), PATCH)


_WIDE = PatchSettings(size=(8, 12, 26), stride=(8, 12, 26))


@query(
    "extract_patches",
    f"""{DENSE}, o AS (SELECT CAST(UNNEST([0, 8, 16]) AS INT) AS pz), q AS (SELECT CAST(UNNEST([0, 12]) AS INT) AS py)
SELECT volume_id, pz, py, 0 AS px, z - pz AS lz, y - py AS ly, x AS lx, value AS intensity, label FROM dense JOIN o ON z - pz BETWEEN 0 AND 7 JOIN q ON y - py BETWEEN 0 AND 11
UNION ALL SELECT volume_id, pz, py, 0, CAST(a.i AS INT), CAST(b.i AS INT), CAST(c.i AS INT), 0, 2 FROM volumes CROSS JOIN o CROSS JOIN q
CROSS JOIN (SELECT UNNEST(range(8)) AS i) a CROSS JOIN (SELECT UNNEST(range(12)) AS i) b CROSS JOIN (SELECT UNNEST([24, 25]) AS i) c""",
)
def extract_patches(spark, folder):
    volumes = X.volumes(spark, folder)
    return T.extract_patches(T.patch_origins(volumes, _WIDE), X.voxels(spark, folder), volumes, _WIDE)


_BOXES = """boxes AS (SELECT volume_id, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1
FROM vox WHERE label = 1 AND prob > 0.9 AND intensity > 60000 AND (z*7 + y*3 + x) % 5 > 0 AND z > 2 AND y > 3 AND x BETWEEN 4 AND 20 GROUP BY 1)"""


@query(
    "bbox_crop",
    f"""{VOX}, {_BOXES} SELECT volume_id, CAST(z - z0 AS INT) AS z, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, label
FROM vox JOIN boxes USING (volume_id) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1""",
)
def bbox_crop(spark, folder):
    v = X.voxels(spark, folder)
    inner = v.filter("label = 1 AND prob > 0.9 AND intensity > 60000 AND (z*7 + y*3 + x) % 5 > 0 AND z > 2 AND y > 3 AND x BETWEEN 4 AND 20")
    ends = [e for c in "zyx" for e in (F.min(c).alias(f"{c}0"), (F.max(c) + 1).alias(f"{c}1"))]
    return T.bbox_crop(v.select("volume_id", "z", "y", "x", "label"), inner.groupBy("volume_id").agg(*ends))


_NORM = {
    "minmax": "(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-6::DOUBLE)",
    "zscore": "(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6::DOUBLE)",
    "percentile": "(least(greatest(value, lo), hi) - lo) / (hi - lo + 1e-6::DOUBLE)",
}
for _m, _e in _NORM.items():

    @query(
        f"normalize_{_m}",
        f"""{DENSE}, q AS (SELECT volume_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM dense GROUP BY 1)
SELECT volume_id, z, y, x, round({_e}, 5) AS intensity FROM dense JOIN q USING (volume_id) WINDOW w AS (PARTITION BY volume_id)""",
    )
    def normalize(spark, folder, _m=_m):
        dense = densify(X.voxels(spark, folder), X.volumes(spark, folder), {"intensity": 0.0})
        return _rounded(T.normalize(dense, _m), 5, "intensity")


@query(
    "normalize_patches",
    f"""{DENSE}, o AS (SELECT CAST(UNNEST([0, 12]) AS INT) AS o), p AS (SELECT volume_id, a.o AS pz, b.o AS py, c.o AS px, z - a.o AS lz, y - b.o AS ly, x - c.o AS lx, value, label
FROM o a CROSS JOIN o b CROSS JOIN o c JOIN dense ON z - a.o BETWEEN 0 AND 11 AND y - b.o BETWEEN 0 AND 11 AND x - c.o BETWEEN 0 AND 11)
SELECT volume_id, pz, py, px, lz, ly, lx, label, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6::DOUBLE), 5) AS intensity
FROM p WINDOW w AS (PARTITION BY volume_id, pz, py, px)""",
)
def normalize_patches(spark, folder):
    settings = PatchSettings(size=(12, 12, 12), stride=(12, 12, 12))
    volumes = X.volumes(spark, folder)
    rows = T.extract_patches(T.patch_origins(volumes, settings), X.voxels(spark, folder), volumes, settings)
    return _rounded(T.normalize(rows, "zscore", T.PATCH), 5, "intensity")


def _draw(name: str, seed: int) -> str:
    key = "concat_ws('|', volume_id, pz, py, px, '" + name + f"', '{seed}')"
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296)"


# Stored voxels in local coordinates of 12-voxel patches that do not overlap.
_LOCAL = "loc AS MATERIALIZED (SELECT volume_id, z - z%12 AS pz, y - y%12 AS py, x - x%12 AS px, z%12 AS lz, y%12 AS ly, x%12 AS lx, label FROM vox)"


def _local(spark, folder):
    v = X.voxels(spark, folder)
    corner = [(F.col(c) - F.col(c) % 12).alias(f"p{c}") for c in "zyx"]
    inner = [(F.col(c) % 12).alias(f"l{c}") for c in "zyx"]
    return v.select("volume_id", *corner, *inner, "label")


@query(
    "augment_flip",
    f"{VOX}, {_LOCAL} SELECT volume_id, pz, py, px, "
    + ", ".join(f"CAST(CASE WHEN {_draw(a, 3)} < 0.5 THEN 11 - {a} ELSE {a} END AS INT) AS {a}" for a in ("lz", "ly", "lx"))
    + ", label FROM loc",
)
def augment_flip(spark, folder):
    return T.augment_flip(_local(spark, folder), (12, 12, 12), seed=3)


def _turned(axis: str) -> str:
    pairs = {"lz": [(1, "lx", "a"), (2, "ly", "a")], "ly": [(0, "lx", "a"), (2, "lz", "b")], "lx": [(0, "ly", "b"), (1, "lz", "b")]}
    out = []
    for plane, other, role in pairs[axis]:
        k1, k3 = (f"11 - {other}", other) if role == "a" else (other, f"11 - {other}")
        out += [f"WHEN p = {plane} AND k = 1 THEN {k1}", f"WHEN p = {plane} AND k = 2 THEN 11 - {axis}", f"WHEN p = {plane} AND k = 3 THEN {k3}"]
    return f"CAST(CASE {' '.join(out)} ELSE {axis} END AS INT) AS {axis}"


@query(
    "augment_rot90",
    f"""{VOX}, {_LOCAL}, t AS (SELECT *, CASE WHEN {_draw('rot', 5)} < 0.5 THEN floor({_draw('turns', 5)} * 4) ELSE 0 END AS k,
floor({_draw('plane', 5)} * 3) AS p FROM loc) SELECT volume_id, pz, py, px, {_turned('lz')}, {_turned('ly')}, {_turned('lx')}, label FROM t""",
)
def augment_rot90(spark, folder):
    return T.augment_rot90(_local(spark, folder), (12, 12, 12), seed=5)


_KERNEL = ", ".join(
    f"({k}, {w!r}::DOUBLE)" for k in range(-4, 5) for w in [H.gaussian_kernel(1.0)[abs(k)]]
)


def _blur_pass(name: str, source: str, axis: str) -> str:
    """Gather form: every cell reads its reflected neighbours."""
    rest = [c for c in "zyx" if c != axis]
    at = f"(g.i + k)"
    mirrored = f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} > 23 THEN 47 - {at} ELSE {at} END"
    return f"""{name} AS MATERIALIZED (SELECT s.volume_id, s.{rest[0]}, s.{rest[1]}, CAST(g.i AS INT) AS {axis}, sum(s.v * wt) AS v
  FROM (SELECT UNNEST(range(24)) AS i) g CROSS JOIN (VALUES {_KERNEL}) kk(k, wt) JOIN {source} s ON s.{axis} = {mirrored} GROUP BY ALL)"""


_BLUR = f"""{VOX}, raw AS (SELECT volume_id, z, y, x, intensity AS v FROM vox), {_blur_pass('b1', 'raw', 'z')}, {_blur_pass('b2', 'b1', 'y')}, {_blur_pass('b3', 'b2', 'x')}"""


@query("gaussian_blur", f"{_BLUR} SELECT volume_id, z, y, x, round(v, 4) AS blurred FROM b3")
def gaussian_blur(spark, folder):
    return _rounded(H.gaussian_blur(X.voxels(spark, folder), X.volumes(spark, folder), tile=16), 4, "blurred")


@query(
    "highpass_channel",
    f"{_BLUR} SELECT volume_id, z, y, x, round(coalesce(r.v, 0) - coalesce(b.v, 0), 4) AS highpass FROM raw r FULL JOIN b3 b USING (volume_id, z, y, x)",
)
def highpass_channel(spark, folder):
    return _rounded(H.highpass_channel(X.voxels(spark, folder), X.volumes(spark, folder), tile=16), 4, "highpass")


# --- probabilities ----------------------------------------------------------------------------------
@query(
    "argmax_label",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS label FROM embeddings",
)
def argmax_label(spark, folder):
    return X.table(spark, folder, "embeddings").select("vec_id", K.argmax_label("embedding").alias("label"))


@query(
    "ensemble",
    f"""{VOX}, e AS (SELECT volume_id, z, y, x, CAST(0.65 AS DOUBLE) * (1 - prob) + CAST(0.35 AS DOUBLE) * (1 - tax) AS a, CAST(0.65 AS DOUBLE) * prob + CAST(0.35 AS DOUBLE) * tax AS b FROM vox WHERE volume_id <> 'v0')
SELECT volume_id, z, y, x, round(a, 6) AS p0, round(b, 6) AS p1, CASE WHEN b > a THEN 1 ELSE 0 END AS label FROM e""",
    derive_once=True,
)
def ensemble(spark, folder):
    out = H.ensemble(X.model_probs(spark, folder), {"a": 0.65, "b": 0.35})
    return out.select("volume_id", "z", "y", "x", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"), "label")


@query(
    "binarize",
    f"""{VOX}, l AS (SELECT volume_id, z, y, x, CASE WHEN scroll_id = 's0' THEN label % 2 ELSE label END AS label FROM vox JOIN volumes USING (volume_id))
SELECT volume_id, z, y, x, 'labels' AS kind FROM l WHERE label = 1
UNION ALL SELECT volume_id, z, y, x, 'values' FROM vox WHERE tax >= 0.5
UNION ALL SELECT volume_id, z, y, x, 'probs' FROM vox WHERE prob >= 0.7
UNION ALL SELECT volume_id, z, y, x, 'winners' FROM vox WHERE prob > 1 - prob""",
)
def binarize(spark, folder):
    v = X.voxels(spark, folder)
    scroll = v.join(X.volumes(spark, folder).select("volume_id", "scroll_id"), "volume_id")
    mixed = scroll.withColumn("label", F.when(F.col("scroll_id") == "s0", F.col("label") % 2).otherwise(F.col("label")))
    probs = X.model_probs(spark, folder).filter("model = 'a'").drop("model")
    parts = {
        "labels": H.binarize(mixed.select("volume_id", "z", "y", "x", "label")),
        "values": H.binarize(v.select("volume_id", "z", "y", "x", F.col("tax").alias("value"))),
        "probs": H.binarize(probs, 0.7),
        # Two classes, so there is no channel 2: the winners are a map of 0 and 1.
        "winners": H.binarize(probs, surface=2),
    }
    return reduce(DataFrame.unionByName, [m.withColumn("kind", F.lit(k)) for k, m in parts.items()])


# --- targets ------------------------------------------------------------------------------------------
_OFFSETS = ((1, 0, 0), (0, 2, 0), (0, -1, 4))


def affinity_sql(background: bool, dense: bool = True) -> str:
    any_surface = "TRUE" if background else "(a.label = 1 OR b.label = 1)"
    valid = f"b.label IS NOT NULL AND a.label <> 2 AND b.label <> 2 AND {any_surface}"
    return f"""{DENSE}, truth AS MATERIALIZED (SELECT volume_id, z, y, x FROM vox WHERE label = 1), {X.component_sql('cc', 'truth', 26)},
comp AS MATERIALIZED (SELECT volume_id, z, y, x, lab FROM cc JOIN cc_f USING (volume_id, id)),
lab AS MATERIALIZED (SELECT * FROM dense LEFT JOIN comp USING (volume_id, z, y, x)),
aff AS MATERIALIZED (SELECT a.volume_id, a.z, a.y, a.x, oz, oy, ox, CASE WHEN NOT coalesce({valid}, FALSE) THEN -1 WHEN a.lab = b.lab THEN 1 ELSE 0 END AS affinity
FROM lab a CROSS JOIN (VALUES {', '.join(map(str, _OFFSETS))}) o(oz, oy, ox) LEFT JOIN lab b ON b.volume_id = a.volume_id AND b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox)"""


def _targets(spark, folder, background=False, targets=H.affinity_targets):
    volumes = X.volumes(spark, folder)
    parts = C.connected_components(X.truth(spark, folder), volumes)
    return targets(X.voxels(spark, folder), parts, volumes, _OFFSETS, background)


@query("affinity_targets", f"{affinity_sql(False)} SELECT * FROM aff", derive_once=True)
def affinity_targets(spark, folder):
    return _targets(spark, folder, targets=H.all_affinity)


@query("affinity_targets_unmasked", f"{affinity_sql(True)} SELECT * FROM aff WHERE affinity >= 0", derive_once=True)
def affinity_unmasked(spark, folder):
    return _targets(spark, folder, background=True)


_AGREEMENT = f"""{affinity_sql(False)}, j AS (SELECT oz, oy, ox, a.volume_id, affinity AS t, coalesce(prob * 4 - 2, 0) AS g FROM aff a LEFT JOIN vox USING (volume_id, z, y, x) WHERE affinity >= 0),
agree AS (SELECT volume_id, oz, oy, ox, count(*) AS n_valid, avg(greatest(g, 0) - g * t + ln(1 + exp(-abs(g)))) AS bce,
(2 * sum(t / (1 + exp(-g))) + 1e-5::DOUBLE) / (sum(1 / (1 + exp(-g))) + sum(t) + 1e-5::DOUBLE) AS soft_dice FROM j GROUP BY 1, 2, 3, 4)"""


def _agreement(spark, folder, offsets=None):
    v = X.voxels(spark, folder).select("volume_id", "z", "y", "x", (F.col("prob") * 4 - 2).alias("logit"))
    taps = F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(o, ("oz", "oy", "ox"))]) for o in _OFFSETS])
    logits = v.withColumn("tap", F.explode(taps)).select("volume_id", "z", "y", "x", "logit", "tap.*")
    return score.affinity_agreement(_targets(spark, folder), logits, offsets=offsets)


@query(
    "affinity_agreement",
    f"{_AGREEMENT} SELECT volume_id, oz, oy, ox, n_valid, round(bce, 6) AS bce, round(soft_dice, 6) AS soft_dice FROM agree",
    derive_once=True,
)
def affinity_agreement(spark, folder):
    return _rounded(_agreement(spark, folder), 6, "bce", "soft_dice")


# One more offset than was asked of any pair: it has no valid pairs.
_ASKED = (*_OFFSETS, (0, 0, 16))


@query(
    "affinity_summary",
    f"""{_AGREEMENT}, asked AS (SELECT volume_id, o.* FROM volumes CROSS JOIN (VALUES {', '.join(map(str, _ASKED))}) o(oz, oy, ox)),
every AS (SELECT volume_id, coalesce(n_valid, 0) AS n, coalesce(bce, 0) AS bce, coalesce(soft_dice, 1) AS dice FROM asked LEFT JOIN agree USING (volume_id, oz, oy, ox)),
s AS (SELECT volume_id, coalesce(sum(bce * n) / nullif(sum(n), 0), 0) AS bce, avg(dice) AS dice FROM every GROUP BY 1)
SELECT volume_id, round(bce, 6) AS bce, round(dice, 6) AS soft_dice, round(CAST(0.5 AS DOUBLE) * bce + CAST(0.5 AS DOUBLE) * (1 - dice), 6) AS combined FROM s""",
    derive_once=True,
)
def affinity_summary(spark, folder):
    taps = F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(o, ("oz", "oy", "ox"))]) for o in _ASKED])
    asked = X.volumes(spark, folder).select("volume_id", F.inline(taps))
    return _rounded(score.affinity_summary(_agreement(spark, folder, asked)), 6, "bce", "soft_dice", "combined")


# A sparse stand-in skeleton: surface voxels on every third diagonal plane.
_SKELETON = "label = 1 AND (z + y + x) % 3 = 0"


@query(
    "tube_mask",
    f"""{VOX}, {', '.join(f'''s{i + 1} AS (SELECT DISTINCT volume_id, z + a AS z, y + b AS y, x + c AS x FROM {f"s{i}" if i else f"(SELECT * FROM vox WHERE {_SKELETON})"},
(VALUES (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) o(a, b, c))''' for i in range(2))}
SELECT volume_id, z, y, x FROM vox SEMI JOIN s2 USING (volume_id, z, y, x) WHERE label = 1""",
)
def tube_mask(spark, folder):
    skeleton = X.voxels(spark, folder).filter(_SKELETON).select("volume_id", "z", "y", "x")
    return P.tube_mask(skeleton, X.truth(spark, folder), X.volumes(spark, folder))


# Some volumes have no skeleton at all.
_BONES = "(z + y + x) % 3 = 0 AND volume_id <> 'v0'"


@query(
    "skeleton_recall",
    f"""{VOX}, s AS (SELECT * FROM vox WHERE {_BONES} AND label <> 2)
SELECT volume_id, count(s.z) AS n_skeleton, (coalesce(sum(prob), 0) + 1) / (count(s.z) + 1) AS skeleton_recall FROM volumes LEFT JOIN s USING (volume_id) GROUP BY 1""",
)
def skeleton_recall(spark, folder):
    v = X.voxels(spark, folder)
    return score.skeleton_recall(v, v.filter(_BONES), v, X.volumes(spark, folder))


@query(
    "confusion_dice",
    f"""{VOX}, p AS (SELECT volume_id, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS p, label AS t FROM vox WHERE label <> 2),
c AS (SELECT volume_id, 1 AS class, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn FROM p GROUP BY 1)
SELECT *, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS dice FROM c""",
)
def confusion_dice(spark, folder):
    v = X.voxels(spark, folder)
    guess = v.filter("prob >= 0.5").withColumn("label", F.lit(1))
    return score.confusion_dice(guess, v)
