"""Patch grids, crops, normalisation and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.columns import axis_origins, unit_hash
from lamina.operators.quantiles import quantiles
from lamina.session import settle

PATCH = ["volume_id", "pz", "py", "px"]


def _axes(settings: M.PatchSettings):
    return zip(("pz", "py", "px"), ("z", "y", "x"), ("d", "h", "w"), settings.size, settings.stride)


def patch_origins(volumes: DataFrame, settings: M.PatchSettings) -> DataFrame:
    """Every window origin of every volume."""
    out = volumes.select("volume_id", "d", "h", "w")
    for p, _, n, size, stride in _axes(settings):
        out = out.withColumn(p, F.explode(axis_origins(F.col(n), size, stride)))
    return out


def patch_index(
    labels: DataFrame, volumes: DataFrame, settings: M.PatchSettings, unlabeled: DataFrame | None = None
) -> DataFrame:
    """Patches with enough labelled cells and enough surface among them.

    Only surface and ignore voxels are routed to the windows that cover them; the rest
    of a window is known from its geometry. Cells outside the volume count as ignored.
    Volumes named in ``unlabeled`` keep every window, with null ratios.
    """
    marked = labels.filter(F.col("label").isin(M.SURFACE, M.IGNORE)).join(
        volumes.select("volume_id", "d", "h", "w"), "volume_id"
    )
    for p, c, n, size, stride in _axes(settings):
        covering = F.filter(axis_origins(F.col(n), size, stride), lambda o: (o <= F.col(c)) & (F.col(c) < o + size))
        marked = marked.withColumn(p, F.explode(covering))
    counts = marked.groupBy(*PATCH).agg(
        F.count_if(F.col("label") == M.SURFACE).alias("n_surface"),
        F.count_if(F.col("label") == M.IGNORE).alias("n_ignore"),
    )
    inside, total = F.lit(1).cast("long"), 1
    for p, _, n, size, _ in _axes(settings):
        inside = inside * (F.least(F.col(n), F.col(p) + size) - F.col(p))
        total *= size
    labeled = inside - F.coalesce("n_ignore", F.lit(0))
    rated = patch_origins(volumes, settings).join(counts, PATCH, "left").select(
        *PATCH,
        (labeled / total).alias("labeled_ratio"),
        (F.coalesce("n_surface", F.lit(0)) / F.nullif(labeled, F.lit(0))).alias("foreground_ratio"),
    )
    kept = rated.filter(
        (F.col("labeled_ratio") >= settings.min_labeled) & (F.col("foreground_ratio") >= settings.min_foreground)
    )
    if unlabeled is None:
        return kept
    free = unlabeled.select("volume_id").distinct()
    whole = patch_origins(volumes.join(free, "volume_id", "left_semi"), settings).select(
        *PATCH, F.lit(None).cast("double").alias("labeled_ratio"), F.lit(None).cast("double").alias("foreground_ratio")
    )
    return kept.join(free, "volume_id", "left_anti").unionByName(whole)


def require_patches(index: DataFrame) -> DataFrame:
    """The index itself; an empty one is an error."""
    found = settle(index)
    if found.isEmpty():
        raise RuntimeError("no patch passes; lower min_labeled or min_foreground, or check the labels")
    return found


def extract_patches(patches: DataFrame, voxels: DataFrame, volumes: DataFrame, settings: M.PatchSettings) -> DataFrame:
    """Dense fixed-size crops in local coordinates.

    Absent cells inside the volume are background, cells outside it take the pads.
    """
    cells = patches.select(*PATCH).join(volumes.select("volume_id", "d", "h", "w"), "volume_id")
    inside = F.lit(True)
    for p, c, n, size, _ in _axes(settings):
        cells = cells.withColumn(f"l{c}", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        cells = cells.withColumn(c, F.col(p) + F.col(f"l{c}"))
        inside = inside & (F.col(c) < F.col(n))
    filled = cells.join(voxels.select(*M.VOXEL, "intensity", "label"), M.VOXEL, "left")
    return filled.select(
        *PATCH,
        "lz",
        "ly",
        "lx",
        F.when(inside, F.coalesce("intensity", F.lit(0.0))).otherwise(settings.image_pad).alias("intensity"),
        F.when(inside, F.coalesce("label", F.lit(M.BACKGROUND))).otherwise(settings.label_pad).alias("label"),
    )


def bbox_crop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels inside half-open boxes ``(volume_id, z0, z1, y0, y1, x0, x1)``, moved to the box origin."""
    inside = " AND ".join(f"{c} >= {c}0 AND {c} < {c}1" for c in M.COORDS)
    rest = [c for c in voxels.columns if c not in M.VOXEL]
    return voxels.join(boxes, "volume_id").filter(inside).select(
        "volume_id", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in M.COORDS], *rest
    )


def normalize(
    rows: DataFrame,
    method: str = "zscore",
    keys: Sequence[str] = ("volume_id",),
    value: str = "intensity",
    percentiles: tuple[float, float] = (0.01, 0.99),
    mean: float | None = None,
    std: float | None = None,
    eps: float = 1e-6,
) -> DataFrame:
    """Rescale dense rows per volume or patch into ``value``.

    The statistics come from a combined aggregate joined back, so a large volume is
    never pulled into one window.
    """
    v = F.col(value)
    keys = list(keys)
    if method in ("none", "identity"):
        return rows
    if method == "zscore" and mean is not None and std is not None:
        return rows.withColumn(value, (v - mean) / (std + eps))
    if method == "minmax":
        found = rows.groupBy(*keys).agg(F.min(v).alias("__a"), F.max(v).alias("__b"))
        scaled = (v - F.col("__a")) / (F.col("__b") - F.col("__a") + eps)
    elif method == "zscore":
        found = rows.groupBy(*keys).agg(F.avg(v).alias("__a"), F.stddev_pop(v).alias("__b"))
        scaled = (v - F.col("__a")) / (F.col("__b") + eps)
    elif method == "percentile":
        lo, hi = percentiles
        counts = rows.groupBy(*keys, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        found = quantiles(counts, keys, (lo, hi), "__v", "__n").select(
            *keys, F.col("q")[0].alias("__a"), F.col("q")[1].alias("__b")
        )
        scaled = (F.least(F.greatest(v, F.col("__a")), F.col("__b")) - F.col("__a")) / (F.col("__b") - F.col("__a") + eps)
    else:
        raise ValueError(f"unknown normalisation {method}")
    return rows.join(found, keys).withColumn(value, scaled).drop("__a", "__b")


def augment_flip(
    patches: DataFrame, size: tuple[int, int, int], p: float = 0.5, seed: int = 0, keys: Sequence[str] = tuple(PATCH)
) -> DataFrame:
    """Mirror each axis of a patch with probability ``p``; every column moves along."""
    name = [F.col(k).cast("string") for k in keys]
    out = patches
    for axis, n in zip(("lz", "ly", "lx"), size):
        flipped = unit_hash(*name, F.lit(axis), seed=seed) < p
        out = out.withColumn(axis, F.when(flipped, n - 1 - F.col(axis)).otherwise(F.col(axis)))
    return out


def augment_rot90(
    patches: DataFrame, size: tuple[int, int, int], p: float = 0.5, seed: int = 0, keys: Sequence[str] = tuple(PATCH)
) -> DataFrame:
    """Rotate a patch by 0 to 3 quarter turns in one of its three planes with probability ``p``."""
    name = [F.col(k).cast("string") for k in keys]
    draw = lambda what: unit_hash(*name, F.lit(what), seed=seed)
    turns = F.when(draw("rot") < p, F.floor(draw("turns") * 4).cast("int")).otherwise(0)
    extent = dict(zip(("lz", "ly", "lx"), size))
    out = patches.withColumn("__k", turns).withColumn("__plane", F.floor(draw("plane") * 3).cast("int"))
    moved = {axis: F.col(axis) for axis in extent}
    for i, (a, b) in enumerate((("ly", "lx"), ("lz", "lx"), ("lz", "ly"))):
        u, v = F.col(a), F.col(b)
        na, nb = extent[a], extent[b]
        here = F.col("__plane") == i
        k = F.col("__k")
        moved[a] = F.when(here & (k == 1), nb - 1 - v).when(here & (k == 2), na - 1 - u).when(here & (k == 3), v).otherwise(moved[a])
        moved[b] = F.when(here & (k == 1), u).when(here & (k == 2), nb - 1 - v).when(here & (k == 3), na - 1 - u).otherwise(moved[b])
    return out.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in patches.columns])
