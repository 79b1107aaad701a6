"""Closing of gaps in the projected height map of each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.session import settle

PART = ["volume_id", "component"]
# Per projection axis, the depth, row and column coordinates.
VIEWS = (("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y"))


def project(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """Column statistics along the axis with the largest footprint; the first axis wins ties.

    Returns ``axis, r, c`` with the mean depth inside the frame and the voxel count.
    """
    placed = parts.join(frames, PART)
    views = F.array(
        *[
            F.struct(
                F.lit(i).alias("axis"),
                (F.col(depth) - F.col(f"f{depth}0")).alias("depth"),
                F.col(row).alias("r"),
                F.col(column).alias("c"),
            )
            for i, (depth, row, column) in enumerate(VIEWS)
        ]
    )
    columns = (
        placed.select(*PART, F.inline(views))
        .groupBy(*PART, "axis", "r", "c")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("total"))
    )
    best = (
        columns.groupBy(*PART, "axis").agg(F.count(F.lit(1)).alias("area"))
        .groupBy(*PART)
        .agg(F.max_by("axis", F.struct(F.col("area"), -F.col("axis"))).alias("axis"))
    )
    return columns.join(best, [*PART, "axis"]).select(
        *PART,
        "axis",
        "r",
        "c",
        # Heights are single precision, as stored height maps are.
        (F.col("total") / F.col("n")).cast("float").cast("double").alias("height"),
        F.col("n").cast("double").alias("thick"),
    )


def _pick(axis: str, role: int, prefix: str, suffix: str) -> Column:
    out = F.lit(None).cast("int")
    for i, view in enumerate(VIEWS):
        out = F.when(F.col(axis) == i, F.col(f"{prefix}{view[role]}{suffix}")).otherwise(out)
    return out


def gap_cells(columns: DataFrame, frames: DataFrame) -> DataFrame:
    """Projected cells without voxels that the footprint encloses."""
    flat = columns.select(*PART, F.lit(0).alias("z"), F.col("r").alias("y"), F.col("c").alias("x"))
    planes = (
        columns.select(*PART, "axis").distinct().join(frames, PART).select(
            *PART,
            F.lit(0).alias("fz0"),
            F.lit(0).alias("fz1"),
            _pick("axis", 1, "f", "0").alias("fy0"),
            _pick("axis", 1, "f", "1").alias("fy1"),
            _pick("axis", 2, "f", "0").alias("fx0"),
            _pick("axis", 2, "f", "1").alias("fx1"),
        )
    )
    holes = C.from_runs(C.enclosed_runs(flat, planes, PART, connectivity=4), keys=PART)
    return holes.select(*PART, F.col("y").alias("r"), F.col("x").alias("c"))


def _between(cells: DataFrame, along: str, line: str, name: str) -> DataFrame:
    """Linear interpolation of height and thickness along one direction.

    An enclosed cell always has a filled cell on either side of it in its row and in
    its column. Lines are at most one frame side long.
    """
    order = W.partitionBy(*PART, line).orderBy(along)
    filled = F.when(F.col("height").isNotNull(), F.struct(F.col(along).alias("at"), "height", "thick"))
    left = F.last(filled, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(filled, True).over(order.rowsBetween(0, W.unboundedFollowing))
    out = cells.withColumn("__a", left).withColumn("__b", right)
    step = F.col("__b.at") - F.col("__a.at")
    # A filled cell is its own neighbour on both sides.
    value = lambda v: (
        (F.col(f"__b.{v}") - F.col(f"__a.{v}")) / F.nullif(step, F.lit(0)) * (F.col(along) - F.col("__a.at"))
        + F.col(f"__a.{v}")
    ).cast("float").cast("double")
    near = F.least(F.col(along) - F.col("__a.at"), F.col("__b.at") - F.col(along))
    return (
        out.withColumn(f"h_{name}", value("height"))
        .withColumn(f"t_{name}", value("thick"))
        .withColumn(f"w_{name}", 1.0 / F.nullif(near.cast("double"), F.lit(0.0)))
        .drop("__a", "__b")
    )


def painted_gaps(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """Voxels that fill the projected gaps at the interpolated depth and thickness."""
    columns = settle(project(parts, frames))
    gaps = gap_cells(columns, frames)
    axes = columns.select(*PART, "axis").distinct()
    none = F.lit(None).cast("double")
    cells = columns.select(*PART, "r", "c", "height", "thick").unionByName(
        gaps.select(*PART, "r", "c", none.alias("height"), none.alias("thick"))
    )
    cells = _between(_between(cells, "c", "r", "row"), "r", "c", "col").filter("height IS NULL")
    mean = lambda v: (
        (F.col(f"{v}_row") * F.col("w_row") + F.col(f"{v}_col") * F.col("w_col")) / (F.col("w_row") + F.col("w_col"))
    )
    depth = lambda suffix: _pick("axis", 0, "f", suffix)
    placed = cells.join(axes, PART).join(frames, PART).select(
        *PART,
        "axis",
        "r",
        "c",
        depth("0").alias("base"),
        (depth("1") - depth("0")).alias("last"),
        F.rint(mean("h")).cast("int").alias("center"),
        F.greatest(F.lit(0), F.rint(mean("t") / 2).cast("int")).alias("half"),
    )
    lo = F.greatest(F.lit(0), F.col("center") - F.col("half"))
    hi = F.least(F.col("last"), F.col("center") + F.col("half"))
    painted = placed.withColumn("at", F.explode(F.sequence(lo, hi))).withColumn("at", F.col("at") + F.col("base"))
    place = {role: name for role, name in enumerate(("at", "r", "c"))}
    coordinate = lambda axis: F.coalesce(
        *[F.when(F.col("axis") == i, F.col(place[view.index(axis)])) for i, view in enumerate(VIEWS)]
    )
    return painted.select(*PART, *[coordinate(c).alias(c) for c in ("z", "y", "x")])


def patch_gaps(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """Component voxels plus painted gaps, unless painting adds closed-off holes.

    ``parts`` holds ``(volume_id, component, z, y, x)``, ``frames`` the component crops.
    """
    return P.unpack(patch_words(P.pack(parts, PART), frames), PART)


def patch_words(words: DataFrame, frames: DataFrame) -> DataFrame:
    """:func:`patch_gaps` of packed words. Voxels become rows only to be projected."""
    painted = settle(P.pack(painted_gaps(P.unpack(words, PART), frames), PART))
    touched = painted.select(*PART).distinct()
    old = words.join(touched, PART, "left_semi")
    version = lambda df, v: df.withColumn("version", F.lit(v))
    tagged = version(old, 0).unionByName(version(P.merge(old, painted, keys=PART), 1))
    versions = frames.join(touched, PART, "left_semi").withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
    holes = C.count_holes_of(tagged, versions, [*PART, "version"])
    worse = (
        holes.groupBy(*PART)
        .agg(
            F.max(F.when(F.col("version") == 0, F.col("n_holes"))).alias("before"),
            F.max(F.when(F.col("version") == 1, F.col("n_holes"))).alias("after"),
        )
        .filter("after > before")
        .select(*PART)
    )
    return P.merge(words, painted.join(worse, PART, "left_anti"), keys=PART)
