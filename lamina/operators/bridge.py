"""Bridging gaps between components that continue each other."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.stencils import ball_spans
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators.unmerge import near_cells
from lamina.session import settle

PART = ["volume_id", "component"]
PAIR = ["volume_id", "component_a", "component_b"]
ENDS = [f"{s}_{c}" for s in "ab" for c in M.COORDS]


def nearest_pairs_within(points: DataFrame, max_gap: float) -> DataFrame:
    """Closest pair of points for every two components nearer than ``max_gap``.

    ``points`` holds ``(volume_id, component, z, y, x)``. Boxes of points are compared
    first: a pair of boxes is dropped when even its closest corners are farther apart
    than the farthest corners of some other pair of boxes of the same components. Only
    points of the remaining boxes are paired, so the cost stays close to that of the
    contact area. Equal distances: first point of a, then of b, in raster order.
    """
    size = max(4, ceil(max_gap / 2))
    reach = ceil(max_gap / size)
    cell = [F.expr(f"CAST({c} div {size} AS INT)").alias(f"g{c}") for c in M.COORDS]
    gridded = points.select(*PART, *M.COORDS, *cell)
    corners = [e for c in M.COORDS for e in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))]
    boxes = gridded.groupBy(*PART, "gz", "gy", "gx").agg(*corners)
    names = ["component", "gz", "gy", "gx", *[f"{c}{i}" for c in M.COORDS for i in (0, 1)]]
    side = lambda s: boxes.select("volume_id", *[F.col(n).alias(f"{n}_{s}") for n in names])
    left = side("a")
    for c in M.COORDS:
        around = F.array(*[F.col(f"g{c}_a") + i for i in range(-reach, reach + 1)])
        left = left.withColumn(f"g{c}", F.explode(around))
    right = side("b").select("*", *[F.col(f"g{c}_b").alias(f"g{c}") for c in M.COORDS])
    near, far = [], []
    for c in M.COORDS:
        lo_a, hi_a, lo_b, hi_b = (F.col(f"{c}{i}_{s}") for s in "ab" for i in (0, 1))
        near.append(F.greatest(F.lit(0), lo_b - hi_a, lo_a - hi_b))
        far.append(F.greatest(hi_b - lo_a, hi_a - lo_b))
    square = lambda parts: sum((p * p for p in parts[1:]), parts[0] * parts[0])
    boxed = (
        left.join(right, ["volume_id", "gz", "gy", "gx"])
        .filter("component_a < component_b")
        .select(*PAIR, *[f"g{c}_{s}" for s in "ab" for c in M.COORDS], square(near).alias("low"), square(far).alias("high"))
        .filter(F.col("low") < max_gap * max_gap)
    )
    best = boxed.groupBy(*PAIR).agg(F.min("high").alias("bound"))
    open_ = boxed.join(best, PAIR).filter("low <= bound").drop("low", "high", "bound")
    for s in "ab":
        ends = gridded.select(
            "volume_id", F.col("component").alias(f"component_{s}"),
            *[F.col(f"g{c}").alias(f"g{c}_{s}") for c in M.COORDS], *[F.col(c).alias(f"{s}_{c}") for c in M.COORDS],
        )
        open_ = open_.join(ends, ["volume_id", f"component_{s}", *[f"g{c}_{s}" for c in M.COORDS]])
    d2 = square([F.col(f"a_{c}") - F.col(f"b_{c}") for c in M.COORDS])
    return (
        open_.withColumn("d2", d2)
        .filter((F.col("d2") < max_gap * max_gap) & (F.col("d2") > 0))
        .groupBy(*PAIR)
        .agg(F.min(F.struct("d2", *ENDS)).alias("p"))
        .select(*PAIR, F.sqrt("p.d2").alias("distance"), *[F.col(f"p.{e}").alias(e) for e in ENDS])
    )


def local_tangent(points: DataFrame, voxels: DataFrame, radius: float) -> DataFrame:
    """Unit vector from the centroid of the nearby voxels of the point's component to the point.

    ``points`` and ``voxels`` hold ``(volume_id, component, z, y, x)``. Null with fewer
    than four voxels within ``radius`` or no clear direction.
    """
    size = max(1, ceil(radius))
    at = [*PART, *M.COORDS]
    around = points.select(*at).distinct()
    for c, cell in zip(M.COORDS, near_cells(size)):
        around = around.withColumn(f"g{c}", F.explode(cell))
    cells = voxels.select(
        *PART, *[F.expr(f"CAST({c} div {size} AS INT)").alias(f"g{c}") for c in M.COORDS],
        *[F.col(c).alias(f"v{c}") for c in M.COORDS],
    )
    delta = [F.col(c) - F.col(f"v{c}") for c in M.COORDS]
    inside = sum((d * d for d in delta[1:]), delta[0] * delta[0]) <= radius * radius
    means = (
        around.join(cells, [*PART, "gz", "gy", "gx"]).filter(inside).groupBy(*at)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{c}").alias(f"m{c}") for c in M.COORDS])
    )
    step = [F.col(c) - F.col(f"m{c}") for c in M.COORDS]
    norm = F.sqrt(sum((s * s for s in step[1:]), step[0] * step[0]))
    clear = (F.col("n") >= 4) & (norm >= 1e-6)
    return means.select(*at, *[F.when(clear, s / F.nullif(norm, F.lit(0.0))).alias(f"t{c}") for c, s in zip(M.COORDS, step)])


def _angle(tangent: list[Column], ray: list[Column]) -> Column:
    dot = sum((t * r for t, r in zip(tangent[1:], ray[1:])), tangent[0] * ray[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def bridge_candidates(runs: DataFrame, settings: M.BridgeSettings = M.BridgeSettings()) -> DataFrame:
    """Pairs of large components whose nearest surface points face each other.

    ``runs`` are component runs; sort by ``distance`` for the order of drawing.
    """
    voxels = C.from_runs(runs, keys=PART)
    large = C.from_runs(C.large_runs(runs, settings.min_size), keys=PART)
    surface = P.surface_voxels(large, PART)
    pairs = settle(nearest_pairs_within(surface, settings.max_gap))
    out = pairs
    for s in "ab":
        ends = pairs.select("volume_id", F.col(f"component_{s}").alias("component"), *[F.col(f"{s}_{c}").alias(c) for c in M.COORDS])
        tangents = local_tangent(ends, voxels, settings.tangent_radius).select(
            "volume_id", F.col("component").alias(f"component_{s}"),
            *[F.col(c).alias(f"{s}_{c}") for c in M.COORDS], *[F.col(f"t{c}").alias(f"t{c}_{s}") for c in M.COORDS],
        )
        out = out.join(tangents, ["volume_id", f"component_{s}", *[f"{s}_{c}" for c in M.COORDS]])
    ray = [(F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col("distance") for c in M.COORDS]
    angle_a = _angle([F.col(f"t{c}_a") for c in M.COORDS], ray)
    angle_b = _angle([F.col(f"t{c}_b") for c in M.COORDS], [-r for r in ray])
    return out.select(*PAIR, "distance", *ENDS, angle_a.alias("angle_a"), angle_b.alias("angle_b")).filter(
        (F.col("angle_a") <= settings.angle_tolerance) & (F.col("angle_b") <= settings.angle_tolerance)
    )


def rasterize_segments(segments: DataFrame, volumes: DataFrame, tube_radius: int = 0) -> DataFrame:
    """Voxel lines between two end points, optionally as tubes, clipped to the volume."""
    delta = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in M.COORDS]
    steps = F.greatest(*[F.abs(d) for d in delta])
    points = segments.withColumn("__n", F.greatest(steps, F.lit(1))).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), steps))
    )
    at = [
        F.rint(F.col("__i") * (d.cast("double") / F.col("__n")) + F.col(f"a_{c}")).cast("int").alias(c)
        for c, d in zip(M.COORDS, delta)
    ]
    line = points.select("volume_id", *at).filter("z >= 0 AND y >= 0 AND x >= 0")
    words = P.clip(P.pack(line), volumes, ["volume_id"], ["volume_id"])
    if tube_radius > 0:
        words = P.dilate_words(words, ball_spans(tube_radius), volumes)
    return P.unpack(words)


def propose_bridges(
    mask: DataFrame, volumes: DataFrame, settings: M.BridgeSettings = M.BridgeSettings()
) -> tuple[DataFrame, DataFrame]:
    """``(mask with every accepted bridge drawn, counts per volume)``.

    Every pair occurs once, so the drawing order cannot matter.
    """
    runs = settle(C.component_runs(mask, volumes, settings.connectivity))
    candidates = settle(bridge_candidates(runs, settings))
    lines = rasterize_segments(candidates, volumes, settings.tube_radius)
    proposed = mask.select(*M.VOXEL).unionByName(lines).distinct()
    parts = runs.groupBy("volume_id").agg(F.count_distinct("component").alias("n_components"))
    drawn = candidates.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_edits"))
    counts = (
        volumes.select("volume_id").join(parts, "volume_id", "left").join(drawn, "volume_id", "left").na.fill(0)
        .select("volume_id", "n_components", F.col("n_edits").alias("n_candidates"), "n_edits")
    )
    return proposed, counts
