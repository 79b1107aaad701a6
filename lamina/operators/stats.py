"""Class, intensity and domain statistics.

Values are first counted per group and distinct value, so every statistic works on a
small histogram of exact values, and the background cells that have no row enter as a
single weighted zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.columns import format_bytes, nearest_choice
from lamina.operators.quantiles import quantiles

# Patch depths that may be recommended.
PATCH_DEPTHS = (32, 48, 64, 96, 128, 160, 192)


def _cells() -> Column:
    return F.col("d").cast("long") * F.col("h") * F.col("w")


def labeled_values(voxels: DataFrame, volumes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``volume_id, value, n``: finite intensities outside the ignored region."""
    value = F.col("intensity").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    stored = voxels.filter((F.col("label") != M.IGNORE) & finite)
    counts = stored.groupBy("volume_id", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = voxels.groupBy("volume_id").agg(F.count(F.lit(1)).alias("stored"))
    empty = volumes.join(rows, "volume_id", "left").select(
        "volume_id", F.lit(0.0).alias("value"), (_cells() - F.coalesce("stored", F.lit(0))).alias("n")
    )
    out = counts.unionByName(empty.filter("n > 0")).groupBy("volume_id", "value").agg(F.sum("n").alias("n"))
    return out.join(volumes.select("volume_id", *carry), "volume_id") if carry else out


def _moments(values: DataFrame, key: str) -> DataFrame:
    """Weighted count, range, mean and population deviation."""
    base = values.groupBy(key).agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    spread = values.join(base.select(key, "mean"), key).groupBy(key).agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)) / F.sum("n")).alias("std")
    )
    return base.join(spread, key)


def intensity_stats(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    values = labeled_values(voxels, volumes)
    ranks = quantiles(values, ["volume_id"], (0.01, 0.5, 0.99)).select(
        "volume_id", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99")
    )
    numbers = ["count", "min", "max", "mean", "std", "p01", "p50", "p99"]
    found = _moments(values, "volume_id").join(ranks, "volume_id")
    return volumes.select("volume_id").join(found, "volume_id", "left").na.fill(0, numbers)


def class_stats(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    label = F.col("label")
    counts = voxels.groupBy("volume_id").agg(
        F.count_if(label == M.SURFACE).alias("n1"),
        F.count_if(label == M.IGNORE).alias("n2"),
        F.count_if(label != M.BACKGROUND).alias("other"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = _cells()
    bg = n - zero("other")
    labeled = bg + zero("n1")
    return volumes.join(counts, "volume_id", "left").select(
        "volume_id",
        n.alias("n_voxels"),
        (bg / n).alias("frac_bg"),
        (zero("n1") / n).alias("frac_surface"),
        (zero("n2") / n).alias("frac_ignore"),
        (labeled / n).alias("frac_labeled"),
        (zero("n1") / F.greatest(labeled, F.lit(1))).alias("surface_among_labeled"),
    )


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin; the last one is closed on the right."""
    return F.least(F.floor((value - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")


def intensity_histogram(voxels: DataFrame, volumes: DataFrame, bins: int = 64) -> DataFrame:
    """Density per bin over each volume's own value range."""
    values = labeled_values(voxels, volumes)
    span = values.groupBy("volume_id").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        "volume_id",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "total",
    )
    filled = (
        values.join(span, "volume_id")
        .groupBy("volume_id", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return (
        span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .join(filled, ["volume_id", "bin"], "left")
        .select(
            "volume_id",
            "bin",
            (F.col("lo") + step * F.col("bin")).alias("edge"),
            (F.coalesce("n", F.lit(0)) / F.col("total") / step).alias("density"),
        )
    )


def volume_report(voxels: DataFrame, volumes: DataFrame, first: int | None = None) -> DataFrame:
    """Metadata, class shares and readable sizes; optionally the first ids only."""
    shares = class_stats(voxels, volumes).select("volume_id", "frac_bg", "frac_surface", "frac_ignore")
    if first is not None:
        volumes = volumes.orderBy("volume_id").limit(first)
    return volumes.join(shares, "volume_id").select(
        *volumes.columns,
        "frac_bg",
        "frac_surface",
        "frac_ignore",
        format_bytes("image_bytes").alias("disk_size"),
    )


def surface_thickness(distances: DataFrame, volumes: DataFrame) -> DataFrame:
    """Sheet width statistics from squared distances ``(volume_id, z, y, x, d2)`` inside the surface."""
    counts = distances.filter("d2 > 0").groupBy("volume_id", "d2").agg(F.count(F.lit(1)).alias("n"))
    width = counts.withColumn("width", 2.0 * F.sqrt("d2"))
    stats = width.groupBy("volume_id").agg(
        (F.sum(F.col("width") * F.col("n")) / F.sum("n")).alias("mean_thickness"),
    )
    stats = stats.join(quantiles(width, ["volume_id"], (0.5, 0.9), "width"), "volume_id")
    median = F.coalesce(F.col("q")[0], F.lit(0.0))
    raw = F.greatest(F.lit(32.0), F.least(F.lit(192.0), F.rint(median * 8 / 16) * 16))
    raw = F.when(median > 0, raw).otherwise(64.0)
    return volumes.select("volume_id").join(stats, "volume_id", "left").select(
        "volume_id",
        median.alias("median_thickness"),
        F.coalesce("mean_thickness", F.lit(0.0)).alias("mean_thickness"),
        F.coalesce(F.col("q")[1], F.lit(0.0)).alias("p90_thickness"),
        nearest_choice(raw, PATCH_DEPTHS).alias("recommended_depth"),
    )


def imbalance_report(voxels: DataFrame, volumes: DataFrame, patches: DataFrame) -> DataFrame:
    """Voxel class ratio plus how surface spreads over the kept patches."""
    label = F.col("label")
    counts = voxels.groupBy("volume_id").agg(
        F.count_if(label == M.SURFACE).alias("pos"), F.count_if(label == M.IGNORE).alias("ign")
    )
    fraction = F.col("foreground_ratio")
    spread = patches.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("num_patches"),
        F.avg((fraction > 0).cast("double")).alias("with_surface"),
        F.avg((fraction >= 0.01).cast("double")).alias("ge_1pct"),
    )
    middle = quantiles(patches.withColumn("n", F.lit(1)), ["volume_id"], (0.5,), "foreground_ratio")
    spread = spread.join(middle.select("volume_id", F.col("q")[0].alias("median_fraction")), "volume_id", "left")
    pos, ign = F.coalesce("pos", F.lit(0)), F.coalesce("ign", F.lit(0))
    neg = _cells() - pos - ign
    return volumes.join(counts, "volume_id", "left").join(spread, "volume_id", "left").select(
        "volume_id",
        (neg / F.greatest(pos, F.lit(1))).alias("neg_pos_ratio"),
        (pos / F.greatest(pos + neg, F.lit(1))).alias("surface_among_labeled"),
        (ign / _cells()).alias("frac_ignore"),
        F.coalesce("num_patches", F.lit(0)).alias("num_patches"),
        F.coalesce("with_surface", F.lit(0.0)).alias("frac_patches_with_surface"),
        F.coalesce("ge_1pct", F.lit(0.0)).alias("frac_patches_ge_1pct"),
        F.coalesce("median_fraction", F.lit(0.0)).alias("median_patch_fraction"),
    )


def scroll_domain_shift(voxels: DataFrame, volumes: DataFrame, bins: int = 64) -> DataFrame:
    """Pairwise differences between scrolls over one shared value range."""
    values = (
        labeled_values(voxels, volumes, ("scroll_id",)).groupBy("scroll_id", "value").agg(F.sum("n").alias("n"))
    )
    low, high = F.col("q")[0], F.col("q")[1]
    flat = low == high
    # A range of one value is widened by one half on either side.
    shared = quantiles(values, [], (0.01, 0.99)).select(
        F.when(flat, low - 0.5).otherwise(low).alias("lo"), F.when(flat, high + 0.5).otherwise(high).alias("hi")
    )
    inside = (
        values.join(shared, (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        .groupBy("scroll_id", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    # One fixed-length array per scroll: `bins` conditional sums.
    histogram = inside.groupBy("scroll_id").agg(
        F.array(*[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) for b in range(bins)]).alias("h"),
        F.sum("n").alias("total"),
    ).select("scroll_id", F.transform("h", lambda v: v / F.col("total")).alias("hist"))
    surface = voxels.filter(F.col("label") == M.SURFACE).groupBy("volume_id").agg(F.count(F.lit(1)).alias("pos"))
    ignore = voxels.filter(F.col("label") == M.IGNORE).groupBy("volume_id").agg(F.count(F.lit(1)).alias("ign"))
    density = (
        volumes.join(surface, "volume_id", "left")
        .join(ignore, "volume_id", "left")
        .groupBy("scroll_id")
        .agg(
            (
                F.sum(F.coalesce("pos", F.lit(0)))
                / F.greatest(F.sum(_cells() - F.coalesce("ign", F.lit(0))), F.lit(1))
            ).alias("density")
        )
    )
    # Scrolls without labelled values stay, with an empty histogram.
    nothing = F.array(*[F.lit(0.0)] * bins)
    one = (
        density.join(_moments(values, "scroll_id"), "scroll_id", "left").join(histogram, "scroll_id", "left")
        .na.fill(0, ["mean", "std"]).withColumn("hist", F.coalesce("hist", nothing))
    )
    side = lambda s: one.select(*[F.col(c).alias(f"{c}_{s}") for c in ("scroll_id", "mean", "std", "hist", "density")])
    l1 = F.aggregate(
        F.zip_with("hist_a", "hist_b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda acc, v: acc + v
    )
    return side("a").join(side("b"), F.col("scroll_id_a") < F.col("scroll_id_b")).select(
        F.col("scroll_id_a").alias("scroll_a"),
        F.col("scroll_id_b").alias("scroll_b"),
        F.abs(F.col("mean_a") - F.col("mean_b")).alias("mean_diff"),
        (F.greatest("std_a", "std_b") / (F.least("std_a", "std_b") + 1e-6)).alias("std_ratio"),
        l1.alias("hist_l1"),
        F.col("density_a").alias("surface_density_a"),
        F.col("density_b").alias("surface_density_b"),
        F.abs(F.col("density_a") - F.col("density_b")).alias("surface_density_diff"),
    )


def validation_recommendation(shift: DataFrame) -> DataFrame:
    """Whether scrolls differ enough to demand leaving whole scrolls out."""
    l1, gap = F.avg("hist_l1"), F.avg("surface_density_diff")
    verdict = (
        F.when(F.count(F.lit(1)) == 0, "need two scrolls")
        .when((l1 > 0.25) | (gap > 0.05), "leave one scroll out")
        .otherwise("scrolls are similar")
    )
    return shift.agg(l1.alias("mean_hist_l1"), gap.alias("mean_density_gap"), verdict.alias("verdict"))


def mid_planes(voxels: DataFrame, volumes: DataFrame, value: str = "intensity") -> DataFrame:
    """Dense middle slices ``(volume_id, plane, r, c, value)``."""
    stored = voxels.select("volume_id", "z", "y", "x", F.col(value).cast("double").alias("value"))
    out = None
    for plane, (axis, size, rows, columns) in {
        "axial": ("z", "d", ("y", "h"), ("x", "w")),
        "coronal": ("y", "h", ("z", "d"), ("x", "w")),
        "sagittal": ("x", "w", ("z", "d"), ("y", "h")),
    }.items():
        mid = F.expr(f"CAST({size} div 2 AS INT)").alias(axis)
        cells = (
            volumes.select("volume_id", mid, rows[1], columns[1])
            .withColumn(rows[0], F.explode(F.sequence(F.lit(0), F.col(rows[1]) - 1)))
            .withColumn(columns[0], F.explode(F.sequence(F.lit(0), F.col(columns[1]) - 1)))
        )
        part = cells.join(stored, ["volume_id", "z", "y", "x"], "left").select(
            "volume_id",
            F.lit(plane).alias("plane"),
            F.col(rows[0]).alias("r"),
            F.col(columns[0]).alias("c"),
            F.coalesce("value", F.lit(0.0)).alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def stretch_plane(planes: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Stretch each plane between two quantiles to 0..255, truncating."""
    key = ["volume_id", "plane"]
    counts = planes.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
    span = quantiles(counts, key, (low, high)).select(*key, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 255.0
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")
    return planes.join(span, key).select(
        *key, "r", "c", F.when(F.col("hi") > F.col("lo"), level).otherwise(0).alias("level")
    )
