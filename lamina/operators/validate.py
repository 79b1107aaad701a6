"""Consistency checks between metadata, files, shapes and label values.

Every check returns findings ``(severity, volume_id, message)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M


def _finding(rows: DataFrame, severity, message) -> DataFrame:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(as_column(severity).alias("severity"), "volume_id", as_column(message).alias("message"))


def orphan_files(metadata: DataFrame, images: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Files that no metadata row names."""
    out = None
    for files, kind in ((images, "image"), (labels, "label")):
        if files is None:
            continue
        lost = files.select("id").distinct().join(metadata.select("id"), "id", "left_anti")
        rows = _finding(lost.withColumnRenamed("id", "volume_id"), "warning", f"{kind} not listed in metadata")
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_files(metadata: DataFrame, listings: dict[str, DataFrame], require_label: bool = True) -> DataFrame:
    """Listed cases without image or label; the image is judged first and ends the case."""
    rows = metadata.select("id").distinct()
    for name in ("images", "labels", "deprecated_images", "deprecated_labels", "test_images"):
        mark = listings[name].select("id").distinct().withColumn(name, F.lit(1))
        rows = rows.join(mark, "id", "left")
    has = lambda n: F.col(n).isNotNull()
    no_label = ~has("labels") & F.lit(require_label)
    message = (
        F.when(~has("images") & has("deprecated_images") & has("test_images"), "image deprecated, also in test")
        .when(~has("images") & has("deprecated_images"), "image deprecated")
        .when(~has("images") & has("test_images"), "image only in test")
        .when(~has("images"), "image missing")
        .when(no_label & has("deprecated_labels"), "label deprecated")
        .when(no_label, "label missing")
    )
    found = rows.select(F.col("id").alias("volume_id"), message.alias("message")).filter("message IS NOT NULL")
    severity = F.when(F.col("message").endswith("missing"), "error").otherwise("warning")
    return _finding(found, severity, F.col("message"))


def shape_mismatch(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Volumes whose image and label shapes ``d, h, w`` differ."""
    shape = lambda side: F.concat_ws("x", *[F.col(f"{side}.{c}").cast("string") for c in "dhw"])
    both = images.alias("i").join(labels.alias("l"), "volume_id").select(
        "volume_id", shape("i").alias("image"), shape("l").alias("label")
    )
    message = F.concat(F.lit("shape mismatch: image "), "image", F.lit(" vs label "), "label")
    return _finding(both.filter("image != label"), "error", message)


def illegal_labels(voxels: DataFrame) -> DataFrame:
    """Volumes with label values outside the known classes."""
    bad = (
        voxels.filter(~F.col("label").isin(*M.LABEL_NAMES))
        .groupBy("volume_id")
        .agg(F.sort_array(F.collect_set("label")).alias("values"))
    )
    text = F.array_join(F.transform("values", lambda v: v.cast("string")), ", ")
    return _finding(bad, "error", F.concat(F.lit("illegal label values: "), text))


def label_inventory(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Shape and label shares per volume; cells without a row are background."""
    label = F.col("label")
    counts = voxels.groupBy("volume_id").agg(
        F.count_if(label == M.SURFACE).alias("n1"),
        F.count_if(label == M.IGNORE).alias("n2"),
        F.count_if(label != M.BACKGROUND).alias("other"),
    )
    n = F.col("d").cast("long") * F.col("h") * F.col("w")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    labeled = n - zero("n2")
    return volumes.join(counts, "volume_id", "left").select(
        "volume_id",
        "scroll_id",
        "d",
        "h",
        "w",
        "dtype",
        "image_bytes",
        ((n - zero("other")) / n).alias("frac_background"),
        (zero("n1") / n).alias("frac_surface"),
        (zero("n2") / n).alias("frac_ignore"),
        (labeled / n).alias("frac_labeled"),
        F.when(labeled > 0, zero("n1") / F.nullif(labeled, F.lit(0))).otherwise(0.0).alias("frac_surface_among_labeled"),
    )


def sparse_labels(inventory: DataFrame, least: float = 0.01) -> DataFrame:
    few = inventory.filter(F.col("frac_labeled") < least)
    return _finding(few, "warning", "very few labeled voxels")


def validation_findings(*checks: DataFrame) -> DataFrame:
    """Findings of checks given in the order in which they look at a volume.

    A volume is done at its first error: what later checks say about it is left out.
    """
    columns = checks[0].columns
    placed = reduce(DataFrame.unionByName, [c.withColumn("_check", F.lit(k)) for k, c in enumerate(checks)])
    failed = placed.filter("severity = 'error'").groupBy("volume_id").agg(F.min("_check").alias("_failed"))
    kept = placed.join(failed, "volume_id", "left").filter("_failed IS NULL OR _check <= _failed")
    return kept.select(*columns)


def validation_report(findings: DataFrame) -> DataFrame:
    """Counts by severity and the verdict: fine unless there is an error."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(
        errors.alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        (errors == 0).alias("ok"),
    )
