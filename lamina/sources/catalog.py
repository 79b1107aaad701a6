"""Case metadata, file listings and the volume index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.columns import file_stem
from lamina.session import by_cells

UNKNOWN = "unknown"


def read_case_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``id, scroll_id`` of a CSV whose header may differ in case and padding."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return normalize_metadata(raw.withColumn("__place", place), "__place")


def normalize_metadata(raw: DataFrame, order: str) -> DataFrame:
    """Find the id columns by name, fill in unknown scrolls, keep the first row per id."""
    names = {c.strip().lower(): c for c in raw.columns}
    if "id" not in names:
        raise KeyError(f"metadata needs an id column, found {raw.columns}")
    scroll = F.col(f"`{names['scroll_id']}`").cast("string") if "scroll_id" in names else F.lit(None).cast("string")
    rows = raw.select(
        F.col(f"`{names['id']}`").cast("string").alias("id"),
        F.coalesce(scroll, F.lit(UNKNOWN)).alias("scroll_id"),
        F.col(order).alias("place"),
    )
    return rows.groupBy("id").agg(F.min_by("scroll_id", "place").alias("scroll_id"))


def list_case_files(spark: SparkSession, folder: str) -> DataFrame:
    """``id, path, length`` of the volume files in a folder; contents are never read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return case_files(files)


def case_files(files: DataFrame) -> DataFrame:
    """Volume files of a ``path, length`` listing, one per id (the last path in order)."""
    return (
        files.withColumn("id", file_stem("path"))
        .filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.max(F.struct("path", "length")).alias("f"))
        .select("id", "f.path", "f.length")
    )


def _flag(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    marked = ids.select("id").distinct().withColumn(name, F.lit(True))
    return df.join(marked, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def build_volume_index(
    metadata: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    deprecated_images: DataFrame,
    deprecated_labels: DataFrame,
    require_label: bool = True,
    volume_ids: Iterable[str] | None = None,
    scroll_ids: Iterable[str] | None = None,
) -> DataFrame:
    """Status of every listed case: ``indexed``, ``deprecated`` or what is missing.

    The allow lists are applied before any file table is joined.
    """
    rows = metadata
    if volume_ids is not None:
        rows = rows.filter(F.col("id").isin(*map(str, volume_ids)))
    if scroll_ids is not None:
        rows = rows.filter(F.col("scroll_id").isin(*map(str, scroll_ids)))
    for ids, name in (
        (images, "has_image"),
        (labels, "has_label"),
        (deprecated_images, "old_image"),
        (deprecated_labels, "old_label"),
    ):
        rows = _flag(rows, ids, name)
    no_label = ~F.col("has_label") & F.lit(require_label)
    status = (
        F.when(~F.col("has_image") & F.col("old_image"), "deprecated")
        .when(~F.col("has_image"), "missing_image")
        .when(no_label & F.col("old_label"), "deprecated")
        .when(no_label, "missing_label")
        .otherwise("indexed")
    )
    return rows.select(F.col("id").alias("volume_id"), "scroll_id", "has_label", status.alias("status"))


def indexed_volumes(index: DataFrame) -> DataFrame:
    """The usable volumes; an empty index is an error."""
    found = index.filter("status = 'indexed'").drop("status")
    if found.isEmpty():
        raise FileNotFoundError("no volume has all its files")
    return found


def scroll_summary(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("scroll_id").agg(
        F.count(F.lit(1)).alias("n_volumes"),
        F.array_join(F.sort_array(F.collect_list("volume_id")), ",").alias("volume_ids"),
    )


def normalize_scroll_map(groups: DataFrame) -> DataFrame:
    """``case_id, scroll_id`` from either one row per case or one row per scroll with ``cases``."""
    if "cases" in groups.columns:
        groups = groups.select(F.explode("cases").alias("case_id"), "scroll_id")
    return groups.select(F.col("case_id").cast("string"), F.col("scroll_id").cast("string"))


def probe_volumes(voxels: DataFrame, intensity: str | None = "intensity") -> DataFrame:
    """Shape and optional value range of each volume, from its voxels."""
    shape = [(F.max(c) + 1).cast("int").alias(n) for c, n in (("z", "d"), ("y", "h"), ("x", "w"))]
    extra = [F.min(intensity).alias("min_value"), F.max(intensity).alias("max_value")] if intensity else []
    return voxels.groupBy("volume_id").agg(*shape, F.count(F.lit(1)).alias("n_voxels"), *extra)


def dense_cells(volumes: DataFrame) -> DataFrame:
    """Every cell of every volume.

    Planes are dealt to as many tasks as the cells need before they are listed, so one volume spreads over many
    tasks; lines are listed one by one, so no row gets large.
    """
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    planes = volumes.select("volume_id", axis("d").alias("z"), "h", "w")
    return (
        by_cells(planes, F.col("h").cast("long") * F.col("w"), "volume_id", "z")
        .select("volume_id", "z", axis("h").alias("y"), "w")
        .select("volume_id", "z", "y", axis("w").alias("x"))
    )


def densify(voxels: DataFrame, volumes: DataFrame, fill: dict) -> DataFrame:
    """One row per cell, with ``fill`` where no voxel is stored."""
    key = ["volume_id", "z", "y", "x"]
    return dense_cells(volumes).join(voxels.select(*key, *fill), key, "left").na.fill(fill)


def case_subset(wanted: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Requested cases with what was found of each; ids are trimmed first."""
    rows = wanted.select(F.trim(F.col("id").cast("string")).alias("id")).distinct()
    rows = _flag(_flag(rows, images, "has_image"), labels, "has_label")
    return rows.select(
        F.col("id").alias("case_id"), "has_image", (F.col("has_image") & F.col("has_label")).alias("has_label")
    )


def export_cases(index: DataFrame, test: DataFrame, max_train: int | None = None) -> DataFrame:
    """``case_id, scroll_id, role`` of an export; a cap keeps the first ids."""
    train = index.select(F.trim("volume_id").alias("case_id"), "scroll_id", F.lit("train").alias("role"))
    if max_train is not None:
        train = train.orderBy("case_id").limit(max_train)
    held = test.select(F.trim("id").alias("case_id"), F.lit(None).cast("string").alias("scroll_id"), F.lit("test").alias("role"))
    return train.unionByName(held)


def export_manifest(cases: DataFrame, name: str, channel: str = "CT") -> DataFrame:
    """One row describing an export."""
    return cases.agg(
        F.lit(name).alias("name"),
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
        F.lit("background=0,surface=1,ignore=2").alias("labels"),
        F.lit(channel).alias("channel_name"),
        F.array_join(F.sort_array(F.collect_set("scroll_id")), ",").alias("scrolls"),
    )


_EXPORTED = (
    "version BIGINT, name STRING, n_train BIGINT, n_test BIGINT, labels STRING, channel_name STRING, scrolls STRING,"
    " n_train_rows BIGINT, n_test_rows BIGINT"
)


def _exports(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_EXPORTED).json(f"{path}/manifest")
    except Exception as error:  # noqa: BLE001 - only a missing path means nothing was exported
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def export_dataset(cases: DataFrame, voxels: DataFrame, path: str, name: str, version: int = 1) -> DataFrame:
    """Write the voxels of the exported cases by role as one ``version``; returns its manifest row.

    The version's folder is written first and counted as it was written; the manifest row that makes it visible to
    :func:`read_export` is appended last, as one file. A run that breaks off leaves no visible version and is simply
    repeated: its folder is replaced. A version that is visible already stays as it is.
    """
    spark = voxels.sparkSession
    known = _exports(spark, path)
    if known is not None and not known.filter(F.col("version") == version).isEmpty():
        return known.filter(F.col("version") == version)
    folder = f"{path}/version-{version}"
    rows = voxels.withColumnRenamed("volume_id", "case_id").join(cases.select("case_id", "role"), "case_id")
    rows.repartition("role", "case_id", F.expr("z div 32")).write.mode("overwrite").partitionBy("role").parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder).agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}_rows") for r in ("train", "test")])
    manifest = export_manifest(cases, name).crossJoin(written).select(F.lit(version).cast("long").alias("version"), "*")
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return _exports(spark, path).filter(F.col("version") == version)


def read_export(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest row, voxels with ``case_id`` and ``role``) of the newest or the given visible version."""
    known = _exports(spark, path)
    if known is not None and version is not None:
        known = known.filter(F.col("version") == version)
    newest = None if known is None else known.agg(F.max("version")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no exported version in {path}")
    return known.filter(F.col("version") == newest), spark.read.parquet(f"{path}/version-{newest}")


def write_masks(masks: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write ``stage, volume_id, z, y, x`` rows by stage and volume.

    Volumes a stage already has are skipped unless ``overwrite``; then only the
    partitions being written are replaced. Returns the keys that were written.
    """
    spark = masks.sparkSession
    keys = ["stage", "volume_id"]
    if not overwrite:
        try:
            done = spark.read.parquet(path).select(*keys).distinct()
        except Exception as error:  # noqa: BLE001 - only a missing path means nothing was written
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            masks = masks.join(done, keys, "left_anti")
    (
        masks.repartition(*keys, F.expr("z div 32"))
        .write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    return masks.select(*keys).distinct()


def submission_check(predictions: DataFrame, sources: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Compare shape and dtype of every prediction with its source; ``all_ok`` covers them all."""
    p = predictions.select("volume_id", *[F.col(c).alias(f"p_{c}") for c in ("d", "h", "w", "dtype")])
    rows = p.join(sources.select("volume_id", "d", "h", "w"), "volume_id", "left").select(
        "volume_id",
        F.coalesce(
            (F.col("p_d") == F.col("d")) & (F.col("p_h") == F.col("h")) & (F.col("p_w") == F.col("w")), F.lit(False)
        ).alias("shape_ok"),
        (F.col("p_dtype") == dtype).alias("dtype_ok"),
    )
    overall = rows.agg(F.coalesce(F.bool_and(F.col("shape_ok") & F.col("dtype_ok")), F.lit(True)).alias("all_ok"))
    return rows.join(overall, F.lit(True))
