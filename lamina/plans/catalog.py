"""Catalog, validation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import session
from lamina.functions import columns as K
from lamina.functions.stencils import ball_offsets, cross_spans
from lamina.operators import stats, validate
from lamina.operators.distance import distance_transform
from lamina.operators.packed import dilate
from lamina.operators.patches import patch_index
from lamina.plans import fixtures as X
from lamina.plans.registry import query
from lamina.model import PatchSettings
from lamina.sources import catalog as G

CATALOG = f"WITH {X.CATALOG_SQL}"
GRID = """cells AS MATERIALIZED (SELECT volume_id, scroll_id, CAST(a.z AS INT) AS z, CAST(b.y AS INT) AS y, CAST(c.x AS INT) AS x
  FROM volumes CROSS JOIN (SELECT UNNEST(range(24)) AS z) a CROSS JOIN (SELECT UNNEST(range(24)) AS y) b
  CROSS JOIN (SELECT UNNEST(range(24)) AS x) c),
dense AS MATERIALIZED (SELECT volume_id, scroll_id, z, y, x, coalesce(intensity, 0) AS value, coalesce(label, 0) AS label
  FROM cells LEFT JOIN vox USING (volume_id, z, y, x))"""
VOX = f"WITH RECURSIVE {X.VOX_SQL}, {X.VOLUMES_SQL}"
DENSE = f"{VOX}, {GRID}"

_EXT = "CASE c_custkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '_0000.tif' ELSE '.png' END"
_PATHS = f"'/data/images/' || CAST(c_custkey AS STRING) || {_EXT}"


def _paths(spark, folder):
    return X.table(spark, folder, "customer").select(F.expr(_PATHS).alias("path"), F.col("c_custkey").alias("length"))


@query(
    "read_case_metadata",
    """WITH raw AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS s,
  o_orderkey FROM orders)
SELECT id, coalesce(arg_min_null(s, o_orderkey), 'unknown') AS scroll_id FROM raw GROUP BY 1""",
)
def read_case_metadata(spark, folder):
    raw = X.table(spark, folder, "orders").select(
        F.col("o_custkey").alias(" ID "),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END").alias("Scroll_Id"),
        F.col("o_orderkey").alias("place"),
    )
    return G.normalize_metadata(raw, "place")


@query(
    "list_case_files",
    f"""SELECT regexp_extract(p, '([^/]+)\\.[^.]+$', 1) AS id, p AS path, length FROM
(SELECT {_PATHS.replace('STRING', 'VARCHAR')} AS p, c_custkey AS length FROM customer) WHERE lower(p) LIKE '%.tif' OR lower(p) LIKE '%.tiff'""",
)
def list_case_files(spark, folder):
    return G.case_files(_paths(spark, folder))


@query(
    "case_id_from_filename",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS case_id, {_PATHS.replace('STRING', 'VARCHAR')} AS path FROM customer WHERE c_custkey % 4 <> 3""",
)
def case_id_from_filename(spark, folder):
    return (
        _paths(spark, folder)
        .select(K.case_id_from_filename("path").alias("case_id"), "path")
        .filter("case_id IS NOT NULL")
    )


_INDEX = f"""{CATALOG}, idx AS (SELECT id AS volume_id, scroll_id, id IN (FROM label_files) AS has_label,
  CASE WHEN id NOT IN (FROM images) THEN CASE WHEN id IN (FROM deprecated_images) THEN 'deprecated' ELSE 'missing_image' END
       WHEN id NOT IN (FROM label_files) THEN CASE WHEN id IN (FROM deprecated_labels) THEN 'deprecated' ELSE 'missing_label' END
       ELSE 'indexed' END AS status FROM metadata)"""


def _index(spark, folder, **options):
    c = X.catalog(spark, folder)
    return G.build_volume_index(
        c["metadata"], c["images"], c["labels"], c["deprecated_images"], c["deprecated_labels"], **options
    )


@query("build_volume_index", f"{_INDEX} SELECT * FROM idx WHERE scroll_id <> '3'")
def build_volume_index(spark, folder):
    return _index(spark, folder, scroll_ids=[s for s in range(25) if s != 3])


@query(
    "scroll_summary",
    f"""{_INDEX} SELECT scroll_id, count(*) AS n_volumes, string_agg(volume_id, ',' ORDER BY volume_id) AS volume_ids
FROM idx WHERE status = 'indexed' GROUP BY 1""",
)
def scroll_summary(spark, folder):
    return G.scroll_summary(_index(spark, folder).filter("status = 'indexed'"))


@query("normalize_scroll_map", f"WITH {X.CASES_SQL} SELECT case_id, scroll_id FROM cases")
def normalize_scroll_map(spark, folder):
    grouped = X.cases(spark, folder).groupBy("scroll_id").agg(F.collect_list("case_id").alias("cases"))
    return G.normalize_scroll_map(grouped)


@query(
    "probe_volumes",
    f"""{VOX} SELECT volume_id, CAST(max(z) + 1 AS INT) AS d, CAST(max(y) + 1 AS INT) AS h, CAST(max(x) + 1 AS INT) AS w,
count(*) AS n_voxels, min(intensity) AS min_value, max(intensity) AS max_value FROM vox GROUP BY 1""",
)
def probe_volumes(spark, folder):
    return G.probe_volumes(X.voxels(spark, folder))


@query("densify", f"{DENSE} SELECT volume_id, z, y, x, value AS intensity, label FROM dense")
def densify(spark, folder):
    return G.densify(X.voxels(spark, folder), X.volumes(spark, folder), {"intensity": 0.0, "label": 0})


@query(
    "case_subset",
    f"""{CATALOG} SELECT CAST(o_custkey AS VARCHAR) AS case_id, case_id IN (FROM images) AS has_image,
case_id IN (FROM images) AND case_id IN (FROM label_files) AS has_label FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def case_subset(spark, folder):
    c = X.catalog(spark, folder)
    wanted = X.table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    return G.case_subset(
        wanted.select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("id")), c["images"], c["labels"]
    )


@query(
    "export_manifest",
    f"""{_INDEX} SELECT 'sheets' AS name, (SELECT count(*) FROM idx WHERE status = 'indexed') AS n_train,
(SELECT count(*) FROM test_images) AS n_test, 'background=0,surface=1,ignore=2' AS labels, 'CT' AS channel_name,
(SELECT string_agg(DISTINCT scroll_id, ',' ORDER BY scroll_id) FROM idx WHERE status = 'indexed') AS scrolls""",
)
def export_manifest(spark, folder):
    train = _index(spark, folder).filter("status = 'indexed'")
    return G.export_manifest(G.export_cases(train, X.catalog(spark, folder)["test_images"]), "sheets")


@query(
    "export_dataset",
    f"""{VOX}, c AS (SELECT volume_id, scroll_id, CASE WHEN scroll_id = 's1' THEN 'test' ELSE 'train' END AS role FROM volumes)
SELECT role, CAST(2 AS BIGINT) AS version, (SELECT count(*) FROM c WHERE role = 'train') AS n_train, (SELECT count(*) FROM c WHERE role = 'test') AS n_test,
(SELECT string_agg(DISTINCT scroll_id, ',' ORDER BY scroll_id) FROM c WHERE role = 'train') AS scrolls,
count(DISTINCT volume_id) AS n_cases, count(*) AS n_rows, round(sum(intensity), 2) AS intensity,
count(*) = (SELECT count(*) FROM vox JOIN c d USING (volume_id) WHERE d.role = c.role) AS as_announced
FROM vox JOIN c USING (volume_id) GROUP BY role""",
    derive_once=True,
)
def export_dataset(spark, folder):
    """Two versions are written, the second one twice; what a reader then gets is counted."""
    path = session.shared_folder(spark, "export")
    volumes, voxels = X.volumes(spark, folder), X.voxels(spark, folder)
    train = volumes.filter("scroll_id != 's1'").select("volume_id", "scroll_id")
    cases = G.export_cases(train, volumes.filter("scroll_id = 's1'").select(F.col("volume_id").alias("id")))
    for version in (1, 2, 2):
        G.export_dataset(cases, voxels.filter("z > 2") if version == 1 else voxels, path, "sheets", version)
    manifest, rows = G.read_export(spark, path)
    announced = F.when(F.col("role") == "train", F.col("n_train_rows")).otherwise(F.col("n_test_rows"))
    found = rows.groupBy("role").agg(
        F.count_distinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("intensity"), 2).alias("intensity"))
    return found.crossJoin(manifest).select(
        "role", "version", "n_train", "n_test", "scrolls", "n_cases", "n_rows", "intensity", (F.col("n_rows") == announced).alias("as_announced"))


_DTYPE = "CASE WHEN CAST(substr(volume_id, 2) AS INT) % 5 = 3 THEN 'float32' ELSE 'uint8' END"


@query(
    "submission_check",
    f"""{VOX}, p AS (SELECT volume_id, max(z) + 1 = any_value(d) AND max(y) + 1 = any_value(h) AND max(x) + 1 = any_value(w) AS shape_ok,
 any_value({_DTYPE}) = 'uint8' AS dtype_ok FROM vox JOIN volumes USING (volume_id) GROUP BY 1)
SELECT *, (SELECT bool_and(shape_ok AND dtype_ok) FROM p) AS all_ok FROM p""",
)
def submission_check(spark, folder):
    shapes = G.probe_volumes(X.voxels(spark, folder)).withColumn("dtype", F.expr(_DTYPE))
    return G.submission_check(shapes, X.volumes(spark, folder))


# --- validation ---------------------------------------------------------------------------------
_ORPHANS = """SELECT 'warning' AS severity, id AS volume_id, 'image not listed in metadata' AS message FROM images ANTI JOIN metadata USING (id)
UNION ALL SELECT 'warning', id, 'label not listed in metadata' FROM label_files ANTI JOIN metadata USING (id)"""
_MISSING = """SELECT CASE WHEN message LIKE '%missing' THEN 'error' ELSE 'warning' END AS severity, volume_id, message FROM (
SELECT id AS volume_id, CASE
 WHEN id NOT IN (FROM images) THEN CASE WHEN id IN (FROM deprecated_images) AND id IN (FROM test_images) THEN 'image deprecated, also in test'
   WHEN id IN (FROM deprecated_images) THEN 'image deprecated' WHEN id IN (FROM test_images) THEN 'image only in test' ELSE 'image missing' END
 WHEN id NOT IN (FROM label_files) THEN CASE WHEN id IN (FROM deprecated_labels) THEN 'label deprecated' ELSE 'label missing' END
 END AS message FROM metadata) WHERE message IS NOT NULL"""
_SHAPES = """SELECT 'error' AS severity, volume_id, 'shape mismatch: image ' || a || ' vs label ' || b AS message FROM
(SELECT volume_id, concat_ws('x', max(z) + 1, max(y) + 1, max(x) + 1) AS a,
 concat_ws('x', max(z) FILTER (label = 1) + 1, max(y) FILTER (label = 1) + 1, max(x) FILTER (label = 1 AND prob > 0.8 AND z = 0) + 1) AS b
 FROM vox GROUP BY 1) WHERE a <> b"""
_ILLEGAL = """SELECT 'error' AS severity, volume_id, 'illegal label values: ' || string_agg(DISTINCT k, ', ' ORDER BY k) AS message
FROM (SELECT volume_id, CAST(CASE WHEN prob > 0.95 AND z < 6 THEN 3 + y % 3 ELSE label END AS INT) AS k FROM vox)
WHERE k NOT IN (0, 1, 2) GROUP BY 2"""
_INVENTORY = """inv AS MATERIALIZED (SELECT volume_id, v.scroll_id, v.d, v.h, v.w, v.dtype, v.image_bytes,
 CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) AS frac_background,
 CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) AS frac_surface,
 CAST(count(*) FILTER (label = 2) AS DOUBLE) / count(*) AS frac_ignore,
 CAST(count(*) FILTER (label <> 2) AS DOUBLE) / count(*) AS frac_labeled,
 CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) FILTER (label <> 2) AS frac_surface_among_labeled
 FROM dense JOIN volumes v USING (volume_id) GROUP BY ALL)"""


def _shape_sides(spark, folder):
    v = X.voxels(spark, folder)
    label = v.filter("label = 1")
    shape = lambda c, n: (F.max(c) + 1).cast("int").alias(n)
    images = v.groupBy("volume_id").agg(shape("z", "d"), shape("y", "h"), shape("x", "w"))
    tight = F.when((F.col("prob") > 0.8) & (F.col("z") == 0), F.col("x"))
    labels = label.groupBy("volume_id").agg(shape("z", "d"), shape("y", "h"), (F.max(tight) + 1).cast("int").alias("w"))
    return images, labels


def _with_illegal(spark, folder):
    changed = F.when((F.col("prob") > 0.95) & (F.col("z") < 6), 3 + F.col("y") % 3).otherwise(F.col("label"))
    return X.voxels(spark, folder).withColumn("label", changed.cast("int"))


@query("orphan_files", f"{CATALOG} {_ORPHANS}")
def orphan_files(spark, folder):
    c = X.catalog(spark, folder)
    return validate.orphan_files(c["metadata"], c["images"], c["labels"])


@query("missing_files", f"{CATALOG} {_MISSING}")
def missing_files(spark, folder):
    c = X.catalog(spark, folder)
    return validate.missing_files(c["metadata"], c)


@query("shape_mismatch", f"{VOX} {_SHAPES}")
def shape_mismatch(spark, folder):
    return validate.shape_mismatch(*_shape_sides(spark, folder))


@query("illegal_labels", f"{VOX} {_ILLEGAL}")
def illegal_labels(spark, folder):
    return validate.illegal_labels(_with_illegal(spark, folder))


@query("label_inventory", f"{DENSE}, {_INVENTORY} SELECT * FROM inv")
def label_inventory(spark, folder):
    return validate.label_inventory(X.voxels(spark, folder), X.volumes(spark, folder))


@query(
    "validation_report",
    f"""{DENSE}, {X.CATALOG_SQL}, {_INVENTORY}, missing AS ({_MISSING}), shapes AS ({_SHAPES}), illegal AS ({_ILLEGAL}),
lost AS (SELECT volume_id FROM missing WHERE severity = 'error'), misfit AS (FROM shapes ANTI JOIN lost USING (volume_id)),
found AS ({_ORPHANS} UNION ALL FROM missing UNION ALL FROM misfit
UNION ALL SELECT severity, volume_id, message FROM illegal ANTI JOIN lost USING (volume_id) ANTI JOIN misfit USING (volume_id)
UNION ALL SELECT 'warning', volume_id, 'very few labeled voxels' FROM inv WHERE frac_labeled < 0.01
 AND volume_id NOT IN (SELECT volume_id FROM lost UNION SELECT volume_id FROM misfit UNION SELECT volume_id FROM illegal))
SELECT count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
 count(*) FILTER (severity = 'error') = 0 AS ok FROM found""",
)
def validation_report(spark, folder):
    inventory = validate.label_inventory(X.voxels(spark, folder), X.volumes(spark, folder))
    found = validate.validation_findings(
        orphan_files(spark, folder),
        missing_files(spark, folder),
        shape_mismatch(spark, folder),
        illegal_labels(spark, folder),
        validate.sparse_labels(inventory),
    )
    return validate.validation_report(found)


# --- statistics -----------------------------------------------------------------------------------
def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query(
    "intensity_stats",
    f"""{DENSE}, s AS (SELECT volume_id, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std,
 quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM dense WHERE label <> 2 GROUP BY 1)
SELECT volume_id, count, min, max, round(mean, 4) AS mean, round(std, 4) AS std, {_r('p01', 'p50', 'p99')} FROM s""",
    derive_once=True,
)
def intensity_stats(spark, folder):
    out = stats.intensity_stats(X.voxels(spark, folder), X.volumes(spark, folder))
    out = out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))
    return _rounded(out, "p01", "p50", "p99")


@query(
    "class_stats",
    f"""{DENSE} SELECT volume_id, count(*) AS n_voxels, CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) AS frac_bg,
 CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) AS frac_surface, CAST(count(*) FILTER (label = 2) AS DOUBLE) / count(*) AS frac_ignore,
 CAST(count(*) FILTER (label < 2) AS DOUBLE) / count(*) AS frac_labeled,
 CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) FILTER (label < 2) AS surface_among_labeled FROM dense GROUP BY 1""",
)
def class_stats(spark, folder):
    return stats.class_stats(X.voxels(spark, folder), X.volumes(spark, folder))


@query(
    "intensity_histogram",
    f"""{DENSE}, r AS (SELECT volume_id, min(value) AS lo, max(value) AS hi, count(*) AS total FROM dense WHERE label <> 2 GROUP BY 1),
b AS (SELECT r.*, CAST(UNNEST(range(64)) AS INT) AS bin FROM r),
c AS (SELECT volume_id, CAST(least(floor((value - lo) / ((hi - lo) / 64)), 63) AS INT) AS bin, count(*) AS n FROM dense JOIN r USING (volume_id) WHERE label <> 2 GROUP BY 1, 2)
SELECT volume_id, bin, lo + (hi - lo) / 64 * bin AS edge, round(CAST(coalesce(n, 0) AS DOUBLE) / total / ((hi - lo) / 64), 9) AS density
FROM b LEFT JOIN c USING (volume_id, bin)""",
    derive_once=True,
)
def intensity_histogram(spark, folder):
    out = stats.intensity_histogram(X.voxels(spark, folder), X.volumes(spark, folder))
    return out.select("volume_id", "bin", "edge", F.round("density", 9).alias("density"))


_BYTES_SQL = """CASE WHEN b < 1024 THEN format('{:.2f} B', b) WHEN b < 1048576 THEN format('{:.2f} KB', b / 1024)
 WHEN b < 1073741824 THEN format('{:.2f} MB', b / 1048576) WHEN b < 1099511627776 THEN format('{:.2f} GB', b / 1073741824)
 ELSE format('{:.2f} TB', b / 1099511627776) END"""


@query(
    "format_bytes",
    f"SELECT k AS id, {_BYTES_SQL} AS size FROM (SELECT o_orderkey AS k, CAST(o_orderkey * o_orderkey * o_custkey AS DOUBLE) AS b FROM orders)",
)
def format_bytes(spark, folder):
    # Wide decimals: the product of the keys of larger tables exceeds a BIGINT.
    key = "CAST(o_orderkey AS DECIMAL(20, 0))"
    o = X.table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{key} * {key} * o_custkey AS b")
    return o.select("id", K.format_bytes("b").alias("size"))


@query(
    "volume_report",
    f"""{DENSE}, s AS (SELECT volume_id, CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) AS frac_bg,
 CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) AS frac_surface, CAST(count(*) FILTER (label = 2) AS DOUBLE) / count(*) AS frac_ignore FROM dense GROUP BY 1)
SELECT v.*, frac_bg, frac_surface, frac_ignore, '13.50 KB' AS disk_size FROM volumes v JOIN s USING (volume_id)""",
)
def volume_report(spark, folder):
    return stats.volume_report(X.voxels(spark, folder), X.volumes(spark, folder))


def nearest_gap_sql(source: str, width: int = X.SIDE) -> str:
    """Squared distance to the nearest empty cell by growing offsets; holes are never deep in the test data."""
    offsets = ", ".join(f"({z}, {y}, {x})" for z, y, x in ball_offsets(5))
    return f"""gaps AS (SELECT volume_id, z, y, x, min(dz*dz + dy*dy + dx*dx) AS d2 FROM (
  SELECT f.volume_id, f.z, f.y, f.x, dz, dy, dx FROM {source} f CROSS JOIN (VALUES {offsets}) o(dz, dy, dx)
  WHERE z + dz BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 AND x + dx BETWEEN 0 AND {width - 1}) c
  ANTI JOIN {source} g ON g.volume_id = c.volume_id AND g.z = c.z + c.dz AND g.y = c.y + c.dy AND g.x = c.x + c.dx GROUP BY 1, 2, 3, 4)"""


_GROWN = """grown AS MATERIALIZED (SELECT DISTINCT volume_id, z + a AS z, y + b AS y, x + c AS x FROM vox,
 (VALUES (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) o(a, b, c)
 WHERE label = 1 AND z + a BETWEEN 0 AND 23 AND y + b BETWEEN 0 AND 23 AND x + c BETWEEN 0 AND 23)"""


def grown_surface(spark, folder):
    """The true surface widened by its face neighbours, which gives it some depth."""
    return dilate(X.truth(spark, folder), X.volumes(spark, folder), cross_spans())


@query("distance_transform", f"{VOX}, {_GROWN}, {nearest_gap_sql('grown')} SELECT volume_id, z, y, x, CAST(d2 AS BIGINT) AS d2 FROM gaps")
def distance(spark, folder):
    return distance_transform(grown_surface(spark, folder), X.volumes(spark, folder))


@query(
    "surface_thickness",
    f"""{VOX}, {_GROWN}, {nearest_gap_sql('grown')}, t AS (SELECT volume_id, 2 * sqrt(d2) AS w FROM gaps),
s AS (SELECT volume_id, quantile_cont(w, 0.5) AS med, avg(w) AS mean, quantile_cont(w, 0.9) AS p90 FROM t GROUP BY 1)
SELECT volume_id, {_r('median_thickness', 'mean_thickness', 'p90_thickness')},
 (SELECT arg_min(c, (abs(c - greatest(32, least(192, round_even(med * 8 / 16, 0) * 16))), c)) FROM UNNEST([32, 48, 64, 96, 128, 160, 192]) u(c)) AS recommended_depth
FROM (SELECT volume_id, med, med AS median_thickness, mean AS mean_thickness, p90 AS p90_thickness FROM s)""",
)
def surface_thickness(spark, folder):
    volumes = X.volumes(spark, folder)
    out = stats.surface_thickness(distance_transform(grown_surface(spark, folder), volumes), volumes)
    return _rounded(out, "median_thickness", "mean_thickness", "p90_thickness")


# Origins 0, 6, 12 of a 12-voxel window with stride 6 on 24 cells.
PATCHES = """o AS (SELECT CAST(UNNEST([0, 6, 12]) AS INT) AS o),
patches AS MATERIALIZED (SELECT volume_id, a.o AS pz, b.o AS py, c.o AS px,
  CAST(count(*) FILTER (label <> 2) AS DOUBLE) / 1728 AS labeled_ratio,
  CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) FILTER (label <> 2) AS foreground_ratio
  FROM o a CROSS JOIN o b CROSS JOIN o c JOIN dense ON z >= a.o AND z < a.o + 12 AND y >= b.o AND y < b.o + 12 AND x >= c.o AND x < c.o + 12 GROUP BY 1, 2, 3, 4)"""
PATCH = PatchSettings(size=(12, 12, 12), stride=(6, 6, 6), min_labeled=0.88, min_foreground=0.1)


@query(
    "imbalance_report",
    f"""{DENSE}, {PATCHES}, p AS (SELECT volume_id, count(*) AS num_patches, avg(CAST(foreground_ratio > 0 AS INT)) AS a,
 avg(CAST(foreground_ratio >= 0.01 AS INT)) AS b, quantile_cont(foreground_ratio, 0.5) AS m FROM patches WHERE labeled_ratio >= 0.88 GROUP BY 1),
v AS (SELECT volume_id, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = 2) AS ign FROM dense GROUP BY 1)
SELECT volume_id, CAST(neg AS DOUBLE) / greatest(pos, 1) AS neg_pos_ratio, CAST(pos AS DOUBLE) / (pos + neg) AS surface_among_labeled,
 CAST(ign AS DOUBLE) / 13824 AS frac_ignore, coalesce(num_patches, 0) AS num_patches, coalesce(a, 0.0::DOUBLE) AS frac_patches_with_surface,
 coalesce(b, 0.0::DOUBLE) AS frac_patches_ge_1pct, round(coalesce(m, 0.0::DOUBLE), 6) AS median_patch_fraction FROM v LEFT JOIN p USING (volume_id)""",
    derive_once=True,
)
def imbalance_report(spark, folder):
    v, volumes = X.voxels(spark, folder), X.volumes(spark, folder)
    settings = PatchSettings(size=(12, 12, 12), stride=(6, 6, 6), min_labeled=0.88)
    return _rounded(stats.imbalance_report(v, volumes, patch_index(v, volumes, settings)), "median_patch_fraction")


_SHIFT = f"""{DENSE}, lv AS MATERIALIZED (SELECT scroll_id, value, label FROM dense WHERE label <> 2),
r AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM lv),
h AS (SELECT scroll_id, least(floor((value - lo) / ((hi - lo) / 64)), 63) AS bin, count(*) AS n FROM lv, r WHERE value BETWEEN lo AND hi GROUP BY 1, 2),
hn AS (SELECT scroll_id, bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY scroll_id) AS f FROM h),
s AS (SELECT scroll_id, avg(value) AS m, stddev_pop(value) AS sd, CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*) AS den FROM lv GROUP BY 1),
shift AS MATERIALIZED (SELECT a.scroll_id AS scroll_a, b.scroll_id AS scroll_b, abs(a.m - b.m) AS mean_diff,
 greatest(a.sd, b.sd) / (least(a.sd, b.sd) + 1e-6::DOUBLE) AS std_ratio,
 (SELECT sum(abs(coalesce(x.f, 0) - coalesce(y.f, 0))) FROM (SELECT bin, f FROM hn WHERE scroll_id = a.scroll_id) x
   FULL JOIN (SELECT bin, f FROM hn WHERE scroll_id = b.scroll_id) y USING (bin)) AS hist_l1,
 a.den AS surface_density_a, b.den AS surface_density_b, abs(a.den - b.den) AS surface_density_diff
 FROM s a JOIN s b ON a.scroll_id < b.scroll_id)"""
_SHIFT_NUMBERS = ("mean_diff", "std_ratio", "hist_l1", "surface_density_a", "surface_density_b", "surface_density_diff")


def _shift(spark, folder):
    return stats.scroll_domain_shift(X.voxels(spark, folder), X.volumes(spark, folder))


@query("scroll_domain_shift", f"{_SHIFT} SELECT scroll_a, scroll_b, {_r(*_SHIFT_NUMBERS)} FROM shift", derive_once=True)
def scroll_domain_shift(spark, folder):
    return _rounded(_shift(spark, folder), *_SHIFT_NUMBERS)


@query(
    "validation_recommendation",
    f"""{_SHIFT} SELECT round(avg(hist_l1), 6) AS mean_hist_l1, round(avg(surface_density_diff), 6) AS mean_density_gap,
CASE WHEN count(*) = 0 THEN 'need two scrolls' WHEN avg(hist_l1) > 0.25 OR avg(surface_density_diff) > 0.05 THEN 'leave one scroll out'
ELSE 'scrolls are similar' END AS verdict FROM shift""",
    derive_once=True,
)
def validation_recommendation(spark, folder):
    return _rounded(stats.validation_recommendation(_shift(spark, folder)), "mean_hist_l1", "mean_density_gap")


_PLANES = f"""{DENSE}, planes AS MATERIALIZED (SELECT volume_id, 'axial' AS plane, y AS r, x AS c, value FROM dense WHERE z = 12
UNION ALL SELECT volume_id, 'coronal', z, x, value FROM dense WHERE y = 12
UNION ALL SELECT volume_id, 'sagittal', z, y, value FROM dense WHERE x = 12)"""


@query("mid_planes", f"{_PLANES} SELECT * FROM planes")
def mid_planes(spark, folder):
    return stats.mid_planes(X.voxels(spark, folder), X.volumes(spark, folder))


@query(
    "stretch_plane",
    f"""{_PLANES}, q AS (SELECT volume_id, plane, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM planes GROUP BY 1, 2)
SELECT volume_id, plane, r, c, CAST(CASE WHEN hi > lo THEN floor(greatest(0, least(255, (value - lo) / (hi - lo) * 255))) ELSE 0 END AS INT) AS level
FROM planes JOIN q USING (volume_id, plane)""",
)
def stretch_plane(spark, folder):
    return stats.stretch_plane(stats.mid_planes(X.voxels(spark, folder), X.volumes(spark, folder)))
