"""Volumes, masks, cases and scores derived from the shared parquet tables.

Every 12 suppliers make one 24 x 24 x 24 volume, so the number of volumes grows with the
data while the density of each stays the same. The SQL texts are the same
derivations for the comparison engine.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import settle

SIDE = 24
SUPPLIERS = 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _volume_key(supplier: str) -> Column:
    return F.col(supplier) - F.col(supplier) % SUPPLIERS


_written: dict[str, DataFrame] | None = None


@contextmanager
def deriving_once():
    """Within the block the voxel table of a folder is written once and then read."""
    global _written
    _written = {}
    try:
        yield
    finally:
        _written = None


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """``volume_id, z, y, x, intensity, label, prob, tax``"""
    if _written is None:
        return _derive(spark, folder)
    if folder not in _written:
        _written[folder] = settle(_derive(spark, folder))
    return _written[folder]


def _derive(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    key = [
        F.concat(F.lit("v"), _volume_key("l_suppkey").cast("string")).alias("volume_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % SIDE).cast("int").alias("z"),
        ((F.col("l_partkey") * 5) % SIDE).cast("int").alias("y"),
        (F.col("l_quantity").cast("long") % SIDE).cast("int").alias("x"),
    ]
    flag = F.col("l_returnflag")
    return line.groupBy(*key).agg(
        F.max("l_extendedprice").alias("intensity"),
        F.min(F.when(flag == "A", 1).when(flag == "R", 2).otherwise(0)).alias("label"),
        (F.max("l_discount") * 10).alias("prob"),
        (F.max("l_tax") * 12.5).alias("tax"),
    )


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """``volume_id, scroll_id, d, h, w, dtype, image_bytes, label_bytes``"""
    keys = table(spark, folder, "supplier").select(_volume_key("s_suppkey").alias("k")).distinct()
    cells = F.lit(SIDE**3).cast("long")
    return keys.select(
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("volume_id"),
        F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("scroll_id"),
        F.lit(SIDE).alias("d"),
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        F.lit("uint8").alias("dtype"),
        cells.alias("image_bytes"),
        cells.alias("label_bytes"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).filter("label = 1").select("volume_id", "z", "y", "x")


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).filter("prob >= 0.5").select("volume_id", "z", "y", "x")


def model_probs(spark: SparkSession, folder: str) -> DataFrame:
    """Two models' class probabilities; model b has not seen volume v0."""
    v = voxels(spark, folder)
    pair = lambda p: F.array(1 - F.col(p), F.col(p)).alias("p")
    a = v.select("volume_id", F.lit("a").alias("model"), "z", "y", "x", pair("prob"))
    b = v.filter("volume_id != 'v0'").select("volume_id", F.lit("b").alias("model"), "z", "y", "x", pair("tax"))
    return a.unionByName(b)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.col("c_nationkey").cast("string").alias("scroll_id")
    )


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Metadata plus the file listings of every folder, as id tables."""
    customer = table(spark, folder, "customer")
    k = F.col("c_custkey")

    def ids(rule: str, orphans: int | None = None) -> DataFrame:
        kept = customer.filter(rule).select(k.cast("string").alias("id"))
        if orphans is None:
            return kept
        extra = customer.filter(k % orphans == 0).select((k + 1000000).cast("string").alias("id"))
        return kept.unionByName(extra)

    return {
        "metadata": customer.select(k.cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("scroll_id")),
        "images": ids("c_custkey % 17 <> 0", 50),
        "labels": ids("c_custkey % 19 <> 0", 75),
        "deprecated_images": ids("c_custkey % 34 = 0"),
        "deprecated_labels": ids("c_custkey % 38 = 0"),
        "test_images": ids("c_custkey % 51 = 0"),
    }


def case_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two conditions, ``control`` and ``proposed``, of the same cases."""
    o = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    part = lambda e, n: (F.expr(e) % n).cast("double") / n
    percent = lambda e: (F.expr(e) % 101).cast("double") / 100

    def condition(name: str, topo: str, dice: str, voi: str, split: int, merge: int) -> DataFrame:
        scored = o.select(
            F.lit(name).alias("condition"),
            F.col("o_orderkey").cast("string").alias("case_id"),
            F.when(F.col("o_orderkey") % 23 != 0, F.col("c_nationkey").cast("string")).alias("scroll_id"),
            percent(topo).alias("topo_score"),
            percent(dice).alias("surface_dice"),
            F.when(F.col("o_orderstatus") != "P", percent(voi)).alias("voi_score"),
            part("o_orderkey", split).alias("voi_split"),
            part("o_orderkey", merge).alias("voi_merge"),
        )
        total = 0.30 * F.col("topo_score") + 0.35 * F.col("surface_dice") + 0.35 * F.col("voi_score")
        return scored.withColumn("score", total)

    return condition("control", "o_orderkey", "o_custkey", "o_orderkey * 3", 7, 5).unionByName(
        condition("proposed", "o_orderkey * 37", "o_custkey * 41", "o_orderkey * 5", 11, 13)
    )


VOX_SQL = """vox AS MATERIALIZED (
  SELECT 'v' || CAST(l_suppkey - l_suppkey % 12 AS VARCHAR) AS volume_id,
         CAST((l_orderkey * 7 + l_linenumber) % 24 AS INT) AS z,
         CAST((l_partkey * 5) % 24 AS INT) AS y,
         CAST(CAST(l_quantity AS BIGINT) % 24 AS INT) AS x,
         MAX(l_extendedprice) AS intensity,
         MIN(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END) AS label,
         MAX(l_discount) * 10 AS prob,
         MAX(l_tax) * CAST(12.5 AS DOUBLE) AS tax
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

VOLUMES_SQL = """volumes AS MATERIALIZED (
  SELECT DISTINCT 'v' || CAST(s_suppkey - s_suppkey % 12 AS VARCHAR) AS volume_id,
         's' || CAST((s_suppkey - s_suppkey % 12) % 5 AS VARCHAR) AS scroll_id,
         24 AS d, 24 AS h, 24 AS w, 'uint8' AS dtype,
         CAST(13824 AS BIGINT) AS image_bytes, CAST(13824 AS BIGINT) AS label_bytes
  FROM supplier)"""

CASES_SQL = """cases AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS case_id, CAST(c_nationkey AS VARCHAR) AS scroll_id FROM customer)"""

CATALOG_SQL = """metadata AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS scroll_id FROM customer),
images AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 17 <> 0
  UNION ALL SELECT CAST(c_custkey + 1000000 AS VARCHAR) FROM customer WHERE c_custkey % 50 = 0),
label_files AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 19 <> 0
  UNION ALL SELECT CAST(c_custkey + 1000000 AS VARCHAR) FROM customer WHERE c_custkey % 75 = 0),
deprecated_images AS MATERIALIZED (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 34 = 0),
deprecated_labels AS MATERIALIZED (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 38 = 0),
test_images AS MATERIALIZED (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 51 = 0)"""

_CONDITION = """SELECT '{name}' AS condition, CAST(o_orderkey AS VARCHAR) AS case_id,
         CASE WHEN o_orderkey % 23 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS scroll_id,
         CAST(({topo}) % 101 AS DOUBLE) / 100 AS topo_score,
         CAST(({dice}) % 101 AS DOUBLE) / 100 AS surface_dice,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(({voi}) % 101 AS DOUBLE) / 100 END AS voi_score,
         CAST(o_orderkey % {split} AS DOUBLE) / {split} AS voi_split,
         CAST(o_orderkey % {merge} AS DOUBLE) / {merge} AS voi_merge
  FROM orders JOIN customer ON o_custkey = c_custkey"""

SCORES_SQL = (
    "scores AS MATERIALIZED (SELECT *, CAST(0.30 AS DOUBLE) * topo_score + CAST(0.35 AS DOUBLE) * surface_dice"
    " + CAST(0.35 AS DOUBLE) * voi_score AS score FROM (\n  "
    + _CONDITION.format(name="control", topo="o_orderkey", dice="o_custkey", voi="o_orderkey * 3", split=7, merge=5)
    + "\n  UNION ALL\n  "
    + _CONDITION.format(name="proposed", topo="o_orderkey * 37", dice="o_custkey * 41", voi="o_orderkey * 5", split=11, merge=13)
    + "))"
)


def component_sql(name: str, source: str, connectivity: int, width: int = SIDE) -> str:
    """CTEs that label ``source(volume_id, z, y, x)`` on the 24-voxel grid as ``name(.., id, lab)``."""
    reach = {6: " AND abs(a.z-b.z)+abs(a.y-b.y)+abs(a.x-b.x) = 1",
             18: " AND abs(a.z-b.z)+abs(a.y-b.y)+abs(a.x-b.x) <= 2", 26: ""}[connectivity]
    return f"""{name}_f AS MATERIALIZED (SELECT volume_id, z, y, x, (z*24+y)*{width}+x AS id FROM {source}),
{name}_e AS MATERIALIZED (SELECT a.volume_id, a.id AS s, b.id AS t FROM {name}_f a JOIN {name}_f b
   ON a.volume_id = b.volume_id AND b.z BETWEEN a.z-1 AND a.z+1
  AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1{reach}),
{name}(volume_id, id, lab) USING KEY (volume_id, id) AS (
  SELECT volume_id, id, id FROM {name}_f
  UNION
  SELECT e.volume_id, e.t, MIN(c.lab) FROM {name} c
  JOIN {name}_e e ON c.volume_id = e.volume_id AND c.id = e.s
  JOIN recurring.{name} rc ON rc.volume_id = e.volume_id AND rc.id = e.t
  WHERE c.lab < rc.lab GROUP BY 1, 2)"""


# Two volumes side by side: 48 voxels wide, so that runs, words and tiles end inside.
WIDTH = 2 * SIDE
WIDE_SQL = f"""wide_volumes AS MATERIALIZED (SELECT DISTINCT 'w' || CAST(CAST(substr(volume_id, 2) AS INT) // 24 * 24 AS VARCHAR) AS volume_id, 24 AS d, 24 AS h, {WIDTH} AS w FROM volumes)"""


def wide_sql(name: str, source: str) -> str:
    """``source`` voxels in the coordinates of the wide volumes."""
    number = "CAST(substr(volume_id, 2) AS INT)"
    return f"""{name} AS MATERIALIZED (SELECT 'w' || CAST({number} // 24 * 24 AS VARCHAR) AS volume_id, z, y, x + {number} % 24 // 12 * 24 AS x FROM {source})"""


def wide(mask: DataFrame) -> DataFrame:
    number = F.substring("volume_id", 2, 20).cast("int")
    return mask.select(
        F.concat(F.lit("w"), (number - number % 24).cast("string")).alias("volume_id"), "z", "y",
        (F.col("x") + F.when(number % 24 == 12, SIDE).otherwise(0)).cast("int").alias("x"))


def wide_volumes(spark: SparkSession, folder: str) -> DataFrame:
    keys = wide(volumes(spark, folder).select("volume_id", *[F.lit(0).alias(c) for c in ("z", "y", "x")])).select("volume_id").distinct()
    return keys.select("volume_id", F.lit(SIDE).alias("d"), F.lit(SIDE).alias("h"), F.lit(WIDTH).alias("w"))
