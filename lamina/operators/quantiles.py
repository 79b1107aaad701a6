"""Exact quantiles of weighted values without sorting a whole group in one task.

Values are counted per group in equal-width histograms. The bucket that holds a wanted rank is known from the counts
alone, so only its values are counted again, in a finer histogram between its least and greatest value, until a bucket
holds few distinct values; the rank is then found among these. Groups of any size and shape take a few passes, each
with a map-side combined aggregate; ties and skew only change the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import settle

#: Buckets of a histogram, and distinct values that are ranked in one window.
BUCKETS = 4096
FEW = 10_000


def quantiles(
    values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], value: str = "value", weight: str = "n"
) -> DataFrame:
    """``(keys, q)``: linearly interpolated quantiles of every group, in the order of ``probabilities``.

    ``values`` holds finite numbers with whole weights; rows may repeat. Groups without weight have no row, and with
    no ``keys`` all rows are one group.
    """
    keys = list(keys)
    group = [*keys, "__all"]
    counted = settle(
        values.select(*keys, F.lit(0).alias("__all"), F.col(value).cast("double").alias("v"), F.col(weight).cast("long").alias("n"))
        .filter("n > 0").groupBy(*group, "v").agg(F.sum("n").alias("n"))
    )
    spans = counted.groupBy(*group).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Each probability lies between two ranks; both are looked up.
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), (F.ceil(x) if end else F.floor(x)).cast("long").alias("rank"),
                 (x - F.floor(x)).alias("part"))
        for i, x in enumerate(at) for end in (0, 1)
    ])
    asked = spans.select(*group, F.inline(wanted), "kinds", "lo", "hi")
    asked = asked.withColumn("skip", F.lit(0).cast("long"))
    while True:
        asked = settle(asked)
        if asked.filter((F.col("kinds") > FEW) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        asked = _narrowed(counted, asked, group)
    # Few distinct values are left around each rank.
    rows = _within(counted, asked.select(*group, "lo", "hi").distinct(), group)
    order = W.partitionBy(*group, "lo", "hi").orderBy("v")
    ranked = rows.withColumn("until", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = (
        asked.join(ranked, [*group, "lo", "hi"])
        .filter((F.col("rank") - F.col("skip") < F.col("until")) & (F.col("rank") - F.col("skip") >= F.col("until") - F.col("n")))
        .groupBy(*group, "i").agg(
            F.max(F.when(F.col("end") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("v"))).alias("b"),
            F.max("part").alias("part"))
        .select(*group, "i", (F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("q"))
    )
    return found.groupBy(*group).agg(
        F.array(*[F.max(F.when(F.col("i") == i, F.col("q"))) for i in range(len(probabilities))]).alias("q")
    ).drop("__all")


def _within(counted: DataFrame, spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counted values of each group's ``lo .. hi`` spans."""
    return counted.join(spans, list(group)).filter("v >= lo AND v <= hi")


def _narrowed(counted: DataFrame, asked: DataFrame, group: Sequence[str]) -> DataFrame:
    """``asked`` with the bucket that holds the rank as its new span."""
    spans = asked.select(*group, "lo", "hi").distinct()
    # Halves keep the difference of far ends finite; the last bucket is closed on the right.
    share = (F.col("v") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
    bucket = F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")
    counts = (
        _within(counted, spans, group).groupBy(*group, "lo", "hi", bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds2"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
    )
    # At most BUCKETS rows each.
    order = W.partitionBy(*group, "lo", "hi").orderBy("bucket")
    summed = counts.withColumn("until", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (
        asked.join(summed, [*group, "lo", "hi"])
        .filter((F.col("rank") - F.col("skip") < F.col("until")) & (F.col("rank") - F.col("skip") >= F.col("until") - F.col("n")))
        .select(*group, "i", "end", "rank", "part", F.col("kinds2").alias("kinds"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                (F.col("skip") + F.col("until") - F.col("n")).alias("skip"))
    )
