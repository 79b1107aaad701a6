"""Score reports by scroll, stage and condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = [
    "score", "topo_score", "surface_dice", "voi_score", "voi_split", "voi_merge",
    "topo_f1_dim0", "topo_f1_dim1", "topo_f1_dim2",
]
EVERYTHING = "ALL"


def _present(scores: DataFrame) -> list[str]:
    return [m for m in METRICS if m in scores.columns]


def aggregate_by_scroll(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Case count and null-skipping means per scroll plus an ``ALL`` row, per ``by`` group."""
    known = scores.withColumn("scroll_id", F.coalesce(F.nullif("scroll_id", F.lit("")), F.lit("unknown")))
    levels = [[*by, "scroll_id"], list(by)]
    means = [F.avg(m).alias(m) for m in _present(scores)]
    grouped = known.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in levels[0]])
    out = grouped.agg(F.grouping("scroll_id").alias("__all"), F.count(F.lit(1)).alias("n"), *means)
    # An empty table has no overall row either.
    return out.filter("n > 0").select(
        *by, F.when(F.col("__all") == 1, EVERYTHING).otherwise(F.col("scroll_id")).alias("scroll_id"), "n",
        *_present(scores),
    )


def compare_conditions(scores: DataFrame, metrics: Sequence[str] = ("score", "surface_dice", "topo_score", "voi_score")) -> DataFrame:
    """Mean and population deviation of each metric, one row per condition and metric."""
    pairs = [p for m in metrics for p in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    wide = scores.groupBy("condition").agg(*pairs)
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in metrics]
    )
    return wide.select("condition", F.inline(rows))


def ablation_table(scores: DataFrame, stages: Sequence[str], by: str = "stage") -> DataFrame:
    """Overall means per stage and the score change against the first stage present."""
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(by)).cast("int")
    means = (
        scores.filter(F.col(by).isin(*stages)).groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in _present(scores)])
        .withColumn("position", order)
    )
    # One row per stage.
    first = F.first("score").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return means.withColumn("score_delta", F.col("score") - first)


def delta_table(control: DataFrame, accepted: DataFrame, metric: str) -> DataFrame:
    """Control against accepted means per scroll both have; ``metric`` is voi_merge or voi_split."""
    side = lambda df, s: df.select("scroll_id", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "score", metric)])
    both = side(control, "control").join(side(accepted, "accepted").drop("accepted_n"), "scroll_id")
    return both.withColumnRenamed("control_n", "n").select(
        "scroll_id",
        "n",
        "control_score",
        "accepted_score",
        (F.col("accepted_score") - F.col("control_score")).alias("score_delta"),
        f"control_{metric}",
        f"accepted_{metric}",
        (F.col(f"accepted_{metric}") - F.col(f"control_{metric}")).alias(f"{metric}_delta"),
    )


def worst_k(scores: DataFrame, k: int) -> DataFrame:
    """The k lowest scores per condition over the cases every condition has; ids break ties."""
    n = scores.agg(F.count_distinct("condition").alias("n_conditions"))
    common = (
        scores.filter("score IS NOT NULL").groupBy("case_id").agg(F.count_distinct("condition").alias("c"))
        .join(n, F.col("c") == F.col("n_conditions")).select("case_id")
    )
    rank = F.row_number().over(W.partitionBy("condition").orderBy("score", "case_id"))
    return (
        scores.join(common, "case_id", "left_semi")
        .select("condition", "case_id", "score", rank.alias("rank"))
        .filter(F.col("rank") <= k)
    )


def worst_k_overlap(worst: DataFrame) -> DataFrame:
    """Cases on the list of every condition."""
    n = worst.agg(F.count_distinct("condition").alias("n_conditions"))
    return (
        worst.groupBy("case_id").agg(F.count_distinct("condition").alias("c"))
        .join(n, F.col("c") == F.col("n_conditions")).select("case_id")
    )


def mean_score(cases: DataFrame, predictions: DataFrame, labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score over ``cases``; a case without prediction or label is an error."""
    checked = (
        cases.select("case_id")
        .join(predictions.select("case_id", F.lit(True).alias("has_prediction")), "case_id", "left")
        .join(labels.select("case_id", F.lit(True).alias("has_label")), "case_id", "left")
        .withColumn(
            "problem",
            F.when(F.col("has_prediction").isNull(), F.concat(F.lit("missing prediction for "), "case_id"))
            .when(F.col("has_label").isNull(), F.concat(F.lit("missing label for "), "case_id")),
        )
    )
    # The check is part of the aggregated value, so it cannot be optimised away.
    value = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("double")).otherwise(F.col("score"))
    return checked.join(scores.select("case_id", "score"), "case_id", "left").agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg(value).alias("mean_score")
    )
