"""Train / validation splits as ``folds(fold, case_id, role)`` and checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _shuffle_key(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _ranked(cases: DataFrame, key: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Zero-based rank by hash key inside each group, as ``i``.

    Ranks inside hash-prefix buckets and adds the count of the earlier buckets, so no
    task sorts a whole group.
    """
    rows = cases.withColumn("key", key).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    before = rows.groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("c")).select(
        *groups,
        "bucket",
        F.coalesce(
            F.sum("c").over(W.partitionBy(*groups).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    inside = F.row_number().over(W.partitionBy(*groups, "bucket").orderBy("key", "case_id")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(before, [*groups, "bucket"])
        .withColumn("i", F.col("before") + F.col("inside"))
        .drop("key", "bucket", "before", "inside")
    )


def _roles(val: DataFrame, folds: Column) -> DataFrame:
    """Every fold's full case list, from each case's validation fold ``val_fold``."""
    return val.withColumn("fold", F.explode(folds)).select(
        "fold", "case_id", F.when(F.col("fold") == F.col("val_fold"), "val").otherwise("train").alias("role")
    )


def kfold_split(cases: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled blocks of ``n // k`` cases, the first ``n % k`` folds one larger."""
    total = cases.agg(F.count(F.lit(1)).alias("n"))
    ranked = _ranked(cases.select("case_id"), _shuffle_key(seed, "case_id")).join(total, F.lit(True))
    small, extra = F.expr(f"n div {k}"), F.col("n") % k
    cut = extra * (small + 1)
    fold = F.when(F.col("i") < cut, F.floor(F.col("i") / (small + 1))).otherwise(
        extra + F.floor((F.col("i") - cut) / F.greatest(small, F.lit(1)))
    )
    return _roles(ranked.select("case_id", fold.cast("int").alias("val_fold")), F.sequence(F.lit(0), F.lit(k - 1)))


def _scroll_ranks(cases: DataFrame) -> DataFrame:
    """``scroll_id, scroll_rank``; there are few scrolls."""
    rank = F.row_number().over(W.orderBy("scroll_id")) - 1
    return cases.select("scroll_id").distinct().select("scroll_id", rank.alias("scroll_rank"))


def _known_scroll(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.coalesce("scroll_id", F.lit("unknown")).alias("scroll_id"))


def stratified_group_split(cases: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Deal each scroll's shuffled cases round-robin, starting at the scroll's rank."""
    cases = _known_scroll(cases)
    ranked = _ranked(cases, _shuffle_key(seed, "case_id"), ["scroll_id"]).join(_scroll_ranks(cases), "scroll_id")
    fold = ((F.col("i") + F.col("scroll_rank")) % k).cast("int")
    return _roles(ranked.select("case_id", fold.alias("val_fold")), F.sequence(F.lit(0), F.lit(k - 1)))


def leave_one_group_out(cases: DataFrame) -> DataFrame:
    """One fold per scroll, in scroll order."""
    cases = _known_scroll(cases)
    ranks = _scroll_ranks(cases)
    last = ranks.agg(F.max("scroll_rank").alias("last"))
    val = cases.join(ranks, "scroll_id").join(last, F.lit(True))
    val = val.select("case_id", F.col("scroll_rank").cast("int").alias("val_fold"), "last")
    return _roles(val, F.sequence(F.lit(0), F.col("last").cast("int")))


def group_holdout(cases: DataFrame, val_scrolls: Sequence[str]) -> DataFrame:
    """One fold whose validation cases are the named scrolls'; unknown names and empty sides are errors."""
    wanted = sorted({str(s) for s in val_scrolls})
    cases = _known_scroll(cases)
    counts = cases.agg(
        *[F.count_if(F.col("scroll_id") == s).alias(f"n{i}") for i, s in enumerate(wanted)],
        F.count_if(~F.col("scroll_id").isin(*wanted)).alias("rest"),
    ).first()
    missing = [s for i, s in enumerate(wanted) if counts[f"n{i}"] == 0]
    if missing or not wanted:
        raise ValueError(f"no cases of scroll {missing}")
    if counts["rest"] == 0:
        raise ValueError("the training side is empty")
    role = F.when(F.col("scroll_id").isin(*wanted), "val").otherwise("train")
    return cases.select(F.lit(0).alias("fold"), "case_id", role.alias("role"))


def write_splits(folds: DataFrame, path: str) -> None:
    """Fold list JSON, one line per fold in fold order.

    A fold's case list is one value of that format, so it must fit a task.
    """
    side = lambda r: F.sort_array(F.collect_list(F.when(F.col("role") == r, F.col("case_id")))).alias(r)
    folds.groupBy("fold").agg(side("train"), side("val")).orderBy("fold").write.mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Fold list JSON, one array of folds or one fold per line, to rows; ``source`` names the file.

    Folds without a ``fold`` number take their list position.
    """
    text = spark.read.text(path, wholetext=True)
    # Either form parses as an array of folds once line breaks between folds become commas.
    body = F.trim(F.regexp_replace(F.trim("value"), r"\}\s*\n\s*\{", "},{"))
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    folds = text.filter(F.length(F.trim("value")) > 0).select(
        F.posexplode(F.from_json(listed, "ARRAY<STRUCT<fold: INT, train: ARRAY<STRING>, val: ARRAY<STRING>>>"))
    )
    numbered = folds.select(F.coalesce("col.fold", "pos").alias("fold"), "col.train", "col.val")
    sides = [
        numbered.select("fold", F.explode(side).alias("case_id"), F.lit(side).alias("role")) for side in ("train", "val")
    ]
    return sides[0].unionByName(sides[1]).withColumn("source", F.lit(f"file:{path}"))


def resolve_splits(spark: SparkSession, path: str | None, cases: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of the split file if it can be read, else a reconstruction, with ``source``."""
    if path is not None:
        try:
            return read_splits(spark, path)
        except Exception as error:  # noqa: BLE001 - only a missing file falls back
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return kfold_split(cases, k, seed).withColumn("source", F.lit("reconstructed"))


def describe_fold(folds: DataFrame, cases: DataFrame, fold: int = 0) -> DataFrame:
    """Per scroll: cases overall and in validation, whether it is missing there, and the fold's sizes."""
    one = folds.filter(F.col("fold") == fold).join(cases, "case_id", "left").select(
        "role", F.coalesce("scroll_id", F.lit("unknown")).alias("scroll_id")
    )
    is_val = F.col("role") == "val"
    sizes = one.agg(F.count_if(~is_val).alias("n_train"), F.count_if(is_val).alias("n_val"))
    return (
        one.groupBy("scroll_id")
        .agg(F.count(F.lit(1)).alias("n_total"), F.count_if(is_val).alias("n_in_val"))
        .withColumn("missing", F.col("n_in_val") == 0)
        .join(sizes, F.lit(True))
    )


def fold_distribution(folds: DataFrame, cases: DataFrame) -> DataFrame:
    """Validation cases per scroll and fold with totals (null keys) and empty cells as 0."""
    val = folds.filter("role = 'val'").join(_known_scroll(cases), "case_id")
    counts = val.cube("scroll_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    names = cases.select(F.coalesce("scroll_id", F.lit("unknown")).alias("scroll_id")).distinct()
    # Scrolls times folds is the size of the report itself.
    grid = names.join(folds.select("fold").distinct(), F.lit(True)).withColumn("level", F.lit(0).cast("long"))
    cells = grid.join(counts, ["scroll_id", "fold", "level"], "left").na.fill(0, ["n"])
    totals = counts.filter("level > 0").select("scroll_id", "fold", "level", "n")
    return cells.unionByName(totals).drop("level")


def empty_cells(distribution: DataFrame) -> DataFrame:
    return distribution.filter("n = 0").select("fold", "scroll_id")


def check_split(folds: DataFrame, cases: DataFrame) -> DataFrame:
    """Per fold: cases on both sides, cases missing from it, and scrolls on both sides."""
    sides = folds.groupBy("fold", "case_id").agg(
        F.bool_or(F.col("role") == "train").alias("t"), F.bool_or(F.col("role") == "val").alias("v")
    )
    total = cases.agg(F.count_distinct("case_id").alias("n_cases"))
    covered = sides.join(cases.select("case_id"), "case_id", "left_semi")
    per_fold = (
        covered.groupBy("fold").agg(F.count(F.lit(1)).alias("covered"), F.count_if(F.col("t") & F.col("v")).alias("n_overlap"))
        .join(total, F.lit(True))
        .select("fold", "n_overlap", (F.col("n_cases") - F.col("covered")).alias("n_uncovered"))
    )
    leaks = (
        sides.join(_known_scroll(cases), "case_id").groupBy("fold", "scroll_id")
        .agg(F.bool_or("t").alias("t"), F.bool_or("v").alias("v"))
        .groupBy("fold").agg(F.count_if(F.col("t") & F.col("v")).alias("n_leaking_scrolls"))
    )
    return per_fold.join(leaks, "fold")


def train_val_scrolls(
    cases: DataFrame, val_scrolls: Sequence[str], train_scrolls: Sequence[str] | None = None
) -> DataFrame:
    """Role per scroll; without a training list every other scroll trains."""
    names = cases.select("scroll_id").distinct()
    val = [str(s) for s in val_scrolls]
    train = ~F.col("scroll_id").isin(*val) if train_scrolls is None else F.col("scroll_id").isin(*map(str, train_scrolls))
    sides = [names.filter(train).withColumn("role", F.lit("train")), names.filter(F.col("scroll_id").isin(*val)).withColumn("role", F.lit("val"))]
    return sides[0].unionByName(sides[1])
