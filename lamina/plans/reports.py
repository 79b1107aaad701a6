"""Report, split and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import gate, report, splits
from lamina.plans import fixtures as X
from lamina.plans.registry import query
from lamina.sources import scores as S

SCORES = f"WITH {X.SCORES_SQL}"
_MEANS = ["score", "topo_score", "surface_dice", "voi_score", "voi_split", "voi_merge"]
_AVG = ", ".join(f"avg({m}) AS {m}" for m in _MEANS)
_BY_SCROLL = f"""{SCORES}, g AS (SELECT condition, coalesce(scroll_id, 'unknown') AS scroll_id, count(*) AS n, {_AVG} FROM scores GROUP BY 1, 2
UNION ALL SELECT condition, 'ALL', count(*), {_AVG} FROM scores GROUP BY 1)"""


def _round(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else c for c, t in df.dtypes])


def _r(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("aggregate_by_scroll", f"{_BY_SCROLL} SELECT condition, scroll_id, n, {_r(_MEANS)} FROM g")
def aggregate_by_scroll(spark, folder):
    return _round(report.aggregate_by_scroll(X.case_scores(spark, folder), ["condition"]))


_FOUR = ["score", "surface_dice", "topo_score", "voi_score"]


@query(
    "compare_conditions",
    f"{SCORES} "
    + " UNION ALL ".join(f"SELECT condition, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM scores GROUP BY 1" for m in _FOUR),
)
def compare_conditions(spark, folder):
    return _round(report.compare_conditions(X.case_scores(spark, folder)))


@query(
    "ablation_table",
    f"""{SCORES}, a AS (SELECT CASE condition WHEN 'control' THEN 'remove_small' ELSE 'patch' END AS stage,
CASE condition WHEN 'control' THEN 2 ELSE 4 END AS position, count(*) AS n, {_AVG} FROM scores GROUP BY 1, 2)
SELECT stage, position, n, {_r(_MEANS)}, round(score - (SELECT score FROM a WHERE position = 2), 6) AS score_delta FROM a""",
)
def ablation_table(spark, folder):
    from lamina.model import STAGES

    stage = F.when(F.col("condition") == "control", "remove_small").otherwise("patch")
    return _round(report.ablation_table(X.case_scores(spark, folder).withColumn("stage", stage), STAGES))


@query(
    "delta_table",
    f"""{_BY_SCROLL} SELECT c.scroll_id, c.n, {', '.join(f'round({e}, 6) AS {n}' for n, e in {
        'control_score': 'c.score', 'accepted_score': 'a.score', 'score_delta': 'a.score - c.score',
        'control_voi_merge': 'c.voi_merge', 'accepted_voi_merge': 'a.voi_merge', 'voi_merge_delta': 'a.voi_merge - c.voi_merge'}.items())}
FROM g c JOIN g a ON c.scroll_id = a.scroll_id AND c.condition = 'control' AND a.condition = 'proposed'""",
)
def delta_table(spark, folder):
    s = X.case_scores(spark, folder)
    one = lambda c: report.aggregate_by_scroll(s.filter(F.col("condition") == c))
    return _round(report.delta_table(one("control"), one("proposed"), "voi_merge"))


_WORST = f"""{SCORES}, common AS (SELECT case_id FROM scores WHERE score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT condition) = 2),
worst AS (SELECT condition, case_id, score, CAST(row_number() OVER (PARTITION BY condition ORDER BY score, case_id) AS INT) AS rank
FROM scores SEMI JOIN common USING (case_id))"""


@query("worst_k", f"{_WORST} SELECT condition, case_id, round(score, 6) AS score, rank FROM worst WHERE rank <= 10")
def worst_k(spark, folder):
    return _round(report.worst_k(X.case_scores(spark, folder), 10))


@query("worst_k_overlap", f"{_WORST} SELECT case_id FROM worst WHERE rank <= 1000 GROUP BY 1 HAVING count(*) = 2")
def worst_k_overlap(spark, folder):
    return report.worst_k_overlap(report.worst_k(X.case_scores(spark, folder), 1000))


@query(
    "mean_score",
    f"""{SCORES} SELECT count(*) AS n_cases, round(avg(score), 6) AS mean_score FROM orders
LEFT JOIN scores ON case_id = CAST(o_orderkey AS VARCHAR) AND condition = 'control' WHERE o_orderkey % 3 <> 0""",
)
def mean_score(spark, folder):
    """Every second and third case is asked for; predictions, labels and scores are tables of their own."""
    scores = X.case_scores(spark, folder)
    ids = X.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("case_id"))
    predictions = scores.filter("condition = 'proposed'").select("case_id")
    labels = X.table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id")).distinct().unionByName(
        ids.select("case_id")).distinct()
    return _round(report.mean_score(ids.filter("o_orderkey % 3 <> 0"), predictions, labels, scores.filter("condition = 'control'")))


# --- splits -----------------------------------------------------------------------------------------
CASES = f"WITH {X.CASES_SQL}"
_EVERY = "SELECT f.fold, case_id, CASE WHEN f.fold = v.val_fold THEN 'val' ELSE 'train' END AS role FROM v CROSS JOIN (SELECT CAST(UNNEST(range({k})) AS INT) AS fold) f"
_KFOLD = f"""{CASES}, r AS (SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '|42'), case_id) - 1 AS i, count(*) OVER () AS n FROM cases),
v AS (SELECT case_id, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS val_fold FROM r)"""
_STRAT = f"""{CASES}, r AS (SELECT case_id, scroll_id, row_number() OVER (PARTITION BY scroll_id ORDER BY md5(case_id || '|42'), case_id) - 1 AS i,
dense_rank() OVER (ORDER BY scroll_id) - 1 AS o FROM cases), v AS (SELECT case_id, scroll_id, (i + o) % 5 AS val_fold FROM r)"""


@query("kfold_split", f"{_KFOLD} {_EVERY.format(k=7)}")
def kfold_split(spark, folder):
    return splits.kfold_split(X.cases(spark, folder), 7)


@query("stratified_group_split", f"{_STRAT} {_EVERY.format(k=5)}")
def stratified_group_split(spark, folder):
    return splits.stratified_group_split(X.cases(spark, folder))


@query("leave_one_group_out", f"{CASES}, v AS (SELECT case_id, dense_rank() OVER (ORDER BY scroll_id) - 1 AS val_fold FROM cases) {_EVERY.format(k=25)}")
def leave_one_group_out(spark, folder):
    return splits.leave_one_group_out(X.cases(spark, folder))


@query("group_holdout", f"{CASES} SELECT 0 AS fold, case_id, CASE WHEN scroll_id IN ('7', '11') THEN 'val' ELSE 'train' END AS role FROM cases")
def group_holdout(spark, folder):
    return splits.group_holdout(X.cases(spark, folder), ["7", 11])


@query(
    "describe_fold",
    f"""{CASES}, f AS (SELECT CASE WHEN scroll_id = '7' THEN 'val' ELSE 'train' END AS role, scroll_id FROM cases)
SELECT scroll_id, count(*) AS n_total, count(*) FILTER (role = 'val') AS n_in_val, count(*) FILTER (role = 'val') = 0 AS missing,
(SELECT count(*) FROM f WHERE role = 'train') AS n_train, (SELECT count(*) FROM f WHERE role = 'val') AS n_val FROM f GROUP BY 1""",
)
def describe_fold(spark, folder):
    c = X.cases(spark, folder)
    return splits.describe_fold(splits.group_holdout(c, ["7"]), c)


# Cells of scrolls that a fold does not hold are reported as 0.
_DIST = f"""{_STRAT}, n AS (SELECT scroll_id, CAST(val_fold AS INT) AS fold, count(*) AS n FROM v GROUP BY CUBE (1, 2)),
grid AS (SELECT DISTINCT scroll_id, f.fold FROM cases CROSS JOIN (SELECT CAST(UNNEST(range(5)) AS INT) AS fold) f),
full_n AS (SELECT scroll_id, fold, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (scroll_id, fold)
UNION ALL SELECT scroll_id, fold, n FROM n WHERE scroll_id IS NULL OR fold IS NULL)"""


@query("fold_distribution", f"{_DIST} SELECT * FROM full_n")
def fold_distribution(spark, folder):
    c = X.cases(spark, folder)
    return splits.fold_distribution(splits.stratified_group_split(c), c)


@query(
    "fold_empty_cells",
    f"""{CASES}, s AS (SELECT DISTINCT scroll_id, dense_rank() OVER (ORDER BY scroll_id) - 1 AS r FROM cases)
SELECT CAST(f.r AS INT) AS fold, s.scroll_id FROM s JOIN s f ON f.r <> s.r""",
)
def fold_empty_cells(spark, folder):
    c = X.cases(spark, folder)
    return splits.empty_cells(splits.fold_distribution(splits.leave_one_group_out(c), c))


@query(
    "check_split",
    f"""{_STRAT} SELECT f.fold, CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_uncovered,
(SELECT count(*) FROM (SELECT scroll_id FROM v GROUP BY 1 HAVING bool_or(val_fold = f.fold) AND bool_or(val_fold <> f.fold))) AS n_leaking_scrolls
FROM (SELECT CAST(UNNEST(range(5)) AS INT) AS fold) f""",
)
def check_split(spark, folder):
    c = X.cases(spark, folder)
    return splits.check_split(splits.stratified_group_split(c), c)


@query("train_val_scrolls", f"{CASES} SELECT DISTINCT scroll_id, CASE WHEN scroll_id IN ('3', '7') THEN 'val' ELSE 'train' END AS role FROM cases")
def train_val_scrolls(spark, folder):
    return splits.train_val_scrolls(X.cases(spark, folder), ["3", "7"])


# --- gate and resume ------------------------------------------------------------------------------------
_GATE = f"""{SCORES}, gate AS MATERIALIZED (SELECT c.case_id AS volume_id, k.o_orderkey % 50 AS n_components, k.o_orderkey % 4 AS n_candidates, k.o_orderkey % 4 AS n_edits,
k.o_orderkey % 4 > 0 AND coalesce(p.score - c.score >= 0, FALSE) AS accepted, CASE WHEN k.o_orderkey % 4 > 0 THEN c.score END AS control_score,
CASE WHEN k.o_orderkey % 4 > 0 THEN p.score END AS proposed_score, CASE WHEN k.o_orderkey % 4 > 0 THEN p.score - c.score END AS score_delta,
CASE WHEN k.o_orderkey % 4 > 0 THEN c.voi_split END AS control_voi_split, CASE WHEN k.o_orderkey % 4 > 0 THEN p.voi_split END AS proposed_voi_split,
CASE WHEN k.o_orderkey % 4 > 0 THEN p.voi_split - c.voi_split END AS voi_split_delta
FROM orders k JOIN scores c ON c.case_id = CAST(k.o_orderkey AS VARCHAR) AND c.condition = 'control' JOIN scores p ON p.case_id = c.case_id AND p.condition = 'proposed')"""


def _verdicts(spark, folder):
    s = X.case_scores(spark, folder).withColumnRenamed("case_id", "volume_id")
    k = X.table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS volume_id", "o_orderkey % 50 AS n_components",
        "o_orderkey % 4 AS n_candidates", "o_orderkey % 4 AS n_edits",
    )
    return gate.metric_gate(k, s.filter("condition = 'control'"), s.filter("condition = 'proposed'"), "voi_split")


_GATE_COLUMNS = ["control_score", "proposed_score", "score_delta", "control_voi_split", "proposed_voi_split", "voi_split_delta"]


@query("metric_gate", f"{_GATE} SELECT volume_id, n_components, n_candidates, n_edits, accepted, {_r(_GATE_COLUMNS)} FROM gate")
def metric_gate(spark, folder):
    return _round(_verdicts(spark, folder))


@query(
    "gate_summary",
    f"""{_GATE} SELECT count(*) AS n_volumes, count(*) FILTER (n_candidates > 0) AS n_with_candidates, count(*) FILTER (accepted) AS n_accepted,
round(avg(score_delta), 6) AS mean_score_delta, round(avg(voi_split_delta), 6) AS mean_voi_split_delta FROM gate""",
)
def gate_summary(spark, folder):
    return _round(gate.gate_summary(_verdicts(spark, folder), "voi_split"))


@query(
    "load_scores_latest",
    """SELECT CAST(o_custkey AS VARCHAR) AS case_id, arg_max(o_totalprice, o_orderkey) AS score, arg_max(o_orderpriority, o_orderkey) AS scroll_id FROM orders GROUP BY 1""",
)
def load_scores_latest(spark, folder):
    rows = X.table(spark, folder, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS case_id", "o_totalprice AS score", "o_orderpriority AS scroll_id", "o_orderkey AS place"
    )
    return S.latest(rows, "place")


@query(
    "score_pairs",
    """SELECT CAST(c_custkey AS VARCHAR) AS volume_id, CASE WHEN c_custkey % 7 = 0 THEN 'done' WHEN c_custkey % 17 = 0 THEN 'missing_prediction'
WHEN c_custkey % 19 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'shape_mismatch' ELSE 'score' END AS status FROM customer WHERE c_custkey % 11 <> 0""",
)
def score_pairs(spark, folder):
    c = X.table(spark, folder, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("volume_id"))
    dims = lambda df, d: df.select("volume_id", d.alias("d"), F.lit(24).alias("h"), F.lit(24).alias("w"))
    predictions = dims(c.filter("c_custkey % 17 <> 0"), F.when(F.col("c_custkey") % 5 == 0, 23).otherwise(24))
    labels = dims(c.filter("c_custkey % 19 <> 0"), F.lit(24))
    return S.score_pairs(predictions, labels, c.filter("c_custkey % 7 = 0"), c.filter("c_custkey % 11 <> 0"))
