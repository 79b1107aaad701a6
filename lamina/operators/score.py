"""Scoring predictions against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.stencils import ball_spans
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.session import settle

KEY = ["volume_id"]
SIDED = ["volume_id", "side"]


def apply_ignore(mask: DataFrame, ignore: DataFrame) -> DataFrame:
    """Mask voxels outside the region the ground truth leaves unlabelled; whole words are subtracted."""
    return P.unpack(P.minus(P.pack(mask), P.pack(ignore)))


def both_sides(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Prediction (side 0) and ground truth (side 1) as one table, so that every step runs once."""
    side = lambda df, i: df.select(*M.VOXEL, F.lit(i).alias("side"))
    return side(pred, 0).unionByName(side(truth, 1))


def surface_dice(
    pred: DataFrame, truth: DataFrame, volumes: DataFrame, tolerance: float = M.SURFACE_TOLERANCE
) -> DataFrame:
    """Share of surface voxels of either side within ``tolerance`` of the other side's surface."""
    return sided_surface_dice(both_sides(pred, truth), volumes, tolerance)


def sided_surface_dice(masks: DataFrame, volumes: DataFrame, tolerance: float = M.SURFACE_TOLERANCE) -> DataFrame:
    """:func:`surface_dice` of ``(volume_id, side, z, y, x)`` rows.

    A voxel is within tolerance iff it lies in the other surface dilated by the ball,
    so no distance is ever computed; matches are counted bit by bit.
    """
    return dice_of_words(P.pack(masks, SIDED), volumes, tolerance)


def dice_of_words(words: DataFrame, volumes: DataFrame, tolerance: float = M.SURFACE_TOLERANCE) -> DataFrame:
    """:func:`sided_surface_dice` of packed words."""
    surface = P.surface_words(words, SIDED)
    near = P.dilate_words(surface, ball_spans(tolerance), volumes, SIDED)
    tagged = surface.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
    none = F.lit(0).cast("long")
    pick = lambda kind, side: F.bit_or(
        F.when((F.col("kind") == kind) & (F.col("side") == side), F.col("bits")).otherwise(none)
    )
    merged = tagged.groupBy(*KEY, *P.WORD_KEYS).agg(
        pick(0, 0).alias("p"), pick(0, 1).alias("t"), pick(1, 0).alias("near_p"), pick(1, 1).alias("near_t")
    )
    total = lambda bits: F.sum(F.bit_count(F.expr(bits)).cast("long"))
    found = merged.groupBy(*KEY).agg(
        total("p").alias("n_pred"),
        total("t").alias("n_truth"),
        total("p & near_t").alias("pred_matched"),
        total("t & near_p").alias("truth_matched"),
    )
    counts = ["n_pred", "n_truth", "pred_matched", "truth_matched"]
    out = volumes.select(*KEY).join(found, KEY, "left").na.fill(0, counts)
    size = F.col("n_pred") + F.col("n_truth")
    return out.select(
        *KEY,
        *counts,
        F.when(size == 0, 1.0)
        .when((F.col("n_pred") == 0) | (F.col("n_truth") == 0), 0.0)
        .otherwise((F.col("pred_matched") + F.col("truth_matched")) / F.nullif(size, F.lit(0)))
        .cast("double")
        .alias("surface_dice"),
    )


def _plogp(n: Column) -> Column:
    return F.sum(n * F.log2(n.cast("double")))


def voi(pred_runs: DataFrame, truth_runs: DataFrame, volumes: DataFrame, alpha: float = M.VOI_ALPHA) -> DataFrame:
    """Variation of information between two component labelings (``node`` runs).

    Uses split = H(both) - H(pred) and merge = H(both) - H(truth), so three grouped
    sums of ``n log n`` suffice. Voxels only one side has keep the label 0 on the other.
    """
    pair = _contingency(pred_runs, truth_runs)
    joint = pair.groupBy(*KEY).agg(F.sum("n").alias("n_foreground"), _plogp(F.col("n")).alias("h_both"))
    for side in ("p", "t"):
        marginal = pair.groupBy(*KEY, side).agg(F.sum("n").alias("m"))
        entropy = marginal.groupBy(*KEY).agg(
            _plogp(F.col("m")).alias(f"h_{side}"), F.max(F.col(side) >= 0).alias(f"has_{side}")
        )
        joint = joint.join(entropy, KEY)
    n = F.col("n_foreground")
    # Rounding errors may leave a tiny negative value.
    split = F.greatest((F.col("h_p") - F.col("h_both")) / n, F.lit(0.0))
    merge = F.greatest((F.col("h_t") - F.col("h_both")) / n, F.lit(0.0))
    score = F.when(F.col("has_p") & F.col("has_t"), 1 / (1 + alpha * (split + merge))).otherwise(0.0)
    scored = joint.select(
        *KEY, "n_foreground", split.alias("voi_split"), merge.alias("voi_merge"), score.alias("voi_score")
    )
    return (
        volumes.select(*KEY)
        .join(scored, KEY, "left")
        .na.fill({"n_foreground": 0, "voi_split": 0.0, "voi_merge": 0.0, "voi_score": 1.0})
    )


def _contingency(pred_runs: DataFrame, truth_runs: DataFrame) -> DataFrame:
    """``(volume_id, p, t, n)``; label -1 stands for absent.

    Intervals of both sides meet by word and count their overlap; what is left of a label's length is absent on the
    other side. No voxel becomes a row, and a line's intervals meet only within 32 voxels.
    """
    def pieces(runs: DataFrame, label: str, lo: str, hi: str) -> DataFrame:
        word = F.explode(F.expr("sequence(x0 div 32, x1 div 32)")).alias("xb")
        return runs.select(*KEY, "z", "y", "x0", "x1", F.col("node").alias(label), word).select(
            *KEY, "z", "y", "xb", label, F.greatest("x0", F.col("xb") * 32).alias(lo), F.least("x1", F.col("xb") * 32 + 31).alias(hi))

    length = F.least("p1", "t1") - F.greatest("p0", "t0") + 1
    met = (
        pieces(pred_runs, "p", "p0", "p1").join(pieces(truth_runs, "t", "t0", "t1"), [*KEY, "z", "y", "xb"])
        .filter("p0 <= t1 AND t0 <= p1").groupBy(*KEY, "p", "t").agg(F.sum(length).cast("long").alias("n"))
    )
    both = settle(met)
    out = both
    for runs, side, other in ((pred_runs, "p", "t"), (truth_runs, "t", "p")):
        size = runs.groupBy(*KEY, F.col("node").alias(side)).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("size"))
        shared = both.groupBy(*KEY, side).agg(F.sum("n").alias("shared"))
        rest = size.join(shared, [*KEY, side], "left").withColumn("n", F.col("size") - F.coalesce("shared", F.lit(0)))
        alone = rest.filter("n > 0").select(*KEY, side, F.lit(-1).cast("long").alias(other), "n")
        out = out.unionByName(alone)
    return out


def euler_characteristic(mask: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Vertices - edges + faces - cubes of the voxels taken as closed unit cubes.

    A cell spanning the axes outside a set S is present iff one of the voxels shifted
    by 0 or 1 along the axes of S is; the eight kinds of cells are eight shifted ORs of
    the packed mask.
    """
    return euler_of_words(P.pack(mask, keys), volumes, keys)


def euler_of_words(words: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """:func:`euler_characteristic` of packed words."""
    low = "4294967295L"
    taps = F.expr(
        "array(struct(0 AS dz, 0 AS dy), struct(0 AS dz, 1 AS dy), struct(1 AS dz, 0 AS dy), struct(1 AS dz, 1 AS dy))"
    )
    # Along x a shift may carry one bit into the next word.
    blocks = F.expr(
        f"array(struct(xb AS xb, bits AS own, (bits | shiftleft(bits, 1)) & {low} AS both),"
        " struct(xb + 1 AS xb, 0L AS own, shiftrightunsigned(bits, 31) AS both))"
    )
    cells = (
        words.select(*keys, "z", "y", F.inline(blocks))
        .filter("both != 0")
        .select(*keys, "z", "y", "xb", "own", "both", F.inline(taps))
    )
    kinds, terms = [], []
    for sz in (0, 1):
        for sy in (0, 1):
            for sx, column in ((0, "own"), (1, "both")):
                name = f"c{sz}{sy}{sx}"
                allowed = (F.col("dz") <= sz) & (F.col("dy") <= sy)
                kinds.append(F.bit_or(F.when(allowed, F.col(column)).otherwise(F.lit(0).cast("long"))).alias(name))
                sign = 1 if (sz + sy + sx) % 2 else -1
                terms.append(F.bit_count(name) * sign)
    merged = cells.groupBy(*keys, (F.col("z") + F.col("dz")).alias("z"), (F.col("y") + F.col("dy")).alias("y"), "xb").agg(*kinds)
    total = sum(terms[1:], terms[0])
    found = merged.groupBy(*keys).agg(F.sum(total.cast("long")).alias("euler"))
    return volumes.select(*keys).join(found, list(keys), "left").na.fill(0, ["euler"])


def betti_numbers(
    mask: DataFrame,
    volumes: DataFrame,
    runs: DataFrame | None = None,
    keys: Sequence[str] = ("volume_id",),
    tile: int = C.TILE,
) -> DataFrame:
    """b0 (26-connected parts), b1 (tunnels) and b2 (6-connected cavities) per ``keys`` row of ``volumes``."""
    return betti_of_words(P.pack(mask, keys), volumes, runs, keys, tile)


def betti_of_words(
    words: DataFrame,
    volumes: DataFrame,
    runs: DataFrame | None = None,
    keys: Sequence[str] = ("volume_id",),
    tile: int = C.TILE,
) -> DataFrame:
    """:func:`betti_numbers` of packed words."""
    if runs is None:
        runs = C.label_runs(C.runs_of(words, keys, tile), 26, keys, tile)
        # Everything below starts from the settled runs instead of the caller's plan.
        words = C.words_of(runs, keys)
    parts = runs.groupBy(*keys).agg(F.count_distinct("node").alias("b0"))
    holes = C.count_holes_of(words, C.bounds(volumes, keys), keys, tile)
    chi = euler_of_words(words, volumes, keys)
    b0 = F.coalesce("b0", F.lit(0)).cast("long")
    return (
        chi.join(parts, list(keys), "left")
        .join(holes, list(keys))
        .select(
            *keys,
            b0.alias("b0"),
            F.greatest(F.lit(0), b0 - F.col("euler") + F.col("n_holes")).alias("b1"),
            F.col("n_holes").alias("b2"),
        )
    )


def topo_score(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Weighted F1 of the matched Betti counts, from two :func:`betti_numbers` tables."""
    both = pred.select(*KEY, *[F.col(f"b{k}").alias(f"p{k}") for k in range(3)]).join(
        truth.select(*KEY, *[F.col(f"b{k}").alias(f"t{k}") for k in range(3)]), KEY
    )
    parts = []
    for k in range(3):
        p, t = F.col(f"p{k}"), F.col(f"t{k}")
        # 2PR / (P + R) with P = m/p and R = m/t; null where neither side has any.
        parts.append((2.0 * F.least(p, t) / F.nullif(p + t, F.lit(0))).alias(f"topo_f1_dim{k}"))
    scored = both.select("*", *parts)
    names = [f"topo_f1_dim{k}" for k in range(3)]
    value = sum(
        (F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in zip(names, M.BETTI_WEIGHTS)), F.lit(0.0)
    )
    weight = sum(
        (F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in zip(names, M.BETTI_WEIGHTS)), F.lit(0.0)
    )
    return scored.select(
        *KEY, *names, F.when(weight == 0, 1.0).otherwise(value / F.nullif(weight, F.lit(0.0))).alias("topo_score")
    )


def score_masks(
    pred: DataFrame,
    truth: DataFrame,
    volumes: DataFrame,
    tolerance: float = M.SURFACE_TOLERANCE,
    tile: int = C.TILE,
) -> DataFrame:
    """All score parts per volume; masks must already exclude ignored voxels."""
    return score_words(P.pack(both_sides(pred, truth), SIDED), volumes, tolerance, tile)


def score_words(
    words: DataFrame, volumes: DataFrame, tolerance: float = M.SURFACE_TOLERANCE, tile: int = C.TILE
) -> DataFrame:
    """:func:`score_masks` of packed ``(volume_id, side)`` words; no voxel becomes a row."""
    runs = C.label_runs(C.runs_of(words, SIDED, tile), 26, SIDED, tile)
    # Everything below starts from the settled runs instead of the callers' plans.
    words = C.words_of(runs, SIDED)
    sides = volumes.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    one = lambda df, i: df.filter(F.col("side") == i).drop("side")
    dice = dice_of_words(words, volumes, tolerance).select(*KEY, "surface_dice")
    information = voi(one(runs, 0), one(runs, 1), volumes)
    betti = betti_of_words(words, sides, runs, SIDED, tile)
    topology = topo_score(one(betti, 0), one(betti, 1))
    score = (
        M.TOPO_WEIGHT * F.col("topo_score")
        + M.DICE_WEIGHT * F.col("surface_dice")
        + M.VOI_WEIGHT * F.col("voi_score")
    )
    rounded = [
        F.round(F.col(c), 6).alias(c)
        for c in ["topo_score", "surface_dice", "voi_score", "voi_split", "voi_merge"]
        + [f"topo_f1_dim{k}" for k in range(3)]
    ]
    return dice.join(information, KEY).join(topology, KEY).select(
        *KEY, F.round(score, 6).alias("score"), *rounded, "n_foreground"
    )


def case_score(
    predictions: DataFrame, labels: DataFrame, volumes: DataFrame, tolerance: float = M.SURFACE_TOLERANCE
) -> DataFrame:
    """Score mask rows against label rows ``(volume_id, z, y, x, label)``, ignoring label 2."""
    ignore = labels.filter(F.col("label") == M.IGNORE)
    truth = labels.filter(F.col("label") == M.SURFACE).select(*M.VOXEL)
    guess = P.minus(P.pack(predictions), P.pack(ignore)).withColumn("side", F.lit(0))
    return score_words(guess.unionByName(P.pack(truth).withColumn("side", F.lit(1))), volumes, tolerance)


def confusion_dice(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """True / false positive / false negative voxels and Dice per foreground class.

    ``predicted`` and ``labels`` hold a ``label`` per voxel; absent rows are background
    and voxels labelled ignore count nowhere.
    """
    both = (
        predicted.select(*M.VOXEL, F.col("label").alias("p"))
        .join(labels.select(*M.VOXEL, F.col("label").alias("t")), M.VOXEL, "full")
        .na.fill(M.BACKGROUND, ["p", "t"])
        .filter(F.col("t") != M.IGNORE)
    )
    hits = both.select(
        *KEY, F.explode(F.array_distinct(F.array("p", "t"))).alias("class"), "p", "t"
    ).filter(F.col("class") != M.BACKGROUND)
    is_p, is_t = F.col("p") == F.col("class"), F.col("t") == F.col("class")
    tp, fp, fn = F.count_if(is_p & is_t), F.count_if(is_p & ~is_t), F.count_if(~is_p & is_t)
    return hits.groupBy(*KEY, "class").agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (2 * tp / (2 * tp + fp + fn)).alias("dice")
    )


def skeleton_recall(
    probs: DataFrame, skeleton: DataFrame, labels: DataFrame, volumes: DataFrame, smooth: float = 1.0
) -> DataFrame:
    """Soft recall of skeleton voxels by the stored surface probability ``prob``.

    Every row of ``volumes`` gets one; a volume without skeleton has nothing to miss and recall 1.
    """
    valid = apply_ignore(skeleton.select(*M.VOXEL), labels.filter(F.col("label") == M.IGNORE))
    hit = valid.join(probs.select(*M.VOXEL, "prob"), M.VOXEL, "left")
    n = F.count(F.lit(1))
    found = hit.groupBy(*KEY).agg(
        n.alias("n_skeleton"),
        ((F.sum(F.coalesce("prob", F.lit(0.0))) + smooth) / (n + smooth)).alias("skeleton_recall"),
    )
    return volumes.select(*KEY).join(found, KEY, "left").select(
        *KEY, F.coalesce("n_skeleton", F.lit(0).cast("long")).alias("n_skeleton"),
        F.coalesce("skeleton_recall", F.lit(1.0)).alias("skeleton_recall"),
    )


def affinity_agreement(
    targets: DataFrame,
    logits: DataFrame,
    smooth: float = 1e-5,
    keys: Sequence[str] = ("volume_id",),
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Per offset: valid pairs, mean logistic loss and soft Dice of stored affinity logits.

    A pair without a stored logit counts as logit 0; :func:`affinity_summary` combines the offsets. ``offsets`` names
    the ``(keys, oz, oy, ox)`` that get a row in any case: without valid pairs the loss is 0 and the Dice 1.
    """
    pair = [*M.VOXEL, "oz", "oy", "ox"]
    joined = targets.filter("affinity >= 0").join(logits.select(*pair, "logit"), pair, "left")
    t = F.col("affinity").cast("double")
    x = F.coalesce("logit", F.lit(0.0))
    loss = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    p = 1 / (1 + F.exp(-x))
    found = joined.groupBy(*keys, "oz", "oy", "ox").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(loss).alias("bce"),
        ((2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)).alias("soft_dice"),
    )
    if offsets is None:
        return found
    at = [*keys, "oz", "oy", "ox"]
    return offsets.select(*at).join(found, at, "left").na.fill({"n_valid": 0, "bce": 0.0, "soft_dice": 1.0})


def affinity_summary(agreement: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """The combined measure: loss over all valid pairs, Dice over offsets, and half of each with Dice as a loss."""
    bce = F.coalesce(F.sum(F.col("bce") * F.col("n_valid")) / F.nullif(F.sum("n_valid"), F.lit(0)), F.lit(0.0))
    dice = F.avg("soft_dice")
    return agreement.groupBy(*keys).agg(
        bce.alias("bce"), dice.alias("soft_dice"), (0.5 * bce + 0.5 * (1 - dice)).alias("combined")
    )


def score_cases(
    predictions: DataFrame, labels: DataFrame, volumes: DataFrame, pairs: DataFrame, scrolls: DataFrame | None = None
) -> DataFrame:
    """Score the volumes whose :func:`lamina.sources.scores.score_pairs` status is ``score``."""
    todo = pairs.filter("status = 'score'").select(*KEY)
    here = lambda df: df.join(todo, KEY, "left_semi")
    scored = case_score(here(predictions), here(labels), here(volumes))
    if scrolls is None:
        return scored
    return scored.join(scrolls.select(*KEY, "scroll_id"), KEY, "left")
