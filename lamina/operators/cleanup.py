"""The mask cleanup chain: small parts, closing, gap patching, plugging, hole filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.stencils import ball_spans
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators.channels import binarize
from lamina.operators.gaps import patch_words
from lamina.session import settle, tasks_for

PART = ["volume_id", "component"]
_LOW32 = "4294967295L"


def component_frames(runs: DataFrame, volumes: DataFrame, pad: int) -> DataFrame:
    """Bounding box of each component, padded and clipped to its volume."""
    boxes = C.component_stats(runs).join(volumes.select("volume_id", "d", "h", "w"), "volume_id")
    low = lambda c: F.greatest(F.lit(0), F.col(f"{c}0") - pad).alias(f"f{c}0")
    high = lambda c, n: F.least(F.col(n) - 1, F.col(f"{c}1") + pad).alias(f"f{c}1")
    return boxes.select(
        *PART, low("z"), high("z", "d"), low("y"), high("y", "h"), low("x"), high("x", "w")
    )


def plug_words(words: DataFrame, keys: Sequence[str] = ("volume_id",), rounds: int = 5) -> DataFrame:
    """Fill face-diagonal pinches.

    On every unit square whose diagonal is set and whose other two corners are clear,
    the lower-numbered clear corner is added; all squares of a round see the same
    mask. Squares lie between a line and its next line in y or z, or across the four
    lines around an edge along x, so six neighbouring lines decide a word.
    """
    # The line that the source word is, seen from the line it helps to decide.
    lines = {"own": (0, 0), "north": (0, 1), "up": (1, 0), "up_north": (1, 1), "south": (0, -1), "up_south": (1, -1)}
    roles = F.array(
        *[F.struct(F.lit(n).alias("role"), F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for n, (dz, dy) in lines.items()]
    )
    halo = F.expr(
        f"array(struct(xb AS xb, shiftleft(bits, {P.HALO}) AS wide),"
        " struct(xb - 1 AS xb, shiftleft(bits & 65535L, 48) AS wide),"
        " struct(xb + 1 AS xb, shiftrightunsigned(bits, 16) AS wide))"
    )
    before, after = "shiftleft({0}, 1)", "shiftrightunsigned({0}, 1)"
    pinches = ["north & up & ~own & ~up_north", "south & up & ~own & ~up_south"]
    for side in ("north", "up"):
        for near in (before, after):
            pinches.append(f"{near.format('own')} & {side} & ~own & ~{near.format(side)}")
    grown = " | ".join(["own", *[f"({p})" for p in pinches]])
    empty = F.lit(0).cast("long")
    # Words are few bytes but make many rows, and joins before may have left all words of a component in one task.
    # So each round deals them anew, by blocks of lines whose rows meet again, to tasks of bounded output.
    tasks = tasks_for(words.count() * len(lines) * 3)
    blocks = [F.expr("z div 8"), F.expr("y div 8"), "xb"]
    for _ in range(rounds):
        spread = (
            words.repartition(tasks, *keys, *blocks).select(*keys, "z", "y", F.inline(halo))
            .filter("wide != 0")
            .select("*", F.explode(roles).alias("r"))
            .select(
                *keys,
                (F.col("z") - F.col("r.dz")).alias("z"),
                (F.col("y") - F.col("r.dy")).alias("y"),
                "xb",
                "wide",
                F.col("r.role").alias("role"),
            )
        )
        seen = spread.groupBy(*keys, *P.WORD_KEYS).agg(
            *[F.bit_or(F.when(F.col("role") == n, F.col("wide")).otherwise(empty)).alias(n) for n in lines]
        )
        words = seen.select(
            *keys, *P.WORD_KEYS, F.expr(f"shiftrightunsigned({grown}, {P.HALO}) & {_LOW32}").alias("bits")
        ).filter("bits != 0")
    return words


def plug_holes(mask: DataFrame, frames: DataFrame, keys: Sequence[str] = ("volume_id",), rounds: int = 5) -> DataFrame:
    """:func:`plug_words` on voxels; frames that are one cell thin along an axis stay as they are."""
    return P.unpack(plug_thick(P.pack(mask, keys), frames, keys, rounds), keys)


def plug_thick(words: DataFrame, frames: DataFrame, keys: Sequence[str] = ("volume_id",), rounds: int = 5) -> DataFrame:
    """:func:`plug_holes` of packed words."""
    thick = frames.filter("fz1 > fz0 AND fy1 > fy0 AND fx1 > fx0").select(*keys)
    plugged = plug_words(words.join(thick, list(keys), "left_semi"), keys, rounds)
    return plugged.unionByName(words.join(thick, list(keys), "left_anti"))


def close_components(runs: DataFrame, volumes: DataFrame, radius: int) -> DataFrame:
    """Closing of every component on its own, from component runs, as packed words."""
    spans = ball_spans(radius)
    return P.erode_words(P.dilate_words(C.words_of(runs, PART), spans, volumes, PART), spans, PART)


def run_stages(
    mask: DataFrame, volumes: DataFrame, settings: M.CleanupSettings = M.CleanupSettings(), through: str = "fill"
) -> dict[str, DataFrame]:
    """The mask after every stage up to ``through``; each stage starts from the one before.

    ``mask`` may also hold predictions (see :func:`lamina.operators.channels.binarize`); they are binarised first.
    """
    if through not in M.STAGES:
        raise ValueError(f"unknown stage {through}")
    wanted = M.STAGES[: M.STAGES.index(through) + 1]
    mask = settle(binarize(mask, settings.threshold, settings.surface_label).distinct())
    out = {"raw": mask}
    if through == "raw":
        return out
    # From here on the state is packed words by component; voxel rows are made for what a caller reads.
    kept = settle(C.large_runs(C.component_runs(mask, volumes, settings.connectivity), settings.min_size))
    out["remove_small"] = C.from_runs(kept)
    if through == "remove_small":
        return out
    closing = settings.closing and settings.closing_radius > 0
    frames = settle(component_frames(kept, volumes, settings.closing_radius if closing else 0))
    parts = settle(close_components(kept, volumes, settings.closing_radius) if closing else C.words_of(kept, PART))
    out["closing"] = P.unpack(P.merge(parts))
    if "patch" in wanted:
        if settings.patching:
            parts = settle(patch_words(parts, frames))
        out["patch"] = P.unpack(P.merge(parts))
    if "plug" in wanted:
        if settings.plugging:
            parts = settle(plug_thick(parts, frames, PART, settings.plug_rounds))
        out["plug"] = P.unpack(P.merge(parts))
    if "fill" in wanted:
        words = P.merge(parts)
        if settings.filling:
            words = settle(words)
            words = P.merge(words, C.words_of(C.enclosed_of(words, C.bounds(volumes))))
        out["fill"] = P.unpack(words)
    return out


def cleanup_chain(
    mask: DataFrame, volumes: DataFrame, settings: M.CleanupSettings = M.CleanupSettings(), through: str = "fill"
) -> DataFrame:
    return run_stages(mask, volumes, settings, through)[through]


def stage_table(stages: dict[str, DataFrame]) -> DataFrame:
    """All stages in one table with a ``stage`` column."""
    out = None
    for name, rows in stages.items():
        tagged = rows.select(F.lit(name).alias("stage"), *M.VOXEL)
        out = tagged if out is None else out.unionByName(tagged)
    return out
