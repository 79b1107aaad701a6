"""Cutting components that a thin neck holds together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import model as M
from lamina.functions.stencils import ball_spans, cross_spans
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators.lines import NOTHING, along_lines, envelope, grids
from lamina.session import settle

PART = ["volume_id", "component"]


def near_cells(radius: int, columns: Sequence[str] = M.COORDS) -> list:
    """Columns of the 27 grid cells around a point, for a grid of ``radius`` wide cells."""
    return [
        F.array(*[F.expr(f"CAST(floor({c} / {radius}) AS INT) + {step}") for step in (-1, 0, 1)]) for c in columns
    ]


def nearest_seed_partition(voxels: DataFrame, seeds: DataFrame, keys: Sequence[str] = tuple(PART)) -> DataFrame:
    """Each voxel takes the ``seed`` of the nearest seed voxel; the smaller seed wins a tie.

    Separable like the distance transform: along x, y and z, lower envelopes carry (squared distance, seed) over the
    box that the unsettled voxels of a key span. One pass an axis, whatever the distances are. A key without any seed
    yields no rows. Only seed voxels at the seed's own surface can be nearest to a voxel outside it.
    """
    return _nearest(P.pack(voxels, keys), P.pack(seeds, [*keys, "seed"]), keys)


def _nearest(own: DataFrame, sown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`nearest_seed_partition` of packed voxels and seeds; voxels become rows only where lines need them."""
    at, on, with_seed = [*keys, *M.COORDS], [*keys, *P.WORD_KEYS], [*keys, "seed"]
    sown = settle(sown)
    has_seed = sown.select(*keys).distinct()
    taken = sown.groupBy(*on).agg(F.bit_or("bits").alias("bits"))
    rest = settle(P.minus(own.join(has_seed, list(keys), "left_semi"), taken, keys))
    box = P.unpack(rest, keys).groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("least", F.min), ("most", F.max))]
    )
    rim = P.unpack(P.surface_words(sown, with_seed), with_seed)
    step = rim.select(*at, "seed", F.lit(0).cast("long").alias("d2")).join(box, list(keys))
    for axis, line in (("x", [*keys, "z", "y"]), ("y", [*keys, "z", "x"])):
        step = along_lines(step, line, axis, _spread_pass(axis), step.schema)
    carried = step.select(*at, "seed", "d2", F.lit(False).alias("wanted"))
    asked = P.unpack(rest, keys).withColumn("wanted", F.lit(True))
    met = carried.unionByName(asked, allowMissingColumns=True).select(*at, "seed", "d2", "wanted")
    nearest = along_lines(met, [*keys, "y", "x"], "z", _last_pass("z"), met.schema)
    mine = sown.join(own.select(*on, F.col("bits").alias("mine")), on).select(*on, "seed", F.expr("bits & mine").alias("bits"))
    return P.unpack(mine, with_seed).select(*at, "seed").unionByName(nearest.select(*at, "seed"))


def _costs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(cost, seeds): distance and rank of the seed as one number, so that the smaller seed wins a tie.

    ``cost // len(seeds)`` is the distance, the remainder the place of the seed. Rows without a seed cost nothing's price.
    """
    seed, d2 = (rows.column(c).combine_chunks() for c in ("seed", "d2"))
    known = seed.is_valid().to_numpy(zero_copy_only=False)
    seeds, rank = np.unique(seed.fill_null(0).to_numpy()[known], return_inverse=True)
    cost = np.full(len(known), NOTHING, np.int64)
    cost[known] = d2.fill_null(0).to_numpy()[known] * len(seeds) + rank
    return cost, seeds


def _laid_out(at: np.ndarray, starts: np.ndarray, cost: np.ndarray, first: np.ndarray, last: np.ndarray, scale: int):
    """For grids of lines: (lines, cost of every cell, best source of every cell)."""
    line_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    row_of = np.full(len(starts), -1)
    for lines, width in grids(first, last):
        row_of[:] = -1
        row_of[lines] = np.arange(len(lines))
        mine = np.nonzero((row_of[line_of] >= 0) & (cost < NOTHING))[0]
        grid = np.full((len(lines), width), NOTHING, np.int64)
        np.minimum.at(grid, (row_of[line_of[mine]], at[mine] - first[line_of[mine]]), cost[mine])
        yield lines, grid, envelope(grid, scale)


def _spread_pass(axis: str):
    """Every line with a source gets a row for each place between ``least`` and ``most``."""

    def treat(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        at = rows.column(axis).to_numpy().astype(np.int64)
        cost, seeds = _costs(rows)
        low, high = (rows.column(f"{n}_{axis}").to_numpy()[starts].astype(np.int64) for n in ("least", "most"))
        first = np.minimum(low, np.minimum.reduceat(at, starts))
        last = np.maximum(high, np.maximum.reduceat(at, starts))
        for lines, grid, best in _laid_out(at, starts, cost, first, last, len(seeds)):
            place = np.arange(grid.shape[1])[None, :] + first[lines][:, None]
            r, c = np.nonzero((place >= low[lines][:, None]) & (place <= high[lines][:, None]))
            b = best[r, c]
            taken = grid[r, b]
            out = rows.take(pa.array(starts[lines[r]]))
            for name, values in ((axis, place[r, c]), ("seed", seeds[taken % len(seeds)]), ("d2", (c - b) ** 2 + taken // len(seeds))):
                i = out.schema.get_field_index(name)
                out = out.set_column(i, name, pa.array(values).cast(out.schema.field(i).type))
            yield out

    return treat


def _last_pass(axis: str):
    """Wanted rows take the seed of the best source of their line."""

    def treat(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        at = rows.column(axis).to_numpy().astype(np.int64)
        wanted = rows.column("wanted").to_numpy()
        cost, seeds = _costs(rows)
        if not len(seeds) or not wanted.any():
            return
        first, last = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
        line_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        row_of = np.full(len(starts), -1)
        for lines, grid, best in _laid_out(at, starts, cost, first, last, len(seeds)):
            row_of[:] = -1
            row_of[lines] = np.arange(len(lines))
            mine = np.nonzero(wanted & (row_of[line_of] >= 0))[0]
            r, c = row_of[line_of[mine]], at[mine] - first[line_of[mine]]
            b = best[r, c]
            mine, r, c, b = (v[b >= 0] for v in (mine, r, c, b))
            taken = grid[r, b]
            out = rows.take(pa.array(mine))
            for name, values in (("seed", seeds[taken % len(seeds)]), ("d2", (c - b) ** 2 + taken // len(seeds))):
                i = out.schema.get_field_index(name)
                out = out.set_column(i, name, pa.array(values).cast(out.schema.field(i).type))
            yield out

    return treat


def partition_boundary(
    partition: DataFrame, volumes: DataFrame, width: int = 1, keys: Sequence[str] = tuple(PART)
) -> DataFrame:
    """Voxels with a face neighbour of another ``seed``, both sides, widened for ``width > 1``."""
    return P.unpack(_boundary(P.pack(partition, [*keys, "seed"]), volumes, width, keys), keys)


def _boundary(words: DataFrame, volumes: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """:func:`partition_boundary` as words, of the packed voxels of each ``seed``."""
    labelled = [*keys, "seed"]
    on = [*keys, *P.WORD_KEYS]
    reached = P.dilate_words(words, cross_spans(), volumes, labelled).select(
        *on, F.col("seed").alias("other"), F.col("bits").alias("reach")
    )
    edge = (
        words.join(reached, on)
        .filter("seed != other")
        .select(*on, F.expr("bits & reach").alias("bits"))
        .filter("bits != 0")
        .groupBy(*on)
        .agg(F.bit_or("bits").alias("bits"))
    )
    if width > 1:
        edge = P.dilate_words(edge, ball_spans(width - 1), volumes, keys)
    return edge


def propose_cuts(
    mask: DataFrame, volumes: DataFrame, settings: M.UnmergeSettings = M.UnmergeSettings()
) -> tuple[DataFrame, DataFrame]:
    """``(proposed mask, diagnostics per component)``.

    A component is a candidate if eroding it leaves at least two large seeds. Candidates
    are cut in raster order while the volume's budget lasts.
    """
    runs = settle(C.component_runs(mask, volumes, settings.connectivity))
    sizes = C.component_stats(runs).select(*PART, F.col("size").alias("voxel_count"))
    eroded = P.erode_words(C.words_of(runs, PART), ball_spans(settings.erosion_radius), PART)
    blobs = C.label_runs(C.runs_of(eroded, PART), settings.connectivity, PART)
    blobs = blobs.select(*PART, "z", "y", "x0", "x1", F.col("node").alias("seed"))
    big = (
        blobs.groupBy(*PART, "seed").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
        .filter(F.col("size") >= settings.min_seed_size).select(*PART, "seed")
    )
    counts = settle(
        sizes.join(big.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_seeds")), PART, "left").na.fill(0, ["n_seeds"])
    )
    candidates = counts.filter("n_seeds >= 2").select(*PART)
    turn = C.rank_components(candidates).withColumnRenamed("component_no", "turn")
    chosen = turn if settings.budget is None else turn.filter(F.col("turn") <= settings.budget)
    chosen = settle(chosen.select(*PART))

    labelled = [*PART, "seed"]
    seeds = C.words_of(blobs.join(big, labelled, "left_semi").join(chosen, PART, "left_semi"), labelled)
    whole = C.words_of(runs.join(chosen, PART, "left_semi"), PART)
    split = settle(P.pack(_nearest(whole, seeds, PART), labelled))
    cut = P.minus(whole, _boundary(split, volumes, settings.cut_width, PART), PART)
    pieces = C.label_runs(C.runs_of(cut, PART), settings.connectivity, PART).withColumnRenamed("node", "piece")
    piece_sizes = pieces.groupBy(*PART, "piece").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    kept = piece_sizes.filter(F.col("size") >= settings.min_piece_size).select(*PART, "piece")
    cleaned = C.from_runs(pieces.join(kept, [*PART, "piece"], "left_semi"))
    proposed = C.from_runs(runs.join(chosen, PART, "left_anti")).unionByName(cleaned)

    n_pieces = piece_sizes.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_pieces"))
    was_cut = F.coalesce("cut", F.lit(False))
    reason = (
        F.when(was_cut, F.concat(F.lit("cut_into_"), F.coalesce("n_pieces", F.lit(0)).cast("string"), F.lit("_pieces")))
        .when(F.col("n_seeds") < 2, "not_candidate")
        .otherwise("budget_exhausted")
    )
    info = (
        counts.join(C.rank_components(runs), PART)
        .join(chosen.withColumn("cut", F.lit(True)), PART, "left")
        .join(n_pieces, PART, "left")
        .select(*PART, "component_no", "voxel_count", was_cut.alias("cut"), "n_seeds", reason.alias("reason"))
    )
    return proposed, info


def cut_counts(info: DataFrame, volumes: DataFrame) -> DataFrame:
    """Components, candidates and cuts per volume, for the gate."""
    counts = info.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n_components"),
        F.count_if(F.col("n_seeds") >= 2).alias("n_candidates"),
        F.count_if("cut").alias("n_edits"),
    )
    return volumes.select("volume_id").join(counts, "volume_id", "left").na.fill(0)
