"""Filter channels, model combination and affinity targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import model as M
from lamina.functions.columns import argmax_label
from lamina.operators.lines import CELLS, along_lines
from lamina.session import tasks_for

# Default affinity offsets, face neighbours and powers of two along each axis.
AFFINITY_OFFSETS = tuple(
    tuple(reach if axis == k else 0 for k in range(3)) for reach in (1, 2, 4, 8, 16) for axis in range(3)
)

#: Side of the cubes that filters and affinities work on.
TILE = 32
#: What a row of a cube of affinities tells.
_SURFACE, _IGNORED, _CUBE = 0, 1, 2
_STEP = ("oz", "oy", "ox")


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights for offsets ``0..radius`` with ``radius = int(4 sigma + 0.5)``."""
    radius = int(4 * sigma + 0.5)
    raw = [exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def gaussian_blur(
    voxels: DataFrame, volumes: DataFrame, sigma: float = 1.0, value: str = "intensity", tile: int = TILE
) -> DataFrame:
    """Separable blur of every cell that a stored voxel reaches; values mirror at the faces, edge cell included."""
    return _filtered(voxels, volumes, sigma, value, tile, "blurred", lambda own, blurred: blurred)


def highpass_channel(
    voxels: DataFrame, volumes: DataFrame, sigma: float = 1.0, value: str = "intensity", tile: int = TILE
) -> DataFrame:
    """Value minus its blur, for every cell where either is stored."""
    return _filtered(voxels, volumes, sigma, value, tile, "highpass", lambda own, blurred: own - blurred)


def _filtered(
    voxels: DataFrame, volumes: DataFrame, sigma: float, value: str, tile: int, name: str,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """One shuffle for all three passes: cubes of ``tile`` cells with a copied border.

    A voxel goes to every cube within the kernel's reach of it; mirror images are laid out in the task, as each of them
    that a cube needs is an image of a cell that the cube holds. A task treats many cubes at once, as dense arrays of
    bounded size, whatever a volume holds. Voxels outside their volume take no part.
    """
    kernel = gaussian_kernel(sigma)
    reach = len(kernel) - 1
    inside = F.lit(True)
    for axis, size in zip(M.COORDS, ("d", "h", "w")):
        inside = inside & (F.col(axis) >= 0) & (F.col(axis) < F.col(size))
    rows = voxels.select(*M.VOXEL, F.col(value).cast("double").alias("v")).join(
        volumes.select("volume_id", "d", "h", "w"), "volume_id").filter(inside)
    for axis, size in zip(M.COORDS, ("d", "h", "w")):
        rows = rows.withColumn(f"t{axis}", F.explode(F.expr(
            f"sequence(CAST(greatest({axis} - {reach}, 0) div {tile} AS INT), CAST(least({axis} + {reach}, {size} - 1) div {tile} AS INT))")))

    def treat(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        cube = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        corner = np.stack([rows.column(f"t{c}").to_numpy()[starts].astype(np.int64) * tile for c in M.COORDS], 1)
        sides = np.stack([rows.column(n).to_numpy()[starts].astype(np.int64) for n in "dhw"], 1)
        # Cells that a cube holds before and from its corner on.
        before, after = np.minimum(corner, reach), np.minimum(sides - corner, tile + reach)
        at = np.stack([rows.column(c).to_numpy() for c in M.COORDS], 1) - (corner - before)[cube]
        values = rows.column("v").to_numpy()
        shapes, kind = np.unique(np.concatenate([before, after], 1), axis=0, return_inverse=True)
        row_of = np.full(len(starts), -1)
        for k, shape in enumerate(shapes):
            held = shape[:3] + shape[3:]
            core = np.minimum(shape[3:], tile)
            cubes = np.nonzero(kind.ravel() == k)[0]
            step = max(1, CELLS // int(np.prod(np.maximum(held, core + 2 * reach))))
            for some in np.split(cubes, range(step, len(cubes), step)):
                row_of[:] = -1
                row_of[some] = np.arange(len(some))
                mine = np.nonzero(row_of[cube] >= 0)[0]
                place = np.ravel_multi_index((row_of[cube[mine]], *at[mine].T), (len(some), *held))
                cells = len(some) * int(np.prod(held))
                own = np.bincount(place, values[mine], cells).reshape(len(some), *held)
                stored = np.bincount(place, minlength=cells).reshape(own.shape) > 0
                blurred, reached = own, stored
                for axis in range(3):
                    n = int(core[axis])
                    mirrored = _mirrored(np.arange(-reach, n + reach) + shape[axis], int(held[axis]))
                    blurred, reached = blurred.take(mirrored, axis + 1), reached.take(mirrored, axis + 1)
                    parts = [_window(blurred, axis + 1, j, n) * kernel[abs(j - reach)] for j in range(2 * reach + 1)]
                    blurred = sum(parts)
                    reached = np.logical_or.reduce([_window(reached, axis + 1, j, n) for j in range(2 * reach + 1)])
                inner = own[(slice(None), *[slice(b, b + n) for b, n in zip(shape[:3], core)])]
                found = np.nonzero(reached)
                which = some[found[0]]
                out = {"volume_id": rows.column("volume_id").take(pa.array(starts[which]))}
                out |= {c: pa.array((i + corner[which, axis]).astype(np.int32)) for axis, (c, i) in enumerate(zip(M.COORDS, found[1:]))}
                yield pa.table({**out, name: pa.array(combine(inner, blurred)[found])})

    out = T.StructType([voxels.schema["volume_id"], *[T.StructField(c, T.IntegerType()) for c in M.COORDS], T.StructField(name, T.DoubleType())])
    return along_lines(rows, ["volume_id", "tz", "ty", "tx"], "z", treat, out)


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Cells of a line of ``n`` that the places ``at`` show: it is mirrored at its ends, end cells included."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _window(cells: np.ndarray, axis: int, first: int, n: int) -> np.ndarray:
    return cells[(slice(None),) * axis + (slice(first, first + n),)]


def ensemble(probs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted class sums over all models and the winning class.

    Only volumes every model has seen are combined. ``weights`` names the models to
    combine; without it all models of the table count 1 each.
    """
    if weights:
        probs = probs.filter(F.col("model").isin(*weights))
        every = probs.sparkSession.range(1).select(F.lit(len(weights)).alias("n_models"))
    else:
        every = probs.agg(F.count_distinct("model").alias("n_models"))
    models = probs.select("volume_id", "model").distinct()
    common = (
        models.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
        .join(every, F.col("n") == F.col("n_models"))
        .select("volume_id")
    )
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("model") == name, float(w)).otherwise(weight)
    weighted = probs.join(common, "volume_id", "left_semi").select(
        *M.VOXEL, "model", F.transform("p", lambda q: q * weight).alias("q"))
    # The list of a voxel is as short as the list of models; it is summed in the models' order.
    sums = F.aggregate(
        F.sort_array(F.collect_list(F.struct("model", "q"))), F.array().cast("array<double>"),
        lambda acc, m: F.zip_with(acc, m["q"], lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
    return weighted.groupBy(*M.VOXEL).agg(sums.alias("p")).select(*M.VOXEL, "p", argmax_label("p").alias("label"))


def binarize(rows: DataFrame, threshold: float = 0.5, surface: int = M.SURFACE) -> DataFrame:
    """Mask from stored predictions: class vectors ``p``, floating ``value`` or integer ``label`` rows.

    Rows with none of these columns are a mask already.
    """
    if "p" in rows.columns:
        return binarize_probs(rows, surface, threshold)
    if "value" in rows.columns:
        return binarize_values(rows, "value", threshold)
    return binarize_labels(rows, surface) if "label" in rows.columns else rows.select(*M.VOXEL)


def binarize_probs(probs: DataFrame, surface: int = M.SURFACE, threshold: float = 0.5) -> DataFrame:
    """Mask from class vectors: the surface channel at ``threshold``.

    Vectors without that channel give the winning class, which is then read as a label map.
    """
    own = probs.filter(F.size("p") > surface).filter(F.get("p", F.lit(surface)) >= threshold).select(*M.VOXEL)
    winners = probs.filter(F.size("p") <= surface).select(*M.VOXEL, argmax_label("p").alias("label"))
    return own.unionByName(binarize_labels(winners, surface))


def binarize_values(values: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """Mask from continuous values."""
    return values.filter(F.col(value) >= threshold).select(*M.VOXEL)


def binarize_labels(labels: DataFrame, surface: int = M.SURFACE) -> DataFrame:
    """Mask from a label map; a volume that only holds 0 and 1 is taken as binary already."""
    binary = labels.groupBy("volume_id").agg((F.bool_and(F.col("label").isin(0, 1))).alias("binary"))
    keep = F.when(F.col("binary"), F.col("label") > 0).otherwise(F.col("label") == surface)
    return labels.join(binary, "volume_id").filter(keep).select(*M.VOXEL)


def affinity_targets(
    labels: DataFrame,
    components: DataFrame,
    volumes: DataFrame,
    offsets: Sequence[tuple[int, int, int]] = AFFINITY_OFFSETS,
    background_pairs: bool = False,
) -> DataFrame:
    """Valid voxel pairs ``(v, v + o)``: 1 if both are in the same component, else 0.

    ``components`` holds ``(volume_id, z, y, x, component)`` of the surface class. Pairs
    that leave the volume or touch an ignored voxel are invalid, and so, unless
    ``background_pairs``, are pairs without any surface voxel. Invalid pairs have no
    row; :func:`dense_affinity` adds them as -1.
    """
    return _affinity(labels, components, volumes, offsets, background_pairs, False)


def _affinity(
    labels: DataFrame, components: DataFrame, volumes: DataFrame, offsets: Sequence[tuple[int, int, int]],
    background_pairs: bool, dense: bool,
) -> DataFrame:
    """One shuffle of stored voxels to cubes of ``TILE`` cells, pairs come back as words of 32 along x.

    A voxel goes to its own cube and to those of the cells that reach it by an offset; a row of its own names every cube
    where background counts. No pair is shuffled. A task lays many cubes out at once, as dense arrays of bounded size.
    """
    for o in offsets:
        if len(o) != 3 or not any(o):
            raise ValueError(f"offset {o} is not a non-zero 3-vector")
    sides = volumes.select("volume_id", "d", "h", "w")
    surface = components.select(*M.VOXEL, F.col("component").cast("long").alias("component"), F.lit(_SURFACE).alias("kind"))
    ignored = labels.filter(F.col("label") == M.IGNORE).select(*M.VOXEL, F.lit(None).cast("long").alias("component"), F.lit(_IGNORED).alias("kind"))
    inside = F.lit(True)
    for c, n in zip(M.COORDS, ("d", "h", "w")):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < F.col(n))
    rows = surface.unionByName(ignored).join(sides, "volume_id").filter(inside)
    by = [f"t{c}" for c in M.COORDS]
    cells = [[F.col(c) - i for c, i in zip(M.COORDS, o)] for o in [(0, 0, 0), *offsets]]
    within = [reduce(lambda a, b: a & b, [(v >= 0) & (v < F.col(n)) for v, n in zip(cell, ("d", "h", "w"))]) for cell in cells]
    # A cube as one number: distinct numbers are found much faster than distinct structs.
    shifts = (42, 21, 0)
    homes = F.array(*[F.when(ok, reduce(lambda a, b: a + b, [F.shiftleft(F.floor(v / TILE).cast("long"), i) for v, i in zip(cell, shifts)]))
                      for cell, ok in zip(cells, within)])
    rows = rows.select("*", F.explode(F.array_compact(F.array_distinct(homes))).alias("home")).select(
        *rows.columns, *[F.shiftright("home", i).bitwiseAND(F.lit(2097151)).cast("int").alias(t) for t, i in zip(by, shifts)])
    tasks = None
    if background_pairs or dense:
        tasks = tasks_for(sides.agg(F.sum(F.col("d").cast("long") * F.col("h") * F.col("w"))).first()[0] or 0)
        cubes = sides
        for t, n in zip(by, ("d", "h", "w")):
            cubes = cubes.filter(F.col(n) > 0).withColumn(t, F.explode(F.expr(f"sequence(0, CAST(({n} - 1) div {TILE} AS INT))")))
        corner = [F.col(t) * TILE for t in by]
        cubes = cubes.select("volume_id", *[v.alias(c) for c, v in zip(M.COORDS, corner)], F.lit(None).cast("long").alias("component"),
                             F.lit(_CUBE).alias("kind"), "d", "h", "w", *by)
        rows = rows.unionByName(cubes)
    low, high = (np.array([f(0, *[o[axis] for o in offsets]) for axis in range(3)]) for f in (min, max))

    def treat(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        cube = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        corner = np.stack([rows.column(t).to_numpy()[starts].astype(np.int64) * TILE for t in by], 1)
        sides = np.stack([rows.column(n).to_numpy()[starts].astype(np.int64) for n in "dhw"], 1)
        # Cells that a cube holds: its own and those within reach, as far as the volume goes.
        begin, core = np.maximum(corner + low, 0), np.minimum(sides - corner, TILE)
        held = np.minimum(corner + TILE + high, sides) - begin
        at = np.stack([rows.column(c).to_numpy() for c in M.COORDS], 1) - begin[cube]
        kind = rows.column("kind").to_numpy()
        component = rows.column("component").combine_chunks()
        known = component.is_valid().to_numpy(zero_copy_only=False)
        # Equal components get equal codes; one without a number equals none.
        code = np.arange(1, len(known) + 1) + len(known)
        code[known] = np.unique(component.fill_null(0).to_numpy()[known], return_inverse=True)[1] + 1
        shapes, shape_of = np.unique(np.concatenate([corner - begin, held, core], 1), axis=0, return_inverse=True)
        row_of = np.full(len(starts), -1)
        for k, shape in enumerate(shapes):
            before, room, own = shape[:3], shape[3:6], shape[6:]
            cubes = np.nonzero(shape_of.ravel() == k)[0]
            step = max(1, CELLS // int(np.prod(room)))
            for some in np.split(cubes, range(step, len(cubes), step)):
                row_of[:] = -1
                row_of[some] = np.arange(len(some))
                mine = np.nonzero((row_of[cube] >= 0) & (kind != _CUBE))[0]
                place = np.ravel_multi_index((row_of[cube[mine]], *at[mine].T), (len(some), *room))
                found = kind[mine] == _SURFACE
                flat = np.zeros(len(some) * int(np.prod(room)), np.int64)
                np.maximum.at(flat, place[found], code[mine[found]])
                flat[place[~found]] = -1
                grid = flat.reshape(len(some), *room)
                for o in offsets:
                    # Where both ends lie in the volume.
                    first = np.minimum(np.maximum(0, -before - o), own)
                    last = np.maximum(np.minimum(own, room - before - o), first)
                    a, b = (grid[(slice(None), *[slice(f + s, t + s) for f, t, s in zip(first, last, before + np.array(move))])] for move in ((0, 0, 0), o))
                    here = (slice(None), *[slice(f, t) for f, t in zip(first, last)])
                    valid, same = (np.zeros((len(some), own[0], own[1], 32), bool) for _ in range(2))
                    valid[here] = (a >= 0) & (b >= 0)
                    if not background_pairs:
                        valid[here] &= (a > 0) | (b > 0)
                    same[here] = (a == b) & (a > 0)
                    same &= valid
                    valid, same = (np.packbits(v, axis=3, bitorder="little").view("<u4")[..., 0].astype(np.int64) for v in (valid, same))
                    words = np.nonzero(np.ones_like(valid) if dense else valid)
                    which = some[words[0]]
                    places = (words[1] + corner[which, 0], words[2] + corner[which, 1], corner[which, 2])
                    yield pa.table({
                        "volume_id": rows.column("volume_id").take(pa.array(starts[which])),
                        **{c: pa.array(v.astype(np.int32)) for c, v in zip(M.COORDS, places)},
                        **{c: pa.array(np.full(len(which), v, np.int32)) for c, v in zip(_STEP, o)},
                        "n": pa.array(np.full(len(which), own[2], np.int32)), "valid": pa.array(valid[words]), "same": pa.array(same[words])})

    ints = [T.StructField(c, T.IntegerType()) for c in (*M.COORDS, *_STEP, "n")]
    schema = T.StructType([components.schema["volume_id"], *ints, T.StructField("valid", T.LongType()), T.StructField("same", T.LongType())])
    words = along_lines(rows, ["volume_id", *by], "z", treat, schema, tasks)
    bit = F.explode(F.expr("sequence(0, n - 1)" if dense else "filter(sequence(0, 31), i -> (shiftright(valid, i) & 1L) = 1L)"))
    held = F.expr("CAST(shiftright(same, bit) & 1L AS INT)")
    affinity = F.when(F.expr("shiftright(valid, bit) & 1L") == 1, held).otherwise(-1) if dense else held
    return words.select("*", bit.alias("bit")).select(
        "volume_id", "z", "y", (F.col("x") + F.col("bit")).alias("x"), *_STEP, affinity.alias("affinity"))


def all_affinity(
    labels: DataFrame, components: DataFrame, volumes: DataFrame,
    offsets: Sequence[tuple[int, int, int]] = AFFINITY_OFFSETS, background_pairs: bool = False,
) -> DataFrame:
    """:func:`affinity_targets` with a row of every cell and offset, -1 where the pair is invalid."""
    return _affinity(labels, components, volumes, offsets, background_pairs, True)


def dense_affinity(targets: DataFrame, volumes: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every cell and offset, -1 where the pair is invalid."""
    from lamina.sources.catalog import dense_cells

    taps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("oz", "oy", "ox"))]) for o in offsets])
    pair = [*M.VOXEL, "oz", "oy", "ox"]
    every = dense_cells(volumes).withColumn("tap", F.explode(taps)).select(*M.VOXEL, "tap.*")
    return every.join(targets, pair, "left").na.fill(-1, ["affinity"])
