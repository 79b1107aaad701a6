"""Masks packed into 32-voxel words along x.

A mask line is stored as rows ``(keys, z, y, xb, bits)``: bit ``i`` of ``bits`` is the
voxel at ``x = 32 * xb + i``. Morphology, set operations and counting then work on
whole words with built-in bit functions, so a stencil moves one row per word and line
offset instead of one row per voxel and voxel offset, and partial ``bit_or`` /
``bit_and`` aggregation shrinks it further before the shuffle.

The upper half of the BIGINT leaves room for a halo of 16 voxels on each side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.stencils import Span, cross_spans

HALO = 16
_LOW32 = "4294967295L"
WORD_KEYS = ["z", "y", "xb"]


def pack(mask: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxel rows to words; duplicate voxels collapse."""
    return (
        mask.groupBy(*keys, "z", "y", F.expr("CAST(x div 32 AS INT)").alias("xb"))
        .agg(F.expr("bit_or(shiftleft(1L, x % 32))").alias("bits"))
    )


def unpack(words: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Words back to voxel rows."""
    bit = F.explode(F.expr("filter(sequence(0, 31), i -> (shiftright(bits, i) & 1L) = 1L)"))
    return (
        words.select(*keys, "z", "y", "xb", bit.alias("bit"))
        .select(*keys, "z", "y", (F.col("xb") * 32 + F.col("bit")).alias("x"))
    )


def merge(*parts: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Union of packed masks."""
    columns = [*keys, *WORD_KEYS, "bits"]
    whole = parts[0].select(*columns)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*columns))
    return whole.groupBy(*keys, *WORD_KEYS).agg(F.bit_or("bits").alias("bits"))


def minus(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxels of ``left`` that ``right`` does not have."""
    on = [*keys, *WORD_KEYS]
    other = right.select(*on, F.col("bits").alias("other"))
    return (
        left.join(other, on, "left")
        .select(*on, F.expr("bits & ~coalesce(other, 0L)").alias("bits"))
        .filter("bits != 0")
    )


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxels both masks have."""
    on = [*keys, *WORD_KEYS]
    other = right.select(*on, F.col("bits").alias("other"))
    return (
        left.join(other, on)
        .select(*on, F.expr("bits & other").alias("bits"))
        .filter("bits != 0")
    )


def clip(words: DataFrame, frames: DataFrame, keys: Sequence[str], frame_keys: Sequence[str]) -> DataFrame:
    """Drop what lies outside ``frames(frame_keys, d, h, w)``."""
    dims = frames.select(*frame_keys, "d", "h", "w")
    room = F.least(F.lit(32), F.col("w") - F.col("xb") * 32).alias("room")
    return (
        words.filter("z >= 0 AND y >= 0 AND xb >= 0")
        .join(dims, list(frame_keys))
        .filter("z < d AND y < h AND xb * 32 < w")
        .select(*keys, *WORD_KEYS, "bits", room)
        .select(*keys, *WORD_KEYS, F.expr("bits & (shiftleft(1L, room) - 1L)").alias("bits"))
        .filter("bits != 0")
    )


def _taps(spans: Sequence[Span], widths: Sequence[int]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(dz).alias("dz"),
                F.lit(dy).alias("dy"),
                F.lit(widths.index(hw) + 1).alias("k"),
            )
            for dz, dy, hw in spans
        ]
    )


def _check(spans: Sequence[Span]) -> list[int]:
    widths = sorted({hw for _, _, hw in spans})
    if widths[-1] > HALO:
        raise ValueError(f"structuring elements may reach at most {HALO} voxels along x")
    return widths


def dilate_words(
    words: DataFrame,
    spans: Sequence[Span],
    frames: DataFrame,
    keys: Sequence[str] = ("volume_id",),
    frame_keys: Sequence[str] = ("volume_id",),
) -> DataFrame:
    """Dilation by a structuring element, clipped to the frame."""
    widths = _check(spans)
    wide = [f"shiftleft(bits, {HALO})"]
    for k in range(1, widths[-1] + 1):
        wide.append(f"{wide[-1]} | shiftleft(bits, {HALO + k}) | shiftleft(bits, {HALO - k})")
    spread = F.array(*[F.expr(wide[hw]) for hw in widths])
    blocks = F.expr(
        "array(struct(xb - 1 AS xb, shiftleft(wide & 65535L, 16) AS bits),"
        f" struct(xb AS xb, shiftrightunsigned(wide, 16) & {_LOW32} AS bits),"
        " struct(xb + 1 AS xb, shiftrightunsigned(wide, 48) AS bits))"
    )
    moved = (
        words.select(*keys, *WORD_KEYS, spread.alias("spread"), F.explode(_taps(spans, widths)).alias("tap"))
        .select(
            *keys,
            (F.col("z") + F.col("tap.dz")).alias("z"),
            (F.col("y") + F.col("tap.dy")).alias("y"),
            "xb",
            F.element_at("spread", F.col("tap.k")).alias("wide"),
        )
        .select(*keys, "z", "y", F.inline(blocks))
        .filter("bits != 0")
    )
    grown = moved.groupBy(*keys, *WORD_KEYS).agg(F.bit_or("bits").alias("bits"))
    return clip(grown, frames, keys, frame_keys)


def erode_words(words: DataFrame, spans: Sequence[Span], keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Erosion by a symmetric structuring element; everything outside counts as empty."""
    widths = _check(spans)
    parts = F.expr(
        f"array(struct(xb AS xb, shiftleft(bits, {HALO}) AS bits),"
        " struct(xb - 1 AS xb, shiftleft(bits & 65535L, 48) AS bits),"
        " struct(xb + 1 AS xb, shiftrightunsigned(bits, 16) AS bits))"
    )
    haloed = (
        words.select(*keys, "z", "y", F.inline(parts))
        .filter("bits != 0")
        .groupBy(*keys, *WORD_KEYS)
        .agg(F.bit_or("bits").alias("wide"))
    )
    narrow = ["wide"]
    for k in range(1, widths[-1] + 1):
        narrow.append(f"{narrow[-1]} & shiftleft(wide, {k}) & shiftrightunsigned(wide, {k})")
    shrunk = F.array(*[F.expr(f"shiftrightunsigned({narrow[hw]}, {HALO}) & {_LOW32}") for hw in widths])
    return (
        haloed.select(*keys, *WORD_KEYS, shrunk.alias("shrunk"), F.explode(_taps(spans, widths)).alias("tap"))
        .select(
            *keys,
            (F.col("z") - F.col("tap.dz")).alias("z"),
            (F.col("y") - F.col("tap.dy")).alias("y"),
            "xb",
            F.element_at("shrunk", F.col("tap.k")).alias("bits"),
        )
        .filter("bits != 0")
        .groupBy(*keys, *WORD_KEYS)
        .agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("lines"))
        .filter((F.col("lines") == len(spans)) & (F.col("bits") != 0))
        .select(*keys, *WORD_KEYS, "bits")
    )


def surface_words(words: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Voxels with at least one empty face neighbour."""
    return minus(words, erode_words(words, cross_spans(), keys), keys)


def dilate(
    mask: DataFrame,
    volumes: DataFrame,
    spans: Sequence[Span],
    iterations: int = 1,
    keys: Sequence[str] = ("volume_id",),
    frame_keys: Sequence[str] = ("volume_id",),
) -> DataFrame:
    words = pack(mask, keys)
    for _ in range(iterations):
        words = dilate_words(words, spans, volumes, keys, frame_keys)
    return unpack(words, keys)


def erode(mask: DataFrame, spans: Sequence[Span], iterations: int = 1, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    words = pack(mask, keys)
    for _ in range(iterations):
        words = erode_words(words, spans, keys)
    return unpack(words, keys)


def surface_voxels(mask: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    return unpack(surface_words(pack(mask, keys), keys), keys)


def close(
    mask: DataFrame,
    volumes: DataFrame,
    spans: Sequence[Span],
    keys: Sequence[str] = ("volume_id",),
    frame_keys: Sequence[str] = ("volume_id",),
) -> DataFrame:
    """Dilation clipped to the volume, then erosion with nothing outside it.

    Voxels within reach of a volume face are therefore worn away by the erosion.
    """
    grown = dilate_words(pack(mask, keys), spans, volumes, keys, frame_keys)
    return unpack(erode_words(grown, spans, keys), keys)


def tube_mask(skeleton: DataFrame, surface: DataFrame, volumes: DataFrame, iterations: int = 2) -> DataFrame:
    """A skeleton grown by face neighbours and kept inside the surface."""
    words = pack(skeleton)
    for _ in range(iterations):
        words = dilate_words(words, cross_spans(), volumes)
    return unpack(overlap(words, pack(surface)))
