"""Column expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings of volume images, and the units of readable sizes.
VOLUME_FILE = r"(?i)([^/]+)\.tiff?$"
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def file_stem(path: str) -> Column:
    """Stem of a volume image path; null for other files."""
    stem = F.regexp_extract(path, VOLUME_FILE, 1)
    return F.when(stem != "", stem)


def case_id_from_filename(path: str) -> Column:
    """Case of an image file: its stem without a numeric channel suffix."""
    return F.regexp_replace(file_stem(path), "_[0-9]+$", "")


def _two_decimals(value: Column) -> Column:
    """The exact binary value with two decimals, ties to even; rounding functions start from its shortest text instead."""
    whole = F.floor(value)
    # Hundredths in units of 2^-52, which hold every fraction of a double from 1 on.
    parts = ((value - whole) * 2.0**52).cast("long") * 100
    cents, rest = F.shiftright(parts, 52), parts.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    total = (whole * 100 + cents + up.cast("long")).cast("decimal(20,0)")
    return (total * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)").cast("string")


def format_bytes(size: str) -> Column:
    """Readable size in 1024 steps with two decimals, ties to even."""
    value = F.col(size).cast("double")
    text = lambda v, unit: F.concat(_two_decimals(v), F.lit(f" {unit}"))
    out = text(value / 1024.0 ** (len(BYTE_UNITS) - 1), BYTE_UNITS[-1])
    for step in reversed(range(len(BYTE_UNITS) - 1)):
        scaled = value / 1024.0**step
        out = F.when(scaled < 1024.0, text(scaled, BYTE_UNITS[step])).otherwise(out)
    return out


def argmax_label(p: str) -> Column:
    """Class of the largest probability; the lowest class wins a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def unit_hash(*parts: str | Column, seed: int = 0) -> Column:
    """Deterministic pseudo-random number in [0, 1) from the text of ``parts``."""
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def axis_origins(length: Column, size: int, stride: int) -> Column:
    """Window starts along one axis: every ``stride`` plus one flush with the end."""
    last = length - size
    stepped = F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(stepped))


def nearest_choice(value: Column, choices: Sequence[int]) -> Column:
    """Nearest entry of an ascending list; the smaller one wins a tie."""
    ranked = F.array(*[F.struct(F.abs(value - c).alias("gap"), F.lit(c).alias("choice")) for c in choices])
    return F.array_min(ranked)["choice"]
