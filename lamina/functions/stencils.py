"""Structuring elements and neighbourhoods as small literal tables."""

from __future__ import annotations

from itertools import product
from math import floor, isqrt

Span = tuple[int, int, int]  # (dz, dy, half width along x)


def ball_spans(radius: float) -> list[Span]:
    """Lines of the ball ``dz^2 + dy^2 + dx^2 <= radius^2``."""
    limit = floor(radius * radius)
    reach = range(-floor(radius), floor(radius) + 1)
    return [
        (dz, dy, isqrt(limit - dz * dz - dy * dy))
        for dz, dy in product(reach, reach)
        if dz * dz + dy * dy <= limit
    ]


def cross_spans() -> list[Span]:
    """A voxel and its six face neighbours."""
    return ball_spans(1)


def ball_offsets(radius: float) -> list[tuple[int, int, int]]:
    return [(dz, dy, dx) for dz, dy, hw in ball_spans(radius) for dx in range(-hw, hw + 1)]


def line_reach(connectivity: int) -> list[Span]:
    """Forward line neighbours ``(dz, dy, slack along x)`` of a run.

    4 and 8 are the planar neighbourhoods of data that lies in one z plane.
    """
    if connectivity == 4:
        return [(0, 1, 0)]
    if connectivity == 8:
        return [(0, 1, 1)]
    if connectivity == 6:
        return [(0, 1, 0), (1, 0, 0)]
    if connectivity == 18:
        return [(0, 1, 1), (1, 0, 1), (1, -1, 0), (1, 1, 0)]
    if connectivity == 26:
        return [(0, 1, 1), (1, -1, 1), (1, 0, 1), (1, 1, 1)]
    raise ValueError(f"unknown connectivity {connectivity}")
