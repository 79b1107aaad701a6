"""Label classes, column names and operator settings."""

from __future__ import annotations

from dataclasses import dataclass

# Label classes of a volume.
BACKGROUND, SURFACE, IGNORE = 0, 1, 2
LABEL_NAMES = {BACKGROUND: "background", SURFACE: "surface", IGNORE: "ignore"}

COORDS = ["z", "y", "x"]
VOXEL = ["volume_id", "z", "y", "x"]

# Weights and tolerances of the case score.
TOPO_WEIGHT, DICE_WEIGHT, VOI_WEIGHT = 0.30, 0.35, 0.35
BETTI_WEIGHTS = (0.34, 0.33, 0.33)
SURFACE_TOLERANCE = 2.0
VOI_ALPHA = 0.3

# Cleanup stages in operational order.
STAGES = ("raw", "remove_small", "closing", "patch", "plug", "fill")


@dataclass(frozen=True)
class CleanupSettings:
    min_size: int = 20_000
    closing_radius: int = 3
    connectivity: int = 26
    closing: bool = True
    patching: bool = True
    plugging: bool = True
    filling: bool = True
    surface_label: int = SURFACE
    threshold: float = 0.5
    plug_rounds: int = 5


@dataclass(frozen=True)
class UnmergeSettings:
    erosion_radius: int = 1
    min_seed_size: int = 100
    min_piece_size: int = 100
    cut_width: int = 1
    connectivity: int = 26
    min_score_delta: float = 0.0
    budget: int | None = None


@dataclass(frozen=True)
class BridgeSettings:
    max_gap: float = 12.0
    angle_tolerance: float = 60.0
    min_size: int = 200
    tangent_radius: float = 6.0
    tube_radius: int = 1
    connectivity: int = 26
    min_score_delta: float = 0.0


@dataclass(frozen=True)
class PatchSettings:
    size: tuple[int, int, int] = (128, 128, 128)
    stride: tuple[int, int, int] = (64, 64, 64)
    image_pad: float = 0.0
    label_pad: int = IGNORE
    min_labeled: float = 0.1
    min_foreground: float = 0.0

    def __post_init__(self):
        if min(*self.size, *self.stride) <= 0:
            raise ValueError("patch size and stride must be positive")
