"""Parameters as frozen dataclasses, and what is derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

#: Map channels; semantic ones follow.
OBSTACLE, EXPLORED, CURRENT, VISITED, BEEN_CLOSE, BLACKLISTED = range(6)
NON_SEMANTIC = 6


@dataclass(frozen=True)
class Camera:
    width: int = 640
    height: int = 480
    fov_deg: float = 79.0

    @property
    def centre(self) -> tuple[float, float]:
        return (self.width - 1) / 2, (self.height - 1) / 2

    @property
    def focal(self) -> float:
        return self.width / 2 / math.tan(math.radians(self.fov_deg) / 2)


@dataclass(frozen=True)
class MapSize:
    """Sizes of the global and the local map in cells."""

    map_cm: int = 4800
    resolution_cm: int = 5
    downscaling: int = 2

    @property
    def global_cells(self) -> int:
        return self.map_cm // self.resolution_cm

    @property
    def local_cells(self) -> int:
        return self.global_cells // self.downscaling


@dataclass(frozen=True)
class Mapping:
    """The map builder's parameters; heights in cm, radii in cells."""

    size: MapSize = MapSize()
    vision_range: int = 100
    min_voxel: int = -8
    max_voxel: int = 72
    min_mapped: int = 14
    max_mapped: int = 29
    stride: int = 4
    max_depth_cm: float = 500.0
    obstacle_threshold: float = 1.0
    explored_threshold: float = 1.0
    explored_radius: int = 10
    close_radius: int = 20
    blacklist_radius: int = 20


@dataclass(frozen=True)
class Grid:
    """A scene's grid: the world place of cell (0, 0) and a cell's side in metres."""

    x0: float = 0.0
    z0: float = 0.0
    metres: float = 0.25


@dataclass(frozen=True)
class Curation:
    min_area: int = 1000
    per_class: int = 100
    bins: int = 10
    top_bins: int = 5
    seed: int = 0

    @property
    def candidates_per_object(self) -> int:
        return self.per_class // 4


def from_mapping(kind, values: dict):
    """A dataclass from a parsed configuration; unknown names are an error."""
    known = {f.name for f in fields(kind)}
    if extra := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return kind(**values)


def read_yaml(path: str) -> dict:
    """A small configuration file, on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path) as f:
        return yaml.safe_load(f) or {}
