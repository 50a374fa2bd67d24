"""Settings of the operators. The defaults are fixed values: results depend on them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

FREE, OBSTACLE, STAIR = 0, 1, 2


@dataclass(frozen=True)
class OctreeConfig:
    max_depth: int = 9
    corridor_min_voxel: float = 0.20
    corridor_max_voxel: float = 0.50
    stair_min_voxel: float = 0.05
    stair_max_voxel: float = 0.10
    min_points_to_split: int = 6
    dense_points_to_split: int = 36
    dense_points_per_m3: float = 220.0
    dynamic_decay: float = 0.80
    flood_fill_max_depth: int = 2
    blocked_probability: float = 0.95

    def __post_init__(self):
        if not 0 <= self.max_depth <= 20:
            raise ValueError("max_depth is 0 to 20: a path takes three bits a level")


@dataclass(frozen=True)
class FeatureConfig:
    floor_z: float = 0.0
    story_height: float = 4.0
    floor_surface_offset: float = 1.0
    ceiling_offset: float = 4.0
    near_floor_z: float = 0.4
    near_ceiling_z: float = 0.4
    epsilon: float = 1e-6


@dataclass(frozen=True)
class WeakLabelConfig:
    floor_z: float = 0.0
    story_height: float = 4.0
    floor_surface_offset: float = 1.0
    ceiling_offset: float = 4.0
    floor_band: float = 0.35
    free_max_slope_rad: float = 0.30
    stair_min_slope_rad: float = 0.25
    stair_max_slope_rad: float = 0.90
    min_stair_height: float = 0.08
    min_points: int = 3


@dataclass(frozen=True)
class PlannerConfig:
    allow_cross_floor: bool = True
    max_expansions: int = 200_000
    heuristic_weight: float = 1.15
    probability_weight: float = 6.0
    stair_weight: float = 1.25
    cross_floor_weight: float = 2.0
    vertical_weight: float = 0.75
    obstacle_block_probability: float = 0.92
    enable_obstacle_clearance: bool = True
    obstacle_clearance_radius: float = 0.15
    obstacle_clearance_z_tolerance: float = 1.5
    block_edges_through_obstacles: bool = True
    edge_obstacle_clearance_radius: float = 0.03
    smooth_waypoints: bool = True
    snap_endpoints: bool = True
    endpoint_snap_radius: float = 1.5
    enable_stair_edges: bool = True
    stair_connection_radius: float = 1.25
    constrain_stair_transitions: bool = True
    stair_endpoint_tolerance: float = 0.6
    stair_step_max_vertical: float = 0.8
    stair_floor_connection_max_vertical: float = 1.2
    max_non_stair_vertical_step: float = 0.35
    constrain_stair_exits: bool = True
    floor_z: float = 0.0
    story_height: float = 4.0
    floor_surface_offset: float = 1.0
    stair_floor_exit_tolerance: float = 0.45
    constrain_stair_direction: bool = True
    stair_direction_dot_min: float = 0.5
    stair_entry_lateral_margin: float = 0.25
    stair_entry_forward_margin: float = 0.55

    @property
    def obstacle_cell(self) -> float:
        return max(0.25, self.obstacle_clearance_radius + 0.35)

    @property
    def end_band(self) -> float:
        return max(0.25, min(self.stair_endpoint_tolerance, max(self.stair_step_max_vertical, 0.25)))


def parse_point(text: str) -> tuple[float, float, float] | None:
    """A point from "X,Y,Z", or None."""
    parts = text.split(",")
    try:
        values = tuple(float(p) for p in parts)
    except ValueError:
        return None
    return values if len(values) == 3 else None  # type: ignore[return-value]


#: The settings that scripts pass by name, and the fields they stand for.
PLANNER_NAMES = {
    "PATH_BLOCK_PROBABILITY": "obstacle_block_probability",
    "PATH_PROBABILITY_WEIGHT": "probability_weight",
    "PATH_VERTICAL_WEIGHT": "vertical_weight",
    "PATH_STAIR_CONNECTION_RADIUS": "stair_connection_radius",
    "PATH_MAX_NON_STAIR_VERTICAL_STEP": "max_non_stair_vertical_step",
    "PATH_STAIR_FLOOR_EXIT_TOLERANCE": "stair_floor_exit_tolerance",
    "FEATURE_FLOOR_Z": "floor_z",
    "FEATURE_STORY_HEIGHT": "story_height",
    "FEATURE_FLOOR_SURFACE_OFFSET": "floor_surface_offset",
}


def from_names(kind: type, given: Mapping[str, str], names: Mapping[str, str] = PLANNER_NAMES):
    """Settings of a kind from texts by name; names that the kind has no field for are left out, and defaults fill the rest."""
    known = {f.name: f for f in fields(kind)}
    values = {}
    for name, field in names.items():
        if name in given and field in known:
            default = known[field].default
            values[field] = given[name].lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(float(given[name]))
    return kind(**values)
