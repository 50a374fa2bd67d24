"""Leaf features and rule-based labels, as projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig, WeakLabelConfig
from ..functions.geometry import AXES, clamp, d, extent, safe_divide

#: The columns of a feature file, in order.
FEATURE_COLUMNS = [
    "node_index", "entity_id", "morton_code", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "num_points",
    "voxel_volume", "density", "log_density", "surface_density", "voxel_size", "depth", "normalized_depth",
    "center_x", "center_y", "center_z", "story_index", "story_local_z", "relative_height_from_floor",
    "relative_distance_to_ceiling", "height_ratio", "is_near_floor", "is_near_ceiling", "avg_normal_x", "avg_normal_y",
    "avg_normal_z", "normal_magnitude", "verticality", "horizontality", "slope_angle_rad", "roughness_proxy",
    "eigenvalue_0", "eigenvalue_1", "eigenvalue_2", "pca_linearity", "pca_flatness", "pca_roughness", "pca_curvature",
    "aabb_flatness", "aabb_linearity", "aabb_anisotropy", "xy_area", "z_extent", "morton_low_8bits", "label",
    "obstacle_probability",
]
#: What names a leaf or is predicted; the rest are model inputs.
NOT_INPUTS = {"node_index", "entity_id", "morton_code", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "label", "obstacle_probability"}


def vertical_context(z: Column, cfg: FeatureConfig | WeakLabelConfig, near_floor: float, near_ceiling: float) -> dict[str, Column]:
    """Where a height is within its story."""
    tall = cfg.story_height > 1e-6
    story = F.floor((z - cfg.floor_z) / cfg.story_height).cast("int") if tall else F.lit(0)
    local = z - (cfg.floor_z + story * cfg.story_height) if tall else z - cfg.floor_z
    above, under = local - cfg.floor_surface_offset, cfg.ceiling_offset - local
    return {
        "story_index": story,
        "story_local_z": local,
        "relative_height_from_floor": above,
        "relative_distance_to_ceiling": under,
        "height_ratio": clamp(safe_divide(above, F.lit(cfg.ceiling_offset - cfg.floor_surface_offset)), 0, 1),
        "is_near_floor": (F.abs(above) <= near_floor).cast("int"),
        "is_near_ceiling": (F.abs(under) <= near_ceiling).cast("int"),
    }


def leaf_features(leaves: DataFrame, cfg: FeatureConfig = FeatureConfig(), keep: list[str] | None = None) -> DataFrame:
    """The feature columns of leaves (bounds, n, depth, normal_x.., eigenvalue_0.., shape measures, label, probability)."""
    e = cfg.epsilon
    df = leaves.select("*", *[F.greatest(F.lit(0.0), extent(a)).alias(f"_d{a}") for a in AXES])
    dx, dy, dz = (F.col(f"_d{a}") for a in AXES)
    nx, ny, nz = (d(f"normal_{a}") for a in AXES)
    n = d("n")
    space = F.greatest(F.lit(e), dx * dy * dz)
    surface = (dx * dy + dy * dz + dx * dz) * 2.0
    sides = F.array_sort(F.array(dx, dy, dz))
    shortest, middle, longest = sides[0], sides[1], F.greatest(sides[2], F.lit(e))
    z = (d("min_z") + d("max_z")) * 0.5
    columns: dict[str, Column] = {
        "entity_id": F.col("entity_id"),
        **{f"{side}_{a}": F.col(f"{side}_{a}") for side in ("min", "max") for a in AXES},
        "num_points": F.col("n"),
        "voxel_volume": space,
        "density": n / space,
        "log_density": F.log1p(n / space),
        "surface_density": safe_divide(n, surface),
        "voxel_size": dx,
        "depth": F.col("depth"),
        "normalized_depth": d("depth") / 32.0,
        **{f"center_{a}": (d(f"min_{a}") + d(f"max_{a}")) * 0.5 for a in AXES},
        **vertical_context(z, cfg, cfg.near_floor_z, cfg.near_ceiling_z),
        **{f"avg_normal_{a}": d(f"normal_{a}") for a in AXES},
        "normal_magnitude": F.sqrt(nx * nx + ny * ny + nz * nz),
        "verticality": F.abs(nz),
        "horizontality": F.sqrt(nx * nx + ny * ny),
        "slope_angle_rad": F.acos(clamp(F.abs(nz), 0, 1)),
        "roughness_proxy": clamp(1.0 - F.sqrt(nx * nx + ny * ny + nz * nz), 0, 1),
        **{f"eigenvalue_{i}": d(f"eigenvalue_{i}") for i in range(3)},
        **{f"pca_{k}": d(k) for k in ("linearity", "flatness", "roughness", "curvature")},
        "aabb_flatness": safe_divide(shortest, longest),
        "aabb_linearity": safe_divide(longest, F.greatest(middle, F.lit(e))),
        "aabb_anisotropy": safe_divide(longest - shortest, longest),
        "xy_area": dx * dy,
        "z_extent": dz,
        "label": F.col("label"),
        "obstacle_probability": clamp(F.col("probability"), 0, 1),
    }
    if "node_index" in df.columns:
        columns["node_index"] = F.col("node_index")
    if "morton_code" in df.columns:
        columns |= {"morton_code": F.col("morton_code"), "morton_low_8bits": F.col("morton_code").bitwiseAND(0xFF).cast("int")}
    ordered = [columns[c].alias(c) for c in FEATURE_COLUMNS if c in columns]
    return df.select(*(keep or []), *ordered)


def feature_vector(rows: DataFrame, names: list[str]) -> Column:
    """The features of the given names, as doubles in their order; a name that rows have no column for counts as 0."""
    return F.array(*[d(n) if n in rows.columns else F.lit(0.0) for n in names])


def weak_labels(leaves: DataFrame, cfg: WeakLabelConfig = WeakLabelConfig()) -> DataFrame:
    """Leaves with label and probability by rule: floors are free, slopes above them stairs, and what stands above is in the way."""
    nx, ny, nz = (d(f"normal_{a}") for a in AXES)
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    upright = F.when(size > 1e-6, F.abs(nz) / size).otherwise(F.lit(0.0))
    slope = F.acos(clamp(upright, 0, 1))
    at = vertical_context((d("min_z") + d("max_z")) * 0.5, cfg, cfg.floor_band, cfg.floor_band)
    height = at["relative_height_from_floor"]
    enough = F.col("n") >= cfg.min_points
    floor = enough & (at["is_near_floor"] == 1) & (upright >= math.cos(cfg.free_max_slope_rad)) & (d("flatness") >= 0.35)
    stair = enough & (height >= cfg.min_stair_height) & (at["story_local_z"] <= cfg.ceiling_offset) & slope.between(cfg.stair_min_slope_rad, cfg.stair_max_slope_rad) & (d("flatness") >= 0.25)
    above = enough & (height > cfg.floor_band)
    label = F.when(floor, 0).when(stair, 2).otherwise(1)
    p = F.when(floor, 0.05).when(stair, 0.25).when(above & (upright < 0.45), 0.90).when(above, 0.75).when(enough, 0.65).otherwise(0.50)
    return leaves.withColumn("label", label).withColumn("probability", p)
