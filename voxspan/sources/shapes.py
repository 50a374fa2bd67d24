"""Points on the surfaces of scene shapes, as generators: a row for each shape in, a row for each point out.

Points on shared edges come once for each face they are on, by design.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, d, rotate

#: The least spacing.
LEAST_SPACING = 1e-3


def _spacing(s: float) -> float:
    return max(LEAST_SPACING, s)


def _steps(length: Column, spacing: float, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.ceil(d(length) / spacing).cast("int"))


def _grid(df: DataFrame, name: str, steps: Column, closed: bool = True) -> DataFrame:
    """A row for each i from 0 to the number of steps (without the last if not closed)."""
    df = df.withColumn(f"_n{name}", steps)
    return df.withColumn(f"_i{name}", F.explode(F.sequence(F.lit(0), F.col(f"_n{name}") - (0 if closed else 1))))


def _at(size: Column, name: str) -> Column:
    return d(size) * F.col(f"_i{name}") / F.col(f"_n{name}") - d(size) * 0.5


def _points(df: DataFrame, keys: list[str], x: Column, y: Column, z: Column) -> DataFrame:
    return df.select(*keys, x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"))


def sample_box(shapes: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """All six faces of boxes (size_x, size_y, size_z) around the origin."""
    s, out = _spacing(spacing), None
    for flat in reversed(AXES):
        u, v = (a for a in AXES if a != flat)
        face = _grid(_grid(shapes, "u", _steps(F.col(f"size_{u}"), s)), "v", _steps(F.col(f"size_{v}"), s))
        face = face.withColumn("_side", F.explode(F.array(F.lit(-0.5), F.lit(0.5))))
        at = {u: _at(F.col(f"size_{u}"), "u"), v: _at(F.col(f"size_{v}"), "v"), flat: d(f"size_{flat}") * F.col("_side")}
        face = _points(face, keys, at["x"], at["y"], at["z"])
        out = face if out is None else out.unionByName(face)
    return out


def sample_cylinder(shapes: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """The side and both caps (rings around a middle point) of cylinders (radius, length)."""
    s, r = _spacing(spacing), d("radius")
    turn = 2.0 * math.pi
    side = _grid(_grid(shapes, "z", _steps(F.col("length"), s)), "t", _steps(r * turn, s, 12), closed=False)
    angle = F.col("_it") * turn / F.col("_nt")
    out = _points(side, keys, r * F.cos(angle), r * F.sin(angle), _at(F.col("length"), "z"))
    caps = shapes.withColumn("_end", F.explode(F.array(F.lit(-0.5), F.lit(0.5))))
    out = out.unionByName(_points(caps, keys, F.lit(0.0), F.lit(0.0), d("length") * F.col("_end")))
    rings = _grid(caps, "r", _steps(r, s)).where("_ir > 0").withColumn("_ring", r * F.col("_ir") / F.col("_nr"))
    rings = _grid(rings, "t", _steps(F.col("_ring") * turn, s, 8), closed=False)
    angle = F.col("_it") * turn / F.col("_nt")
    return out.unionByName(_points(rings, keys, F.col("_ring") * F.cos(angle), F.col("_ring") * F.sin(angle), d("length") * F.col("_end")))


def sample_sphere(shapes: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """An even spiral over spheres (radius): 32 points, or as many as the area has squares of the spacing."""
    s, r = _spacing(spacing), d("radius")
    df = _grid(shapes, "p", F.greatest(F.lit(32), F.ceil(r * r * (4.0 * math.pi) / (s * s)).cast("int")), closed=False)
    up = F.lit(1.0) - (F.col("_ip") * 2.0 + 1.0) / F.col("_np")
    out = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - up * up))
    angle = F.col("_ip") * (math.pi * (3.0 - math.sqrt(5.0)))
    return _points(df, keys, r * out * F.cos(angle), r * out * F.sin(angle), r * up)


def turn_from_up(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column, Column, Column]:
    """The unit quaternion that turns the z axis to a direction; to its opposite by way of the x axis."""
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    x, y, z = nx / size, ny / size, nz / size
    w = F.sqrt(F.greatest(F.lit(0.0), (z + 1.0) * 0.5))
    flipped = w < 1e-9
    half = F.when(flipped, F.lit(1.0)).otherwise(w * 2.0)
    return w, F.when(flipped, 1.0).otherwise(-y / half), F.when(flipped, 0.0).otherwise(x / half), F.lit(0.0)


def sample_plane(shapes: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """A grid over planes (size_x, size_y) turned to their normal (normal_x, normal_y, normal_z)."""
    s = _spacing(spacing)
    df = _grid(_grid(shapes, "u", _steps(F.col("size_x"), s)), "v", _steps(F.col("size_y"), s))
    q = turn_from_up(*(d(f"normal_{a}") for a in AXES))
    return _points(df, keys, *rotate(q, (_at(F.col("size_x"), "u"), _at(F.col("size_y"), "v"), F.lit(0.0))))


def sample_triangles(triangles: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """A grid in barycentric coordinates over triangles (ax, ay, az, bx, .., cz); those without area are left out."""
    s = _spacing(spacing)

    def diff(p: str, q: str) -> list[Column]:
        return [d(f"{q}{k}") - d(f"{p}{k}") for k in AXES]

    def size(v: list[Column]) -> Column:
        return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])

    u, v = diff("a", "b"), diff("a", "c")
    area = size([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
    longest = F.greatest(size(u), size(v), size(diff("b", "c")))
    df = _grid(triangles.where(area >= 1e-9), "u", _steps(longest, s))
    df = df.withColumn("_iv", F.explode(F.sequence(F.lit(0), F.col("_nu") - F.col("_iu"))))
    p, q = F.col("_iu") / F.col("_nu"), F.col("_iv") / F.col("_nu")
    return _points(df, keys, *[(F.lit(1.0) - p - q) * d(f"a{k}") + p * d(f"b{k}") + q * d(f"c{k}") for k in AXES])


def mesh_triangles(vertices: DataFrame, indices: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles of submeshes: vertices (keys, vertex, x, y, z) by indices (keys, at, vertex), three in a row; submeshes
    without a triangle of indices take their vertices three in a row."""
    valid = indices.join(vertices, [*keys, "vertex"]).select(*keys, "at", *AXES)
    own = vertices.join(valid.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("vertex").alias("at"), *AXES)

    def three(rows: DataFrame) -> DataFrame:
        corner = F.pmod("at", F.lit(3))
        corners = [F.max(F.when(corner == i, F.col(k))).alias(f"{c}{k}") for i, c in enumerate("abc") for k in AXES]
        return rows.groupBy(*keys, F.floor(F.col("at") / 3).alias("triangle")).agg(F.count(F.lit(1)).alias("_n"), *corners).where("_n = 3").drop("_n")

    return three(valid).unionByName(three(own))


def demo_grid(spark, n: int = 10) -> DataFrame:
    """A level n x n grid of points one metre apart."""
    return spark.range(n * n).select((F.col("id") % n).cast("float").alias("x"), F.floor(F.col("id") / n).cast("float").alias("y"), F.lit(1.0).cast("float").alias("z"))


#: What one mesh is known by: its file and its scale.
MESH_KEY = ["uri", "scale_x", "scale_y", "scale_z"]


def sample_meshes(shapes: DataFrame, vertices: DataFrame, indices: DataFrame, spacing: float, keys: list[str]) -> DataFrame:
    """Points of meshes (uri, scale_x, scale_y, scale_z), from the vertices (uri, submesh, vertex, x, y, z) and indices
    (uri, submesh, at, vertex) of their files. Each file and scale is sampled once, however many shapes use it; shapes
    without a uri, or whose file is not there, give no points."""
    wanted = shapes.where("uri is not null and uri <> ''")
    distinct = wanted.select(*MESH_KEY).distinct()
    corners = [f"{c}{k}" for c in "abc" for k in AXES]
    triangles = mesh_triangles(vertices, indices, ["uri", "submesh"]).join(distinct, "uri")
    scaled = triangles.select(*MESH_KEY, *[(d(c) * d(f"scale_{c[1]}")).alias(c) for c in corners])
    points = sample_triangles(scaled, spacing, MESH_KEY)
    return wanted.select(*keys, *MESH_KEY).join(points, MESH_KEY).select(*keys, *AXES)


def sample_shapes(shapes: DataFrame, spacing: float, keys: list[str], vertices: DataFrame | None = None, indices: DataFrame | None = None) -> DataFrame:
    """Points of boxes, cylinders, spheres and planes by geometry_type, and of meshes where their vertices and indices are given; other types give none."""
    kinds = [("BOX", sample_box), ("CYLINDER", sample_cylinder), ("SPHERE", sample_sphere), ("PLANE", sample_plane)]
    if vertices is not None and indices is not None:
        kinds.append(("MESH", lambda own, s, k: sample_meshes(own, vertices, indices, s, k)))
    out = None
    for kind, sample in kinds:
        own = sample(shapes.where(F.col("geometry_type") == kind), spacing, keys)
        out = own if out is None else out.unionByName(own)
    return out


def scene_collisions(models: DataFrame, links: DataFrame, collisions: DataFrame) -> DataFrame:
    """Collisions with the names of their link and model: two equi-joins from the small sides."""
    named = collisions.join(links, "link_id").join(models, "model_id")
    return named.withColumn("scoped_name", F.concat_ws("::", "model_name", "link_name", "collision_name"))


def entity_delta(live: DataFrame, cached: DataFrame, key: str = "entity_key") -> DataFrame:
    """Entities that appeared and those that went, as rows with change = added or removed."""
    added = live.join(cached.select(key), key, "left_anti").select(key, F.lit("added").alias("change"))
    removed = cached.join(live.select(key), key, "left_anti").select(key, F.lit("removed").alias("change"))
    return added.unionByName(removed)
