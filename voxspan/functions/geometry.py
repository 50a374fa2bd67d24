"""Column helpers: clamps, distances, cell paths and Morton codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

AXES = ("x", "y", "z")
TOUCH = 2e-4


def d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), d(c)))


def safe_divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(F.abs(b) > 1e-6, a / b).otherwise(F.lit(otherwise))


def is_finite(c: Column | str) -> Column:
    c = d(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def centers(prefix: str = "") -> list[Column]:
    """Centre of a box as doubles, from its float32 bounds."""
    return [((d(f"{prefix}min_{a}") + d(f"{prefix}max_{a}")) * 0.5).alias(f"{prefix}c{a}") for a in AXES]


def distance(a: str, b: str) -> Column:
    """Between points with columns <a>cx.. and <b>cx.. ."""
    x, y, z = (F.col(f"{a}c{k}") - F.col(f"{b}c{k}") for k in AXES)
    return F.sqrt(x * x + y * y + z * z)


def planar(a: str, b: str) -> Column:
    x, y = (F.col(f"{a}c{k}") - F.col(f"{b}c{k}") for k in "xy")
    return F.sqrt(x * x + y * y)


def extent(axis: str, prefix: str = "") -> Column:
    return d(f"{prefix}max_{axis}") - d(f"{prefix}min_{axis}")


def max_extent(prefix: str = "") -> Column:
    return F.greatest(*[extent(a, prefix) for a in AXES])


def box_contains(prefix: str = "root_", point: tuple[str, str, str] = AXES) -> Column:
    out = F.lit(True)
    for p, a in zip(point, AXES, strict=True):
        out = out & (F.col(p) >= F.col(f"{prefix}min_{a}")) & (F.col(p) <= F.col(f"{prefix}max_{a}"))
    return out


def nearly_touches(a: Column, b: Column) -> Column:
    return F.abs(d(a) - d(b)) <= TOUCH


def ranges_overlap(a: str, b: str, axis: str) -> Column:
    return F.greatest(d(f"{a}min_{axis}"), d(f"{b}min_{axis}")) <= F.least(d(f"{a}max_{axis}"), d(f"{b}max_{axis}")) + TOUCH


def _halves(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, upper: bool) -> np.ndarray:
    """Bits of the halves that x falls into, from the whole to the smallest, in float32. upper: a point on the cut belongs to the upper half."""
    code = np.zeros(len(x), np.int64)
    half = np.float32(0.5)
    for _ in range(depth):
        mid = half * (lo + hi)
        bit = x >= mid if upper else x > mid
        lo, hi = np.where(bit, mid, lo), np.where(bit, hi, mid)
        code = code << 1 | bit
    return code


def _interleave(parts: list[np.ndarray], depth: int) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.int64)
    for level in range(depth):
        for axis, code in enumerate(parts):
            out |= ((code >> level) & 1) << (3 * level + axis)
    return out


def cell_code(depth: int):
    """A column function (x, y, z, root bounds) -> the path of the cell at `depth`: three bits a level, x lowest."""

    @pandas_udf("long")
    def code(x: pd.Series, y: pd.Series, z: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.Series:
        f = [s.to_numpy(np.float32) for s in (x, y, z, ax, ay, az, bx, by, bz)]
        return pd.Series(_interleave([_halves(f[i], f[3 + i], f[6 + i], depth, True) for i in range(3)], depth))

    return code


def place(depth: str, path: str) -> Column:
    """Depth and path of a cell (columns) as one long: a one before the path's bits."""
    return F.expr(f"shiftleft(1L, cast(3 * {depth} as int)) | {path}")


def cell_codes(depth: int):
    """Like cell_code, but the paths of all cells at `depth` that hold a point; a point on cuts is in those of both sides, of cuts at any depth."""

    @pandas_udf("array<long>")
    def codes(x: pd.Series, y: pd.Series, z: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.Series:
        f = [s.to_numpy(np.float32) for s in (x, y, z, ax, ay, az, bx, by, bz)]
        both = [[_interleave([_halves(f[i], f[3 + i], f[6 + i], depth, upper)], depth) << i for upper in (True, False)] for i in range(3)]
        every = np.sort(np.stack([both[0][k & 1] | both[1][k >> 1 & 1] | both[2][k >> 2] for k in range(8)], 1), 1)
        new = np.ones(every.shape, bool)
        new[:, 1:] = every[:, 1:] != every[:, :-1]
        return pd.Series(np.split(every[new], np.cumsum(new.sum(1))[:-1])) if len(every) else pd.Series([], dtype=object)

    return codes


def cell_bounds():
    """A column function (path, depth, root bounds) -> struct of the cell's bounds, by the same cuts as cell_code."""

    @pandas_udf("min_x float, min_y float, min_z float, max_x float, max_y float, max_z float")
    def bounds(code: pd.Series, depth: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.DataFrame:
        c, n = code.to_numpy(np.int64), depth.to_numpy(np.int64)
        lo = [s.to_numpy(np.float32).copy() for s in (ax, ay, az)]
        hi = [s.to_numpy(np.float32).copy() for s in (bx, by, bz)]
        for level in range(int(n.max()) if len(n) else 0):
            live = level < n
            octant = c >> np.maximum(3 * (n - 1 - level), 0)
            for i in range(3):
                mid = np.float32(0.5) * (lo[i] + hi[i])
                upper = (octant >> i & 1).astype(bool)
                lo[i], hi[i] = np.where(live & upper, mid, lo[i]), np.where(live & ~upper, mid, hi[i])
        return pd.DataFrame(dict(zip(("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"), lo + hi, strict=True)))

    return bounds


#: The shifts and masks that spread 21 bits over 63.
def spread_bits(c: Column) -> Column:
    """21 bits with two zeros after each."""
    c = c.bitwiseAND(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(depth: Column, max_depth: int, point: tuple[Column, Column, Column], root: str = "root_") -> Column:
    """The Morton code of a point in the root box with the depth in the top four bits, as the long with those bits."""
    grid = float((1 << min(max_depth, 20)) - 1)
    code = F.shiftleft(depth.cast("long"), 60)
    for i, (p, a) in enumerate(zip(point, AXES, strict=True)):
        lo, hi = F.col(f"{root}min_{a}").cast("float"), F.col(f"{root}max_{a}").cast("float")
        scale = F.when(hi - lo > F.lit(0.0).cast("float"), F.lit(grid).cast("float") / (hi - lo)).otherwise(F.lit(0.0).cast("float")).cast("float")
        cell = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(grid).cast("float"), ((p.cast("float") - lo) * scale).cast("float"))).cast("long")
        code = code.bitwiseOR(F.shiftleft(spread_bits(cell), i))
    return code


def unsigned(c: Column) -> Column:
    """A long's bits as an unsigned number."""
    c = c.cast("decimal(20,0)")
    return F.when(c < 0, c + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c).cast("decimal(20,0)")


def rotate(q: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    a, b, c = v
    # twice the cross product of the imaginary part with v
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return a + w * tx + y * tz - z * ty, b + w * ty + z * tx - x * tz, c + w * tz + x * ty - y * tx
