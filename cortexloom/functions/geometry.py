"""Column functions on section and atlas coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def atlas_coordinates(x: Column, y: Column, width: Column, height: Column, anchoring: Column) -> tuple[Column, Column, Column]:
    """Atlas position in um of a section pixel; ``anchoring`` holds origin, u and v, three numbers each, in voxels of 25 um."""
    fx, fy = x / (width - 1), y / (height - 1)
    xv, yv, zv = (fx * anchoring[3 + i] + fy * anchoring[6 + i] + anchoring[i] for i in range(3))
    return 13175 - 25 * yv, 7975 - 25 * zv, 25 * xv


def voxel_index(um: Column, resolution: float = 25.0) -> Column:
    """Index of the nearest voxel; halves go to the even one."""
    return F.rint(um / resolution).cast("int")


def barycentric(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """u, v with (x, y) = A + u (B - A) + v (C - A); null for a flat triangle."""
    det = F.nullif((bx - ax) * (cy - ay) - (cx - ax) * (by - ay), F.lit(0.0))
    u = ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det
    v = ((bx - ax) * (y - ay) - (x - ax) * (by - ay)) / det
    return u, v


def inside(u: Column, v: Column, slack: float = 1e-9) -> Column:
    """Whether barycentric coordinates lie in the triangle, its edges included."""
    return (u >= -slack) & (v >= -slack) & (u + v <= 1 + slack)


def exponential_decay(x: Column, a: float, b: float) -> Column:
    return a * F.exp(-b * x)
