"""Scenes as grids: world and cell places, footprints, visibility, viewpoints, windows, lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Grid, MapSize
from ..functions.pose import rotate
from .stencil import cone, shifted

HEADINGS = tuple(range(0, 360, 30))


def world_to_grid(x: Column, z: Column, grid: Grid, rounded: bool = True) -> Column:
    """(row, col); halves go to the even cell, or all to the lower one."""
    cell = (lambda v: F.rint(v)) if rounded else (lambda v: F.floor(v))
    return F.struct(
        cell((z - grid.z0) / grid.metres).cast("int").alias("row"),
        cell((x - grid.x0) / grid.metres).cast("int").alias("col"),
    )


def grid_to_world(row: Column, col: Column, grid: Grid) -> Column:
    return F.struct((F.lit(grid.x0) + col * grid.metres).alias("x"), (F.lit(grid.z0) + row * grid.metres).alias("z"))


def box_corners(low: Column, high: Column, rotation: Column, translation: Column) -> Column:
    """The eight corners (x, y, z) of a turned and moved box; z changes fastest."""
    out = []
    for i in range(8):
        pick = [(high if i >> (2 - k) & 1 else low)[c] for k, c in enumerate("xyz")]
        turned = rotate(rotation, tuple(pick))
        out.append(F.struct(*[(turned[c] + translation[c]).alias(c) for c in "xyz"]))
    return F.array(*out)


def footprint(objects: DataFrame, grid: Grid, height: int, width: int, keys: list[str], corners: str = "corners") -> DataFrame:
    """(keys..., row, col): the cells of the convex quadrangle of corners 0, 1, 6 and 7.

    Corners go to the nearest cells, are clipped to the grid and ordered by their angle about
    the middle; a cell belongs to it on or within all four sides.
    """
    four = [F.get(corners, F.lit(i)) for i in (0, 1, 6, 7)]
    cells = [world_to_grid(c["x"], c["z"], grid) for c in four]
    clipped = F.array(
        *[
            F.struct(
                F.greatest(F.lit(0), F.least(F.lit(height - 1), c["row"])).alias("row"),
                F.greatest(F.lit(0), F.least(F.lit(width - 1), c["col"])).alias("col"),
            )
            for c in cells
        ]
    )
    placed = objects.select(*keys, clipped.alias("_c"))
    mean = lambda f: F.aggregate("_c", F.lit(0.0), lambda a, c: a + c[f]) / 4
    placed = placed.withColumn("_mr", mean("row")).withColumn("_mc", mean("col"))
    turn = F.transform("_c", lambda c: F.struct(F.atan2(c["row"] - F.col("_mr"), c["col"] - F.col("_mc")).alias("a"), c["row"].alias("row"), c["col"].alias("col")))
    placed = placed.withColumn("_p", F.array_sort(turn))
    edge = lambda f, pick: pick(F.transform("_p", lambda p: p[f]))
    filled = placed.withColumn("row", F.explode(F.sequence(edge("row", F.array_min), edge("row", F.array_max))))
    filled = filled.withColumn("col", F.explode(F.sequence(edge("col", F.array_min), edge("col", F.array_max))))
    within = F.lit(True)
    for i in range(4):
        a, b = F.get("_p", F.lit(i)), F.get("_p", F.lit((i + 1) % 4))
        within &= (b["col"] - a["col"]) * (F.col("row") - a["row"]) - (b["row"] - a["row"]) * (F.col("col") - a["col"]) >= 0
    return filled.where(within).select(*keys, "row", "col").distinct()


def visible_from(objects: DataFrame, fov_deg: float, low: int, high: int, headings=HEADINGS) -> DataFrame:
    """(keys..., yaw_deg, row, col): places and headings that see an object's cell in their cone.
    Nothing hides an object."""
    offsets = [(a, b, yaw) for yaw in headings for a, b in cone(yaw, fov_deg, low, high)]
    return shifted(objects, offsets, "yaw_deg", sign=-1).distinct()


def viewpoints(objects: DataFrame, navigable: DataFrame, grid: Grid, near: float = 0.5, far: float = 2.0, spacing: float = 0.5, fov_deg: float = 10.0) -> DataFrame:
    """Navigable places on the spacing grid, with a heading, that see an object.

    objects: (keys..., row, col); navigable: (row, col) and those keys it shares with objects.
    Adds x, z and the heading's yaw in degrees.
    """
    step = max(1, int(spacing / grid.metres))
    seen = visible_from(objects, fov_deg, int(near / grid.metres), int(far / grid.metres))
    seen = seen.where((F.pmod("row", F.lit(step)) == 0) & (F.pmod("col", F.lit(step)) == 0))
    shared = [c for c in navigable.columns if c in seen.columns]
    found = seen.join(navigable.select(*shared), shared, "left_semi")
    return found.withColumn("_w", grid_to_world(F.col("row"), F.col("col"), grid)).select(
        *seen.columns, "_w.x", "_w.z"
    )


def agent_states(navigable: DataFrame) -> DataFrame:
    """Each navigable place with each heading."""
    return navigable.withColumn("yaw_deg", F.explode(F.array(*[F.lit(h) for h in HEADINGS])))


def window(row: Column, col: Column, size: MapSize) -> Column:
    """(top, bottom, left, right) of the local window around a cell, moved into the map."""
    big, small = size.global_cells, size.local_cells
    if size.downscaling <= 1:
        return F.struct(*[F.lit(v).alias(n) for n, v in (("top", 0), ("bottom", big), ("left", 0), ("right", big))])
    low = lambda c: F.greatest(F.lit(0), F.least(c - small // 2, F.lit(big - small)))
    return F.struct(
        low(row).alias("top"), (low(row) + small).alias("bottom"), low(col).alias("left"), (low(col) + small).alias("right")
    )


def recentre(poses: DataFrame, size: MapSize, x: str = "x", y: str = "y") -> DataFrame:
    """poses (metres in the global map) with the window, its origin and the pose within it."""
    cell = lambda c: F.floor(F.col(c) * 100 / size.resolution_cm).cast("int")
    w = F.col("_w")
    metre = size.resolution_cm / 100
    return (
        poses.withColumn("_w", window(cell(y), cell(x), size))
        .withColumn("origin_x", w["left"] * metre)
        .withColumn("origin_y", w["top"] * metre)
        .select(
            *poses.columns,
            "_w.top", "_w.bottom", "_w.left", "_w.right",
            "origin_x", "origin_y",
            (F.col(x) - F.col("origin_x")).alias("local_x"),
            (F.col(y) - F.col("origin_y")).alias("local_y"),
        )
    )


def global_to_local(row: Column, col: Column, top: Column, left: Column) -> Column:
    return F.struct((row - top).alias("row"), (col - left).alias("col"))


def local_to_global(row: Column, col: Column, top: Column, left: Column) -> Column:
    return F.struct((row + top).alias("row"), (col + left).alias("col"))


def line_cells(lines: DataFrame, keys: list[str], steps: int = 25, thickness: int = 1) -> DataFrame:
    """(keys..., row, col) of lines (r0, c0) to (r1, c1): points at equal steps, rounded to the
    even cell on halves, each a square from -thickness up to and without +thickness."""
    t = F.col("_i") / steps
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * t).cast("int")
    points = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).select(
        *keys, at("r0", "r1").alias("row"), at("c0", "c1").alias("col")
    )
    around = range(-thickness, thickness)
    return shifted(points, [(a, b) for a in around for b in around]).distinct()


def clamp_cells(row: Column, col: Column, height: int, width: int) -> Column:
    low = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    return F.struct(low(row, height).alias("row"), low(col, width).alias("col"))


def heading_quaternion(yaw_deg: Column) -> Column:
    """(w, x, y, z) of a heading less a quarter turn, about y."""
    half = (F.radians(yaw_deg.cast("double")) - math.pi / 2) / 2
    return F.struct(F.cos(half).alias("w"), F.lit(0.0).alias("x"), F.sin(half).alias("y"), F.lit(0.0).alias("z"))
