"""Neighbourhood operators as equi-joins.

Grids are sparse tables of integer cells (keys..., row, col, value).  What looks at
(row + dr, col + dc) for constant offsets shifts the cells by the offsets first, so a
neighbourhood is an explode and a hash aggregate or join on cells, linear in cells times offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offsets = list[tuple[int, int]]


def disk(radius: int) -> Offsets:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if a * a + b * b <= radius * radius]


def square(radius: int) -> Offsets:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r]


def plus() -> Offsets:
    return disk(1)


def cone(yaw_deg: int, fov_deg: float, low: int, high: int) -> Offsets:
    """Offsets from an observer to cells at a distance of low to high, at most half of fov_deg
    away from the heading; the angle is that of (rows, columns)."""
    yaw, half, out = math.radians(yaw_deg), math.radians(fov_deg) / 2, []
    for a, b in square(high):
        if low * low <= a * a + b * b <= high * high:
            off = (math.atan2(a, b) - yaw - math.pi) % (2 * math.pi) - math.pi
            if abs(off) <= half:
                out.append((a, b))
    return out


def literal(offsets, *names: str) -> Column:
    """Offsets as an array of structs, dr and dc first."""
    fields = ("dr", "dc", *names)
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, o, strict=True)]) for o in offsets])


def shifted(cells: DataFrame, offsets, *names: str, sign: int = 1) -> DataFrame:
    """Each cell moved by each offset, with the offset's further fields as columns."""
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return cells.withColumn("_o", F.explode(literal(offsets, *names))).select(
        *rest,
        (F.col("row") + F.col("_o.dr") * sign).alias("row"),
        (F.col("col") + F.col("_o.dc") * sign).alias("col"),
        *[F.col(f"_o.{n}").alias(n) for n in names],
    )


def inside(height: int, width: int) -> Column:
    return F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)


def full_grid(keys: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of the box for each row of keys."""
    rows = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
