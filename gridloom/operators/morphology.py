"""Morphology, pooling, edges, frontiers and components of sparse grids.

Unless said otherwise cells are (keys..., row, col) of the set cells of a binary image of
height x width; a missing cell is 0.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import Offsets, disk, full_grid, inside, literal, plus, shifted, square

AT = ["row", "col"]


def _keys(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c not in ("row", "col")]


def dilate(cells: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    return shifted(cells, offsets).where(inside(height, width)).distinct()


def complement(cells: DataFrame, height: int, width: int) -> DataFrame:
    """The unset cells of each key that has cells."""
    keys = _keys(cells)
    if keys:
        grid = full_grid(cells.select(*keys).distinct(), height, width)
    else:
        spark = cells.sparkSession
        grid = full_grid(spark.range(1).select(), height, width)
    return grid.join(cells, [*keys, *AT], "left_anti").select(*cells.columns)


def erode(cells: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Cells outside the image count as set.

    If the offsets have, with each one, all that are nearer by rows or columns, as disks and
    squares do, only the holes that touch a cell travel: what a hole further in reaches, one of
    these reaches too.
    """
    holes = complement(cells, height, width)
    if _closed(offsets):
        beside = shifted(cells, [o for o in plus() if o != (0, 0)]).where(inside(height, width)).distinct()
        holes = holes.join(beside, cells.columns, "left_semi")
    return cells.join(dilate(holes, offsets, height, width), cells.columns, "left_anti")


def _closed(offsets: Offsets) -> bool:
    have = set(offsets)
    nearer = lambda v: v - (v > 0) + (v < 0)
    return all((nearer(a), b) in have and (a, nearer(b)) in have for a, b in have)


def opening(cells: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    return dilate(erode(cells, offsets, height, width), offsets, height, width)


def closing(cells: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    return erode(dilate(cells, offsets, height, width), offsets, height, width)


def denoise(cells: DataFrame, offsets: Offsets, height: int, width: int) -> DataFrame:
    """Closed, so that small holes go, and then opened, so that small cells go."""
    return opening(closing(cells, offsets, height, width), offsets, height, width)


def expand_mask(cells: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    return dilate(cells, disk(radius), height, width)


def edges(cells: DataFrame, height: int, width: int, threshold: float = 0.5) -> DataFrame:
    """Cells whose Sobel magnitude is over the threshold, with the two sums gx and gy."""
    weights = [
        (-a, -b, (1 + (a == 0)) * b, (1 + (b == 0)) * a) for a, b in square(1) if (a, b) != (0, 0)
    ]
    sums = (
        shifted(cells, weights, "wx", "wy")
        .where(inside(height, width))
        .groupBy(*_keys(cells), *AT)
        .agg(F.sum("wx").alias("gx"), F.sum("wy").alias("gy"))
    )
    return sums.where(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > threshold)


def frontier(explored: DataFrame, height: int, width: int, radius: int = 10) -> DataFrame:
    """The rim around the unexplored area shrunk by a disk.  A grid with no explored cell at all
    has no row here, and so no frontier, as a grid that is all explored."""
    unexplored = complement(explored, height, width)
    core = erode(unexplored, disk(radius), height, width)
    return dilate(core, plus(), height, width).join(core, core.columns, "left_anti")


def grey_dilate(labels: DataFrame, radius: int, height: int, width: int, value: str = "label") -> DataFrame:
    """(keys..., row, col, value): the largest label of the disk around a cell."""
    keys = [c for c in labels.columns if c not in ("row", "col", value)]
    moved = shifted(labels, disk(radius)).where(inside(height, width))
    return moved.groupBy(*keys, *AT).agg(F.max(value).alias(value))


def median_blur(values: DataFrame, height: int, width: int, size: int = 3, value: str = "value") -> DataFrame:
    """The median of a cell's size x size square; outside the image the nearest cell counts.

    values has a row for each cell of the image.
    """
    r = size // 2
    keys = [c for c in values.columns if c not in ("row", "col", value)]
    near = full_grid(values.select(*keys).distinct() if keys else values.sparkSession.range(1).select(), height, width)
    asked = near.withColumn("_o", F.explode(literal(square(r)))).select(
        *keys,
        *AT,
        F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("row") + F.col("_o.dr"))).alias("_r"),
        F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("col") + F.col("_o.dc"))).alias("_c"),
    )
    given = values.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return asked.join(given, [*keys, "_r", "_c"]).groupBy(*keys, *AT).agg(F.expr(f"percentile({value}, 0.5)").alias(value))


def max_pool(values: DataFrame, size: int, value: str = "value") -> DataFrame:
    keys = [c for c in values.columns if c not in ("row", "col", value)]
    return values.groupBy(*keys, F.expr(f"row div {size}").alias("row"), F.expr(f"col div {size}").alias("col")).agg(
        F.max(value).alias(value)
    )


def avg_pool(values: DataFrame, size: int, value: str = "value") -> DataFrame:
    """A missing cell is 0, so sums are divided by the size of a block."""
    keys = [c for c in values.columns if c not in ("row", "col", value)]
    return values.groupBy(*keys, F.expr(f"row div {size}").alias("row"), F.expr(f"col div {size}").alias("col")).agg(
        (F.sum(value) / F.lit(float(size * size))).alias(value)
    )


def components(cells: DataFrame, offsets: Offsets) -> DataFrame:
    """cells with component, the smallest cell (row * 2**20 + col) reachable by the offsets.

    Labels travel and then jump to their label's label, so rounds grow with the logarithm of a
    component's length; each round is a checkpoint.
    """
    keys = _keys(cells)
    code = F.col("row").cast("long") * (1 << 20) + F.col("col")
    now = cells.withColumn("at", code).withColumn("component", code)
    now = _saved(now)
    while True:
        near = shifted(now.select(*keys, *AT, "component"), offsets).groupBy(*keys, *AT).agg(F.min("component").alias("_near"))
        hooked = now.join(near, [*keys, *AT], "left").withColumn("_best", F.least("component", F.coalesce("_near", "component")))
        roots = hooked.select(*keys, F.col("at").alias("_root"), F.col("_best").alias("_jump"))
        lead = hooked.groupBy(*keys, F.col("component").alias("_old")).agg(F.min("_best").alias("_low"))
        after = (
            hooked.join(lead.withColumnRenamed("_old", "component"), [*keys, "component"])
            .withColumn("_root", F.least("_best", "_low"))
            .join(roots, [*keys, "_root"], "left")
            .select(*keys, *AT, "at", F.least("_root", F.coalesce("_jump", "_root")).alias("_new"), "component")
        )
        after = _saved(after)
        changed = after.where(F.col("_new") != F.col("component")).limit(1).count()
        now = after.select(*keys, *AT, "at", F.col("_new").alias("component"))
        if not changed:
            return now.select(*cells.columns, "component")


def _saved(df: DataFrame) -> DataFrame:
    """df computed and its lineage cut, in the folder of spark.checkpoint.dir, which only a local
    session may leave unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[[^\]]*\])?$", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def largest_component(cells: DataFrame, offsets: Offsets) -> DataFrame:
    """The cells of each key's largest component, the one with the smallest cell on ties."""
    keys = _keys(cells)
    found = components(cells, offsets)
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    best = F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component")
    best = sizes.groupBy(*keys).agg(best) if keys else sizes.agg(best)
    return found.join(best, [*keys, "component"], "left_semi").select(*cells.columns)


def component_centres(cells: DataFrame, least: int = 30) -> DataFrame:
    """(keys..., component, n, row, col): centres of 4-connected components of `least` cells."""
    keys = _keys(cells)
    return (
        components(cells, plus())
        .groupBy(*keys, "component")
        .agg(F.count("*").alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col"))
        .where(F.col("n") >= least)
    )


def nearest(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The nearest cell to a place, per key; the smallest on ties; no row without cells."""
    keys = _keys(cells)
    d = (F.col("row") - row) * (F.col("row") - row) + (F.col("col") - col) * (F.col("col") - col)
    best = F.min(F.struct(d.alias("d2"), F.col("row"), F.col("col"))).alias("_b")
    found = (cells.groupBy(*keys) if keys else cells.groupBy()).agg(best).where("_b is not null")
    return found.select(*keys, "_b.row", "_b.col", "_b.d2")
