"""From depth frames to map patches: points, voxels, heights and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXPLORED, OBSTACLE, Camera, Mapping, MapSize
from .morphology import avg_pool
from .stencil import inside, literal

def depth_points(pixels: DataFrame, camera: Camera, stride: int = 1, depth: str = "depth") -> DataFrame:
    """pixels (.., row, col, depth) on the stride, with px (right), py (ahead) and pz (up)."""
    cx, cz = camera.centre
    d = F.col(depth)
    on = (F.pmod("row", F.lit(stride)) == 0) & (F.pmod("col", F.lit(stride)) == 0)
    return pixels.where(on).select(
        *pixels.columns,
        ((F.col("col") - cx) * d / camera.focal).alias("px"),
        d.cast("double").alias("py"),
        (((camera.height - 1 - F.col("row")) - cz) * d / camera.focal).alias("pz"),
    )


def camera_view(points: DataFrame, sensor_height: float, elevation_deg: float = 0.0) -> DataFrame:
    """Points turned about the x axis by the camera's elevation and lifted to its height."""
    a = math.radians(elevation_deg)
    c, s = math.cos(a), math.sin(a)
    y, z = F.col("py"), F.col("pz")
    return points.withColumns({"py": y * c - z * s, "pz": y * s + z * c + sensor_height})


def planar_pose(points: DataFrame, x: Column, y: Column, theta: Column) -> DataFrame:
    """Points turned by theta less a quarter turn in the plane, then moved by (x, y)."""
    a = theta - math.pi / 2
    px, py = F.col("px"), F.col("py")
    return points.withColumns(
        {"px": px * F.cos(a) - py * F.sin(a) + x, "py": px * F.sin(a) + py * F.cos(a) + y}
    )


def voxel_places(points: DataFrame, mapping: Mapping, shift_x_cm: float | None = None) -> DataFrame:
    """vx, vy, vz: points (cm) in voxels; x starts at the left edge of the patch."""
    res = mapping.size.resolution_cm
    shift = mapping.vision_range * res // 2 if shift_x_cm is None else shift_x_cm
    return points.withColumns(
        {
            "vx": (F.col("px") + shift) / res,
            "vy": F.col("py") / res,
            "vz": F.col("pz") / res - mapping.min_voxel,
        }
    )


def splat(points: DataFrame, keys: list[str], places: list[str], dims: list[int], feature: str = "value") -> DataFrame:
    """(keys..., i0, i1, .., value): features spread over the corners of their cells.

    A corner gets the product of 1 - |place - corner|; it counts if it lies above 0 and below its
    dimension.  Sums go to the nearest whole number, the even one on halves.
    """
    n = len(places)
    names = [f"d{k}" for k in range(n)]
    corner = lambda i: F.struct(*[F.lit(i >> k & 1).alias(d) for k, d in enumerate(names)])
    corners = F.array(*[corner(i) for i in range(1 << n)])
    spread = points.select(*keys, *places, feature, F.explode(corners).alias("_o"))
    weight, valid = F.lit(1.0), F.lit(True)
    cells = []
    for k, (p, name) in enumerate(zip(places, names, strict=True)):
        at = F.floor(p) + F.col(f"_o.{name}")
        weight = weight * (1 - F.abs(F.col(p) - at))
        valid &= (at > 0) & (at < dims[k])
        cells.append(at.cast("int").alias(f"i{k}"))
    return (
        spread.where(valid)
        .select(*keys, *cells, (weight * F.col(feature)).alias("_w"))
        .groupBy(*keys, *[f"i{k}" for k in range(n)])
        .agg(F.rint(F.sum("_w")).alias("value"))
    )


def project_heights(voxels: DataFrame, mapping: Mapping, keys: list[str]) -> DataFrame:
    """(keys..., row, col, obstacle, explored) in [0, 1] from voxels (i0 across, i1 ahead, i2 up)."""
    band = F.col("i2").between(mapping.min_mapped, mapping.max_mapped - 1)
    sums = voxels.groupBy(*keys, F.col("i1").alias("row"), F.col("i0").alias("col")).agg(
        F.sum(F.when(band, F.col("value")).otherwise(0.0)).alias("o"), F.sum("value").alias("e")
    )
    cut = lambda c, t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / t))
    return sums.select(
        *keys, "row", "col",
        cut("o", mapping.obstacle_threshold).alias("obstacle"),
        cut("e", mapping.explored_threshold).alias("explored"),
    )


def point_features(channels: DataFrame, stride: int, keys: list[str]) -> DataFrame:
    """(keys..., row, col, channel, value): the mean of each channel over stride x stride pixels,
    and channel 0, which is 1 at every point."""
    pooled = avg_pool(channels.select(*keys, "row", "col", "channel", "value"), stride)
    one = pooled.select(*keys, "row", "col").distinct().select(*keys, F.lit(0).alias("channel"), "row", "col", F.lit(1.0).alias("value"))
    return pooled.where("channel > 0").unionByName(one)


def place_patch(cells: DataFrame, mapping: Mapping) -> DataFrame:
    """A patch in the agent's local view: rows ahead of the centre, columns around it."""
    half, small = mapping.size.local_cells // 2, mapping.size.local_cells
    moved = cells.withColumns(
        {"row": F.col("row") + half, "col": F.col("col") + (small - mapping.vision_range) // 2}
    )
    return moved.where(inside(small, small))


def _pass(values: DataFrame, keys: list[str], size: int, angle: Column, x: Column, y: Column) -> DataFrame:
    """One bilinear pass.  The middle of output cell i lies at (2 i + 1) / size - 1; it is turned
    by angle, moved by (x, y) and read where -1 and 1 are the middles of the first and last cells.

    Each input cell gives to the output cells that read within one cell of it, which lie about
    its own image.
    """
    mid, grow = (size - 1) / 2, size / (size - 1)
    at = values.withColumns({"_a": angle, "_x": x, "_y": y})
    c = (F.col("col") - mid) * grow - F.col("_x") * size / 2
    r = (F.col("row") - mid) * grow - F.col("_y") * size / 2
    at = at.withColumn("_c", c * F.cos("_a") + r * F.sin("_a") + mid).withColumn("_r", r * F.cos("_a") - c * F.sin("_a") + mid)
    near = F.explode(literal([(i, j) for i in range(-1, 3) for j in range(-1, 3)]))
    spots = at.withColumn("_o", near).select(
        *keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value", "_a", "_x", "_y",
        (F.floor("_r") + F.col("_o.dr")).cast("int").alias("row"),
        (F.floor("_c") + F.col("_o.dc")).cast("int").alias("col"),
    )
    u, v = (2 * F.col("col") + 1) / size - 1, (2 * F.col("row") + 1) / size - 1
    read_c = (u * F.cos("_a") - v * F.sin("_a") + F.col("_x") + 1) * mid
    read_r = (u * F.sin("_a") + v * F.cos("_a") + F.col("_y") + 1) * mid
    weight = F.greatest(F.lit(0.0), 1 - F.abs(read_r - F.col("_sr"))) * F.greatest(F.lit(0.0), 1 - F.abs(read_c - F.col("_sc")))
    return (
        spots.where(inside(size, size))
        .withColumn("_w", weight * F.col("value"))
        .where("_w <> 0")
        .groupBy(*keys, "row", "col")
        .agg(F.sum("_w").alias("value"))
    )


def resample(values: DataFrame, keys: list[str], size: int, x: Column, y: Column, angle: Column) -> DataFrame:
    """values (keys..., row, col, value) of a size x size image, turned by angle about its middle
    and then moved by (x, y), in halves of the image, each by a bilinear pass of its own.

    angle, x and y are constants or made of keys.  Results are cut to [0, 1]; what leaves the
    image is lost.
    """
    zero = F.lit(0.0)
    turned = _pass(values.select(*keys, "row", "col", "value"), keys, size, angle, zero, zero)
    moved = _pass(turned, keys, size, zero, x, y)
    return moved.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))))


def map_pose(x_m: Column, y_m: Column, heading_deg: Column, size: MapSize) -> tuple[Column, Column, Column]:
    """(x, y, angle) for resample() of an agent's place and heading in the local map."""
    half = size.local_cells // 2
    part = lambda c: -((c * 100 / size.resolution_cm - half) / half)
    return part(x_m), part(y_m), F.radians(90.0 - heading_deg)


def patch_of_frames(pixels: DataFrame, camera: Camera, mapping: Mapping, keys: list[str], sensor_height: float, elevation_deg: float = 0.0) -> DataFrame:
    """Depth frames (keys..., row, col, depth in cm) as (keys..., row, col, obstacle, explored)
    patches; one aggregation over voxels and one over heights, with no Python."""
    cut = pixels.withColumn("depth", F.when(F.col("depth") > mapping.max_depth_cm, 0.0).otherwise(F.col("depth")))
    points = camera_view(depth_points(cut.where("depth > 0"), camera, mapping.stride), sensor_height, elevation_deg)
    voxels = splat(
        voxel_places(points, mapping).withColumn("value", F.lit(1.0)),
        keys,
        ["vx", "vy", "vz"],
        [mapping.vision_range, mapping.vision_range, mapping.max_voxel - mapping.min_voxel],
    )
    return project_heights(voxels, mapping, keys)


def map_patches(frames: DataFrame, poses: DataFrame, camera: Camera, mapping: Mapping, sensor_height: float, elevation_deg: float = 0.0) -> DataFrame:
    """(env, step, channel, row, col, value): what each frame (env, step, row, col, depth in cm)
    adds to its local map, seen from the pose (env, step, local_x, local_y, heading_deg).

    Frames become patches, patches are placed ahead of the agent, turned and moved.
    """
    keys = ["env", "step"]
    placed = place_patch(patch_of_frames(frames, camera, mapping, keys, sensor_height, elevation_deg), mapping)
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(n).alias("value")) for n, c in (("obstacle", OBSTACLE), ("explored", EXPLORED))]))
    cells = placed.select(*keys, "row", "col", pair.alias("_p")).select(*keys, "_p.channel", "row", "col", "_p.value").where("value > 0")
    x, y, angle = map_pose(F.col("local_x"), F.col("local_y"), F.col("heading_deg"), mapping.size)
    posed = cells.join(poses.select(*keys, x.alias("_px"), y.alias("_py"), angle.alias("_pa")), keys)
    every = [*keys, "channel", "_px", "_py", "_pa"]
    return resample(posed, every, mapping.size.local_cells, F.col("_px"), F.col("_py"), F.col("_pa")).select(*keys, "channel", "row", "col", "value")
