"""Whole flows out of the operators: a detection data set, an episode set, an evaluation, and a
map after any number of steps.

What a simulator or a detector gives comes as tables: frames are (scene, row, col, yaw_deg,
instances), an array of structs with object_id, class_name and mask_area, for each pose;
predictions are pixels.  Each flow is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Camera, Curation, Grid, Mapping
from ..functions.strings import episode_id, sample_prefix
from . import annotations, curation, grid, lookup, mapstate, projection, sampling

POSE = ["row", "col", "yaw_deg"]


def candidate_views(objects: DataFrame, navigable: DataFrame, place: Grid) -> DataFrame:
    """(scene, object_id, class_name, yaw_deg, row, col, x, z): the viewpoints of objects
    (scene, object_id, class_name, row, col) whose class is known.  Objects are dealt out before
    each becomes many rows, as a small file of them is read by few tasks."""
    known = lookup.known_classes(objects, "class_name").repartition("scene", "object_id")
    return grid.viewpoints(known, navigable, place)


def _shown(frames: DataFrame, field: str, min_area: int) -> DataFrame:
    """(scene, row, col, yaw_deg, field, area): the largest area of each class or object in a frame,
    if it has min_area pixels.

    Views meet these rows instead of whole frames, whose instances grow with the scene.  Spark's
    estimates miss the rows that exploding makes, so the hint keeps it from broadcasting them.
    """
    one = frames.select("scene", *POSE, F.explode("instances").alias("_i")).select("scene", *POSE, F.col(f"_i.{field}").alias(field), "_i.mask_area")
    found = one.where(F.col("mask_area") >= min_area).groupBy("scene", *POSE, field).agg(F.max("mask_area").alias("area"))
    return found.hint("merge")


def pose_key() -> Column:
    return F.concat_ws(":", "scene", "object_id", *POSE)


@dataclass(frozen=True)
class Detections:
    #: class_name, scene, object_id, row, col, yaw_deg, prefix, instances of each chosen sample.
    samples: DataFrame
    #: class_name, n, bucket.
    buckets: DataFrame


def detection_set(objects: DataFrame, navigable: DataFrame, frames: DataFrame, classes: DataFrame, place: Grid, rules: Curation) -> Detections:
    """The samples of a detection data set, and its classes' frequencies.

    Each object of a known class gives a quarter of rules.per_class viewpoints at most, drawn by
    hash; those stay whose frame shows an instance of the class with rules.min_area pixels; of
    each class rules.per_class are drawn that prefer large areas.  Frequencies count objects;
    classes (class_name) without objects are rare.
    """
    views = candidate_views(objects, navigable, place)
    drawn = curation.capped(views.withColumn("k", pose_key()), ["scene", "object_id"], ["k"], rules.candidates_per_object, rules.seed)
    fit = drawn.join(_shown(frames, "class_name", rules.min_area), ["scene", *POSE, "class_name"])
    chosen = sampling.area_binned(fit, "class_name", "k", "area", rules.per_class, rules.bins, rules.top_bins, rules.seed)
    prefix = sample_prefix(F.col("class_name"), F.col("scene"), F.col("object_id"))
    # the few samples are hashed, as frames needn't be sorted for them and mustn't be broadcast
    taken = chosen.hint("shuffle_hash").join(frames, ["scene", *POSE])
    samples = taken.select("class_name", "scene", "object_id", *POSE, prefix.alias("prefix"), "instances")
    known = lookup.known_classes(objects, "class_name").select("scene", "object_id", "class_name").distinct()
    return Detections(samples, curation.frequency_buckets(curation.class_counts(known, "class_name"), classes))


def episode_set(objects: DataFrame, navigable: DataFrame, frames: DataFrame, scenes: DataFrame, place: Grid, min_area: int = 1000, least: int = 4, radius: float = 0.0) -> DataFrame:
    """An episode for each object that `least` viewpoints or more show with min_area pixels.

    scenes: (scene, scene_idx).  It starts at the first viewpoint, in the order of heading, row
    and column, and its goal is the last one.
    """
    shown = candidate_views(objects, navigable, place).join(_shown(frames, "object_id", min_area), ["scene", *POSE, "object_id"], "left_semi")
    posed = shown.join(scenes, "scene").select(
        "scene", "scene_idx", "object_id", *POSE, "x", F.lit(0.0).alias("y"), "z", grid.heading_quaternion(F.col("yaw_deg")).alias("rotation")
    )
    name = episode_id(F.col("scene_idx"), F.col("object_id"))
    return annotations.episodes(posed, ["scene", "scene_idx", "object_id"], name, F.col("scene"), ["yaw_deg", "row", "col"], least, radius)


def evaluation(views: DataFrame, targets: DataFrame, predicted: DataFrame, least: int = 8, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(kept, rates): predictions that overlap their episode's object, and each class's rate.

    views: (episode_id, seq, frame_id) in the order of seq; episodes with fewer than `least` are
    left out, and the first `most` of the others count if their frame shows the object.
    targets, predicted: pixels (frame_id, row, col) of the object, and (frame_id, pred_id,
    class_name, row, col) of predictions.
    """
    enough = curation.group_size_at_least(views, ["episode_id"], least)
    used = curation.first_views(enough, targets, ["episode_id"], ["seq"], "frame_id", most).select("frame_id").distinct()
    seen = predicted.join(used, "frame_id", "left_semi")
    kept = curation.overlapping(seen, targets, "frame_id", "pred_id")
    preds = seen.select("frame_id", "pred_id", "class_name").distinct()
    return kept, curation.hit_rates(kept, preds, ["frame_id", "pred_id"])


def map_steps(frames: DataFrame, poses: DataFrame, camera: Camera, mapping: Mapping, sensor_height: float, elevation_deg: float = 0.0, close_only: bool = False) -> DataFrame:
    """The map (env, channel, row, col, value) after all steps of each environment.

    frames: (env, step, row, col, depth in cm); poses: (env, step, x, y, heading_deg) in metres of
    the global map.  Each frame is seen from its pose within the window around it, and its cells
    go back to their places in the global map; they merge in one aggregation with the stamps of
    the places.
    """
    size = mapping.size
    posed = grid.recentre(poses, size)
    patches = projection.map_patches(frames, posed, camera, mapping, sensor_height, elevation_deg)
    moved = patches.join(posed.select("env", "step", "top", "left"), ["env", "step"]).select(
        "env", "channel", (F.col("row") + F.col("top")).alias("row"), (F.col("col") + F.col("left")).alias("col"), "value"
    )
    cell = lambda c: F.floor(F.col(c) * 100 / size.resolution_cm).cast("int")
    places = poses.select("env", "step", cell("y").alias("row"), cell("x").alias("col"))
    return mapstate.update(mapstate.empty_map(frames.sparkSession), moved, places, mapping, close_only)
