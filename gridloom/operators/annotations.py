"""Nested annotation documents: images, annotations, categories, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbered


def image_rows(samples: DataFrame, order: list[str], coarse: Column, stem: Column, width: int = 640, height: int = 480) -> DataFrame:
    """samples with id (from 0 in the order), file_name, width and height, and two empty arrays."""
    none = F.array().cast("array<int>")
    return (
        numbered(samples, order, coarse, "id")
        .withColumn("file_name", F.concat(F.lit("images/"), stem, F.lit(".jpg")))
        .withColumn("width", F.lit(width))
        .withColumn("height", F.lit(height))
        .withColumn("not_exhaustive_category_ids", none)
        .withColumn("neg_category_ids", none)
    )


def annotation_rows(instances: DataFrame, classes: DataFrame, order: list[str], coarse: Column, cls: str = "class_name") -> DataFrame:
    """instances with id (from 1 in the order), category_id, area (of the box) and iscrowd 0."""
    known = instances.join(classes.select(cls, "idx"), cls)
    return (
        numbered(known, order, coarse, "id", start=1)
        .withColumn("category_id", F.col("idx") + 1)
        .withColumn("area", F.col("bbx_area"))
        .withColumn("iscrowd", F.lit(0))
        .drop("idx")
    )


def category_rows(classes: DataFrame, buckets: DataFrame, cls: str = "class_name") -> DataFrame:
    """(id, name, frequency): indices from 1 and the bucket's first letter."""
    joined = classes.join(buckets.select(cls, "bucket"), cls, "left")
    return joined.select((F.col("idx") + 1).alias("id"), F.col(cls).alias("name"), F.substring("bucket", 1, 1).alias("frequency"))


def class_maps(classes: DataFrame, buckets: DataFrame, cls: str = "class_name") -> dict[str, dict[int, str]]:
    """classes, and classes_frequent, _common and _rare, as maps from the full index; on the
    driver, one entry for each class."""
    rows = classes.join(buckets.select(cls, "bucket"), cls, "left").orderBy("idx").collect()
    out = {"classes": {r.idx: r[cls] for r in rows}}
    for b in ("frequent", "common", "rare"):
        out[f"classes_{b}"] = {r.idx: r[cls] for r in rows if r.bucket == b}
    return out


def document_rows(rows: DataFrame) -> DataFrame:
    """(id, entry): each row as JSON text, its id first; what one list of a document holds."""
    return rows.select("id", F.to_json(F.struct("id", *[c for c in rows.columns if c != "id"])).alias("entry"))


def episodes(views: DataFrame, keys: list[str], episode: Column, scene: Column, order: list[str], least: int = 4, radius: float = 0.1) -> DataFrame:
    """A nested row for each group of at least `least` views (x, y, z and rotation, a struct):
    it starts at the first view, its goal is the last one, info holds all of them in order."""
    view = F.struct(F.array("x", "y", "z").alias("position"), F.col("rotation"))
    grouped = (
        views.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, view.alias("_view")))).alias("_v"))
        .where(F.size("_v") >= least)
        .withColumn("_views", F.transform("_v", lambda v: v["_view"]))
    )
    first, last = F.element_at("_views", 1), F.element_at("_views", -1)
    return grouped.select(
        *keys,
        episode.alias("episode_id"),
        scene.alias("scene_id"),
        first["position"].alias("start_position"),
        first["rotation"].alias("start_rotation"),
        F.array(F.struct(last["position"].alias("position"), F.lit(radius).alias("radius"))).alias("goals"),
        F.struct(F.col("_views").alias("viewpoints")).alias("info"),
    )


