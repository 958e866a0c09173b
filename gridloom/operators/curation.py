"""Choosing frames, instances and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hash_order

INVALID_DEPTHS = (10000, 10001)


def class_counts(rows: DataFrame, cls: str) -> DataFrame:
    return rows.groupBy(F.col(cls).alias("class_name")).agg(F.count("*").alias("n"))


def frequency_buckets(counts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class_name, n, bucket).  With k sorted counts, t1 is the one at k // 3 and t2 the one at
    2k // 3 from 0; up to t1 is rare, up to t2 common, above frequent.  Classes that were never
    seen are rare, with n null.  One row per class; without counts all classes are rare."""
    ordered = counts.select("n", (F.row_number().over(Window.orderBy("n")) - 1).alias("r"), F.count("*").over(Window.partitionBy()).alias("k"))
    at = lambda third: F.max(F.when(F.col("r") == F.floor(F.col("k") * third / 3), F.col("n")))
    limits = ordered.agg(at(1).alias("t1"), at(2).alias("t2"))
    rows = counts if classes is None else classes.join(counts, "class_name", "left")
    n = F.col("n")
    bucket = F.when(n.isNull() | (n <= F.col("t1")), "rare").when(n <= F.col("t2"), "common").otherwise("frequent")
    return rows.crossJoin(F.broadcast(limits)).select("class_name", "n", bucket.alias("bucket"))  # limits: one row


def has_instance(instances: str, match, min_area: int, area: str = "mask_area") -> Column:
    """Whether an array of instances holds one that match takes, of at least min_area pixels."""
    return F.exists(instances, lambda i: match(i) & (i[area] >= min_area))


def largest_area(instances: str, match, area: str = "mask_area") -> Column:
    """The largest matching area, 0 without one."""
    found = F.transform(F.filter(instances, match), lambda i: i[area])
    return F.coalesce(F.array_max(found), F.lit(0))


def all_objects(samples: DataFrame, instances: str, field: str = "object_id") -> DataFrame:
    return samples.select(F.explode(F.transform(instances, lambda i: i[field])).alias(field)).distinct()


def capped(rows: DataFrame, group: list[str], keys: list[str], most: int, seed: int) -> DataFrame:
    """At most `most` rows of each group, at random but repeatably."""
    w = Window.partitionBy(*group).orderBy(hash_order(seed, *keys), *keys)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return rows.orderBy(hash_order(seed, *keys), *keys)


def first_scenes(scenes: DataFrame, n: int) -> DataFrame:
    return scenes.orderBy("scene").limit(n)


def group_size_at_least(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    big = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*keys)
    return rows.join(big, keys, "left_semi")


def rejected(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(chosen, keys, "left_anti")


def ends(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(keys..., first, last): fields of each group's first and last row, as structs."""
    at, what = F.struct(*order), F.struct(*fields)
    return rows.groupBy(*keys).agg(F.min_by(what, at).alias("first"), F.max_by(what, at).alias("last"))


def first_views(views: DataFrame, targets: DataFrame, group: list[str], order: list[str], frame: str, most: int = 8) -> DataFrame:
    """The first `most` views of each group, without those whose frame shows no target."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = views.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return kept.join(targets.select(frame).distinct(), frame, "left_semi")


def overlapping(predicted: DataFrame, targets: DataFrame, frame: str, pred: str) -> DataFrame:
    """(frame, pred): predictions that share a pixel with any target of their frame.

    Both are tables of pixels (frame, ..., row, col).
    """
    shared = predicted.join(targets.select(frame, "row", "col"), [frame, "row", "col"], "left_semi")
    return shared.select(frame, pred).distinct()


def confident(predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One row per proposal: its best class, the first on ties, if its score is high enough."""
    best = F.min_by("class_name", F.struct(-F.col("score"), F.col("class_name"))).alias("class_name")
    found = predictions.groupBy(*keys).agg(best, F.max("score").alias("score"))
    return found.where(F.col("score") >= threshold)


def valid_depth(depth: Column) -> Column:
    return ~depth.isin(*INVALID_DEPTHS)


def clipped_depth(depth: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), depth))


def cut_depth(depth: Column, high: float) -> Column:
    """Depths above high count as no reading."""
    return F.when(depth > high, 0.0).otherwise(depth)


def coloured(pixels: DataFrame, palette: DataFrame, label: str = "label") -> DataFrame:
    """Pixels with their object's colour, by its id; label 0 is the background."""
    return pixels.join(palette, label, "left")


def hit_rates(kept: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(class_name, predictions, hits, rate): how many of a class's predictions overlap a target."""
    marked = predictions.join(kept.select(*keys).withColumn("_hit", F.lit(1)), keys, "left")
    hits = F.sum(F.coalesce("_hit", F.lit(0)))
    return marked.groupBy("class_name").agg(
        F.count("*").alias("predictions"), hits.alias("hits"), (hits / F.count("*")).alias("rate")
    )
