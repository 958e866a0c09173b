"""Instances in frames and in the map: extraction, views, association with earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .morphology import grey_dilate


def mask_areas(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mask_area, x, y, w, h, bbx_area) of labelled pixels (keys..., row, col)."""
    w, h = F.max("col") - F.min("col") + 1, F.max("row") - F.min("row") + 1
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("mask_area"),
        F.min("col").alias("x"), F.min("row").alias("y"), w.alias("w"), h.alias("h"),
        (w * h).alias("bbx_area"),
    )


def pixel_argmax(scores: DataFrame, keys: list[str], height: int | None = None, width: int | None = None) -> DataFrame:
    """(keys..., row, col, channel): the channel of the largest value, the first on ties.

    A pixel's missing channels are 0; so a pixel without a positive value gets channel 0 if the
    size of the image is given, and if not the first one of its largest values.
    """
    best = scores.groupBy(*keys, "row", "col").agg(
        F.min_by("channel", F.struct(-F.col("value"), F.col("channel"))).alias("channel"), F.max("value").alias("_m")
    )
    if height is None:
        return best.drop("_m")
    return best.select(*keys, "row", "col", F.when(F.col("_m") > 0, F.col("channel")).otherwise(0).alias("channel"))


def instance_views(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """pixels (env, timestep, local_id, category_id, row, col) as one row per view: box (the upper
    ends excluded), the smallest category, and the part of the frame."""
    return pixels.where("local_id > 0").groupBy("env", "timestep", "local_id").agg(
        F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"),
        F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"),
        F.min("category_id").alias("category_id"),
        (F.count("*") / F.lit(float(height * width))).alias("object_coverage"),
    )


def downsampled(pixels: DataFrame, step: int) -> DataFrame:
    """Every step-th pixel of every step-th row, counted anew."""
    on = (F.pmod("row", F.lit(step)) == 0) & (F.pmod("col", F.lit(step)) == 0)
    return pixels.where(on).withColumns({"row": F.expr(f"row div {step}"), "col": F.expr(f"col div {step}")})


def crop_ranges(views: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    """Views with their box made larger by pad, within the frame."""
    low = lambda c: F.greatest(F.lit(0), F.col(c) - pad).alias(c)
    high = lambda c, n: F.least(F.lit(n), F.col(c) + pad).alias(c)
    rest = [c for c in views.columns if c not in ("row0", "row1", "col0", "col1")]
    return views.select(*rest, low("row0"), high("row1", height), low("col0"), high("col1", width))


def associate(local: DataFrame, world: DataFrame, height: int, width: int, radius: int = 5, keys: tuple[str, ...] = ("env",)) -> DataFrame:
    """(keys..., category, local_id, global_id, new): which instance of the map a local one is.

    local and world are cells (keys..., category, id, row, col) with ids over 0.  The local labels
    of a category are made larger by a disk, where the largest wins a cell.  A local id is the
    smallest instance of its category under the cells that are then its own.  The others get new
    ids over the map's largest, in the order of category and local id.
    """
    on = [*keys, "category", "row", "col"]
    grown = grey_dilate(local.select(*on, "id"), radius, height, width, "id")
    met = grown.withColumnRenamed("id", "local_id").join(world.withColumnRenamed("id", "_g"), on)
    match = met.groupBy(*keys, "category", "local_id").agg(F.min("_g").alias("_g"))
    ids = local.select(*keys, "category", F.col("id").alias("local_id")).distinct()
    top = world.groupBy(*keys).agg(F.max("id").alias("_top"))
    joined = ids.join(match, [*keys, "category", "local_id"], "left").join(top, list(keys), "left")
    new = F.col("_g").isNull()
    rank = F.sum(new.cast("long")).over(Window.partitionBy(*keys).orderBy("category", "local_id"))
    return joined.select(
        *keys, "category", "local_id",
        F.coalesce("_g", F.coalesce("_top", F.lit(0)) + rank).cast("long").alias("global_id"),
        new.alias("new"),
    )


def update_instance_map(world: DataFrame, local: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("env",)) -> DataFrame:
    """The instance map after a frame: cell by cell, the larger of the old and the new id."""
    named = local.withColumnRenamed("id", "local_id").join(ids, [*keys, "category", "local_id"])
    new = named.select(*keys, "category", F.col("global_id").alias("id"), "row", "col")
    return world.unionByName(new).groupBy(*keys, "category", "row", "col").agg(F.max("id").alias("id"))


def category_instances(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., category, row, col, id): of each category the instance of the largest value over
    1e-5 at a cell, the first on ties; scores are (keys..., category, id, row, col, value)."""
    found = scores.where(F.col("value") > 1e-5)
    best = F.min_by("id", F.struct(-F.col("value"), F.col("id"))).alias("id")
    return found.groupBy(*keys, "category", "row", "col").agg(best)


def memory(views: DataFrame, ids: DataFrame) -> DataFrame:
    """(env, global_id, category_id, views): each instance's views in the order of time; its
    category is that of the first one."""
    named = views.join(ids.select("env", "timestep", "local_id", "global_id"), ["env", "timestep", "local_id"])
    fields = [c for c in views.columns if c not in ("env", "timestep")]
    return named.groupBy("env", "global_id").agg(
        F.min_by("category_id", F.struct("timestep", "local_id")).alias("category_id"),
        F.array_sort(F.collect_list(F.struct("timestep", *fields))).alias("views"),
    )


def without_env(memory_rows: DataFrame, envs: list[int] | None = None) -> DataFrame:
    """What a reset leaves: the rows of other environments, or none."""
    return memory_rows.where(~F.col("env").isin(envs)) if envs is not None else memory_rows.limit(0)
