"""Names, stems and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def synset_key(c: Column) -> Column:
    """The text before the first dot; "unknown" for null."""
    return F.split_part(F.coalesce(c, F.lit("unknown")), F.lit("."), F.lit(1))


def shortname(handle: Column) -> Column:
    """An object's name from its handle: the last path part up to ".", "_:" and "_"."""
    last = F.element_at(F.split(handle, "/"), -1)
    return F.split_part(F.split_part(F.split_part(last, F.lit("."), F.lit(1)), F.lit("_:"), F.lit(1)), F.lit("_"), F.lit(1))


def decimals(c: Column) -> Column:
    """Two decimals with "p" for the point."""
    return F.replace(F.format_string("%.2f", F.bround(c.cast("double"), 2)), F.lit("."), F.lit("p"))


def pose_stem(prefix: Column, x: Column, y: Column, z: Column, yaw: Column) -> Column:
    """prefix_x_.._y_.._z_.._yaw_..; for show only, as several poses may share one."""
    parts = [prefix]
    for tag, c in (("x", x), ("y", y), ("z", z), ("yaw", yaw)):
        parts += [F.lit(tag), decimals(c)]
    return F.concat_ws("_", *parts)


def stem_number(stem: Column, tag: str) -> Column:
    """The number after _tag_ in a stem; null if there is none."""
    found = F.regexp_extract(stem, f"_{tag}_(-?[0-9]+p?[0-9]*)", 1)
    return F.when(found != "", F.replace(found, F.lit("p"), F.lit(".")).cast("double"))


def sample_prefix(cls: Column, scene: Column, object_id: Column, infix: str = "_scene_") -> Column:
    """cls_<class><infix><scene>_objid_<id>; infix is what a data set's files have there."""
    return F.concat(F.lit("cls_"), cls, F.lit(infix), scene, F.lit("_objid_"), object_id.cast("string"))


def class_of_prefix(stem: Column, infix: str = "_scene_") -> Column:
    return F.split_part(F.regexp_replace(stem, "^cls_", ""), F.lit(infix), F.lit(1))


def episode_id(scene: Column, object_id: Column) -> Column:
    return F.concat(scene.cast("string"), F.lit("_obj_id_"), object_id.cast("string"))


def object_of_episode(episode: Column) -> Column:
    return F.element_at(F.split(episode, "_"), -1).cast("int")


def prompt(cls: Column) -> Column:
    return F.concat(F.lit("a "), cls)


def natural_key(name: Column) -> Column:
    """The first number in a name, by which names sort naturally; null without one."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def hex_to_rgb(c: Column) -> Column:
    """(r, g, b) of #rrggbb, the sign optional; an error for another length."""
    h = F.regexp_replace(c, "^#", "")
    h = F.when(F.length(h) == 6, h).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), c)))
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))
