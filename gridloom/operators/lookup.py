"""Vocabularies: lookups with defaults, dense indices and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCABULARIES = {
    "semantic_class": "semantic_class",
    "full_name": "name",
    "wnsynsetkey": "wnsynsetkey",
    "category": "main_category",
}


def last_per_key(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Of several rows of a key the last in the order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_default(rows: DataFrame, lookup: DataFrame, on: str, value: str, default: str = "undefined") -> DataFrame:
    """rows with lookup's value, or the default where there is no row or a null."""
    return rows.join(lookup.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def semantic_classes(catalogue: DataFrame, configs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, semantic_class) of each catalogue object: its configuration's lexicon name, or "undefined"."""
    named = configs.where("semantic_id is not null").join(
        lexicon.select(F.col("id").alias("semantic_id"), F.col("name").alias("semantic_class")), "semantic_id"
    )
    own = catalogue.select("id").distinct()
    found = named.select(F.col("obj_name").alias("id"), "semantic_class").dropDuplicates(["id"])
    return with_default(own, found, "id", "semantic_class")


def vocabulary(catalogue: DataFrame, kind: str = "wnsynsetkey") -> DataFrame:
    """(id, class_name) of one of the four vocabularies."""
    if kind not in VOCABULARIES:
        raise ValueError(f"unknown vocabulary: {kind}")
    return catalogue.select("id", F.col(VOCABULARIES[kind]).alias("class_name"))


def annotate(objects: DataFrame, vocab: DataFrame, name: str = "obj_name") -> DataFrame:
    """objects with class_name; an object outside the vocabulary is an error when it is read."""
    known = vocab.select(F.col("id").alias(name), "class_name")
    missing = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(F.col(name), F.lit("null"))))
    return objects.join(known, name, "left").withColumn("class_name", F.coalesce("class_name", missing.cast("string")))


def missing_objects(objects: DataFrame, vocab: DataFrame, name: str = "obj_name") -> DataFrame:
    return objects.join(vocab.select(F.col("id").alias(name)), name, "left_anti")


def class_index(rows: DataFrame, cls: str) -> DataFrame:
    """(cls, idx): the distinct classes, numbered from 0 in their order."""
    return rows.select(cls).where(F.col(cls).isNotNull()).distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy(cls)).cast("long") - 1
    )


def contiguous_ids(rows: DataFrame, categories: DataFrame, column: str, to: str = "contiguous_id") -> DataFrame:
    """rows with their category's place among the sorted ids; an unknown id is an error when read."""
    ids = class_index(categories, column).withColumnRenamed("idx", to)
    unknown = F.raise_error(F.concat(F.lit("unknown category: "), F.col(column).cast("string")))
    return rows.join(ids, column, "left").withColumn(to, F.coalesce(to, unknown.cast("long")))


def known_classes(rows: DataFrame, cls: str) -> DataFrame:
    return rows.where(F.col(cls) != "unknown")


def group_annotations(images: DataFrame, annotations: DataFrame, image_id: str, fields: list[str], order: list[str]) -> DataFrame:
    """images with annotations, an array of structs in the order given; images without any keep
    an empty array, annotations without an image go."""
    struct = F.struct(*order, *[f for f in fields if f not in order])
    grouped = annotations.groupBy(image_id).agg(F.array_sort(F.collect_list(struct)).alias("annotations"))
    return images.join(grouped, image_id, "left").withColumn(
        "annotations", F.coalesce("annotations", F.array().cast(grouped.schema["annotations"].dataType))
    )


def frequency_letter(frequent: Column, common: Column, rare: Column) -> Column:
    """f, c or r of three flags; the more frequent wins."""
    return F.when(frequent, "f").when(common, "c").when(rare, "r")
