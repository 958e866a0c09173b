"""Catalogues, scenes, annotation documents, episodes and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import natural_key, synset_key
from ..operators.lookup import contiguous_ids, group_annotations

OBJECTS = "id string, main_category string, main_wnsynsetkey string, wnsynsetkey string, name string"
LVIS = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,"
    "segmentation:array<array<double>>,area:double,iscrowd:int>>, "
    "categories array<struct<id:long,name:string,frequency:string>>"
)
EPISODE = (
    "episode_id string, scene_id string, start_position array<double>, start_rotation array<double>, "
    "goals array<struct<position:array<double>,radius:double>>, "
    "info struct<viewpoints:array<struct<position:array<double>,rotation:array<double>>>>"
)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a document with a list of classes."""
    read = spark.read.schema("classes array<struct<name:string,id:int>>").option("multiLine", True).json(path)
    return read.select(F.inline("classes"))


def object_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The object table with its three vocabulary columns cleaned: null is "unknown", a synset key
    is the text before its first dot.  Columns are found by their names in the header."""
    rows = spark.read.option("header", True).csv(path)
    for c in ("id", "main_category", "main_wnsynsetkey", "wnsynsetkey"):
        if c not in rows.columns:
            raise ValueError(f"{path} has no column {c}")
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "id",
        F.coalesce("main_category", F.lit("unknown")).alias("main_category"),
        synset_key(F.col("main_wnsynsetkey")).alias("main_wnsynsetkey"),
        synset_key(F.col("wnsynsetkey")).alias("wnsynsetkey"),
        name.alias("name"),
    )


def object_configs(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """(obj_name, semantic_id) of all *.object_config.json files below a folder whose name is in the
    catalogue."""
    read = (
        spark.read.schema("semantic_id int")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.object_config.json")
        .json(folder)
    )
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    named = read.select(F.regexp_replace(file, r"\.object_config\.json$", "").alias("obj_name"), "semantic_id")
    return named.join(catalogue.select(F.col("id").alias("obj_name")), "obj_name", "left_semi")


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "file string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def scenes(spark: SparkSession, folder: str, names: list[str], suffix: str = ".scene_instance.json") -> DataFrame:
    """(scene): the names given, or for ["*"] those of all files of a folder, sorted."""
    if names != ["*"]:
        return spark.createDataFrame([(n,) for n in names], "scene string")
    files = _listing(spark, folder, f"*{suffix}")
    return files.select(F.expr(f"left(file, length(file) - {len(suffix)})").alias("scene")).orderBy("scene")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of a folder's images in natural order; none if there is no folder."""
    files = _listing(spark, folder, "*.{jpg,png}")
    return files.orderBy(natural_key(F.col("file")), "file")


def image_bytes(spark: SparkSession, folder: str, stems: DataFrame) -> DataFrame:
    """(stem, content): the .jpg file of each stem, or else its .png file; neither is an error."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    kind = F.element_at(F.split(file, r"\."), -1)
    own = read.select(F.regexp_replace(file, r"\.(jpg|png)$", "").alias("stem"), kind.alias("kind"), "content")
    best = own.groupBy("stem").agg(F.min_by("content", "kind").alias("content"))
    missing = F.raise_error(F.concat(F.lit("no image: "), F.col("stem")))
    return stems.join(best, "stem", "left").withColumn("content", F.coalesce("content", missing.cast("binary")))


def annotation_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of an annotation document; iscrowd is 0 if absent."""
    doc = spark.read.schema(LVIS).option("multiLine", True).json(path)
    annotations = doc.select(F.inline("annotations")).withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0)))
    return doc.select(F.inline("images")), annotations, doc.select(F.inline("categories"))


def detection_records(spark: SparkSession, path: str, image_root: str) -> DataFrame:
    """One row per image with its annotations and their categories' contiguous ids."""
    pictures, annotations, categories = annotation_document(spark, path)
    named = contiguous_ids(annotations, categories.select(F.col("id").alias("category_id")), "category_id")
    rows = pictures.select(
        F.concat(F.lit(image_root.rstrip("/") + "/"), "file_name").alias("file_name"), F.col("id").alias("image_id"), "height", "width"
    )
    fields = ["id", "contiguous_id", "bbox", "segmentation", "iscrowd"]
    return group_annotations(rows, named, "image_id", fields, ["id"])


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes, plain or gzip-compressed JSON lines."""
    return spark.read.schema(EPISODE).json(path)


def datasets(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders of a folder, sorted; on the driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())


def navigable_cells(raster: DataFrame) -> DataFrame:
    """(scene, row, col) of a raster's cells with the value 1."""
    return raster.where(F.col("value") == 1.0).select("scene", "row", "col")
