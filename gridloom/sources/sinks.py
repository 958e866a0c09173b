"""Writers of data sets, annotation documents and episodes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import class_maps, document_rows


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def guard_new(spark: SparkSession, folder: str) -> None:
    """An error if the folder is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(folder)


def dataset_yaml(root: str, maps: dict[str, dict[int, str]]) -> str:
    """path, classes and the three frequency classes; JSON strings are YAML strings."""
    lines = [f"path: {json.dumps(root)}"]
    for title, entries in maps.items():
        lines.append(f"{title}:" + ("" if entries else " {}"))
        lines += [f"  {i}: {json.dumps(n, ensure_ascii=False)}" for i, n in entries.items()]
    return "\n".join(lines) + "\n"


def write_document(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """The annotation document as one new JSON text file, each list by id.

    Tasks write sorted parts of the lists beside it; the driver strings their bytes together
    through a small buffer, so no list is held anywhere.
    """
    spark = images.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    if files.exists(place):
        raise FileExistsError(path)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lists = {"images": images, "annotations": annotations, "categories": categories}
    try:
        for name, rows in lists.items():
            entries = document_rows(rows)
            first = entries.agg(F.min("id")).first()[0]
            text = F.when(F.col("id") == F.lit(first), F.col("entry")).otherwise(F.concat(F.lit(","), F.col("entry")))
            entries.orderBy("id").select(text.alias("value")).write.text(f"{parts}/{name}")
        out = files.create(place, False)
        try:
            for i, name in enumerate(lists):
                out.write(bytearray(f'{"," if i else "{"}"{name}": [\n'.encode()))
                found = files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
                for part in sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-")):
                    stream = files.open(jvm.org.apache.hadoop.fs.Path(part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                    finally:
                        stream.close()
                out.write(bytearray(b"]"))
            out.write(bytearray(b"}\n"))
        finally:
            out.close()
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def write_tables(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """The same three lists as Parquet tables, for data sets too large for one document."""
    for name, rows in (("images", images), ("annotations", annotations), ("categories", categories)):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def save_dataset(folder: str, splits: dict[str, tuple[DataFrame, DataFrame]], categories: DataFrame, classes: DataFrame, buckets: DataFrame) -> None:
    """dataset.yaml, and <data set>_<split>.json of each split's images and annotations.  Images
    that were not chosen are never written, so none has to be deleted."""
    spark = classes.sparkSession
    guard_new(spark, folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    for split, (images, annotations) in splits.items():
        write_document(f"{folder}/{base}_{split}.json", images, annotations, categories)
    _write_text(spark, f"{folder}/dataset.yaml", dataset_yaml(folder, class_maps(classes, buckets)))


def write_episodes(path: str, rows: DataFrame) -> None:
    """gzip-compressed JSON lines, an episode a line."""
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def write_images(rows: DataFrame, folder: str, stem: str = "stem", content: str = "content") -> DataFrame:
    """Writes <folder>/images/<stem>.jpg for each row; returns (file) of what was written.

    Files go under a name of their own first and are then renamed, so a repeated task does no harm.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{top}/images", recursive=True)
        for batch in batches:
            names = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{top}/images/{name}.jpg"
                part = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data.as_py())
                files.move(part, path)
                names.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return rows.select(F.col(stem), F.col(content)).mapInArrow(run, "file string")


def register(spark: SparkSession, folder: str, records: dict[str, DataFrame], classes: dict[str, dict[int, str]] | None = None, categories: dict[str, DataFrame] | None = None) -> dict[str, dict]:
    """A view for each split, read when it is queried, and what is known of it.

    The result has for each split its view, json_file and image_root, and, where given: classes,
    the names in the order of their indices, and frequency, a letter for each name, from the maps
    of dataset.yaml; contiguous_ids, the place of each category id among all, from the document's
    categories (id, ..).  The driver holds an entry for each class.
    """
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    out = {}
    for split, rows in records.items():
        full = f"{base}_{split}"
        view = "".join(c if c.isalnum() else "_" for c in full)
        rows.createOrReplaceTempView(view)
        out[split] = {"view": view, "json_file": f"{folder}/{full}.json", "image_root": f"{folder}/{split}"}
        if classes:
            out[split]["classes"] = [n for _, n in sorted(classes["classes"].items())]
            out[split]["frequency"] = {n: b[0] for b in ("rare", "common", "frequent") for n in classes.get(f"classes_{b}", {}).values()}
        if categories:
            ids = sorted(r.id for r in categories[split].select("id").distinct().collect())
            out[split]["contiguous_ids"] = {v: i for i, v in enumerate(ids)}
    return out
