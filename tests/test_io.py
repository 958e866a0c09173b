"""Readers, writers and streams on files of their own."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import readers, sinks
from gridloom.streaming import max_merge_sink, pose_stream
from gridloom.streaming.live import live_map, read_map


@pytest.fixture
def files(tmp_path):
    (tmp_path / "lexicon.json").write_text(json.dumps({"classes": [{"name": "chair", "id": 3}, {"name": "bed", "id": 4}]}))
    (tmp_path / "objects.csv").write_text("id,name,main_category,main_wnsynsetkey,wnsynsetkey\na,A,seat,chair.n.01,stool.n.02\nb,B,,,\n")
    (tmp_path / "configs/deep").mkdir(parents=True)
    (tmp_path / "configs/a.object_config.json").write_text('{"semantic_id": 3}')
    (tmp_path / "configs/deep/b.object_config.json").write_text("{}")
    (tmp_path / "configs/deep/zz.object_config.json").write_text('{"semantic_id": 4}')
    for s in ("s2", "s1"):
        (tmp_path / f"{s}.scene_instance.json").write_text("{}")
    return tmp_path


def test_catalogue(spark, files):
    from gridloom.operators.lookup import semantic_classes, vocabulary

    catalogue = readers.object_catalogue(spark, f"{files}/objects.csv")
    assert [tuple(r) for r in catalogue.orderBy("id").collect()] == [("a", "seat", "chair", "stool", "A"), ("b", "unknown", "unknown", "unknown", "B")]
    configs = readers.object_configs(spark, f"{files}/configs", catalogue)
    got = semantic_classes(catalogue, configs, readers.lexicon(spark, f"{files}/lexicon.json"))
    assert {tuple(r) for r in got.collect()} == {("a", "chair"), ("b", "undefined")}
    assert vocabulary(catalogue).where("id = 'a'").first().class_name == "stool"
    assert [r.scene for r in readers.scenes(spark, str(files), ["*"]).collect()] == ["s1", "s2"]
    assert readers.scenes(spark, str(files), ["x"]).first().scene == "x"
    assert readers.images(spark, f"{files}/none").collect() == []


def test_dataset_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(0, "images/a.jpg", 640, 480), (1, "images/b.jpg", 640, 480)], "id long, file_name string, width int, height int")
    notes = spark.createDataFrame([(1, 0, 9, [1.0, 2.0, 3.0, 4.0], [[1.0, 2.0]], 12.0, 0)], "id long, image_id long, category_id long, bbox array<double>, segmentation array<array<double>>, area double, iscrowd int")
    kinds = spark.createDataFrame([(9, "chair", "f")], "id long, name string, frequency string")
    classes = spark.createDataFrame([("chair", 0)], "class_name string, idx long")
    buckets = spark.createDataFrame([("chair", "frequent")], "class_name string, bucket string")
    folder = f"{tmp_path}/set"
    sinks.save_dataset(folder, {"test": (images, notes)}, kinds, classes, buckets)
    assert 'classes_frequent:\n  0: "chair"' in (tmp_path / "set/dataset.yaml").read_text()
    records = readers.detection_records(spark, f"{folder}/set_test.json", "/root")
    got = {r.image_id: r for r in records.collect()}
    assert got[0].file_name == "/root/images/a.jpg" and got[0].annotations[0].contiguous_id == 0 and got[1].annotations == []
    written = json.loads((tmp_path / "set/set_test.json").read_text())
    assert [i["id"] for i in written["images"]] == [0, 1] and written["annotations"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")) == ["dataset.yaml", "set_test.json"]
    maps = {"classes": {1: "bed", 0: "chair"}, "classes_frequent": {0: "chair"}, "classes_rare": {1: "bed"}}
    known = sinks.register(spark, folder, {"test": records}, maps, {"test": kinds.union(kinds.selectExpr("id - 6", "name", "frequency"))})
    assert known == {"test": {
        "view": "set_test", "json_file": f"{folder}/set_test.json", "image_root": f"{folder}/test",
        "classes": ["chair", "bed"], "frequency": {"bed": "r", "chair": "f"}, "contiguous_ids": {3: 0, 9: 1},
    }}
    assert spark.table("set_test").count() == 2
    assert readers.datasets(spark, str(tmp_path)) == ["set"]
    with pytest.raises(FileExistsError):
        sinks.save_dataset(folder, {}, kinds, classes, buckets)


def test_episodes(spark, tmp_path):
    from gridloom.operators.annotations import episodes

    views = spark.createDataFrame([("s", 1, i, float(i), 0.0, 1.0, [1.0, 0.0, 0.0, 0.0]) for i in range(5)], "scene string, object int, seq int, x double, y double, z double, rotation array<double>")
    got = episodes(views, ["scene", "object"], F.lit("0_obj_id_1"), F.col("scene"), ["seq"])
    sinks.write_episodes(f"{tmp_path}/e", got.drop("scene", "object"))
    part = next(p for p in (tmp_path / "e").iterdir() if p.name.endswith(".json.gz"))
    assert json.loads(gzip.open(part).readline())["episode_id"] == "0_obj_id_1"
    back = readers.episodes(spark, f"{tmp_path}/e").first()
    assert back.start_position == [0.0, 0.0, 1.0] and back.goals[0].position == [4.0, 0.0, 1.0] and len(back.info.viewpoints) == 5


def test_images(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two"))], "stem string, content binary")
    sinks.write_images(rows, f"file://{tmp_path}").collect()
    (tmp_path / "images/c.png").write_bytes(b"three")
    stems = spark.createDataFrame([("a",), ("c",)], "stem string")
    got = readers.image_bytes(spark, f"{tmp_path}/images", stems)
    assert {r.stem: bytes(r.content) for r in got.collect()} == {"a": b"one", "c": b"three"}
    assert [r.file for r in readers.images(spark, f"{tmp_path}/images").collect()] == ["a.jpg", "b.jpg", "c.png"]


def test_streams(spark, tmp_path):
    steps = spark.createDataFrame([(1, i, 1.0, 0.0, 90.0) for i in range(4)], "env long, step long, dx double, dy double, turn double")
    steps.coalesce(1).write.parquet(f"{tmp_path}/steps")
    stream = spark.readStream.schema(steps.schema).parquet(f"{tmp_path}/steps")
    q = pose_stream(stream).writeStream.format("memory").queryName("poses").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.step: (round(r.x, 6), round(r.y, 6)) for r in spark.table("poses").collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (0, 1), 3: (0, 0)}
    cells = spark.createDataFrame([(0, 1, 2, 3, 0.5), (0, 1, 2, 3, 0.75), (0, 1, 9, 9, 1.0)], "env long, channel int, row int, col int, value double")
    cells.repartition(3).write.parquet(f"{tmp_path}/cells")
    source = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/cells")
    source.writeStream.foreachBatch(max_merge_sink(f"{tmp_path}/map")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in read_map(spark, f"{tmp_path}/map").collect()} == {tuple(r) for r in live_map(cells).collect()}
