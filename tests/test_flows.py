"""Whole flows against plain versions."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.config import BEEN_CLOSE, CURRENT, EXPLORED, OBSTACLE, VISITED, Camera, Curation, Grid, Mapping, MapSize
from gridloom.operators import flows
from gridloom.operators.stencil import disk, square
from gridloom.plans import flow


def _plain_pass(image, angle, x, y):
    n = len(image)
    out = [[0.0] * n for _ in range(n)]
    for r in range(n):
        for c in range(n):
            u, v = (2 * c + 1) / n - 1, (2 * r + 1) / n - 1
            at_c = (u * math.cos(angle) - v * math.sin(angle) + x + 1) / 2 * (n - 1)
            at_r = (u * math.sin(angle) + v * math.cos(angle) + y + 1) / 2 * (n - 1)
            for i in (math.floor(at_r), math.floor(at_r) + 1):
                for j in (math.floor(at_c), math.floor(at_c) + 1):
                    if 0 <= i < n and 0 <= j < n:
                        out[r][c] += image[i][j] * (1 - abs(at_r - i)) * (1 - abs(at_c - j))
    return out


def _plain_frame(frame, camera, m, lift, tilt):
    """{(row, col): (obstacle, explored)} of one frame's patch."""
    voxels = defaultdict(float)
    shift = m.vision_range * m.size.resolution_cm // 2
    for (r, c), depth in frame.items():
        if r % m.stride or c % m.stride or not 0 < depth <= m.max_depth_cm:
            continue
        x = (c - (camera.width - 1) / 2) * depth / camera.focal
        y, z = depth, (camera.height - 1 - r - (camera.height - 1) / 2) * depth / camera.focal
        y, z = y * math.cos(tilt) - z * math.sin(tilt), y * math.sin(tilt) + z * math.cos(tilt) + lift
        place = ((x + shift) / m.size.resolution_cm, y / m.size.resolution_cm, z / m.size.resolution_cm - m.min_voxel)
        for corner in range(8):
            at = [math.floor(p) + (corner >> k & 1) for k, p in enumerate(place)]
            if all(0 < a < d for a, d in zip(at, (m.vision_range, m.vision_range, m.max_voxel - m.min_voxel), strict=True)):
                voxels[tuple(at)] += math.prod(1 - abs(p - a) for p, a in zip(place, at, strict=True))
    sums = defaultdict(lambda: [0.0, 0.0])
    for (i, j, k), v in voxels.items():
        v = round(v)
        sums[j, i][0] += v * (m.min_mapped <= k < m.max_mapped)
        sums[j, i][1] += v
    return {at: tuple(min(1.0, s / t) for s, t in zip(v, (m.obstacle_threshold, m.explored_threshold), strict=True)) for at, v in sums.items()}


@pytest.mark.parametrize("tilt", [0.0, -20.0])
def test_map_steps(spark, tilt):
    size = MapSize(240, 5, 2)
    m = Mapping(size=size, vision_range=12, stride=1, explored_radius=2, close_radius=3, obstacle_threshold=3.0, explored_threshold=5.0)
    camera, lift = Camera(10, 8, 79.0), 88.0
    poses = [(0, 1, 1.2, 1.2, 0.0), (0, 2, 1.4, 1.1, 40.0), (1, 1, 0.2, 2.2, -130.0)]
    frames = {(e, s): {(r, c): float((r * 7 + c * 5 + s * 11) % 50 + 10) for r in range(8) for c in range(10)} for e, s, *_ in poses}
    rows = [(e, s, r, c, d) for (e, s), f in frames.items() for (r, c), d in f.items()]
    want = defaultdict(float)
    big, small = size.global_cells, size.local_cells
    last = {0: 2, 1: 1}
    for e, s, x, y, heading in poses:
        row, col = math.floor(y * 100 / 5), math.floor(x * 100 / 5)
        top, left = (max(0, min(v - small // 2, big - small)) for v in (row, col))
        patch = _plain_frame(frames[e, s], camera, m, lift, math.radians(tilt))
        for i, channel in enumerate((OBSTACLE, EXPLORED)):
            image = [[0.0] * small for _ in range(small)]
            for (a, b), v in patch.items():
                if 0 <= a + small // 2 < small:
                    image[a + small // 2][b + (small - 12) // 2] = v[i]
            half = small // 2
            px, py = (-((v * 100 / 5 - half) / half) for v in (x - left * 0.05, y - top * 0.05))
            image = _plain_pass(_plain_pass(image, math.radians(90 - heading), 0.0, 0.0), 0.0, px, py)
            for a in range(small):
                for b in range(small):
                    if image[a][b]:
                        at = (e, channel, a + top, b + left)
                        want[at] = max(want[at], min(1.0, image[a][b]))
        stamps = [(VISITED, square(2)), (EXPLORED, disk(2)), (BEEN_CLOSE, disk(3))] + ([(CURRENT, square(2))] if last[e] == s else [])
        for channel, offsets in stamps:
            for a, b in offsets:
                if 0 <= row + a < big and 0 <= col + b < big:
                    want[e, channel, row + a, col + b] = 1.0
    got = flows.map_steps(
        spark.createDataFrame(rows, "env long, step long, row int, col int, depth double"),
        spark.createDataFrame(poses, "env long, step long, x double, y double, heading_deg double"),
        camera, m, lift, tilt,
    )
    found = {tuple(r)[:4]: r.value for r in got.select("env", "channel", "row", "col", "value").collect()}
    assert len([v for v in want.values() if 0 < v < 1]) > 20
    assert all(abs(found.get(k, 0.0) - want.get(k, 0.0)) < 1e-6 for k in found.keys() | want.keys())


def test_flows_of_one_scene(spark):
    objects = spark.createDataFrame([("s", 1, "chair", 20, 20), ("s", 2, "bed", 40, 40), ("s", 3, "unknown", 20, 40)], "scene string, object_id long, class_name string, row int, col int")
    free = spark.createDataFrame([(r, c) for r in range(60) for c in range(60)], "row int, col int")
    views = flows.candidate_views(objects, free, Grid())
    one = F.struct("object_id", "class_name", F.when(F.col("yaw_deg") < 90, 2000).otherwise(10).cast("long").alias("mask_area"))
    frames = views.groupBy("scene", *flows.POSE).agg(F.collect_list(one).alias("instances"))
    classes = spark.createDataFrame([("chair",), ("bed",), ("lamp",)], "class_name string")
    found = flows.detection_set(objects, free, frames, classes, Grid(), Curation(per_class=12))
    got = found.samples.collect()
    assert {r.class_name for r in got} <= {"chair", "bed"} and got
    assert all(any(i.class_name == r.class_name and i.mask_area >= 1000 for i in r.instances) for r in got)
    assert all(sum(x.object_id == k for x in got) <= 3 for k in (1, 2))
    assert {r.class_name: r.bucket for r in found.buckets.collect()}["lamp"] == "rare"
    scenes = spark.createDataFrame([("s", 0)], "scene string, scene_idx long")
    episodes = {r.episode_id: r for r in flows.episode_set(objects, free, frames, scenes, Grid()).collect()}
    assert set(episodes) == {"0_obj_id_1", "0_obj_id_2"}
    wanted = views.where("object_id = 1 and yaw_deg < 90").count()
    e = episodes["0_obj_id_1"]
    assert len(e.info.viewpoints) == wanted and e.start_position == e.info.viewpoints[0].position and e.goals[0].radius == 0.0


def _broadcast_poses(frame):
    """Joins on poses that the plan broadcasts a side of."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "yaw_deg" in x]


def _crowd(spark):
    """Objects at one place, frames whose areas a key gives, and the frames as plain lists."""
    objects = [("s", i, "chair" if i % 3 else "bed", 20, 20) for i in range(9)] + [("s", 0, "bed", 22, 20), ("s", 9, "unknown", 20, 20)]
    table = spark.createDataFrame(objects, "scene string, object_id long, class_name string, row int, col int")
    free = spark.createDataFrame([(r, c) for r in range(40) for c in range(40)], "row int, col int")
    views = [tuple(r) for r in flows.candidate_views(table, free, Grid()).select("scene", "object_id", "class_name", *flows.POSE).collect()]
    shown = defaultdict(list)
    for s, i, c, *pose in views:
        area = (i * 37 + pose[0] * 101 + pose[1] * 53 + pose[2]) % 1500
        shown[s, *pose] += [(i, c, None if area % 7 == 0 else area), (i + 100, c, area // 2)]
    rows = [(*k, v) for k, v in shown.items()] + [("s", 20, 20, 0, None), ("s", 20, 20, 30, [])]
    kind = "scene string, row int, col int, yaw_deg int, instances array<struct<object_id: long, class_name: string, mask_area: long>>"
    return table, free, spark.createDataFrame(rows, kind), views, shown


def test_detection_set_takes_areas_of_whole_frames(spark):
    objects, free, frames, views, shown = _crowd(spark)
    most = {(*v[:3], *v[3:]): max((a for _, c, a in shown[v[0], *v[3:]] if c == v[2] and a is not None), default=0) for v in views}
    want = {k for k, a in most.items() if a >= 900}
    assert 0 < len(want) < len(views) and any(i[2] is None for v in shown.values() for i in v)
    classes = objects.select("class_name").distinct()
    got = flows.detection_set(objects, free, frames, classes, Grid(), Curation(min_area=900, per_class=100_000)).samples.collect()
    assert sorted((r.scene, r.object_id, r.class_name, r.row, r.col, r.yaw_deg) for r in got) == sorted(want)
    assert all(sorted(map(str, map(tuple, r.instances))) == sorted(map(str, shown[r.scene, r.row, r.col, r.yaw_deg])) for r in got)


def test_detection_set_broadcasts_no_views_or_frames(spark):
    # files' sizes don't tell how many views or instances come out of them
    assert not _broadcast_poses(flow.QUERIES["detection_set"](spark, "/root/testdata/sf0.001"))


def test_detection_set_keeps_its_plan_small(spark):
    # the driver holds the plan and a status of each of its stages: views of samples and frames, for the edges
    # and the sample, and those of the samples' frames
    plan = flow.QUERIES["detection_set"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < sum("Generate explode" in x and "_o#" in x for x in plan.splitlines()) <= 5


def test_episode_set_takes_the_objects_own_areas(spark):
    objects, free, frames, views, shown = _crowd(spark)
    want = defaultdict(set)
    for v in views:
        if any(i == v[1] and a is not None and a >= 900 for i, _, a in shown[v[0], *v[3:]]):
            want[v[1]].add((v[5], v[3], v[4]))
    want = {f"0_obj_id_{k}": sorted(v) for k, v in want.items() if len(v) >= 4}
    assert want and sum(map(len, want.values())) < len(views)
    scenes = spark.createDataFrame([("s", 0)], "scene string, scene_idx long")
    got = flows.episode_set(objects, free, frames, scenes, Grid(), min_area=900).select("episode_id", "info.viewpoints.position").collect()
    assert {r.episode_id: [(p[2], p[0]) for p in r.position] for r in got} == {k: [(row * 0.25, col * 0.25) for _, row, col in v] for k, v in want.items()}


def test_episode_set_broadcasts_no_views_or_frames(spark):
    assert not _broadcast_poses(flow.QUERIES["episode_set"](spark, "/root/testdata/sf0.001"))


def test_evaluation_counts_overlaps(spark):
    views = spark.createDataFrame([(1, i, i) for i in range(9)] + [(2, i, 20 + i) for i in range(3)], "episode_id long, seq long, frame_id long")
    targets = spark.createDataFrame([(i, 1, 1) for i in (0, 3, 8, 20)], "frame_id long, row long, col long")
    rows = [(0, 1, "a", 1, 1), (0, 1, "a", 2, 2), (0, 2, "b", 5, 5), (3, 3, "a", 4, 4), (8, 4, "a", 1, 1), (20, 5, "a", 1, 1), (5, 6, "a", 1, 1)]
    predicted = spark.createDataFrame(rows, "frame_id long, pred_id long, class_name string, row long, col long")
    kept, rates = flows.evaluation(views, targets, predicted)
    assert [tuple(r) for r in kept.collect()] == [(0, 1)]
    assert {tuple(r) for r in rates.collect()} == {("a", 2, 1, 0.5), ("b", 1, 0, 0.0)}
