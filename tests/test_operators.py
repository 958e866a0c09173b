"""Operators against small brute-force versions and worked examples."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Camera, Grid, Mapping, MapSize
from gridloom.functions import numbers, pose, strings
from gridloom.operators import annotations, contours, curation, grid, instances, lookup, mapstate, morphology, projection, sampling, vectors
from gridloom.operators.stencil import cone, disk, plus, square


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cells(spark, at):
    return spark.createDataFrame(list(at), "row int, col int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_offsets():
    assert len(disk(10)) == 317 and len(disk(4)) == 49 and len(plus()) == 5
    assert sum(len(cone(y, 10, 2, 8)) for y in grid.HEADINGS) == 76


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(1)
    image = rng.random((9, 11)) < 0.6
    got = cells(spark, [tuple(map(int, p)) for p in np.argwhere(image)])
    padded = np.pad(image, 1)
    grown = np.zeros_like(image)
    shrunk = np.ones_like(image)
    outside = np.pad(image, 1, constant_values=True)
    for a, b in plus():
        grown |= padded[1 + a : 10 + a, 1 + b : 12 + b]
        shrunk &= outside[1 + a : 10 + a, 1 + b : 12 + b]
    assert rows(morphology.dilate(got, plus(), 9, 11)) == sorted(map(tuple, np.argwhere(grown).tolist()))
    assert rows(morphology.erode(got, plus(), 9, 11)) == sorted(map(tuple, np.argwhere(shrunk).tolist()))
    opened = morphology.opening(got, plus(), 9, 11)
    assert rows(morphology.opening(opened, plus(), 9, 11)) == rows(opened)


def test_full_image_is_not_eroded(spark):
    full = cells(spark, [(r, c) for r in range(3) for c in range(3)])
    assert len(rows(morphology.erode(full, plus(), 3, 3))) == 9


def test_frontier_of_all_explored_is_empty(spark):
    full = cells(spark, [(r, c) for r in range(5) for c in range(5)])
    assert rows(morphology.frontier(full, 5, 5, 1)) == []


def test_components_of_a_long_line(spark):
    snake = [(0, c) for c in range(40)] + [(2, c) for c in range(5)]
    found = morphology.components(cells(spark, snake), plus())
    assert {r.component for r in found.collect()} == {0, 2 << 20}
    assert len(rows(morphology.largest_component(cells(spark, snake), plus()))) == 40


def test_frequency_buckets(spark):
    counts = spark.createDataFrame([(c, n) for n, c in enumerate("abcdef", 1)], "class_name string, n long")
    got = {r.class_name: r.bucket for r in curation.frequency_buckets(counts).collect()}
    assert got == {"a": "rare", "b": "rare", "c": "rare", "d": "common", "e": "common", "f": "frequent"}
    every = spark.createDataFrame([("a",), ("z",)], "class_name string")
    lone = spark.createDataFrame([("a", 7)], "class_name string, n long")
    assert {r.bucket for r in curation.frequency_buckets(lone, every).collect()} == {"rare"}
    assert [r.bucket for r in curation.frequency_buckets(lone.limit(0), every.limit(1)).collect()] == ["rare"]


@pytest.mark.parametrize(("areas", "num", "size", "least"), [
    (range(1, 101), 20, 20, 51), (range(1, 101), 60, 50, 51), ([5] * 40, 20, 20, 5), (range(1, 11), 20, 10, 1),
])
def test_area_bins(spark, areas, num, size, least):
    df = spark.createDataFrame([("g", f"k{i}", float(a)) for i, a in enumerate(areas)], "g string, k string, a double")
    got = sampling.area_bins(df, "g", "k", "a", num_samples=num)
    joined = got.join(df, ["g", "k"])
    assert got.count() == size == got.distinct().count()
    assert joined.agg(F.min("a")).first()[0] >= least
    assert rows(sampling.area_bins(df.repartition(3), "g", "k", "a", num_samples=num)) == rows(got)


def _plain_area_bins(areas, num, bins, top, seed):
    """Keys of the sample of one group {key: area}, by its rules."""
    h = lambda s, k: (hashlib.md5(f"{s}:{k}".encode()).hexdigest(), k)
    v, n = sorted(areas.values()), len(areas)
    if n < num:
        return set(areas)
    at = lambda r: (v[r // bins], v[min(r // bins + 1, n - 1)], r % bins / bins)
    edges = sorted({a + (b - a) * f for a, b, f in (at(i * (n - 1)) for i in range(bins + 1))})
    if len(edges) < 3:
        return set(sorted(areas, key=lambda k: h(seed, k))[:num])
    place = {k: sum(e <= a for e in edges[1:-1]) for k, a in areas.items()}
    kept = range(max(0, len(edges) - 1 - top), len(edges) - 1)
    main = []
    for b in kept:
        main += sorted((k for k in areas if place[k] == b), key=lambda k: h(seed, k))[: max(1, num // min(len(edges) - 1, top))]
    rest = sorted((k for k in areas if place[k] in kept and k not in main), key=lambda k: h(seed + 1, k))
    return set(main[:num] + rest[: max(0, num - len(main))])


def test_area_bins_by_their_rules_from_few_reads(spark):
    kinds = {"many": lambda i: i * 7919 % 1009 / 8, "ties": lambda i: i * i % 7, "skew": lambda i: 0 if i % 9 else i, "two": lambda i: i % 50 // 49, "one": lambda i: 3, "null": lambda i: None if i % 3 else i}
    groups = {(g, n): {f"{g}{i}": f(i) for i in range(n)} for g, f in kinds.items() for n in (1, 6, 7, 23, 200)}
    table = [(f"{g}{n}", k, None if a is None else float(a)) for (g, n), areas in groups.items() for k, a in areas.items()]
    df = spark.createDataFrame(table + [(None, "x", 1.0)], "g string, k string, a double")
    for num, bins, top, seed in ((7, 10, 5, 0), (2, 4, 3, 1), (40, 5, 5, 0)):
        got = sampling.area_bins(df, "g", "k", "a", num, bins, top, seed)
        want = {(f"{g}{n}", k) for (g, n), areas in groups.items() for k in _plain_area_bins({k: a or 0.0 for k, a in areas.items()}, num, bins, top, seed)}
        assert sorted(rows(got)) == sorted(want)
    # each read is a copy of the rows' whole plan
    plan = sampling.area_bins(spark.range(9).selectExpr("id % 2 g", "id k", "id a"), "g", "k", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2


def test_kmeans(spark):
    points = [(i, [float(i % 3) * 10, float(i // 3) / 10]) for i in range(30)]
    df = spark.createDataFrame(points, "key long, v array<double>")
    medoids, parts = sampling.kmeans(df, 3, seed=3)
    assert medoids.count() <= 3 and parts.count() == 30
    same, single = sampling.kmeans(df.limit(2), 5)
    assert same.count() == single.count() == 2


def test_covisibility(spark):
    samples = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [1, 2, 3]), (4, [4])], "key long, objects array<int>")
    positions = spark.createDataFrame([(i, [float(i), 0.0]) for i in (1, 2, 3, 4)], "object int, v array<double>")
    got = sampling.covisibility_subset(samples, positions)
    seen = {o for k, o in samples.select("key", F.explode("objects")).collect() if k in got}
    assert seen == {1, 2, 3, 4}
    assert set(sampling.covisibility_sample(samples, positions, 10)) == {1, 2, 3, 4}


def test_balanced_sample(spark):
    rows_ = [(i, ["a"]) for i in range(90)] + [(100 + i, ["b"]) for i in range(10)]
    df = spark.createDataFrame(rows_, "key long, classes array<string>")
    got = sampling.balanced_sample(df, 16, seed=2)
    kinds = [r.classes[0] for r in got.collect()]
    assert len(kinds) == 16 and kinds.count("b") >= 4  # under 2 would be drawn by chance


def test_association(spark):
    world = spark.createDataFrame([(0, 1, 3, 5, 5), (0, 1, 7, 5, 9), (0, 1, 9, 0, 0)], "env int, category int, id long, row int, col int")
    local = spark.createDataFrame([(0, 1, 5, 5, 6), (0, 1, 4, 30, 30), (0, 1, 8, 40, 40)], "env int, category int, id long, row int, col int")
    got = {r.local_id: r.global_id for r in instances.associate(local, world, 64, 64, radius=5).collect()}
    assert got == {5: 3, 4: 10, 8: 11}


def test_splat(spark):
    df = spark.createDataFrame([(2.25, 4.0)], "p double, value double")
    assert rows(projection.splat(df, [], ["p"], [4])) == [(2, 3.0), (3, 1.0)]
    edge = spark.createDataFrame([(0.5, 4.0)], "p double, value double")
    assert rows(projection.splat(edge, [], ["p"], [4])) == [(1, 2.0)]


def test_windows(spark):
    size = MapSize()
    for at, want in ((480, (240, 720)), (10, (0, 480)), (950, (480, 960))):
        got = one(spark, grid.window(F.lit(at), F.lit(at), size))
        assert (got.top, got.bottom) == want


def test_poses(spark):
    got = one(spark, pose.relative_pose(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2)))
    assert got == pytest.approx((1, 0, math.pi / 2))
    for angle, want in ((180.0, 180.0), (-180.0, 180.0), (270.0, -90.0), (-30.0, -30.0), (720.0, 0.0)):
        assert one(spark, pose.normalize_degrees(F.lit(angle))) == want
    steps = [(1, i, 1.0, 0.5, 40.0) for i in range(12)]
    df = spark.createDataFrame(steps, "env long, step long, dx double, dy double, turn double")
    from gridloom.streaming import fold_poses

    want = fold_poses((0.0, 0.0, 0.0), [s[1:] for s in steps])
    got = pose.integrate_poses(df, "env", ["step"], "dx", "dy", "turn").orderBy("step").select("step", "x", "y", "heading_deg").collect()
    assert np.allclose(want, [tuple(r) for r in got])


def test_rotations(spark):
    turn = pose.quaternion_from_rpy(F.lit(0.3), F.lit(-0.2), F.lit(0.7))
    m = np.array(one(spark, pose.rotation_matrix(turn))).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3))
    back = one(spark, pose.rpy_from_matrix(pose.rotation_matrix(turn)))
    assert back == pytest.approx((0.3, -0.2, 0.7))
    q = one(spark, pose.quaternion_from_matrix(pose.rotation_matrix(turn)))
    assert q == pytest.approx(tuple(one(spark, turn)))
    x, y = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", (1, 0, 0), strict=True)]), F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", (0, 1, 0), strict=True)])
    r = np.array(one(spark, pose.rotation_between(x, y))).reshape(3, 3)
    assert np.allclose(r @ [1, 0, 0], [0, 1, 0])
    six = np.array(one(spark, pose.matrix_from_6d(x, y))).reshape(3, 3)
    assert np.allclose(six, np.eye(3))
    camera = pose.camera_matrix(x, turn)
    assert one(spark, camera)[3] == 1.0 and len(one(spark, pose.swap_axes(camera))) == 16
    assert one(spark, pose.angle_between(x, y)) == pytest.approx(math.pi / 2)


def test_strings(spark):
    assert one(spark, strings.synset_key(F.lit("couch.n.01"))) == "couch"
    assert one(spark, strings.synset_key(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, strings.shortname(F.lit("abc/x/foo12_part_1.object_config.json_:0003"))) == "foo12"
    stem = strings.pose_stem(F.lit("p"), F.lit(-1.25), F.lit(0.0), F.lit(3.5), F.lit(90.0))
    assert one(spark, stem) == "p_x_-1p25_y_0p00_z_3p50_yaw_90p00"
    assert one(spark, strings.stem_number(stem, "x")) == -1.25
    assert tuple(one(spark, strings.hex_to_rgb(F.lit("#ff0010")))) == (255, 0, 16)
    with pytest.raises(Exception, match="not a colour"):
        one(spark, strings.hex_to_rgb(F.lit("#ff0")))


def test_missing_object_is_an_error(spark):
    objects = spark.createDataFrame([("a",), ("b",)], "obj_name string")
    vocab = spark.createDataFrame([("a", "chair")], "id string, class_name string")
    assert rows(lookup.missing_objects(objects, vocab)) == [("b",)]
    with pytest.raises(Exception, match="not in the vocabulary"):
        lookup.annotate(objects, vocab).collect()
    with pytest.raises(ValueError):
        lookup.vocabulary(vocab, "nothing")


def test_contours(spark):
    square = [(r, c) for r in range(2, 6) for c in range(3, 9)]
    df = spark.createDataFrame([(1, r, c) for r, c in square] + [(2, 0, 0)], "id int, row int, col int")
    got = contours.mask_polygons(df, ["id"]).collect()
    assert [r.id for r in got] == [1]
    corners = set(zip(got[0].mask_polygons[0][::2], got[0].mask_polygons[0][1::2], strict=True))
    assert corners == {(3.0, 2.0), (8.0, 2.0), (8.0, 5.0), (3.0, 5.0)}


def test_depth_camera(spark):
    cam = Camera(4, 4, 90.0)
    df = spark.createDataFrame([(0, 0, 2.0), (3, 3, 2.0), (1, 0, 2.0)], "row int, col int, depth double")
    got = rows(projection.depth_points(df, cam, 1).select("row", "col", "px", "py", "pz"))
    assert got[0] == pytest.approx((0, 0, -1.5, 2.0, 1.5)) and got[2] == pytest.approx((3, 3, 1.5, 2.0, -1.5))
    assert projection.depth_points(df, cam, 2).count() == 1
    mapping = Mapping()
    patch = projection.patch_of_frames(
        spark.createDataFrame([(0, r, c, 200.0) for r in range(0, 48) for c in range(0, 64)], "env int, row int, col int, depth double"),
        Camera(64, 48), mapping, ["env"], 88.0,
    )
    assert patch.agg(F.min("explored"), F.max("explored")).first()[1] <= 1.0 and patch.count() > 0


def test_map_state(spark):
    envs = spark.createDataFrame([(0,), (1,)], "env long")
    world, poses = mapstate.initial_state(envs, MapSize())
    assert world.count() == 2 * 2 * 9 and {r.top for r in poses.collect()} == {240}
    places = spark.createDataFrame([(0, 0, 480, 480), (0, 1, 2, 2)], "env long, step long, row int, col int")
    after = mapstate.update(world, mapstate.empty_map(spark), places, Mapping())
    now = after.where("env = 0 and channel = 2").agg(F.max("row")).first()[0]
    assert now == 4  # the old current place is gone, the new one is cut at the border
    goal = spark.createDataFrame([(0, 1, 1)], "env long, row int, col int")
    rim = spark.createDataFrame([(0, 9, 9), (1, 9, 9)], "env long, row int, col int")
    assert rows(mapstate.goal_or_frontier(goal, rim)) == [(0, 1, 1), (1, 9, 9)]


def _plain_pass(image, angle, x, y):
    """Each output cell reads its place, zero outside."""
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


def test_resample_is_two_plain_passes(spark):
    n = 7
    image = [[((r * n + c) * 5 % 11) / 11 for c in range(n)] for r in range(n)]
    df = spark.createDataFrame([(k, r, c, image[r][c]) for k in range(4) for r in range(n) for c in range(n) if image[r][c]], "k int, row int, col int, value double")
    turns = [(0.0, 0.0, 0.0), (0.3, -0.2, 0.7), (-0.9, 0.4, 2.5), (0.05, 0.0, -math.pi / 2)]
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in turns]), F.col("k") + 1)
    got = {(r.k, r.row, r.col): r.value for r in projection.resample(df, ["k"], n, pick(0), pick(1), pick(2)).collect()}
    for k, (x, y, a) in enumerate(turns):
        want = _plain_pass(_plain_pass(image, a, 0.0, 0.0), 0.0, x, y)
        for r in range(n):
            for c in range(n):
                assert abs(got.get((k, r, c), 0.0) - min(1.0, want[r][c])) < 1e-9


def test_erosion_by_the_rim(spark):
    import random

    rng = random.Random(1)
    cells = {(k, r, c) for k in range(2) for r in range(20) for c in range(17) if rng.random() < 0.9}
    df = spark.createDataFrame(sorted(cells), "k int, row int, col int")
    for offsets in (disk(2), square(1), [(0, 1), (2, 0)]):
        got = {tuple(r) for r in morphology.erode(df, offsets, 20, 17).collect()}
        want = {(k, r, c) for k, r, c in cells if all((k, r - a, c - b) in cells or not (0 <= r - a < 20 and 0 <= c - b < 17) for a, b in offsets)}
        assert got == want


def test_denoise_closes_first(spark):
    df = spark.createDataFrame([(r, c) for r in range(9) for c in range(9) if (r, c) not in ((4, 4), (4, 5))] + [(2, 14)], "row int, col int")
    got = {tuple(r) for r in morphology.denoise(df, square(1), 20, 20).collect()}
    assert got == {(r, c) for r in range(9) for c in range(9)}


def test_association_lets_the_largest_label_win(spark):
    local = spark.createDataFrame([(0, 1, 2, 5, 5), (0, 1, 9, 5, 6)], "env long, category int, id long, row int, col int")
    world = spark.createDataFrame([(0, 1, 4, 5, 8), (0, 1, 3, 5, 3)], "env long, category int, id long, row int, col int")
    got = {r.local_id: (r.global_id, r.new) for r in instances.associate(local, world, 20, 20, radius=2).collect()}
    assert got == {9: (4, False), 2: (3, False)}
    near = spark.createDataFrame([(0, 1, 4, 5, 4)], "env long, category int, id long, row int, col int")
    got = {r.local_id: (r.global_id, r.new) for r in instances.associate(local, near, 20, 20, radius=2).collect()}
    assert got == {9: (4, False), 2: (5, True)}


def test_blacklisted_disks_have_their_own_radius(spark):
    from gridloom.config import BLACKLISTED, Mapping
    from gridloom.operators import mapstate

    places = spark.createDataFrame([(0, 1, 30, 30)], "env long, step long, row int, col int")
    out = mapstate.stamps(places, Mapping(explored_radius=2, close_radius=3, blacklist_radius=1), 60, blacklist=places.drop("step"))
    assert out.where(F.col("channel") == BLACKLISTED).count() == 5


def test_only_been_close_multiplies(spark):
    from gridloom.config import BEEN_CLOSE, EXPLORED, OBSTACLE, VISITED
    from gridloom.operators import mapstate

    rows = [(0, OBSTACLE, 1, 1, 0.5), (0, EXPLORED, 1, 1, 1.0), (0, BEEN_CLOSE, 1, 1, 0.5), (0, EXPLORED, 2, 2, 1.0), (0, VISITED, 2, 2, 1.0)]
    got = mapstate.only_been_close(spark.createDataFrame(rows, "env long, channel int, row int, col int, value double"))
    assert {tuple(r) for r in got.collect()} == {(0, OBSTACLE, 1, 1, 0.25), (0, EXPLORED, 1, 1, 0.5), (0, BEEN_CLOSE, 1, 1, 0.5), (0, VISITED, 2, 2, 1.0)}


def test_a_class_counts_once_in_a_balanced_sample(spark):
    rows_ = [(i, ["a"] * (1 + i % 3)) for i in range(90)] + [(100 + i, ["b"]) for i in range(10)]
    once = [(i, sorted(set(c))) for i, c in rows_]
    pick = lambda r: {x.key for x in sampling.balanced_sample(spark.createDataFrame(r, "key long, classes array<string>"), 16, seed=2).collect()}
    assert pick(rows_) == pick(once)


def test_planar_state(spark):
    import numpy as np

    from gridloom.functions import pose

    rows_ = [(1.0, 2.0, 3.0, math.cos(h / 2), 0.0, math.sin(h / 2), 0.0, h) for h in (-3.0, -1.2, 0.0, 0.4, 2.9)]
    df = spark.createDataFrame(rows_, "px double, py double, pz double, w double, x double, y double, z double, h double")
    q = F.struct("w", "x", "y", "z")
    got = df.select("h", pose.planar_state(F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")), q).alias("s")).collect()
    for r in got:
        assert (r.s.x, r.s.y) == (-3.0, -1.0) and abs(np.angle(np.exp(1j * (r.s.heading - r.h)))) < 1e-7


def test_look_at(spark):
    import numpy as np

    from gridloom.functions import pose

    rng = np.random.default_rng(3)
    frames = []
    for _ in range(12):
        ahead = [v / np.linalg.norm(v) for v in rng.normal(size=(2, 3))]
        up = [np.cross(np.cross(a, u), a) for a, u in zip(ahead, rng.normal(size=(2, 3)), strict=True)]
        frames.append([*map(float, np.concatenate([np.array([0.0, 1.0, 0.0]), np.array([0.0, 0.0, -1.0]), up[1] / np.linalg.norm(up[1]), ahead[1]]))])
    names = [f"{v}{c}" for v in ("a", "b", "c", "d") for c in "xyz"]
    df = spark.createDataFrame(frames, names)
    v = lambda n: F.struct(*[F.col(n + c).alias(c) for c in "xyz"])
    for r, f in zip(df.select(pose.look_at(v("a"), v("b"), v("c"), v("d")).alias("m")).collect(), frames, strict=True):
        m = np.array(r.m).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-6) and np.linalg.det(m) > 0.99
        assert np.allclose(m @ f[3:6], f[9:12], atol=2e-3) and np.allclose(m @ f[0:3], f[6:9], atol=2e-3)

def test_document(spark, tmp_path):
    from gridloom.sources import sinks

    images = spark.createDataFrame([(i, f"{i}.jpg") for i in range(40)], "id long, file_name string").repartition(5)
    notes = spark.createDataFrame([(1, 0)], "id long, image_id long").limit(0)
    kinds = spark.createDataFrame([(1, "ch\u00e4ir \"x\"", "f")], "id long, name string, frequency string")
    sinks.write_document(f"{tmp_path}/d.json", images, notes, kinds)
    got = json.loads((tmp_path / "d.json").read_text())
    assert [i["file_name"] for i in got["images"]] == [f"{i}.jpg" for i in range(40)] and got["annotations"] == []
    assert got["categories"] == [{"id": 1, "name": "ch\u00e4ir \"x\"", "frequency": "f"}]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["d.json"]
    sinks.write_tables(f"{tmp_path}/t", images, notes, kinds)
    assert spark.read.parquet(f"{tmp_path}/t/images").count() == 40
    with pytest.raises(FileExistsError):
        sinks.write_document(f"{tmp_path}/d.json", images, notes, kinds)

def test_background_and_normalisation(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0])], "class_name string, embedding array<double>")
    got = {r.class_name: list(r.embedding) for r in vectors.with_background(df).collect()}
    assert got == {"a": [0.6, 0.8], "background": [0.0, 0.0]}


def test_numbered(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"))
    got = numbers.numbered(df, ["k"], F.floor(F.col("k") / 7), "n")
    assert all(r.k == r.n for r in got.collect())


def test_world_to_grid(spark):
    got = one(spark, grid.world_to_grid(F.lit(0.625), F.lit(0.375), Grid()))
    assert tuple(got) == (2, 2)  # 1.5 and 2.5 both go to the even cell
