"""Queries on grids, morphology, poses, projection, map state and instances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import Camera, Grid, Mapping, MapSize
from ..functions import pose
from ..operators import contours, curation, grid, instances, mapstate, morphology, projection, vectors
from ..operators.stencil import cone, disk, plus, square
from .tables import HEIGHT, SQL_CELLS, SQL_GRID, SQL_LABELLED, SQL_VALUED, WIDTH, cells, labelled_cells, read, sql_offsets, typed_cells, valued_cells

BOX = (HEIGHT, WIDTH)
#: The type whose parts make the cells of a mask.
TYPE = "PROMO"
SQL_TYPED = f"typed AS (SELECT DISTINCT p_size::INT AS r, (p_partkey % 64)::INT AS c FROM part WHERE p_type = '{TYPE}')"
_IN = "r + dr BETWEEN 0 AND 50 AND c + dc BETWEEN 0 AND 63"
D1, D2 = sql_offsets("d1", plus()), sql_offsets("d2", disk(2))
_HOLES = "holes AS (SELECT r, c FROM grid EXCEPT SELECT r, c FROM cells)"
_SQ = sql_offsets("sq", square(1))


def dilate(spark, d):
    return morphology.dilate(cells(spark, d), plus(), *BOX)


DILATE = f'WITH {SQL_CELLS}, {D1} SELECT DISTINCT r + dr AS "row", c + dc AS "col" FROM cells, d1 WHERE {_IN}'


def erode(spark, d):
    return morphology.erode(cells(spark, d), plus(), *BOX)


_ERODED = "eroded AS (SELECT r, c FROM cells EXCEPT SELECT r + dr, c + dc FROM holes, d1)"
ERODE = f'WITH {SQL_CELLS}, {SQL_GRID}, {D1}, {_HOLES}, {_ERODED} SELECT r AS "row", c AS "col" FROM eroded'


def opening(spark, d):
    return morphology.opening(cells(spark, d), plus(), *BOX)


OPENING = f'WITH {SQL_CELLS}, {SQL_GRID}, {D1}, {_HOLES}, {_ERODED} SELECT DISTINCT r + dr AS "row", c + dc AS "col" FROM eroded, d1 WHERE {_IN}'


def closing(spark, d):
    return morphology.closing(cells(spark, d), plus(), *BOX)


CLOSING = f"""WITH {SQL_CELLS}, {SQL_GRID}, {D1}, big AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM cells, d1 WHERE {_IN}),
out AS (SELECT r, c FROM grid EXCEPT SELECT r, c FROM big)
SELECT r AS "row", c AS "col" FROM (SELECT r, c FROM big EXCEPT SELECT r + dr, c + dc FROM out, d1)"""


def denoise(spark, d):
    return morphology.denoise(cells(spark, d), plus(), *BOX)


DENOISE = f"""WITH {SQL_CELLS}, {SQL_GRID}, {D1}, big AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM cells, d1 WHERE {_IN}),
out AS (SELECT r, c FROM grid EXCEPT SELECT r, c FROM big), closed AS (SELECT r, c FROM big EXCEPT SELECT r + dr, c + dc FROM out, d1),
rest AS (SELECT r, c FROM grid EXCEPT SELECT r, c FROM closed), core AS (SELECT r, c FROM closed EXCEPT SELECT r + dr, c + dc FROM rest, d1)
SELECT DISTINCT r + dr AS "row", c + dc AS "col" FROM core, d1 WHERE {_IN}"""


def expand_mask(spark, d):
    return morphology.expand_mask(typed_cells(spark, d, TYPE), 2, *BOX)


EXPAND_MASK = f'WITH {SQL_TYPED}, {D2} SELECT DISTINCT r + dr AS "row", c + dc AS "col" FROM typed, d2 WHERE {_IN}'


def sobel(spark, d):
    return morphology.edges(cells(spark, d), *BOX).select("row", "col", "gx", "gy")


SOBEL = f"""WITH {SQL_CELLS}, {SQL_GRID}, {_SQ}, s AS (
SELECT g.r, g.c, sum(CASE dr WHEN 0 THEN 2 ELSE 1 END * dc)::BIGINT AS gx, sum(CASE dc WHEN 0 THEN 2 ELSE 1 END * dr)::BIGINT AS gy
FROM grid g, sq JOIN cells x ON x.r = g.r + dr AND x.c = g.c + dc GROUP BY 1, 2)
SELECT r AS "row", c AS "col", gx, gy FROM s WHERE sqrt(gx * gx + gy * gy) > 0.5"""


def frontier(spark, d):
    """Of a 480 x 480 map for each type of event, where its places are explored."""
    e = read(spark, d, "events")
    seen = e.select("event_type", (100 + F.col("event_id") * 7 % 151).cast("int").alias("row"), (120 + F.col("user_id") * 13 % 131).cast("int").alias("col"))
    return morphology.frontier(seen.distinct(), 480, 480)


FRONTIER = f"""WITH {sql_offsets('d10', disk(10))}, {D1}, seen AS (SELECT DISTINCT event_type, (100 + event_id * 7 % 151)::INT AS r, (120 + user_id * 13 % 131)::INT AS c FROM events),
grid AS (SELECT a.range::INT AS r, b.range::INT AS c FROM range(480) a, range(480) b), far AS (SELECT DISTINCT event_type, r + dr AS r, c + dc AS c FROM seen, d10),
core AS (SELECT event_type, g.r, g.c FROM grid g, (SELECT DISTINCT event_type FROM seen) EXCEPT SELECT * FROM far)
SELECT event_type, r AS "row", c AS "col" FROM (SELECT event_type, r + dr AS r, c + dc AS c FROM core, d1 WHERE r + dr BETWEEN 0 AND 479 AND c + dc BETWEEN 0 AND 479 EXCEPT SELECT * FROM core)"""


def grey_dilate(spark, d):
    return morphology.grey_dilate(labelled_cells(spark, d), 2, *BOX)


GREY_DILATE = f'WITH {SQL_LABELLED}, {D2} SELECT r + dr AS "row", c + dc AS "col", max(label) AS label FROM labelled, d2 WHERE {_IN} GROUP BY 1, 2'


def median_blur(spark, d):
    every = morphology.full_grid(spark.range(1).select(), *BOX).join(valued_cells(spark, d), ["row", "col"], "left")
    return morphology.median_blur(every.select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")), *BOX)


MEDIAN_BLUR = f"""WITH {SQL_VALUED}, {SQL_GRID}, {_SQ}, f AS (SELECT g.r, g.c, coalesce(v, 0.0) AS v FROM grid g LEFT JOIN valued USING (r, c))
SELECT g.r AS "row", g.c AS "col", quantile_cont(v, 0.5) AS value FROM grid g, sq JOIN f ON f.r = greatest(0, least(50, g.r + dr)) AND f.c = greatest(0, least(63, g.c + dc)) GROUP BY 1, 2"""


def max_pool(spark, d):
    out = morphology.max_pool(valued_cells(spark, d), 4)
    return out.select(F.col("row").cast("int"), F.col("col").cast("int"), "value")


MAX_POOL = f'WITH {SQL_VALUED} SELECT r // 4 AS "row", c // 4 AS "col", max(v) AS value FROM valued GROUP BY 1, 2'


def avg_pool(spark, d):
    out = morphology.avg_pool(valued_cells(spark, d), 4)
    return out.select(F.col("row").cast("int"), F.col("col").cast("int"), "value")


AVG_POOL = f'WITH {SQL_VALUED} SELECT r // 4 AS "row", c // 4 AS "col", sum(v) / 16.0::DOUBLE AS value FROM valued GROUP BY 1, 2'


_RADIUS4 = disk(4)
# a cell's label is replaced whenever a neighbour's is smaller, until none is
_REACH = f"""{{0}}, s AS (SELECT r, c, r::BIGINT * 1048576 + c AS code FROM {{2}}),
{{1}}, e AS MATERIALIZED (SELECT a.code AS u, b.code AS v FROM s a, o JOIN s b ON b.r = a.r + dr AND b.c = a.c + dc),
walk(code, component) USING KEY (code) AS (SELECT code, code FROM s UNION
  SELECT e.v, min(walk.component) FROM walk JOIN e ON walk.code = e.u JOIN recurring.walk AS old ON old.code = e.v WHERE walk.component < old.component GROUP BY e.v),
comp AS (SELECT s.r, s.c, code, component FROM walk JOIN s USING (code))"""
_SQL_WIDE = _REACH.format(SQL_CELLS, sql_offsets("o", _RADIUS4), "cells")
_SQL_FOUR = _REACH.format(SQL_TYPED, sql_offsets("o", plus()), "typed")


def cell_components(spark, d):
    return morphology.components(cells(spark, d), _RADIUS4).select("row", "col", "component")


CELL_COMPONENTS = f'WITH RECURSIVE {_SQL_WIDE} SELECT r AS "row", c AS "col", component FROM comp'


def goal_component(spark, d):
    return morphology.largest_component(cells(spark, d), _RADIUS4)


GOAL_COMPONENT = f"""WITH RECURSIVE {_SQL_WIDE}, best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT r AS "row", c AS "col" FROM comp JOIN best USING (component)"""


def component_centres(spark, d):
    out = morphology.component_centres(typed_cells(spark, d, TYPE), 3)
    return out.select("component", "n", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


COMPONENT_CENTRES = f"""WITH RECURSIVE {_SQL_FOUR}
SELECT component, count(*) AS n, round(avg(r), 6) AS "row", round(avg(c), 6) AS "col" FROM comp GROUP BY 1 HAVING count(*) >= 3"""


def nearest_cell(spark, d):
    return morphology.nearest(labelled_cells(spark, d), 25, 31).select("label", "row", "col", "d2")


NEAREST_CELL = f"""WITH {SQL_LABELLED} SELECT label, r AS "row", c AS "col", (r - 25) * (r - 25) + (c - 31) * (c - 31) AS d2
FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY d2, r, c) = 1"""


def _objects(spark, d):
    return labelled_cells(spark, d).select(F.col("label").alias("object_id"), "row", "col")


def viewpoints(spark, d):
    return grid.viewpoints(_objects(spark, d), cells(spark, d), Grid()).select("object_id", "yaw_deg", "row", "col", "x", "z")


_SEEN = [(a, b, y) for y in grid.HEADINGS for a, b in cone(y, 10, 2, 8)]
VIEWPOINTS = f"""WITH {SQL_CELLS}, {SQL_LABELLED}, {sql_offsets('o', _SEEN, 'yaw')},
seen AS (SELECT DISTINCT label AS object_id, yaw, r - dr AS r, c - dc AS c FROM labelled, o)
SELECT object_id, yaw AS yaw_deg, r AS "row", c AS "col", c * 0.25::DOUBLE AS x, r * 0.25::DOUBLE AS z FROM seen JOIN cells USING (r, c)
WHERE r % 2 = 0 AND c % 2 = 0"""


def agent_states(spark, d):
    return grid.agent_states(cells(spark, d))


AGENT_STATES = f'WITH {SQL_CELLS} SELECT r AS "row", c AS "col", (range * 30)::INT AS yaw_deg FROM cells, range(12)'


def world_cells(spark, d):
    g = Grid(-3.0, 1.0, 0.25)
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 997 / 16).alias("x"), (F.col("event_id") % 643 / 8).alias("z"))
    low = grid.world_to_grid(F.col("x"), F.col("z"), g, False)
    near = grid.world_to_grid(F.col("x"), F.col("z"), g)
    back = grid.grid_to_world(near["row"], near["col"], g)
    return e.select("event_id", near["row"].alias("row"), near["col"].alias("col"), low["row"].alias("row0"), low["col"].alias("col0"), back["x"].alias("bx"), back["z"].alias("bz"))


WORLD_CELLS = """WITH p AS (SELECT event_id, event_id % 997 / 16 AS x, event_id % 643 / 8 AS z FROM events),
q AS (SELECT *, round_even((z - 1.0) / 0.25, 0)::INT AS r, round_even((x + 3.0) / 0.25, 0)::INT AS c FROM p)
SELECT event_id, r AS "row", c AS "col", floor((z - 1.0) / 0.25)::INT AS row0, floor((x + 3.0) / 0.25)::INT AS col0, (c * 0.25 - 3.0)::DOUBLE AS bx, (r * 0.25 + 1.0)::DOUBLE AS bz FROM q"""


def local_windows(spark, d):
    size = MapSize()
    p = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 960).cast("int").alias("r"), (F.col("p_partkey") * 91 % 960).cast("int").alias("c"))
    return p.select("p_partkey", grid.window(F.col("r"), F.col("c"), size).alias("w")).select("p_partkey", "w.*")


LOCAL_WINDOWS = """WITH p AS (SELECT p_partkey, greatest(0, least(p_partkey * 37 % 960 - 240, 480))::INT AS a, greatest(0, least(p_partkey * 91 % 960 - 240, 480))::INT AS b FROM part)
SELECT p_partkey, a AS top, a + 480 AS bottom, b AS "left", b + 480 AS "right" FROM p"""


def footprints(spark, d):
    k = F.col("p_partkey")
    xs = [(0, 0), (0, 1), (2, 0), (2, 2), (1, 0), (1, 2), (3, 0), (3, 1)]
    corner = lambda a, b: F.struct((k % 40 + a * 1.0).alias("x"), F.lit(0.0).alias("y"), (F.col("p_size") * 0.5 + b * 1.0).alias("z"))
    rows = read(spark, d, "part").select("p_partkey", F.array(*[corner(a, b) for a, b in xs]).alias("corners"))
    return grid.footprint(rows, Grid(metres=0.5), 60, 100, ["p_partkey"])


# corners 0, 1, 6 and 7 are an upright box of 3 x 1 metres, so its cells are 7 columns of 3 rows
FOOTPRINTS = """SELECT p_partkey, (round_even(p_size * 0.5 / 0.5, 0)::INT + b.range)::INT AS "row", ((p_partkey % 40) * 2 + a.range)::INT AS "col"
FROM part, range(7) a, range(3) b"""


def relative_poses(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 89 / 4).alias("x"), (F.col("event_id") % 53 / 4).alias("y"), (F.col("event_id") % 628 / 100).alias("o"))
    out = pose.pose_deltas(e, "user_id", ["ts", "event_id"], "x", "y", "o")
    return out.select("event_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "do")])


RELATIVE_POSES = """WITH e AS (SELECT user_id, ts, event_id, event_id % 89 / 4 AS x, event_id % 53 / 4 AS y, event_id % 628 / 100 AS o FROM events),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(o) OVER w AS po FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, atan2(y - py, x - px) - po AS a, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS s FROM p)
SELECT event_id, round(s * cos(a), 6) + 0.0 AS dx, round(s * sin(a), 6) + 0.0 AS dy, round(o - po, 6) + 0.0 AS "do" FROM t"""


def integrated_poses(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 9 / 4).alias("dx"), (F.col("event_id") % 5 / 4).alias("dy"), (F.col("event_id") % 12 * 30.0).alias("turn"))
    out = pose.integrate_poses(e, "user_id", ["event_id"], "dx", "dy", "turn")
    return out.select("event_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x", "y", "heading_deg")])


INTEGRATED_POSES = """WITH e AS (SELECT user_id, event_id, event_id % 9 / 4 AS dx, event_id % 5 / 4 AS dy, event_id % 12 * 30.0::DOUBLE AS turn FROM events),
h AS (SELECT *, radians(coalesce(sum(turn) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS h,
  sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) % 360 AS g FROM e)
SELECT event_id, round(sum(dx * cos(h) - dy * sin(h)) OVER w, 5) + 0.0 AS x, round(sum(dx * sin(h) + dy * cos(h)) OVER w, 5) + 0.0 AS y,
round(CASE WHEN g > 180 THEN g - 360 ELSE g END, 5) + 0.0 AS heading_deg FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


def normalized_angles(spark, d):
    a = (F.col("event_id") % 1441 - 720).cast("double")
    return read(spark, d, "events").select("event_id", (pose.normalize_degrees(a) + 0.0).alias("deg"), (F.round(pose.normalize_radians(F.radians(a) * 0.9), 6) + 0.0).alias("rad"))


NORMALIZED_ANGLES = f"""WITH a AS (SELECT event_id, (event_id % 1441 - 720)::DOUBLE AS a FROM events),
m AS (SELECT event_id, ((a % 360) + 360) % 360 AS g, ((radians(a) * 0.9 % {2 * math.pi!r}::DOUBLE) + {2 * math.pi!r}::DOUBLE) % {2 * math.pi!r}::DOUBLE AS w FROM a)
SELECT event_id, CASE WHEN g > 180 THEN g - 360 ELSE g END + 0.0 AS deg, round(CASE WHEN w > pi() THEN w - 2 * pi() ELSE w END, 6) + 0.0 AS rad FROM m"""


def quaternions(spark, d):
    n = F.col("p_partkey")
    q = pose.quaternion_from_rpy(F.lit(0.0), F.lit(0.0), F.radians((n % 24 * 15).cast("double")))
    rows = read(spark, d, "part").select("p_partkey", q.alias("q"))
    rpy = pose.rpy_from_matrix(pose.rotation_matrix(F.col("q")))
    rnd = lambda c: F.round(c, 6) + 0.0
    return rows.select("p_partkey", rnd(F.col("q.w")).alias("w"), rnd(F.col("q.y")).alias("y"), rnd(F.sin(rpy["yaw"])).alias("sin_yaw"))


QUATERNIONS = """WITH a AS (SELECT p_partkey, radians((p_partkey % 24 * 15)::DOUBLE) AS a FROM part)
SELECT p_partkey, round(cos(a / 2), 6) + 0.0 AS w, round(sin(a / 2), 6) + 0.0 AS y, round(sin(a), 6) + 0.0 AS sin_yaw FROM a"""

_CAM = Camera(64, 48, 79.0)


def _frames(spark, d):
    e = read(spark, d, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("env"), (n % 48).cast("int").alias("row"), (n * 5 % 64).cast("int").alias("col"),
        F.when(n % 11 == 0, 10000.0).otherwise(n % 400 + 50.0).alias("depth"),
    ).groupBy("env", "row", "col").agg(F.min("depth").alias("depth"))


_SQL_FRAMES = """f AS (SELECT user_id AS env, (event_id % 48)::INT AS r, (event_id * 5 % 64)::INT AS c,
min(CASE WHEN event_id % 11 = 0 THEN 10000.0::DOUBLE ELSE event_id % 400 + 50.0::DOUBLE END) AS depth FROM events GROUP BY 1, 2, 3)"""


def depth_points(spark, d):
    rows = _frames(spark, d).where(curation.valid_depth(F.col("depth")))
    out = projection.camera_view(projection.depth_points(rows, _CAM, 2), 88.0)
    return out.select("env", "row", "col", *[(F.round(c, 5) + 0.0).alias(c) for c in ("px", "py", "pz")])


DEPTH_POINTS = f"""WITH {_SQL_FRAMES} SELECT env, r AS "row", c AS "col", round((c - 31.5::DOUBLE) * depth / {_CAM.focal!r}::DOUBLE, 5) + 0.0 AS px,
round(depth, 5) + 0.0 AS py, round((47 - r - 23.5::DOUBLE) * depth / {_CAM.focal!r}::DOUBLE + 88, 5) + 0.0 AS pz FROM f WHERE depth NOT IN (10000, 10001) AND r % 2 = 0 AND c % 2 = 0"""


def clipped_depths(spark, d):
    return _frames(spark, d).select("env", "row", "col", curation.clipped_depth(F.col("depth"), 100.0, 300.0).alias("clipped"), curation.cut_depth(F.col("depth"), 300.0).alias("cut"))


CLIPPED_DEPTHS = f"""WITH {_SQL_FRAMES} SELECT env, r AS "row", c AS "col", greatest(100.0, least(300.0, depth))::DOUBLE AS clipped, CASE WHEN depth > 300 THEN 0.0 ELSE depth END::DOUBLE AS cut FROM f"""


def _points(spark, d):
    """Each pair of neighbouring numbers of an embedding is a point."""
    v = lambda i: F.get("embedding", i).cast("double")
    rows = read(spark, d, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.select(
        F.col("label").cast("int").alias("label"), (v(F.col("k") * 2) * 16 + 8).alias("a"), (v(F.col("k") * 2 + 1) * 16 + 8).alias("b"), F.lit(4.0).alias("value")
    )


def splat(spark, d):
    out = projection.splat(_points(spark, d), ["label"], ["a", "b"], [16, 16])
    return out.select("label", F.col("i0").alias("row"), F.col("i1").alias("col"), (F.col("value") + 0.0).alias("value"))


SPLAT = """WITH p AS (SELECT label::INT AS label, embedding[2 * k.range + 1]::DOUBLE * 16 + 8 AS a, embedding[2 * k.range + 2]::DOUBLE * 16 + 8 AS b FROM embeddings, range(32) k),
k AS (SELECT label, floor(a) + x.range AS i, floor(b) + y.range AS j, (1 - abs(a - (floor(a) + x.range))) * (1 - abs(b - (floor(b) + y.range))) * 4.0 AS w FROM p, range(2) x, range(2) y)
SELECT label, i::INT AS "row", j::INT AS "col", round_even(sum(w), 0) + 0.0 AS value FROM k WHERE i > 0 AND i < 16 AND j > 0 AND j < 16 GROUP BY 1, 2, 3"""


def height_bands(spark, d):
    v = read(spark, d, "lineitem").groupBy(
        (F.col("l_partkey") % 20).cast("int").alias("i0"), (F.col("l_suppkey") % 20).cast("int").alias("i1"), (F.col("l_orderkey") % 80).cast("int").alias("i2")
    ).agg(F.count("*").cast("double").alias("value"))
    out = projection.project_heights(v, Mapping(obstacle_threshold=64.0, explored_threshold=256.0), [])
    return out.select("row", "col", "obstacle", "explored")


HEIGHT_BANDS = """SELECT (l_suppkey % 20)::INT AS "row", (l_partkey % 20)::INT AS "col",
least(1.0, count(*) FILTER (l_orderkey % 80 BETWEEN 14 AND 28) / 64)::DOUBLE AS obstacle, least(1.0, count(*) / 256)::DOUBLE AS explored FROM lineitem GROUP BY 1, 2"""


def resampled(spark, d):
    v = valued_cells(spark, d).select("row", "col", (F.col("value") / 8).alias("value"))
    out = projection.resample(v, [], 64, F.lit(0.07), F.lit(-0.11), F.radians(F.lit(37.0)))
    return out.select("row", "col", F.round("value", 6).alias("value")).where("value > 0.0001")


# for each output cell the place that it reads, and the four cells around it
_READ = """SELECT a.r, a.c, sum(w.v * (1 - abs(y - w.r)) * (1 - abs(x - w.c))) AS v FROM {at} a, range(2) i, range(2) j
JOIN {src} w ON w.r = floor(y)::INT + i.range AND w.c = floor(x)::INT + j.range GROUP BY 1, 2"""
RESAMPLED = f"""WITH {SQL_VALUED}, g AS (SELECT a.range::INT AS r, b.range::INT AS c, (2 * b.range + 1) / 64::DOUBLE - 1 AS u, (2 * a.range + 1) / 64::DOUBLE - 1 AS w FROM range(64) a, range(64) b),
image AS (SELECT r, c, v / 8 AS v FROM valued), at1 AS (SELECT r, c, (u * cos(radians(37)) - w * sin(radians(37)) + 1) / 2 * 63 AS x, (u * sin(radians(37)) + w * cos(radians(37)) + 1) / 2 * 63 AS y FROM g),
once AS ({_READ.format(at='at1', src='image')}), at2 AS (SELECT r, c, (u + 0.07::DOUBLE + 1) / 2 * 63 AS x, (w - 0.11::DOUBLE + 1) / 2 * 63 AS y FROM g), twice AS ({_READ.format(at='at2', src='once')})
SELECT r AS "row", c AS "col", round(least(1.0::DOUBLE, v), 6) AS value FROM twice WHERE v > 0.0001"""


def _patches(spark, d):
    l = read(spark, d, "lineitem")
    return l.select(
        (F.col("l_suppkey") % 3).alias("env"), (F.col("l_linenumber") % 3).cast("int").alias("channel"), (F.col("l_partkey") % 40).cast("int").alias("row"),
        (F.col("l_orderkey") % 40).cast("int").alias("col"), F.col("l_quantity").cast("double").alias("value"), F.col("l_linenumber").cast("long").alias("step"),
    )


_SQL_PATCHES = """p AS (SELECT l_suppkey % 3 AS env, (l_linenumber % 3)::INT AS channel, (l_partkey % 40)::INT AS r, (l_orderkey % 40)::INT AS c, l_quantity::DOUBLE AS v, l_linenumber::BIGINT AS step FROM lineitem)"""


def map_max_merge(spark, d):
    p = _patches(spark, d)
    return mapstate.merge(p.where("step <= 3"), p.where("step > 3"))


MAP_MAX_MERGE = f'WITH {_SQL_PATCHES} SELECT env, channel, r AS "row", c AS "col", max(v) AS value FROM p GROUP BY 1, 2, 3, 4'


def map_latest(spark, d):
    return mapstate.latest(_patches(spark, d))


MAP_LATEST = f'WITH {_SQL_PATCHES}, m AS (SELECT *, max(step) OVER (PARTITION BY env, channel) AS last FROM p) SELECT env, channel, r AS "row", c AS "col", max(v) AS value FROM m WHERE step = last GROUP BY 1, 2, 3, 4'


def map_stamps(spark, d):
    places = read(spark, d, "events").select(
        (F.col("user_id") % 5).alias("env"), F.col("event_id").alias("step"), (F.col("event_id") * 7 % 64).cast("int").alias("row"), (F.col("event_id") * 3 % 64).cast("int").alias("col")
    )
    return mapstate.stamps(places, Mapping(explored_radius=3, close_radius=2), 64)


MAP_STAMPS = f"""WITH {sql_offsets('s2', square(2))}, {sql_offsets('k3', disk(3))}, {sql_offsets('k2', disk(2))},
p AS (SELECT user_id % 5 AS env, event_id AS step, (event_id * 7 % 64)::INT AS r, (event_id * 3 % 64)::INT AS c FROM events),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY env ORDER BY step DESC) = 1),
a AS (SELECT env, 2 AS channel, r + dr AS r, c + dc AS c FROM n, s2 UNION SELECT env, 3, r + dr, c + dc FROM p, s2 UNION SELECT env, 1, r + dr, c + dc FROM p, k3 UNION SELECT env, 4, r + dr, c + dc FROM p, k2)
SELECT env, channel, r AS "row", c AS "col", 1.0::DOUBLE AS value FROM a WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63"""


def only_been_close(spark, d):
    p = mapstate.merge(_patches(spark, d).withColumn("channel", F.when(F.col("channel") == 2, 4).otherwise(F.col("channel"))))
    return mapstate.only_been_close(p)


ONLY_BEEN_CLOSE = f"""WITH {_SQL_PATCHES}, m AS (SELECT env, CASE channel WHEN 2 THEN 4 ELSE channel END AS channel, r, c, max(v) AS v FROM p GROUP BY 1, 2, 3, 4)
SELECT m.env, m.channel, m.r AS "row", m.c AS "col", CASE WHEN m.channel = 4 THEN m.v ELSE m.v * k.v END AS value FROM m LEFT JOIN m k ON k.channel = 4 AND k.env = m.env AND k.r = m.r AND k.c = m.c WHERE m.channel = 4 OR k.v IS NOT NULL"""


def _windows(spark):
    return spark.createDataFrame([(0, 5, 25, 10, 30), (1, 0, 20, 0, 20)], "env long, top int, bottom int, left int, right int")


def write_back(spark, d):
    world = mapstate.merge(_patches(spark, d))
    local = mapstate.local_view(world, _windows(spark)).withColumn("value", F.col("value") + 100)
    return mapstate.write_back(world, local.where("value > 130"), _windows(spark))


WRITE_BACK = f"""WITH {_SQL_PATCHES}, w(env, t, b, l, e) AS (VALUES (0, 5, 25, 10, 30), (1, 0, 20, 0, 20)), m AS (SELECT env, channel, r, c, max(v) AS v FROM p GROUP BY 1, 2, 3, 4),
j AS (SELECT m.*, coalesce(r >= t AND r < b AND c >= l AND c < e, false) AS inn FROM m LEFT JOIN w USING (env))
SELECT env, channel, r AS "row", c AS "col", CASE WHEN inn THEN v + 100 ELSE v END AS value FROM j WHERE NOT inn OR v > 30"""


def map_features(spark, d):
    world = mapstate.merge(_patches(spark, d))
    local = mapstate.local_view(world, _windows(spark))
    out = mapstate.map_features(local, world, 2)
    return out.select("env", "channel", F.col("row").cast("int"), F.col("col").cast("int"), "value")


MAP_FEATURES = f"""WITH {_SQL_PATCHES}, w(env, t, b, l, e) AS (VALUES (0, 5, 25, 10, 30), (1, 0, 20, 0, 20)), m AS (SELECT env, channel, r, c, max(v) AS v FROM p GROUP BY 1, 2, 3, 4)
SELECT env, channel, r - t AS "row", c - l AS "col", v AS value FROM m JOIN w USING (env) WHERE r >= t AND r < b AND c >= l AND c < e
UNION ALL SELECT env, channel + 6, r // 2, c // 2, max(v) FROM m GROUP BY 1, 2, 3, 4"""


def _semantic(spark, d):
    p = mapstate.merge(_patches(spark, d))
    return p.withColumn("channel", F.col("channel") + 6)


def semantic_map(spark, d):
    return mapstate.semantic_map(_semantic(spark, d), 4)


SEMANTIC_MAP = f"""WITH {_SQL_PATCHES}, m AS (SELECT env, channel, r, c, max(v) AS v FROM p GROUP BY 1, 2, 3, 4)
SELECT env, r AS "row", c AS "col", channel AS category FROM m QUALIFY row_number() OVER (PARTITION BY env, r, c ORDER BY v DESC, channel) = 1"""


def display_layers(spark, d):
    p = mapstate.merge(_patches(spark, d)).withColumn("value", F.col("value") / 50)
    world = p.where("channel < 2 or value > 0.98").withColumn("channel", F.when(F.col("channel") == 2, 3).otherwise(F.col("channel")))
    named = p.where("channel < 2 and value > 0.9").groupBy("env", "row", "col").agg(F.max("channel").alias("category"))
    goal = p.where("value = 1").select("env", "row", "col").distinct()
    return mapstate.display_layers(world, named, goal.where("row < 20"), goal.where("row = 30"), 40, 40)


DISPLAY_LAYERS = f"""WITH {_SQL_PATCHES}, {sql_offsets('k4', disk(4))}, m AS (SELECT env, channel, r, c, max(v) / 50 AS v FROM p GROUP BY 1, 2, 3, 4),
goal AS (SELECT DISTINCT env, r, c FROM m WHERE v = 1), named AS (SELECT env, r, c, max(channel) AS k FROM m WHERE channel < 2 AND v > 0.9 GROUP BY 1, 2, 3),
l AS (SELECT env, r, c, CASE channel WHEN 2 THEN 4 WHEN 0 THEN 2 ELSE 1 END AS layer, NULL::INT AS k FROM m WHERE CASE WHEN channel = 2 THEN v > 0.98 ELSE round_even(v, 0) = 1 END
  UNION ALL SELECT env, r, c, 3, k FROM named WHERE k <> 0
  UNION ALL SELECT env, r + dr, c + dc, CASE WHEN r < 20 THEN 5 ELSE 6 END, NULL FROM goal, k4 WHERE (r < 20 OR r = 30) AND r + dr BETWEEN 0 AND 39 AND c + dc BETWEEN 0 AND 39),
t AS (SELECT env, r, c, max(layer) AS layer FROM l GROUP BY 1, 2, 3)
SELECT env, r AS "row", c AS "col", layer, max(l.k)::INT AS category FROM t JOIN l USING (env, r, c, layer) GROUP BY 1, 2, 3, 4"""


def session_maps(spark, d):
    p = _patches(spark, d)
    steps = p.select("env", "step").distinct().withColumn("done", F.col("step") % 3 == 0)
    return mapstate.session_maps(p, steps)


SESSION_MAPS = f"""WITH {_SQL_PATCHES} SELECT env, (step - 1) // 3 AS session, channel, r AS "row", c AS "col", max(v) AS value FROM p GROUP BY 1, 2, 3, 4, 5"""


def _pixels(spark, d):
    l = read(spark, d, "lineitem")
    return l.select(
        (F.col("l_suppkey") % 7).alias("env"), F.col("l_linenumber").cast("long").alias("timestep"), (F.col("l_orderkey") % 9).alias("local_id"),
        (F.col("l_partkey") % 5 + 1).alias("category_id"), (F.col("l_orderkey") % 48).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"),
    ).distinct()


_SQL_PIXELS = """x AS (SELECT DISTINCT l_suppkey % 7 AS env, l_linenumber::BIGINT AS timestep, l_orderkey % 9 AS local_id, l_partkey % 5 + 1 AS category_id, (l_orderkey % 48)::INT AS r, (l_partkey % 64)::INT AS c FROM lineitem)"""


def instance_views(spark, d):
    return instances.instance_views(_pixels(spark, d), 48, 64)


INSTANCE_VIEWS = f"""WITH {_SQL_PIXELS} SELECT env, timestep, local_id, min(r) AS row0, max(r) + 1 AS row1, min(c) AS col0, max(c) + 1 AS col1, min(category_id) AS category_id, count(*) / 3072.0::DOUBLE AS object_coverage FROM x WHERE local_id > 0 GROUP BY 1, 2, 3"""


def mask_areas(spark, d):
    return instances.mask_areas(_pixels(spark, d), ["env", "timestep", "local_id"])


MASK_AREAS = f"""WITH {_SQL_PIXELS} SELECT env, timestep, local_id, count(*) AS mask_area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, (max(c) - min(c) + 1) * (max(r) - min(r) + 1) AS bbx_area FROM x GROUP BY 1, 2, 3"""


def pixel_argmax(spark, d):
    return instances.pixel_argmax(mapstate.merge(_patches(spark, d)), ["env"])


PIXEL_ARGMAX = f"""WITH {_SQL_PATCHES}, m AS (SELECT env, channel, r, c, max(v) AS v FROM p GROUP BY 1, 2, 3, 4)
SELECT env, r AS "row", c AS "col", channel FROM m QUALIFY row_number() OVER (PARTITION BY env, r, c ORDER BY v DESC, channel) = 1"""


def _ids(spark, d):
    part = read(spark, d, "part")
    rows = part.select((F.col("p_partkey") % 2).alias("env"), (F.col("p_size") % 3).cast("int").alias("category"), (F.col("p_partkey") % 12 + 1).alias("id"), F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % 64).cast("int").alias("col"), "p_type")
    local = F.col("p_type") == TYPE
    return rows.where(local).drop("p_type").distinct(), rows.where(~local).drop("p_type").distinct()


_SQL_IDS = f"""q AS (SELECT DISTINCT p_partkey % 2 AS env, (p_size % 3)::INT AS category, p_partkey % 12 + 1 AS id, p_size::INT AS r, (p_partkey % 64)::INT AS c, p_type = '{TYPE}' AS local FROM part),
loc AS (SELECT env, category, id, r, c FROM q WHERE local), wor AS (SELECT env, category, id, r, c FROM q WHERE NOT local), {sql_offsets('k', disk(3))},
grown AS (SELECT env, category, r + dr AS r, c + dc AS c, max(id) AS id FROM loc, k WHERE {_IN} GROUP BY 1, 2, 3, 4),
hit AS (SELECT env, category, grown.id AS local_id, min(wor.id) AS g FROM grown JOIN wor USING (env, category, r, c) GROUP BY 1, 2, 3),
i AS (SELECT DISTINCT env, category, id AS local_id FROM loc), top AS (SELECT env, max(id) AS t FROM wor GROUP BY 1),
ids AS (SELECT env, category, local_id, coalesce(g, coalesce(t, 0) + sum((g IS NULL)::INT) OVER (PARTITION BY env ORDER BY category, local_id))::BIGINT AS global_id, g IS NULL AS "new" FROM i LEFT JOIN hit USING (env, category, local_id) LEFT JOIN top USING (env))"""


def associate_ids(spark, d):
    local, world = _ids(spark, d)
    return instances.associate(local, world, *BOX, radius=3)


ASSOCIATE_IDS = f"WITH {_SQL_IDS} SELECT * FROM ids"


def instance_map(spark, d):
    local, world = _ids(spark, d)
    return instances.update_instance_map(world, local, instances.associate(local, world, *BOX, radius=3))


INSTANCE_MAP = f"""WITH {_SQL_IDS}, every AS (SELECT env, category, r, c, id FROM wor UNION ALL SELECT env, category, r, c, global_id FROM loc JOIN (SELECT env, category, local_id AS id, global_id FROM ids) USING (env, category, id))
SELECT env, category, r AS "row", c AS "col", max(id) AS id FROM every GROUP BY 1, 2, 3, 4"""


def category_instances(spark, d):
    p = mapstate.merge(_patches(spark, d))
    scores = p.select("env", (F.col("row") % 2).alias("category"), F.col("channel").alias("id"), "row", "col", (F.col("value") - 20).alias("value"))
    return instances.category_instances(scores, ["env"])


CATEGORY_INSTANCES = f"""WITH {_SQL_PATCHES}, m AS (SELECT env, channel, r, c, max(v) - 20 AS v FROM p GROUP BY 1, 2, 3, 4)
SELECT env, r % 2 AS category, r AS "row", c AS "col", channel AS id FROM m WHERE v > 1e-5 QUALIFY row_number() OVER (PARTITION BY env, r, c ORDER BY v DESC, channel) = 1"""


def instance_memory(spark, d):
    views = instances.instance_views(_pixels(spark, d), 48, 64)
    ids = views.select("env", "timestep", "local_id", (F.col("local_id") % 4).alias("global_id"))
    out = instances.memory(views, ids)
    return out.select("env", "global_id", "category_id", F.size("views").cast("long").alias("n"))


INSTANCE_MEMORY = f"""WITH {_SQL_PIXELS}, v AS (SELECT env, timestep, local_id, min(category_id) AS k FROM x WHERE local_id > 0 GROUP BY 1, 2, 3)
SELECT env, local_id % 4 AS global_id, arg_min(k, timestep * 100 + local_id) AS category_id, count(*) AS n FROM v GROUP BY 1, 2"""


def mask_polygons(spark, d):
    out = contours.mask_polygons(cells(spark, d).select(F.lit(1).alias("env"), "row", "col"), ["env"])
    return out.select("env", F.explode("mask_polygons").alias("p")).select("env", F.concat_ws(",", F.transform("p", lambda x: x.cast("int").cast("string"))).alias("polygon"))


def l2_normalized(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


L2_NORMALIZED = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings)
SELECT vec_id, i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) + 0.0 AS x FROM e"""


def lines(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 30).cast("int").alias("r0"), F.lit(3).alias("c0"), (F.col("p_size")).cast("int").alias("r1"), (F.col("p_partkey") % 64).cast("int").alias("c1"))
    return grid.line_cells(rows, ["p_partkey"])


LINES = """WITH p AS (SELECT p_partkey, round_even((p_partkey % 30) + (p_size - p_partkey % 30) * (i.range / 25), 0)::INT AS r, round_even(3 + (p_partkey % 64 - 3) * (i.range / 25), 0)::INT AS c FROM part, range(26) i)
SELECT DISTINCT p_partkey, (r + a.range)::INT AS "row", (c + b.range)::INT AS "col" FROM p, range(-1, 1) a, range(-1, 1) b"""

_NAMES = """dilate erode opening closing denoise expand_mask sobel frontier grey_dilate median_blur max_pool avg_pool cell_components
goal_component component_centres nearest_cell viewpoints agent_states world_cells local_windows footprints relative_poses
integrated_poses normalized_angles quaternions depth_points clipped_depths splat height_bands resampled map_max_merge map_latest
map_stamps only_been_close write_back map_features semantic_map display_layers session_maps instance_views mask_areas
pixel_argmax associate_ids instance_map category_instances instance_memory mask_polygons l2_normalized lines""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
