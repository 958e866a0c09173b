"""Queries on whole flows.  A part is an object of the scene of its brand's first digit, its type
is its class; it is seen from its viewpoints with an area that its key and the pose give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Camera, Curation, Grid, Mapping, MapSize
from ..operators import flows, grid
from ..operators.stencil import cone
from .choose import bins_sql
from .tables import SQL_CELLS, cells, read, sql_offsets

RULES = Curation(min_area=600, per_class=40)


def _objects(spark, d):
    part = read(spark, d, "part")
    named = F.when(F.col("p_size") > 2, F.col("p_type")).otherwise("unknown")
    return part.select(
        F.substring("p_brand", 7, 1).alias("scene"), F.col("p_partkey").alias("object_id"), named.alias("class_name"),
        F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % 64).cast("int").alias("col"),
    )


def _frames(spark, d):
    """What a renderer would give: the objects of each pose, with their areas."""
    seen = flows.candidate_views(_objects(spark, d), cells(spark, d), Grid())
    area = (F.col("object_id") * 37 + F.col("row") * 101 + F.col("col") * 53 + F.col("yaw_deg")) % 1500
    one = F.struct("object_id", "class_name", area.cast("long").alias("mask_area"))
    return seen.groupBy("scene", *flows.POSE).agg(F.collect_list(one).alias("instances"))


_SEEN = [(a, b, y) for y in grid.HEADINGS for a, b in cone(y, 10, 2, 8)]
_SQL_VIEWS = f"""{SQL_CELLS}, {sql_offsets('o', _SEEN, 'yaw')},
obj AS (SELECT substr(p_brand, 7, 1) AS scene, p_partkey AS object_id, p_type AS class_name, p_size::INT AS r, (p_partkey % 64)::INT AS c FROM part WHERE p_size > 2),
at AS (SELECT scene, object_id, class_name, yaw, r - dr AS r, c - dc AS c FROM obj, o),
views AS (SELECT scene, object_id, class_name, yaw, r, c, ((object_id * 37 + r * 101 + c * 53 + yaw) % 1500) AS area,
  concat_ws(':', scene, object_id, r, c, yaw) AS k FROM at JOIN cells USING (r, c) WHERE r % 2 = 0 AND c % 2 = 0)""".replace("at AS", "placed AS").replace("FROM at JOIN", "FROM placed JOIN")


def detection_set(spark, d):
    classes = read(spark, d, "part").select(F.col("p_type").alias("class_name")).distinct()
    found = flows.detection_set(_objects(spark, d), cells(spark, d), _frames(spark, d), classes, Grid(), RULES)
    named = found.samples.join(F.broadcast(found.buckets), "class_name")  # a row for each class
    return named.select("class_name", "bucket", "prefix", *flows.POSE, F.size("instances").cast("long").alias("n_instances"))


# instances of the class in the frame, the largest of which is the sample's area
DETECTION_SET = f"""WITH {_SQL_VIEWS}, drawn AS (SELECT * FROM views QUALIFY row_number() OVER (PARTITION BY scene, object_id ORDER BY md5('0:' || k), k) <= {RULES.candidates_per_object}),
frames AS (SELECT scene, r, c, yaw, class_name, max(area) AS most FROM views GROUP BY ALL), counts AS (SELECT scene, r, c, yaw, count(*) AS n_instances FROM views GROUP BY ALL),
fit AS (SELECT drawn.*, most FROM drawn JOIN frames USING (scene, r, c, yaw, class_name) WHERE most >= {RULES.min_area}),
kinds AS (SELECT class_name, count(*) AS n FROM obj GROUP BY 1), ranked AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM kinds),
t AS (SELECT max(n) FILTER (i = k // 3) AS t1, max(n) FILTER (i = (2 * k) // 3) AS t2 FROM ranked),
b AS (SELECT p_type AS class_name, CASE WHEN n IS NULL OR n <= t1 THEN 'rare' WHEN n <= t2 THEN 'common' ELSE 'frequent' END AS bucket FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN kinds ON p_type = class_name, t),
chosen AS ({bins_sql('SELECT class_name AS g, k, most::DOUBLE AS a FROM fit', RULES.per_class)})
SELECT class_name, bucket, 'cls_' || class_name || '_scene_' || scene || '_objid_' || object_id AS prefix, r AS "row", c AS "col", yaw AS yaw_deg, n_instances
FROM fit JOIN chosen ON fit.class_name = chosen.g AND fit.k = chosen.k JOIN b USING (class_name) JOIN counts USING (scene, r, c, yaw)"""


def episode_set(spark, d):
    scenes = _objects(spark, d).select("scene").distinct().withColumn("scene_idx", F.col("scene").cast("long") - 1)
    out = flows.episode_set(_objects(spark, d), cells(spark, d), _frames(spark, d), scenes, Grid(), min_area=RULES.min_area)
    first, goal = F.col("start_position"), F.get("goals", F.lit(0))["position"]
    return out.select(
        "episode_id", "scene_id", first[0].alias("start_x"), first[2].alias("start_z"), F.round("start_rotation.y", 6).alias("turn"),
        goal[0].alias("goal_x"), goal[2].alias("goal_z"), F.size("info.viewpoints").cast("long").alias("n"),
    )


EPISODE_SET = f"""WITH {_SQL_VIEWS}, s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY scene, object_id) AS n FROM views WHERE area >= {RULES.min_area}
  WINDOW w AS (PARTITION BY scene, object_id ORDER BY yaw, r, c) QUALIFY n > 3)
SELECT (scene::BIGINT - 1) || '_obj_id_' || object_id AS episode_id, scene AS scene_id, max(c * 0.25::DOUBLE) FILTER (i = 1) AS start_x, max(r * 0.25::DOUBLE) FILTER (i = 1) AS start_z,
round(max(sin((radians(yaw::DOUBLE) - pi() / 2) / 2)) FILTER (i = 1), 6) AS turn, max(c * 0.25::DOUBLE) FILTER (i = n) AS goal_x, max(r * 0.25::DOUBLE) FILTER (i = n) AS goal_z, max(n) AS n
FROM s GROUP BY scene, object_id"""


def evaluation(spark, d):
    """Orders are episodes of their lines' views; a part is the object, predictions come from lines."""
    line = read(spark, d, "lineitem")
    views = line.select(F.col("l_suppkey").alias("episode_id"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("seq"), (F.col("l_orderkey") % 400).alias("frame_id"))
    targets = read(spark, d, "part").where("p_size > 25").select((F.col("p_partkey") % 400).alias("frame_id"), (F.col("p_partkey") % 12).alias("row"), (F.col("p_size") % 8).cast("long").alias("col"))
    predicted = line.select(
        (F.col("l_orderkey") % 400).alias("frame_id"), F.col("l_orderkey").alias("pred_id"), F.col("l_returnflag").alias("class_name"),
        (F.col("l_partkey") % 12).alias("row"), F.col("l_linenumber").cast("long").alias("col"),
    )
    return flows.evaluation(views, targets, predicted)[1]


EVALUATION = """WITH v AS (SELECT l_suppkey AS e, concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS seq, l_orderkey % 400 AS f FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY seq) AS i, count(*) OVER (PARTITION BY e) AS k FROM v),
t AS (SELECT DISTINCT p_partkey % 400 AS f, p_partkey % 12 AS r, p_size % 8 AS c FROM part WHERE p_size > 25),
used AS (SELECT DISTINCT f FROM n WHERE i <= 8 AND k >= 8 AND f IN (SELECT f FROM t)),
p AS (SELECT l_orderkey % 400 AS f, l_orderkey AS p, l_returnflag AS class_name, l_partkey % 12 AS r, l_linenumber AS c FROM lineitem WHERE l_orderkey % 400 IN (SELECT f FROM used)),
kept AS (SELECT DISTINCT p.f, p.p FROM p JOIN t ON t.f = p.f AND t.r = p.r AND t.c = p.c), every AS (SELECT DISTINCT f, p, class_name FROM p)
SELECT class_name, count(*) AS predictions, count(kept.p) AS hits, count(kept.p) / count(*) AS rate FROM every LEFT JOIN kept USING (f, p) GROUP BY 1"""

_CAMERA = Camera(32, 24, 79.0)
_MAPPING = Mapping(size=MapSize(960, 5, 2), vision_range=40, stride=2, explored_radius=4, close_radius=6)


def map_steps(spark, d):
    """A map for each nation, from a small depth frame for each supplier.  Without SQL: see the
    tests for the plain version."""
    e = read(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    n = F.col("s_suppkey")
    rows = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("row")
    frames = e.select(F.col("s_nationkey").cast("long").alias("env"), n.alias("step"), rows).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(31))))
    depth = (F.col("step") * 31 + F.col("col") * 7) % 120 + 60.0
    poses = e.select(F.col("s_nationkey").cast("long").alias("env"), n.alias("step"), (n % 13 / 4 + 3.0).alias("x"), (n % 7 / 4 + 4.0).alias("y"), (n % 12 * 30.0).alias("heading_deg"))
    out = flows.map_steps(frames.withColumn("depth", depth), poses, _CAMERA, _MAPPING, 88.0)
    return out.select("env", "channel", "row", "col", F.round("value", 6).alias("value"))


_NAMES = "detection_set episode_set evaluation map_steps".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
