"""Queries on lookups, curation, sampling, strings and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import annotations, curation, lookup, sampling
from .tables import SQL_KEY, line_key, read


def _branded(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def freq_tertiles(spark, d):
    return curation.frequency_buckets(curation.class_counts(_branded(spark, d), "p_brand"))


SQL_COUNTS = """c AS (SELECT p_brand AS class_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS k FROM c),
t AS (SELECT max(n) FILTER (r = k // 3) AS t1, max(n) FILTER (r = (2 * k) // 3) AS t2 FROM o),
b AS (SELECT class_name, n, CASE WHEN n <= t1 THEN 'rare' WHEN n <= t2 THEN 'common' ELSE 'frequent' END AS bucket FROM c, t)"""
FREQ_TERTILES = f"WITH {SQL_COUNTS} SELECT * FROM b"


def freq_unseen(spark, d):
    """All part types are classes; only those of returned lines were seen."""
    part = read(spark, d, "part")
    seen = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    seen = seen.join(part, F.col("l_partkey") == F.col("p_partkey")).where("p_size > 25")
    classes = part.select(F.concat_ws("/", "p_type", "p_brand").alias("class_name")).distinct()
    named = seen.withColumn("cls", F.concat_ws("/", "p_type", "p_brand"))
    return curation.frequency_buckets(curation.class_counts(named, "cls"), classes)


FREQ_UNSEEN = """WITH c AS (SELECT concat_ws('/', p_type, p_brand) AS class_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag = 'R' AND l_quantity > 49 AND p_size > 25 GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS k FROM c),
t AS (SELECT max(n) FILTER (r = k // 3) AS t1, max(n) FILTER (r = (2 * k) // 3) AS t2 FROM o),
a AS (SELECT DISTINCT concat_ws('/', p_type, p_brand) AS class_name FROM part)
SELECT class_name, n, CASE WHEN n IS NULL OR n <= t1 THEN 'rare' WHEN n <= t2 THEN 'common' ELSE 'frequent' END AS bucket
FROM a LEFT JOIN c USING (class_name), t"""


def area_bin_sample(spark, d):
    rows = _branded(spark, d).select("p_brand", line_key().alias("k"), "l_extendedprice")
    return sampling.area_bins(rows, "p_brand", "k", "l_extendedprice", num_samples=20)


def _area_sql(group: str, area: str, n: int) -> str:
    return bins_sql(f"SELECT {group} AS g, {SQL_KEY} AS k, ({area})::DOUBLE AS a FROM lineitem JOIN part ON l_partkey = p_partkey", n)


def bins_sql(base: str, n: int) -> str:
    """The sample by area bins of base (g, k, a)."""
    return f"""WITH base AS ({base}),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a) - 1 AS r, count(*) OVER (PARTITION BY g) AS n, md5('0:' || k) AS h, md5('1:' || k) AS h2 FROM base),
k AS (SELECT g, b, (b * (n - 1)) // 10 AS low, least((b * (n - 1)) // 10 + 1, n - 1) AS high, ((b * (n - 1)) % 10) / 10::DOUBLE AS f FROM (SELECT DISTINCT g, n FROM s), range(11) t(b)),
q AS (SELECT k.g, b, x.a AS lo, y.a AS hi, f FROM k JOIN s x ON x.g = k.g AND x.r = k.low JOIN s y ON y.g = k.g AND y.r = k.high),
e AS (SELECT g, list_sort(list(DISTINCT lo + (hi - lo) * f)) AS edges FROM q GROUP BY g),
j AS (SELECT s.*, len(edges) AS m, edges, row_number() OVER (PARTITION BY g ORDER BY h, k) AS u FROM s JOIN e USING (g)),
p AS (SELECT *, m - 1 AS bins, least(m - 1, 5) AS kept,
  CASE WHEN m >= 3 THEN len(list_filter(edges[2:m - 1], lambda x: x <= a)) END AS bin FROM j),
simple AS (SELECT g, k FROM p WHERE n < {n} OR (m < 3 AND u <= {n})),
top AS (SELECT *, row_number() OVER (PARTITION BY g, bin ORDER BY h, k) AS r1, greatest(1, {n} // kept) AS per FROM p
  WHERE n >= {n} AND m >= 3 AND bin >= greatest(0, bins - 5)),
main AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY bin, r1) AS r2 FROM top WHERE r1 <= per),
took AS (SELECT g, count(*) AS taken FROM main GROUP BY g),
rest AS (SELECT top.*, row_number() OVER (PARTITION BY g ORDER BY h2, k) AS r2 FROM top WHERE r1 > per)
SELECT g, k FROM simple UNION ALL SELECT g, k FROM main WHERE r2 <= {n}
UNION ALL SELECT rest.g, k FROM rest JOIN took USING (g) WHERE r2 <= {n} - taken"""


AREA_BIN_SAMPLE = f"SELECT g AS p_brand, k FROM ({_area_sql('p_brand', 'l_extendedprice', 20)})"


def area_bin_ties(spark, d):
    """Areas with few distinct values, so that quantile edges meet."""
    rows = _branded(spark, d).select("p_type", line_key().alias("k"), F.col("l_linenumber").alias("a"))
    return sampling.area_bins(rows, "p_type", "k", "a", num_samples=60)


AREA_BIN_TIES = f"SELECT g AS p_type, k FROM ({_area_sql('p_type', 'l_linenumber', 60)})"


def capped_shuffle(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", line_key().alias("k"))
    return curation.capped(rows, ["l_suppkey"], ["k"], 25, seed=0)


CAPPED_SHUFFLE = f"SELECT l_suppkey, k FROM (SELECT l_suppkey, {SQL_KEY} AS k FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('0:' || k), k) <= 25"


def _with_instances(spark, d):
    i = F.struct(F.col("l_suppkey").alias("object_id"), F.col("l_returnflag").alias("class_name"), F.col("l_quantity").alias("mask_area"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(i).alias("instances"))


def exists_min_area(spark, d):
    keep = curation.has_instance("instances", lambda i: i["class_name"] == "R", 45)
    return _with_instances(spark, d).where(keep).select("l_orderkey")


EXISTS_MIN_AREA = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45"


def exists_object(spark, d):
    keep = curation.has_instance("instances", lambda i: i["object_id"] == F.col("l_orderkey") % 10 + 1, 10)
    return _with_instances(spark, d).where(keep).select("l_orderkey")


EXISTS_OBJECT = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = l_orderkey % 10 + 1 AND l_quantity >= 10"


def largest_areas(spark, d):
    area = curation.largest_area("instances", lambda i: i["class_name"] == "A")
    return _with_instances(spark, d).select("l_orderkey", area.cast("double").alias("area"))


LARGEST_AREAS = "SELECT l_orderkey, coalesce(max(l_quantity) FILTER (l_returnflag = 'A'), 0)::DOUBLE AS area FROM lineitem GROUP BY 1"


def all_objects(spark, d):
    return curation.all_objects(_with_instances(spark, d), "instances")


ALL_OBJECTS = "SELECT DISTINCT l_suppkey AS object_id FROM lineitem"


def default_lookup(spark, d):
    named = read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("semantic_class"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lookup.with_default(rows, named, "l_partkey", "semantic_class")


DEFAULT_LOOKUP = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, coalesce(p_type, 'undefined') AS semantic_class FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10"


def last_duplicate(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lookup.last_per_key(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


LAST_DUPLICATE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"


def vocab_index(spark, d):
    return lookup.class_index(read(spark, d, "part"), "p_type")


VOCAB_INDEX = "SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)"


def contiguous_ids(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return lookup.contiguous_ids(rows, rows, "s_nationkey")


CONTIGUOUS_IDS = "SELECT s_nationkey, s_suppkey, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS contiguous_id FROM supplier"


def shortname(spark, d):
    return read(spark, d, "pages").select("page_id", strings.shortname(F.col("url")).alias("name"))


_SQL_LAST = "list_extract(string_split(url, '/'), -1)"
SHORTNAME = f"SELECT page_id, split_part(split_part(split_part({_SQL_LAST}, '.', 1), '_:', 1), '_', 1) AS name FROM pages"


def synset_keys(spark, d):
    key = F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.lit(".n."), F.col("event_id").cast("string")))
    return read(spark, d, "events").select("event_id", strings.synset_key(key).alias("key"))


SYNSET_KEYS = "SELECT event_id, split_part(coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type || '.n.' || event_id END, 'unknown'), '.', 1) AS key FROM events"


def stem_roundtrip(spark, d):
    e = read(spark, d, "events")
    n = F.col("event_id")
    stem = strings.pose_stem(F.col("event_type"), (n % 4000 - 2000) / 16, n % 8 / 8, n % 100 / 4, n % 12 * 30)
    rows = e.select("event_id", stem.alias("stem"))
    return rows.select("event_id", "stem", *[strings.stem_number(F.col("stem"), t).alias(f"v_{t}") for t in ("x", "y", "z", "yaw")])


def _sql_dec(v: str) -> str:
    return f"replace(printf('%.2f', round_even(({v})::DOUBLE, 2)), '.', 'p')"


_TAGS = {"x": "(event_id % 4000 - 2000) / 16", "y": "event_id % 8 / 8", "z": "event_id % 100 / 4", "yaw": "event_id % 12 * 30"}
_SQL_STEM = "concat_ws('_', event_type, " + ", ".join(f"'{t}', {_sql_dec(v)}" for t, v in _TAGS.items()) + ")"
STEM_ROUNDTRIP = f"WITH s AS (SELECT event_id, {_SQL_STEM} AS stem FROM events) SELECT event_id, stem, " + ", ".join(
    f"replace(regexp_extract(stem, '_{t}_(-?[0-9]+p?[0-9]*)', 1), 'p', '.')::DOUBLE AS v_{t}" for t in _TAGS
) + " FROM s"


def prefixes(spark, d):
    p = strings.sample_prefix(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id"))
    rows = read(spark, d, "events").select("event_id", p.alias("prefix"), strings.episode_id(F.col("user_id"), F.col("event_id")).alias("episode"))
    return rows.select("*", strings.class_of_prefix(F.col("prefix")).alias("class_name"), strings.object_of_episode(F.col("episode")).alias("object_id"), strings.prompt(F.col("prefix")).alias("prompt"), strings.natural_key(F.col("episode")).alias("natural"))


PREFIXES = """SELECT event_id, 'cls_' || event_type || '_scene_' || user_id || '_objid_' || event_id AS prefix, user_id || '_obj_id_' || event_id AS episode,
event_type AS class_name, event_id::INT AS object_id, 'a cls_' || event_type || '_scene_' || user_id || '_objid_' || event_id AS prompt, user_id::BIGINT AS natural FROM events"""


def colours(spark, d):
    k = F.col("p_partkey")
    hexed = strings.rgb_to_hex(k % 256, k * 7 % 256, k * 13 % 256)
    return read(spark, d, "part").select("p_partkey", hexed.alias("hex")).withColumn("_c", strings.hex_to_rgb(F.col("hex"))).select("p_partkey", "hex", "_c.*")


COLOURS = "SELECT p_partkey, printf('#%02x%02x%02x', (p_partkey % 256)::INT, (p_partkey * 7 % 256)::INT, (p_partkey * 13 % 256)::INT) AS hex, (p_partkey % 256)::INT AS r, (p_partkey * 7 % 256)::INT AS g, (p_partkey * 13 % 256)::INT AS b FROM part"


def lvis_images(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey")
    out = annotations.image_rows(rows, ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000), F.col("o_orderkey").cast("string"))
    return out.select("o_orderkey", "id", "file_name", "width", "height")


LVIS_IMAGES = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id, 'images/' || o_orderkey || '.jpg' AS file_name, 640 AS width, 480 AS height FROM orders"


def _instances(spark, d):
    return _branded(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", F.col("p_brand").alias("class_name"), (F.col("l_quantity") * 2).cast("long").alias("bbx_area")
    )


def lvis_annotations(spark, d):
    classes = lookup.class_index(read(spark, d, "part").withColumnRenamed("p_brand", "class_name"), "class_name")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # the four keys have a few doubles
    out = annotations.annotation_rows(_instances(spark, d), classes, [*order, "l_extendedprice", "l_tax"], F.floor(F.col("l_orderkey") / 100))
    return out.select(*order, "id", "category_id", "area", "iscrowd")


LVIS_ANNOTATIONS = """WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS category_id FROM (SELECT DISTINCT p_brand FROM part))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS id,
category_id, (l_quantity * 2)::BIGINT AS area, 0 AS iscrowd FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k USING (p_brand)"""


def lvis_categories(spark, d):
    counts = curation.class_counts(_branded(spark, d), "p_brand")
    classes = lookup.class_index(counts, "class_name")
    return annotations.category_rows(classes, curation.frequency_buckets(counts))


LVIS_CATEGORIES = f"WITH {SQL_COUNTS} SELECT row_number() OVER (ORDER BY class_name) AS id, class_name AS name, left(bucket, 1) AS frequency FROM b"


def frequency_letters(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", lookup.frequency_letter(s > 40, s > 20, s > 10).alias("letter"))


FREQUENCY_LETTERS = "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'f' WHEN p_size > 20 THEN 'c' WHEN p_size > 10 THEN 'r' END AS letter FROM part"


def group_annotations(spark, d):
    lines = read(spark, d, "lineitem").where("l_quantity > 20").withColumnRenamed("l_orderkey", "o_orderkey")
    out = lookup.group_annotations(read(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    text = F.array_join(F.transform("annotations", lambda a: F.concat_ws("/", a["l_linenumber"], a["l_partkey"], a["l_suppkey"])), ",")
    return out.select("o_orderkey", F.size("annotations").cast("long").alias("n"), text.alias("ids"))


GROUP_ANNOTATIONS = """SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber || '/' || l_partkey || '/' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS ids
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 20 GROUP BY 1"""


def episode_rows(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 64 / 4).alias("x"), F.lit(0.0).alias("y"), (F.col("event_id") % 51 / 4).alias("z"), F.array(F.lit(1.0), F.lit(0.0)).alias("rotation"))
    out = annotations.episodes(e, ["user_id"], strings.episode_id(F.lit("0"), F.col("user_id")), F.col("user_id").cast("string"), ["event_id"], least=60)
    return out.select("user_id", "episode_id", "scene_id", F.element_at("start_position", 1).alias("start_x"), F.get("goals", F.lit(0))["position"][2].alias("goal_z"), F.size("info.viewpoints").cast("long").alias("n"))


EPISODE_ROWS = """SELECT user_id, '0_obj_id_' || user_id AS episode_id, user_id::VARCHAR AS scene_id, arg_min(event_id, event_id) % 64 / 4 AS start_x, arg_max(event_id, event_id) % 51 / 4 AS goal_z, count(*) AS n
FROM events GROUP BY user_id HAVING count(*) >= 60"""


def group_ends(spark, d):
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    out = curation.ends(rows, ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    return out.select("user_id", F.col("first.event_id").alias("first_id"), F.col("first.value").alias("first_value"), F.col("last.event_id").alias("last_id"), F.col("last.value").alias("last_value"))


GROUP_ENDS = """SELECT user_id, max(event_id) FILTER (a = 1) AS first_id, max(value) FILTER (a = 1) AS first_value, max(event_id) FILTER (b = 1) AS last_id, max(value) FILTER (b = 1) AS last_value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) GROUP BY 1"""


def group_sizes(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", line_key().alias("k"))
    return curation.group_size_at_least(rows, ["l_orderkey"], 8)


GROUP_SIZES = f"SELECT l_orderkey, {SQL_KEY} AS k FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 8"


def first_views(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 500).alias("frame"))
    targets = read(spark, d, "part").where("p_size > 30").select((F.col("p_partkey") % 500).alias("frame"))
    return curation.first_views(e, targets, ["user_id"], ["event_id"], "frame")


FIRST_VIEWS = """WITH v AS (SELECT user_id, event_id, event_id % 500 AS frame FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8)
SELECT frame, user_id, event_id FROM v WHERE frame IN (SELECT p_partkey % 500 FROM part WHERE p_size > 30)"""


def rejected(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", line_key().alias("k"))
    chosen = curation.capped(rows, ["l_suppkey"], ["k"], 25, seed=0)
    return curation.rejected(rows, chosen, ["l_suppkey", "k"])


REJECTED = f"SELECT l_suppkey, k FROM (SELECT l_suppkey, {SQL_KEY} AS k FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('0:' || k), k) > 25"


def mask_overlap(spark, d):
    l = read(spark, d, "lineitem")
    pixels = l.select((F.col("l_suppkey") % 10).alias("frame_id"), F.col("l_orderkey").alias("pred_id"), (F.col("l_partkey") % 50).alias("row"), F.col("l_linenumber").cast("long").alias("col"))
    targets = read(spark, d, "part").where("p_size > 35").select((F.col("p_partkey") % 10).alias("frame_id"), (F.col("p_partkey") % 50).alias("row"), (F.col("p_size") % 7).cast("long").alias("col"))
    return curation.overlapping(pixels, targets, "frame_id", "pred_id")


MASK_OVERLAP = """SELECT DISTINCT l_suppkey % 10 AS frame_id, l_orderkey AS pred_id FROM lineitem WHERE EXISTS (
SELECT 1 FROM part WHERE p_size > 35 AND p_partkey % 10 = l_suppkey % 10 AND p_partkey % 50 = l_partkey % 50 AND p_size % 7 = l_linenumber)"""


def confident(spark, d):
    rows = read(spark, d, "events").select((F.col("event_id") % 997).alias("pred_id"), F.col("event_type").alias("class_name"), (F.col("event_id") * 31 % 100 / 100).alias("score"))
    return curation.confident(rows, ["pred_id"], 0.95)


CONFIDENT = """WITH p AS (SELECT event_id % 997 AS pred_id, event_type AS class_name, event_id * 31 % 100 / 100 AS score FROM events)
SELECT pred_id, class_name, score FROM p QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY score DESC, class_name) = 1 AND score >= 0.95"""


def hit_rate(spark, d):
    kept = mask_overlap(spark, d)
    l = read(spark, d, "lineitem")
    preds = l.select((F.col("l_suppkey") % 10).alias("frame_id"), F.col("l_orderkey").alias("pred_id"), F.col("l_returnflag").alias("class_name")).distinct()
    return curation.hit_rates(kept, preds, ["frame_id", "pred_id"])


HIT_RATE = f"""WITH k AS ({MASK_OVERLAP}), p AS (SELECT DISTINCT l_suppkey % 10 AS frame_id, l_orderkey AS pred_id, l_returnflag AS class_name FROM lineitem)
SELECT class_name, count(*) AS predictions, count(k.pred_id) AS hits, count(k.pred_id) / count(*) AS rate FROM p LEFT JOIN k USING (frame_id, pred_id) GROUP BY 1"""


def cover_samples(spark, d):
    samples = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("objects"))
    return sampling.covering(samples, [1, 2], "l_orderkey").select("l_orderkey")


COVER_SAMPLES = "SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey % 10) = 2"


def kmeans_assign(spark, d):
    points = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    found = sampling.assign_nearest(points, [[v if i == at else 0.0 for i in range(64)] for at, v in _CENTRES])
    return found.select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


# (place, value) of the one number of a centre that isn't 0
_CENTRES = ((0, 0.0), (0, 0.25), (17, -0.25), (63, 0.5))
_C = ", ".join(f"({i}, {at}, {v}::DOUBLE)" for i, (at, v) in enumerate(_CENTRES))
KMEANS_ASSIGN = f"""WITH c(cluster, place, x) AS (VALUES {_C}), p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT vec_id, cluster, sum((e - CASE WHEN i = place THEN x ELSE 0 END) * (e - CASE WHEN i = place THEN x ELSE 0 END)) AS d2 FROM p, c GROUP BY 1, 2)
SELECT vec_id, cluster, round(d2, 6) AS d2 FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY f.d2, cluster) = 1"""


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def kmeans_medoids(spark, d):
    return sampling.kmeans(_vectors(spark, d), 8)[0]


def coverage_sample(spark, d):
    return sampling.coverage_sample(_vectors(spark, d), 10).select("key")


def _samples(spark, d):
    l = read(spark, d, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("objects"), F.collect_list("l_returnflag").alias("classes"))


def balanced_sample(spark, d):
    return sampling.balanced_sample(_samples(spark, d), 40).select("key")


def covisibility_sample(spark, d):
    positions = spark.range(10).select(F.col("id").alias("object"), F.array((F.col("id") * 7 % 10).cast("double"), F.col("id").cast("double")).alias("v"))
    keys = sampling.covisibility_sample(_samples(spark, d), positions, 6)
    return spark.createDataFrame([(k,) for k in keys], "key long")


def object_classes(spark, d):
    """Objects named by a vocabulary of part types, unknown ones left out."""
    part = read(spark, d, "part")
    vocab = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("unknown").alias("class_name"))
    objects = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("obj_name"))
    return lookup.known_classes(lookup.annotate(objects, vocab), "class_name")


OBJECT_CLASSES = "SELECT l_partkey AS obj_name, l_orderkey, l_linenumber, l_suppkey, p_type AS class_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5"


def first_scenes(spark, d):
    return curation.first_scenes(read(spark, d, "nation").select(F.col("n_name").alias("scene")), 5)


FIRST_SCENES = "SELECT n_name AS scene FROM nation ORDER BY n_name LIMIT 5"

_NAMES = """freq_tertiles freq_unseen area_bin_sample area_bin_ties capped_shuffle exists_min_area exists_object largest_areas
all_objects default_lookup last_duplicate vocab_index contiguous_ids shortname synset_keys stem_roundtrip prefixes colours
lvis_images lvis_annotations lvis_categories frequency_letters group_annotations episode_rows group_ends group_sizes
first_views rejected mask_overlap confident hit_rate cover_samples kmeans_assign kmeans_medoids coverage_sample
balanced_sample covisibility_sample object_classes first_scenes""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
