"""Map state as a sparse table (env, channel, row, col, value), and its updates.

Merging is a maximum, which is associative: the patches of any number of steps merge in one
aggregation.  Only resets, instance ids and the current place look at the order of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BEEN_CLOSE, BLACKLISTED, CURRENT, EXPLORED, NON_SEMANTIC, OBSTACLE, VISITED, Mapping, MapSize
from .grid import recentre
from .morphology import dilate, max_pool
from .stencil import disk, inside, shifted, square

CELL = ["env", "channel", "row", "col"]


def empty_map(spark) -> DataFrame:
    return spark.createDataFrame([], "env long, channel int, row int, col int, value double")


def initial_state(envs: DataFrame, size: MapSize) -> tuple[DataFrame, DataFrame]:
    """(map, poses): the agent stands in the middle; 3 x 3 cells around it are set in the current
    and visited channels."""
    mid = size.global_cells // 2
    spots = envs.select("env", F.explode(F.array(F.lit(CURRENT), F.lit(VISITED))).alias("channel"), F.lit(mid).alias("row"), F.lit(mid).alias("col"))
    cells = shifted(spots, square(1)).select(*CELL, F.lit(1.0).alias("value"))
    metres = size.map_cm / 100 / 2
    poses = envs.select("env", F.lit(metres).alias("x"), F.lit(metres).alias("y"), F.lit(0.0).alias("heading_deg"))
    return cells, recentre(poses, size)


def merge(*maps: DataFrame) -> DataFrame:
    """Cell by cell, the largest value."""
    every = maps[0].select(*CELL, "value")
    for m in maps[1:]:
        every = every.unionByName(m.select(*CELL, "value"))
    return every.groupBy(*CELL).agg(F.max("value").alias("value"))


def latest(cells: DataFrame, step: str = "step") -> DataFrame:
    """Cell by cell, the value of the last step; for channels that a step overwrites.

    The frames of a channel's last step replace all its cells."""
    last = cells.groupBy("env", "channel").agg(F.max(step).alias("_last"))
    kept = cells.join(last, ["env", "channel"]).where(F.col(step) == F.col("_last"))
    return kept.groupBy(*CELL).agg(F.max("value").alias("value"))


def stamp_places(places: DataFrame, channel: int, offsets, size: int) -> DataFrame:
    """(env, channel, row, col, value 1) around places (env, row, col), cut at the border."""
    cells = shifted(places.select("env", F.lit(channel).alias("channel"), "row", "col"), offsets)
    return cells.where(inside(size, size)).distinct().withColumn("value", F.lit(1.0))


def stamps(places: DataFrame, mapping: Mapping, size: int, step: str = "step", blacklist: DataFrame | None = None) -> DataFrame:
    """What the agent's places (env, step, row, col) add: visited squares, explored and been-close
    disks, the current square of the last step only, and blacklisted disks if given."""
    last = Window.partitionBy("env").orderBy(F.desc(step))
    now = places.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    out = stamp_places(now, CURRENT, square(2), size)
    out = out.unionByName(stamp_places(places, VISITED, square(2), size))
    out = out.unionByName(stamp_places(places, EXPLORED, disk(mapping.explored_radius), size))
    out = out.unionByName(stamp_places(places, BEEN_CLOSE, disk(mapping.close_radius), size))
    if blacklist is not None:
        out = out.unionByName(stamp_places(blacklist, BLACKLISTED, disk(mapping.blacklist_radius), size))
    return out


def only_been_close(cells: DataFrame) -> DataFrame:
    """Explored and obstacle cells times the value of been-close; cells that this makes 0 go.
    cells has a row for each cell and channel at most."""
    close = cells.where(F.col("channel") == BEEN_CLOSE).select("env", "row", "col", F.col("value").alias("_close"))
    bound = F.col("channel").isin(OBSTACLE, EXPLORED)
    scaled = cells.where(bound).join(close, ["env", "row", "col"]).withColumn("value", F.col("value") * F.col("_close"))
    return cells.where(~bound).unionByName(scaled.where("value <> 0").select(*cells.columns))


def write_back(world: DataFrame, local: DataFrame, windows: DataFrame) -> DataFrame:
    """world with the window (env, top, bottom, left, right) replaced by the local map."""
    w = windows.select("env", "top", "bottom", "left", "right")
    within = F.col("row").between(F.col("top"), F.col("bottom") - 1) & F.col("col").between(F.col("left"), F.col("right") - 1)
    kept = world.join(w, "env", "left").where(~F.coalesce(within, F.lit(False))).select(*CELL, "value")
    moved = local.join(w, "env").select(
        "env", "channel", (F.col("row") + F.col("top")).alias("row"), (F.col("col") + F.col("left")).alias("col"), "value"
    )
    return kept.unionByName(moved)


def local_view(world: DataFrame, windows: DataFrame) -> DataFrame:
    """The cells of the windows, counted from their corners."""
    within = F.col("row").between(F.col("top"), F.col("bottom") - 1) & F.col("col").between(F.col("left"), F.col("right") - 1)
    return world.join(windows.select("env", "top", "bottom", "left", "right"), "env").where(within).select(
        "env", "channel", (F.col("row") - F.col("top")).alias("row"), (F.col("col") - F.col("left")).alias("col"), "value"
    )


def map_features(local: DataFrame, world: DataFrame, downscaling: int) -> DataFrame:
    """Local non-semantic channels, then the global ones pooled to the same size, then semantic ones."""
    plain = F.col("channel") < NON_SEMANTIC
    pooled = max_pool(world.where(plain), downscaling).withColumn("channel", F.col("channel") + NON_SEMANTIC)
    semantic = local.where(~plain).withColumn("channel", F.col("channel") + NON_SEMANTIC)
    return local.where(plain).select(*CELL, "value").unionByName(pooled.select(*CELL, "value")).unionByName(semantic.select(*CELL, "value"))


def semantic_map(cells: DataFrame, classes: int) -> DataFrame:
    """(env, row, col, category): the strongest semantic channel of cells that have any value over
    1e-5, the first on ties; the last class stands for nothing and is left out."""
    found = cells.where(
        (F.col("channel") >= NON_SEMANTIC) & (F.col("channel") < NON_SEMANTIC + classes - 1) & (F.col("value") > 1e-5)
    )
    best = F.min_by("channel", F.struct(-F.col("value"), F.col("channel")))
    return found.groupBy("env", "row", "col").agg((best - NON_SEMANTIC).alias("category"))


def channel(cells: DataFrame, number: int) -> DataFrame:
    """One channel: obstacles, explored, visited, been-close, blacklist or a class."""
    return cells.where(F.col("channel") == number).select("env", "row", "col", "value")


def display_layers(cells: DataFrame, categories: DataFrame, goal: DataFrame, closest: DataFrame, height: int, width: int, radius: int = 4) -> DataFrame:
    """(env, row, col, layer, category) by priority: 6 closest goal, 5 goal, 4 visited, 3 a
    category, 2 obstacle, 1 explored.

    categories (env, row, col, category) as semantic_map gives them; category 0 counts as none.
    Obstacles and explored cells are those whose value rounds to 1.  Goals are made larger by a
    disk.  category is null in other layers.
    """
    one = F.rint("value") == 1
    layer = (
        F.when((F.col("channel") == VISITED) & (F.col("value") > 0), 4)
        .when((F.col("channel") == OBSTACLE) & one, 2)
        .when((F.col("channel") == EXPLORED) & one, 1)
    )
    none = F.lit(None).cast("int").alias("category")
    rows = cells.select("env", "row", "col", layer.alias("layer"), none).where("layer is not null")
    named = categories.where("category <> 0").select("env", "row", "col", F.lit(3).alias("layer"), F.col("category").cast("int"))
    rows = rows.unionByName(named)
    for spots, number in ((goal, 5), (closest, 6)):
        grown = dilate(spots.select("env", "row", "col"), disk(radius), height, width)
        rows = rows.unionByName(grown.select("env", "row", "col", F.lit(number).alias("layer"), none))
    top = F.max(F.struct("layer", "category")).alias("_t")
    return rows.groupBy("env", "row", "col").agg(top).select("env", "row", "col", "_t.layer", "_t.category")


def sessions(steps: DataFrame, done: str = "done", step: str = "step") -> DataFrame:
    """steps with session, the number of resets before a step; what follows a reset starts anew."""
    before = Window.partitionBy("env").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("session", F.coalesce(F.sum(F.col(done).cast("int")).over(before), F.lit(0)))


def session_maps(patches: DataFrame, steps: DataFrame) -> DataFrame:
    """(env, session, channel, row, col, value): the patches (env, step, channel, row, col, value)
    of each session, merged in one aggregation."""
    tagged = patches.join(sessions(steps).select("env", "step", "session"), ["env", "step"])
    return tagged.groupBy("env", "session", "channel", "row", "col").agg(F.max("value").alias("value"))


def update(world: DataFrame, patches: DataFrame, places: DataFrame, mapping: Mapping, close_only: bool = False) -> DataFrame:
    """A map after any number of steps: old cells without the current place, patches and stamps."""
    old = world.where(F.col("channel") != CURRENT)
    merged = merge(old, patches, stamps(places, mapping, mapping.size.global_cells))
    return only_been_close(merged) if close_only else merged


def planner_inputs(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """Obstacles, explored and visited cells, and the goal as channel -1."""
    plain = cells.where(F.col("channel").isin(OBSTACLE, EXPLORED, VISITED)).select(*CELL, "value")
    return plain.unionByName(goal.select("env", F.lit(-1).alias("channel"), "row", "col", F.lit(1.0).alias("value")))


def goal_or_frontier(goal: DataFrame, frontier: DataFrame) -> DataFrame:
    """The goal of environments that have one, the frontier of the others."""
    return goal.select("env", "row", "col").unionByName(frontier.join(goal.select("env").distinct(), "env", "left_anti").select("env", "row", "col"))
