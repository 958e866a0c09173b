"""Stratified, coverage-based and balanced sampling.

Random choices are by hashes of (seed, key), so a result depends on the rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hash_order, rank_quantiles
from .morphology import _saved


def area_bins(rows: DataFrame, group: str, key: str, area: str, num_samples: int = 20, num_bins: int = 10, top_bins: int = 5, seed: int = 0) -> DataFrame:
    """(group, key): a sample of each group that prefers its large areas.

    A group with fewer than num_samples rows is taken whole.  Otherwise areas are cut at the
    distinct ones of num_bins + 1 quantiles; with fewer than three edges the sample is uniform.
    A row's bin is the number of inner edges up to its area; the top_bins highest bins give
    num_samples // bins rows each, at least one; what is short is filled from their other rows.
    key is unique in a group.  A null area counts as 0.
    """
    return area_binned(rows, group, key, area, num_samples, num_bins, top_bins, seed).select(group, key)


def area_binned(rows: DataFrame, group: str, key: str, area: str, num_samples: int = 20, num_bins: int = 10, top_bins: int = 5, seed: int = 0) -> DataFrame:
    """The rows that area_bins names.

    rows stands in the plan twice only, for the edges and for the sample, as a plan that repeats a
    flow for each step fills the driver.  Each row goes with its hash to the ranks it takes part
    in, of which each task keeps the first ones; a row for each group, its edges, is broadcast.
    """
    based = rows.withColumns({"_g": F.col(group), "_k": F.col(key), "_a": F.coalesce(F.col(area), F.lit(0)).cast("double")})
    edges = (
        rank_quantiles(based.select("_g", "_a"), ["_g"], "_a", num_bins)
        .groupBy("_g")
        .agg(F.array_sort(F.collect_set("edge")).alias("_edges"), F.max("n").alias("_size"))
        .withColumn("_m", F.size("_edges"))
        .withColumn("_inner", F.when(F.col("_m") >= 3, F.slice("_edges", 2, F.col("_m") - 2)))
    )
    few = (F.col("_size") < num_samples) | (F.col("_m") < 3)  # taken whole, or a uniform sample
    bins = F.col("_m") - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(num_samples) / F.greatest(F.least(bins, F.lit(top_bins)), F.lit(1))))
    at = F.size(F.filter("_inner", lambda e: e <= F.col("_a")))
    binned = based.join(F.broadcast(edges.select("_g", few.alias("_few"), bins.alias("_bins"), per.alias("_per"), "_inner")), "_g").withColumn("_at", at)
    first, second = hash_order(seed, "_k"), hash_order(seed + 1, "_k")
    rank = lambda kind, h, b: F.struct(F.lit(kind).alias("kind"), h.alias("h"), b.cast("int").alias("bin"))
    none = F.lit(None)
    ranks = F.when(F.col("_few"), F.array(rank("few", first, none))).when(
        F.col("_at") >= F.greatest(F.lit(0), F.col("_bins") - top_bins), F.array(rank("main", first, F.col("_at")), rank("rest", second, none))
    )
    ranked = binned.withColumn("_rank", F.explode(ranks)).select(*rows.columns, "_g", "_k", "_per", F.col("_rank.kind").alias("_kind"), F.col("_rank.h").alias("_h"), F.col("_rank.bin").alias("_bin"))
    # so many of the first ones fill up a sample even if every row of the bins is among them
    most = num_samples + max(num_samples, top_bins)
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("_g", "_kind", "_bin").orderBy("_h", "_k"))).where(F.col("_n") <= most)
    main, by_group = (F.col("_kind") == "main") & (F.col("_n") <= F.col("_per")), Window.partitionBy("_g")
    met = ranked.withColumn("_main", F.max(main).over(Window.partitionBy("_g", "_k")))
    met = met.where((F.col("_kind") == "few") | main | ((F.col("_kind") == "rest") & ~F.col("_main")))
    met = met.withColumn("_taken", F.sum((F.col("_kind") == "main").cast("int")).over(by_group))
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_kind").orderBy("_bin", "_n")))
    room = F.when(F.col("_kind") == "rest", F.lit(num_samples) - F.col("_taken")).otherwise(F.lit(num_samples))
    return met.where(F.col("_r") <= room).select(*rows.columns)


def assign_nearest(points: DataFrame, centres: list[list[float]], vector: str = "v") -> DataFrame:
    """points with cluster and d2, the first nearest of the fixed centres."""
    far = [
        F.struct(
            F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d2"),
            F.lit(i).alias("cluster"),
        )
        for i, c in enumerate(centres)
    ]
    return points.withColumn("_n", F.array_min(F.array(*far))).select(*points.columns, "_n.cluster", "_n.d2")


def kmeans(points: DataFrame, k: int, seed: int = 0, max_iter: int = 20, key: str = "key", vector: str = "v"):
    """(medoids, partition): Lloyd's rounds; medoids is (cluster, key), the point nearest to each
    centre, each key once; partition is (key, cluster) as of the last assignment.

    Centres start at k points in hash order; an empty cluster starts again at another one.  With
    k points or fewer each point is its own cluster.  The driver holds k centres.
    """
    points = _saved(points.select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector)))
    seeds = points.orderBy(hash_order(seed, key), key).limit(k + max_iter).collect()
    if len(seeds) <= k and points.count() <= k:
        single = points.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("cluster"))
        return single.select("cluster", key), single
    centres = [list(r[vector]) for r in seeds[:k]]
    spare = [list(r[vector]) for r in seeds[k:]]
    dim = len(centres[0])
    assigned = None
    for _ in range(max_iter):
        assigned = assign_nearest(points, centres, vector)
        means = assigned.groupBy("cluster").agg(F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dim)]).alias("c")).collect()
        new = {r.cluster: list(r.c) for r in means}
        moved = [new.get(i) or (spare.pop() if spare else centres[i]) for i in range(k)]
        close = all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8) for x, y in zip(moved, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = moved
        if close:
            break
    best = assign_all(points, centres, vector, key)
    return best, assigned.select(key, "cluster")


def assign_all(points: DataFrame, centres: list[list[float]], vector: str, key: str) -> DataFrame:
    """(cluster, key): the point nearest to each centre; a point of several centres counts once."""
    far = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("cluster"),
                    F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d2"),
                )
                for i, c in enumerate(centres)
            ]
        )
    )
    nearest = points.select(key, far.alias("e")).groupBy("e.cluster").agg(F.min_by(key, F.struct(F.col("e.d2"), F.col(key))).alias(key))
    return nearest.groupBy(key).agg(F.min("cluster").alias("cluster")).select("cluster", key)


def coverage_sample(samples: DataFrame, num_samples: int, seed: int = 0, key: str = "key", position: str = "v") -> DataFrame:
    """samples nearest to the centres of num_samples clusters of their positions; all of them if
    there are no more."""
    medoids, _ = kmeans(samples, num_samples, seed, key=key, vector=position)
    return samples.join(medoids.select(key), key, "left_semi")


def balanced_weights(marginals: list[list[float]], counts: list[float], rounds: int = 200) -> list[float]:
    """Probabilities of sample kinds that make the expected class counts as equal as they can be.

    marginals[i][c]: 1 if a sample of kind i has the class c, else 0; counts[i]: samples of that kind.
    Minimises C * |q|^2 - (sum q)^2 for q the expected counts, over the simplex with a floor, by
    exponentiated gradient steps; only class sums are formed, never a matrix of samples.
    """
    import numpy as np

    e, n = np.asarray(marginals, float), np.asarray(counts, float)
    c, total = e.shape[1], n.sum()
    floor = 1 / (total * total)
    p = np.full(len(n), 1 / total)
    scale = max(1e-12, np.abs(2 * c * (e @ (e.T @ (p * n)))).max())
    for _ in range(rounds):
        q = e.T @ (p * n)
        grad = 2 * (c * (e @ q) - (e.sum(1)) * q.sum())
        p = p * np.exp(-grad / scale)
        p = np.maximum(p / (p * n).sum(), floor)
        p = p / (p * n).sum()
    return p.tolist()


def balanced_sample(samples: DataFrame, num_samples: int, seed: int = 0, key: str = "key", classes: str = "classes") -> DataFrame:
    """num_samples samples, drawn without replacement so that classes come out balanced.

    classes: array of a sample's class names; a class counts once however often it stands there.
    Samples with the same classes share a weight; the driver holds one row for each such set.  The draw takes the smallest
    -ln(u) / p, with u from the key's hash.
    """
    kind = F.array_sort(F.array_distinct(classes))
    kinds = samples.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).collect()
    if not kinds:
        return samples
    kinds.sort(key=lambda r: list(r.kind))
    names = sorted({c for r in kinds for c in r.kind})
    rows = [[float(c in r.kind) for c in names] for r in kinds]
    weights = balanced_weights(rows, [float(r.n) for r in kinds]) if names else [1.0] * len(kinds)
    lookup = samples.sparkSession.createDataFrame([(list(r.kind), w) for r, w in zip(kinds, weights, strict=True)], "kind array<string>, p double")
    u = (F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    drawn = samples.withColumn("kind", kind).join(lookup, "kind").withColumn("_e", -F.log(u) / F.col("p"))
    return drawn.orderBy("_e", key).limit(num_samples).select(*samples.columns)


def covering(samples: DataFrame, objects: list, key: str = "key", column: str = "objects") -> DataFrame:
    """samples that hold all of the objects."""
    wanted = F.array(*[F.lit(o) for o in objects])
    return samples.where(F.size(F.array_except(wanted, F.col(column))) == 0)


def covisibility_subset(samples: DataFrame, positions: DataFrame, seed: int = 0, key: str = "key", column: str = "objects") -> list:
    """Keys of samples that together show every object.

    Starts with one cluster of all objects and takes the largest: a sample with all of its
    objects, the one with most objects and then the smallest key, covers it; otherwise two-means
    on the objects' positions split it.  positions: (object, v).  A cluster that no sample covers
    is split down to single objects, so this ends; the driver holds the objects of one run.
    """
    every = sorted(r[0] for r in samples.select(F.explode(column)).distinct().collect())
    clusters, chosen = [every] if every else [], []
    while clusters:
        clusters.sort(key=len, reverse=True)
        cluster = clusters.pop(0)
        best = covering(samples, cluster, key, column).orderBy(F.desc(F.size(column)), key).select(key).limit(1).collect()
        if best:
            if best[0][0] not in chosen:
                chosen.append(best[0][0])
            continue
        own = positions.where(F.col("object").isin(cluster)).select(F.col("object").alias("key"), "v")
        _, parts = kmeans(own, 2, seed)
        split: dict[int, list] = {}
        for r in parts.collect():
            split.setdefault(r.cluster, []).append(r["key"])
        halves = [sorted(v) for v in split.values()]
        if len(halves) < 2:  # positions that two-means can't part
            halves = [cluster[: len(cluster) // 2], cluster[len(cluster) // 2 :]]
        clusters += halves
    return chosen


def covisibility_sample(samples: DataFrame, positions: DataFrame, num_samples: int, seed: int = 0, key: str = "key", column: str = "objects") -> list:
    """Covering subsets of what is left, one after another, until num_samples or nothing is left."""
    chosen: list = []
    while len(chosen) < num_samples:
        rest = samples.where(~F.col(key).isin(chosen)) if chosen else samples
        found = covisibility_subset(rest, positions, seed, key, column)
        if not found:
            break
        chosen += found
    return chosen[:num_samples]
