"""Deterministic random order, exact quantiles, positions and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A random but repeatable sort key: the same in every run, partitioning and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.md5(text)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rank_quantiles(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, k, edge, n): the k-th of bins + 1 linearly interpolated quantiles of n rows per key.

    Positions are whole numbers over `bins`, so that engines agree to the last bit.  Equal values
    are counted first, so a task orders the distinct values of a key, and df is read once.
    """
    w = Window.partitionBy(*keys)
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = counts.withColumn("_end", F.sum("_c").over(w.orderBy("_v"))).withColumn("n", F.sum("_c").over(w))
    pos = lambda k: k * (F.col("n") - 1)
    low = lambda k: F.floor(pos(k) / bins)
    high = lambda k: F.least(low(k) + 1, F.col("n") - 1)
    here = lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
    # the values at two ranks for each edge; no row is copied for other ranks
    near = placed.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bins)), lambda k: here(low(k)) | here(high(k)))))
    k = F.col("k")
    lo, hi = (F.max(F.when(here(r(k)), F.col("_v"))) for r in (low, high))
    part = F.max((pos(k) % bins / bins).cast("double"))
    return near.groupBy(*keys, "k").agg((lo + (hi - lo) * part).alias("edge"), F.max("n").alias("n"))


def numbered(df: DataFrame, order: list[Column | str], coarse: Column, name: str, start: int = 0) -> DataFrame:
    """df with the position of each row in a total order.

    coarse rises with the order and takes many values; rows are ranked within a value, and the
    values' sizes are added up, so that no task sorts the whole table.
    """
    tagged = df.withColumn("_coarse", coarse)
    sizes = tagged.groupBy("_coarse").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_coarse", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_coarse").orderBy(*order)) - 1
    return (
        tagged.withColumn("_rank", rank)
        .join(starts, "_coarse")
        .withColumn(name, F.col("_start") + F.col("_rank") + start)
        .drop("_coarse", "_rank", "_start")
    )
