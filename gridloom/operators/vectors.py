"""Class embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_normalize(vector: Column) -> Column:
    """At unit length; a vector of zeros stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def with_background(classes: DataFrame, vector: str = "embedding", normalized: bool = True) -> DataFrame:
    """(class_name, embedding) with a background class of zeros, at unit length if asked for."""
    own = classes.select("class_name", F.transform(vector, lambda x: x.cast("double")).alias(vector))
    zero = own.agg(F.max(F.size(vector)).alias("d")).select(
        F.lit("background").alias("class_name"),
        F.transform(F.sequence(F.lit(1), F.col("d")), lambda i: F.lit(0.0)).alias(vector),
    )
    rows = own.unionByName(zero)
    return rows.withColumn(vector, l2_normalize(F.col(vector))) if normalized else rows

