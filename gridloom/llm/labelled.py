"""Labelled rows for the classifiers: a bounded sample that is the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(name(id_col)).cast("string").cast("binary")), F.lit(parts))


def labelled_rows(labels: DataFrame, id_col: str, label_col: str, train: Column) -> DataFrame:
    """(id, label) of the rows that train holds for.

    Rows without an id or a label of 0 or 1 are left out; of an id's rows one counts.
    """
    return (
        labels.where(train)
        .select(F.col(name(id_col)).cast("long").alias("id"), F.col(name(label_col)).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )


def sample(labels: DataFrame, id_col: str, label_col: str, train: Column, most: int) -> DataFrame:
    """At most `most` labelled rows of each label, by the ids' hashes."""
    rows = labelled_rows(labels, id_col, label_col, train)
    chosen = [
        rows.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most) for v in (0, 1)
    ]
    return chosen[0].union(chosen[1])


def sampled_texts(packed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, text, label) of the packed documents in a sample; of an id's rows all count."""
    return packed.select("id", "text").join(F.broadcast(chosen), "id")  # bounded by the sample
