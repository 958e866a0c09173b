"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The grid that parts are placed on: row = size, column = key modulo 64.
HEIGHT, WIDTH = 51, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def line_key() -> F.Column:
    return F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col")).distinct()


def typed_cells(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """The cells of the parts of some types."""
    part = read(spark, sf_dir, "part").where(F.col("p_type").isin(*types))
    return part.select(F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col")).distinct()


def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, label): the last digits of the brand, the largest where parts meet."""
    part = read(spark, sf_dir, "part")
    label = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return part.groupBy(F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col")).agg(F.max(label).alias("label"))


def valued_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.groupBy(F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col")).agg(F.count("*").cast("double").alias("value"))


SQL_CELLS = "cells AS (SELECT DISTINCT p_size::INT AS r, (p_partkey % 64)::INT AS c FROM part)"
SQL_LABELLED = (
    "labelled AS (SELECT p_size::INT AS r, (p_partkey % 64)::INT AS c, "
    "max(regexp_extract(p_brand, '(\\d+)', 1)::INT) AS label FROM part GROUP BY 1, 2)"
)
SQL_VALUED = "valued AS (SELECT p_size::INT AS r, (p_partkey % 64)::INT AS c, count(*)::DOUBLE AS v FROM part GROUP BY 1, 2)"
SQL_GRID = "grid AS (SELECT a.range::INT AS r, b.range::INT AS c FROM range(51) a, range(64) b)"
SQL_KEY = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def sql_offsets(name: str, offsets, *more: str) -> str:
    rows = ", ".join("(" + ", ".join(map(str, o)) + ")" for o in offsets)
    return f"{name}({', '.join(('dr', 'dc', *more))}) AS (VALUES {rows})"
