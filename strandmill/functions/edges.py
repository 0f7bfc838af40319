"""Row-wise operations on edge tables (vi, vj and perhaps more)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_vertex(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("vi").alias("v"))


def to_vertex_pair(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("vi").alias("v"), F.col("vj").alias("u"))


def to_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("vi", "vj")).alias("v"))


def upper(edges: DataFrame) -> DataFrame:
    """Ends in order; loops dropped."""
    return edges.where("vi <> vj").withColumns({"vi": F.least("vi", "vj"), "vj": F.greatest("vi", "vj")})


def invert(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return pairs.select(F.col(value).alias(key), F.col(key).alias(value))


def add_label(rows: DataFrame, label: int = 1) -> DataFrame:
    return rows.withColumn("label", F.lit(label))


def add_weight(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    return rows.withColumn("w", F.lit(weight))
