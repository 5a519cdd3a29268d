"""Exact k-nearest-neighbour and box queries, single and in batches.

Points need an id column; ties in distance go to the smaller id. Rows with null or non-finite coordinates take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshq.functions.vectors import as_double, flat_in_box, in_box, is_finite, l2_squared, vector
from meshq.operators.parts import against


def knn(points: DataFrame, coords: str, id_col: str, q, k: int) -> DataFrame:
    """The k nearest of one query: a top-k without a full sort."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    v = as_double(coords)
    return points.filter(is_finite(v)).select(id_col, l2_squared(v, vector(q)).alias("d2")).orderBy("d2", id_col).limit(k)


def knn_batch(points: DataFrame, coords: str, id_col: str, queries: DataFrame, k: int) -> DataFrame:
    """queries (qid, q): each one's k nearest with rank from 1. Each map task keeps k rows a query before the shuffle."""
    v = as_double(coords)
    d = against(points.filter(is_finite(v)).select(id_col, v.alias("_v")), queries)
    d = d.select("qid", id_col, l2_squared(F.col("_v"), F.col("q")).alias("d2"))
    w = Window.partitionBy("qid").orderBy("d2", id_col)
    return d.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def box(points: DataFrame, cols: list[str], lo, hi) -> DataFrame:
    """Rows inside a box, bounds included; on flat columns the bounds reach the Parquet scan."""
    return points.filter(flat_in_box([F.col(c) for c in cols], lo, hi))


def box_array(points: DataFrame, coords: str, lo, hi) -> DataFrame:
    return points.filter(in_box(as_double(coords), vector(lo), vector(hi)))


def box_batch(points: DataFrame, cols: list[str], queries: DataFrame) -> DataFrame:
    """queries (qid, lo_<col>, hi_<col> ...): the rows in each box."""
    inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in cols])
    return against(points, queries).filter(inside).drop(*[f"{s}_{c}" for s in ("lo", "hi") for c in cols])
