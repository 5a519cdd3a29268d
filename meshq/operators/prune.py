"""Pruning of clusters by centroid and radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshq.functions.vectors import SLACK


def box_may_hit(box_d2: Column, radius: Column) -> Column:
    """Keeps a cluster whose sphere touches the box."""
    return box_d2 <= radius * radius * (1 + SLACK) + SLACK


def knn_bounds(distance: Column, radius: Column) -> tuple[Column, Column]:
    """Least and greatest distance of a cluster's points to the query."""
    return distance * (1 - SLACK) - radius, distance + radius


def step_select(clusters: DataFrame, k: int, lower: str = "lb", radius: str = "radius", n: str = "n", tie: str = "node_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Takes clusters by lower bound until k points are covered, then all whose lower bound doesn't exceed the greatest upper bound of
    those, which is 0 at least. by: columns that tell queries apart.

    The first k clusters that aren't empty cover k points, so that only they are sorted, k for each query; the rest are two
    aggregates and a filter, wherever they lie."""
    place = F.struct(F.col(lower).alias("lower"), F.col(tie).alias("tie"))
    full = clusters.filter(F.col(n) > 0).select(*by, place.alias("_place"), F.col(n).alias("_n"))
    if by:
        first = full.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_place"))).filter(F.col("_r") <= k).drop("_r")
    else:
        first = full.orderBy("_place").limit(k)
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    w = Window.partitionBy(*(by or ("_all",))).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*keys, "_place", "_n").withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    names = list(by or ("_all",))
    # The last cluster taken to cover k points; without one more than k points there is none beyond it.
    edge = first.groupBy(*names).agg(F.max(F.when(F.col("_before") < k, F.col("_place"))).alias("_edge"), F.sum("_n").alias("_sum"))
    c = clusters if by else clusters.withColumn("_all", F.lit(0))
    c = c.join(F.broadcast(edge) if not by else edge, names, "left")
    covered = (F.col("_sum") >= k) & (place > F.col("_edge"))
    limit = c.filter(~F.coalesce(covered, F.lit(False))).groupBy(*names).agg(F.greatest(F.lit(0.0), F.max(F.col(lower) + 2 * F.col(radius))).alias("_t"))
    c = c.join(F.broadcast(limit) if not by else limit, names)
    return c.filter(~F.coalesce(covered, F.lit(False)) | (F.col(lower) <= F.col("_t"))).drop("_edge", "_sum", "_t", "_all")


def step_limit(clusters: DataFrame, k: int, lower: str = "lb", radius: str = "radius", n: str = "n", tie: str = "node_id") -> float:
    """The greatest upper bound of the clusters that cover k points, 0 at least: one number, so that a plan that uses it needs no join.
    For clusters none of which is empty, as an index has them; infinite if all together have fewer points."""
    first = clusters.select(F.col(lower).alias("_l"), F.col(tie).alias("_tie"), F.col(radius).alias("_r"), F.col(n).alias("_n")).orderBy("_l", "_tie").limit(k)
    w = Window.orderBy("_l", "_tie").rowsBetween(Window.unboundedPreceding, -1)  # over k rows at most
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    got = first.agg(F.max(F.when(F.col("_before") < k, F.col("_l") + 2 * F.col("_r"))), F.sum("_n")).first()
    return float("inf") if got[1] is None or got[1] < k else max(0.0, got[0])
