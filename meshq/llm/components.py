"""Connected components by alternating large and small stars.

The edges stay in DataFrames; each round joins them with the least neighbour of every node. The joins have plain hash
exchanges on both sides, so that adaptive execution splits a hub's rows; each round's edges are written to the shared folder.
A caller may let the driver link few edges, which takes one job and not several for each round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshq.llm.common import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Links each node's neighbours (larger ones, or smaller ones and itself) to its least one."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        j = edges.join(least, "u")
        out = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _linked_here(edges: DataFrame, name: str) -> DataFrame:
    """node, root of edges (u, v), numbers, linked by the driver."""
    t, least = edges.toArrow(), {}

    def find(x: int) -> int:
        while least.setdefault(x, x) != x:
            least[x] = x = least[least[x]]
        return x

    for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist(), strict=True):
        a, b = find(u), find(v)
        least[max(a, b)] = min(a, b)
    found = pa.table({"node": pa.array(list(least), t["u"].type), "root": pa.array([find(x) for x in list(least)], t["u"].type)})
    return materialize(edges.sparkSession.createDataFrame(found), name)


def components(edges: DataFrame, name: str = "components", most_here: int = 0) -> DataFrame:
    """edges (a, b): node, root. root is the least node that can be reached; only nodes of edges are returned. Loops and
    repeated edges do no harm; null ends are left out. Up to most_here distinct edges between numbers are linked by the driver."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    if 0 < before[0] <= most_here:
        found = _linked_here(e, name)
        drop(e)
        return found
    while before[0]:
        large = materialize(_star(e, True), name)
        drop(e)
        e = materialize(_star(large, False), name)
        drop(large)
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
