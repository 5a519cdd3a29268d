"""A multi-level k-means index as DataFrames: build, save, load, prune, refine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshq.functions.vectors import as_double, box_distance_squared, in_box, is_finite, l2, l2_squared, vector
from meshq.operators import cluster
from meshq.operators.parts import against
from meshq.operators.prune import box_may_hit, knn_bounds, step_limit, step_select
from meshq.shared import scratch


def plan_levels(n: int, ratios: list[int]) -> list[int]:
    """Sizes of the levels above the points, finest first; ends at the first that comes to one centroid."""
    out = []
    for r in ratios:
        n = max(1, n // r)
        out.append(n)
        if n == 1:
            break
    return out


@dataclass
class MeshIndex:
    """points (id, coords, node_id of the finest level); nodes (level, node_id, parent_id, centroid, radius, n): level 0 is
    the coarsest. radius covers all points below a node, so that pruning loses nothing; n counts them."""

    points: DataFrame
    nodes: DataFrame
    levels: int

    @staticmethod
    def build(points: DataFrame, id_col: str, coords: str, ratios: list[int], seed: int = 42) -> MeshIndex:
        """Rows whose coordinates are null or not finite are left out. No ratios or an empty table raise ValueError. The index is kept in
        memory or on disk, so that queries don't train again; release ends that."""
        base = points.select(F.col(id_col).alias("id"), as_double(coords).alias("coords")).filter(is_finite(F.col("coords")))
        n = base.count()
        if not n or not ratios:
            raise ValueError("an index needs points and ratios")
        sizes = plan_levels(n, ratios)
        labelled, names, tables, here = base, [], [], base
        for depth, k in enumerate(sizes):
            col = f"_l{depth}"
            got = cluster.fit(here, "coords", k, seed=seed) if k > 1 else here.withColumn("label", F.lit(0))
            means = cluster.means(got, "coords")
            if depth == 0:
                labelled = got.select("id", "coords", F.col("label").alias(col))
            else:
                labelled = labelled.join(got.select(F.col("id").alias(names[-1]), F.col("label").alias(col)), names[-1])
            tables.append(means.select(F.col("label").alias(col), "centroid"))
            names.append(col)
            here = means.select(F.col("label").alias("id"), F.col("centroid").alias("coords"))
        out = None
        for depth, (col, t) in enumerate(zip(names, tables, strict=True)):
            up = names[depth + 1] if depth + 1 < len(names) else None
            j = labelled.join(t, col).groupBy(F.col(col).alias("node_id"), "centroid")
            s = j.agg(F.max(l2(F.col("coords"), F.col("centroid"))).alias("radius"), F.count("*").alias("n"), (F.first(up) if up else F.lit(None).cast("int")).alias("parent_id"))
            s = s.select(F.lit(len(names) - 1 - depth).alias("level"), "node_id", "parent_id", "centroid", "radius", "n")
            out = s if out is None else out.unionByName(s)
        return MeshIndex(labelled.select("id", "coords", F.col(names[0]).alias("node_id")).persist(), out.persist(), len(names))

    @staticmethod
    def from_levels(levels: list[DataFrame]) -> MeshIndex:
        """levels (id, parent_id, coords), coarsest first, the points last: an index whose nodes and links are known, as they stand."""
        *tops, points = levels
        if not tops:
            raise ValueError("an index needs a level above its points")
        base = points.select("id", as_double("coords").alias("coords"), F.col("parent_id").alias(f"_l{len(tops) - 1}"))
        for depth in range(len(tops) - 1, 0, -1):
            base = base.join(tops[depth].select(F.col("id").alias(f"_l{depth}"), F.col("parent_id").alias(f"_l{depth - 1}")), f"_l{depth}")
        out = []
        for depth, t in enumerate(tops):
            own = t.select(F.col("id").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), as_double("coords").alias("centroid"))
            below = base.select(F.col(f"_l{depth}").alias("node_id"), "coords").join(own, "node_id")
            r = below.groupBy("node_id").agg(F.max(l2(F.col("coords"), F.col("centroid"))).alias("radius"), F.count("*").alias("n"))
            s = own.join(r, "node_id").select(F.lit(depth).alias("level"), "node_id", "parent_id", "centroid", "radius", "n")
            out.append(s)
        nodes = reduce(DataFrame.unionByName, out)
        return MeshIndex(base.select("id", "coords", F.col(f"_l{len(tops) - 1}").alias("node_id")).persist(), nodes.persist(), len(tops))

    def release(self) -> None:
        self.points.unpersist()
        self.nodes.unpersist()

    @property
    def dim(self) -> int:
        return len(self.nodes.select("centroid").first()[0])

    def save(self, path: str) -> None:
        """Points are sorted by their leaf, so that a query reads few row groups."""
        self.points.repartitionByRange("node_id").sortWithinPartitions("node_id", "id").write.mode("overwrite").parquet(f"{path}/points")
        self.nodes.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MeshIndex:
        nodes = spark.read.parquet(f"{path}/nodes")
        return MeshIndex(spark.read.parquet(f"{path}/points"), nodes, nodes.agg(F.max("level")).first()[0] + 1)

    def _alive(self, keep) -> list[DataFrame]:
        """The nodes that are kept of each level, coarsest first."""
        alive = [keep(self.nodes.filter("level = 0"))]
        for level in range(1, self.levels):
            below = self.nodes.filter(F.col("level") == level)
            alive.append(keep(below.join(alive[-1].select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")))
        return alive

    def _walk(self, keep) -> DataFrame:
        return self.points.join(self._alive(keep)[-1].select("node_id"), "node_id", "left_semi")

    def _box(self, lo, hi):
        return lambda t: t.filter(box_may_hit(box_distance_squared(F.col("centroid"), vector(lo), vector(hi)), F.col("radius")))

    def _near(self, q, k: int):
        def keep(t):
            d = t.withColumn("lb", knn_bounds(l2(F.col("centroid"), vector(q)), F.col("radius"))[0])
            return d.filter(F.col("lb") <= step_limit(d, k))

        return keep

    def range_candidates(self, lo, hi) -> DataFrame:
        return self._walk(self._box(lo, hi))

    def pruned_sizes(self, q=None, k: int = 10, lo=None, hi=None) -> DataFrame:
        """level, n_nodes: how many nodes of each level a query keeps; the level after the last is that of the candidate points."""
        keep = self._near(q, k) if q is not None else self._box(lo, hi)
        parts = [t.agg(F.lit(i).alias("level"), F.count("*").alias("n_nodes")) for i, t in enumerate(self._alive(keep))]
        points = self._walk(keep).agg(F.lit(self.levels).alias("level"), F.count("*").alias("n_nodes"))
        return reduce(DataFrame.unionByName, [*parts, points])

    def range(self, lo, hi) -> DataFrame:
        if any(a > b for a, b in zip(lo, hi, strict=True)):
            raise ValueError("a lower bound exceeds its upper bound")
        return self.range_candidates(lo, hi).filter(in_box(F.col("coords"), vector(lo), vector(hi)))

    def knn_candidates(self, q, k: int) -> DataFrame:
        return self._walk(self._near(q, k))

    def knn(self, q, k: int) -> DataFrame:
        if k < 1:
            raise ValueError("k must be 1 or more")
        return self.knn_candidates(q, k).select("id", l2_squared(F.col("coords"), vector(q)).alias("d2")).orderBy("d2", "id").limit(k)

    def knn_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (qid, q): survivors of each level are joined by node, never all points with all queries."""
        alive = None
        for level in range(self.levels):
            t = self.nodes.filter(F.col("level") == level)
            t = against(t, queries) if alive is None else t.join(alive.select(F.col("node_id").alias("parent_id"), "qid", "q"), "parent_id")
            # Written, for it is read several times, and the next level is made from it.
            path = scratch(t.sparkSession, "survivors")
            t.withColumn("lb", knn_bounds(l2(F.col("centroid"), F.col("q")), F.col("radius"))[0]).write.parquet(path)
            alive = step_select(t.sparkSession.read.parquet(path), k, by=("qid",))
        d = self.points.join(alive.select("node_id", "qid", "q"), "node_id").select("qid", "id", l2_squared(F.col("coords"), F.col("q")).alias("d2"))
        w = Window.partitionBy("qid").orderBy("d2", "id")
        return d.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)

    def level_sizes(self) -> DataFrame:
        return self.nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_points"))

    def byte_sizes(self) -> DataFrame:
        each = F.size("centroid") * 8 + 8 + 8 + 8
        return self.nodes.groupBy("level").agg(F.sum(each).cast("long").alias("bytes"))

    def sorted_points(self) -> DataFrame:
        """Points with their order within the finest nodes: by node, then id."""
        return self.points.select("node_id", "id").repartitionByRange("node_id", "id").sortWithinPartitions("node_id", "id")
