"""k-means steps and the statistics of clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshq.functions.vectors import l2, l2_squared, ratio, vector
from meshq.operators.parts import against


#: Numbers that centroids may have to be held as literals; more are a table that is met in blocks.
MOST_LITERALS = 65_536


def assign(points: DataFrame, coords: str, centroids: list[list[float]], most: int = MOST_LITERALS) -> DataFrame:
    """Adds the nearest centroid's number (label) and d2; the first minimum wins."""
    if sum(map(len, centroids)) <= most:
        each = [F.struct(l2_squared(F.col(coords), vector(c)).alias("d2"), F.lit(i).alias("label")) for i, c in enumerate(centroids)]
        best = F.least(*each) if len(each) > 1 else each[0]
        return points.withColumn("_b", best).withColumns({"label": F.col("_b.label"), "d2": F.col("_b.d2")}).drop("_b")
    table = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "_label int, _c array<double>")
    groups = against(points.withColumn("_row", F.struct(*points.columns)).select("_row", F.col(coords).alias("_v")), table)
    best = groups.groupBy("_row").agg(F.min(F.struct(l2_squared(F.col("_v"), F.col("_c")).alias("d2"), F.col("_label").alias("label"))).alias("_b"))
    return best.select("_row.*", F.col("_b.label").alias("label"), F.col("_b.d2").alias("d2"))


def plus_plus(points: DataFrame, id_col: str, coords: str, k: int, seed: int = 42) -> list[list[float]]:
    """k-means++ starts: the first by hash, each next one drawn with a chance that grows with its squared distance from those before. A
    draw is the least exponential key over that weight, so that one aggregate finds it wherever its row lies."""
    draw = lambda i: F.xxhash64(id_col, F.lit(seed), F.lit(i))
    got = [list(points.agg(F.min_by(coords, draw(0))).first()[0])]
    while len(got) < k:
        u = (F.shiftrightunsigned(draw(len(got)), 11).cast("double") + 0.5) / float(1 << 53)
        d = assign(points, coords, got).filter("d2 > 0").agg(F.min_by(coords, -F.ln(u) / F.col("d2"))).first()[0]
        if d is None:
            break  # fewer distinct points than k
        got.append(list(d))
    return got


def means(assigned: DataFrame, coords: str, label: str = "label") -> DataFrame:
    """The mean per cluster and dimension, as one array in the order of dimensions."""
    e = assigned.select(label, F.posexplode(coords).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("m"))
    return e.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def lloyd(points: DataFrame, coords: str, centroids: list[list[float]], iterations: int = 7) -> list[list[float]]:
    """Lloyd steps from given centroids; an empty cluster keeps its centroid. Only the k centroids reach the driver."""
    now = [list(map(float, c)) for c in centroids]
    for _ in range(iterations):
        new = list(now)
        for r in means(assign(points, coords, now), coords).collect():
            new[r["label"]] = list(r["centroid"])
        if new == now:
            break
        now = new
    return now


def fit(points: DataFrame, coords: str, k: int, iterations: int = 7, seed: int = 42) -> DataFrame:
    """Distributed k-means for the index: adds label. The fitted centroids are recomputed as means of the members."""
    v = points.withColumn("_features", array_to_vector(F.col(coords)))
    model = KMeans(k=k, maxIter=iterations, tol=1e-4, seed=seed, featuresCol="_features", predictionCol="label").fit(v)
    return model.transform(v).drop("_features")


def edges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (child_id, parent_id, coords) with parents (parent_id, centroid): the ratio per dimension."""
    j = children.join(parents, "parent_id")
    return j.select("parent_id", "child_id", ratio(F.col("coords"), F.col("centroid")).alias("ratio"))


def radii(members: DataFrame, parents: DataFrame, label: str = "label") -> DataFrame:
    """Largest distance from the centroid to a member, and the members' number."""
    return members.join(parents, label).groupBy(label).agg(F.max(l2(F.col("coords"), F.col("centroid"))).alias("radius"), F.count("*").alias("n"))


def children(nodes: DataFrame) -> DataFrame:
    """parent_id, n, and most, the greatest n of any parent."""
    c = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("most"))))


def sample(df: DataFrame, id_col: str, p: float, salt: str = "0") -> DataFrame:
    """Each row with the chance p, fixed by its id and the salt."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{salt}"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.filter(u < p)
