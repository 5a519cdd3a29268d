"""Point matrices and query batches as text: a header with the counts, then a row of numbers a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshq.functions.text import dataset_name


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0, in the order of files and lines) and value. Splits are counted, and a line's number is its place in its split
    after those before; no line is moved."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = d.groupBy("file", "start").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("base", F.coalesce(before, F.lit(0))).drop("n")
    return d.join(F.broadcast(splits), ["file", "start"]).select((F.col("base") + F.col("at") - F.col("low")).alias("number"), "value")


def _numbers(col: Column) -> Column:
    return F.transform(F.split(F.trim(col), r"\s+"), lambda x: x.cast("double"))


def read_matrix(spark: SparkSession, path: str, per_dim: int = 1) -> DataFrame:
    """id (0-based line order), v: the first per_dim * D numbers of each of the N rows that the header announces. A row with too
    few numbers, or a file with too few rows, raises an error; surplus columns and rows are left out."""
    lines = _lines(spark, path)
    head = [int(x) for x in (lines.filter("number = 0").first() or [0, "0 0"])[1].split()]
    if len(head) < 2 or min(head[:2]) < 1:
        raise ValueError(f"{path}: the header must give two positive counts")
    n, width = head[0], head[1] * per_dim
    body = lines.filter((F.col("number") > 0) & (F.col("number") <= n))
    found = body.count()
    if found < n:
        raise ValueError(f"{path}: {found} of {n} rows")
    v = _numbers(F.col("value"))
    short = F.raise_error(F.concat(F.lit("too few numbers in row "), F.col("number").cast("string"))).cast("array<double>")
    return body.select((F.col("number") - 1).alias("id"), F.when(F.size(v) >= width, F.slice(v, 1, width)).otherwise(short).alias("v"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path).withColumnRenamed("v", "coords")


def read_knn_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def read_range_queries(spark: SparkSession, path: str) -> DataFrame:
    """Each row holds the lower bounds, then the upper ones."""
    m = read_matrix(spark, path, 2)
    half = F.floor(F.size("v") / 2).cast("int")
    return m.select(F.col("id").alias("qid"), F.slice("v", F.lit(1), half).alias("lo"), F.slice("v", half + 1, half).alias("hi"), dataset_name(F.lit(path)).alias("label"))


def write_matrix(df: DataFrame, path: str, order: str = "id", coords: str = "coords", per_dim: int = 1) -> None:
    """Text files that follow one another by name, the first with the header; doubles are written so that reading gives them back."""
    first = df.agg(F.count("*").alias("n"), F.max(F.size(coords)).alias("w")).first()
    head = df.sparkSession.createDataFrame([(-1, f"{first['n']} {(first['w'] or 0) // per_dim}")], "o long, value string")
    body = df.select(F.col(order).cast("long").alias("o"), F.array_join(F.transform(coords, lambda x: x.cast("string")), " ").alias("value"))
    head.unionByName(body).repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_range_queries(queries: DataFrame, path: str) -> None:
    """queries (qid, lo, hi), in the form that read_range_queries takes."""
    write_matrix(queries.select("qid", F.concat("lo", "hi").alias("v")), path, "qid", "v", 2)


def synthetic(spark: SparkSession, n: int, dims: int, low: float, high: float, ratios: list[int], whole: bool = False, seed: int = 12345, sigma_divisor: float = 3.0) -> list[DataFrame]:
    """A made hierarchy, coarsest level first: uniform tops, then points dealt round to parents and spread normally about them,
    kept within the bounds. Each level: id, parent_id, coords."""
    if not 0 < low < high or n < 1 or dims < 1:
        raise ValueError("0 < low < high, and a point of a dimension at least")
    sizes = [n]
    for r in ratios:
        sizes.append(max(1, sizes[-1] // r))
    out: list[DataFrame] = []
    shape = (lambda c: F.round(c)) if whole else (lambda c: c)
    for level, size in enumerate(reversed(sizes)):
        ids = spark.range(size)
        if not out:
            coords = [shape(F.rand(seed + i) * (high - low) + low) for i in range(dims)]
            out.append(ids.select("id", F.lit(None).cast("long").alias("parent_id"), F.array(*coords).alias("coords")))
            continue
        parents = sizes[len(sizes) - level]
        spread = (high - low) / parents ** (1 / dims) / sigma_divisor
        noise = F.array(*[F.randn(seed + 1000 * level + i) * spread for i in range(dims)])
        up = out[-1].select(F.col("id").alias("parent_id"), F.col("coords").alias("up"))
        j = ids.select("id", (F.col("id") % parents).alias("parent_id"), noise.alias("noise")).join(up, "parent_id")
        moved = F.zip_with("up", "noise", lambda a, b: shape(F.least(F.greatest(a + b, F.lit(float(low))), F.lit(float(high)))))
        out.append(j.select("id", "parent_id", moved.alias("coords")))
    return out
