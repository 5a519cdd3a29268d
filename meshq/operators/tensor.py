"""The links between levels as sparse tensors: coordinate form (col, row, values) and column form (col, rows, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_columns(coo: DataFrame) -> DataFrame:
    """col, start (entries before it), rows and values in the order of rows. A column holds the children of one node."""
    entries = F.sort_array(F.collect_list(F.struct("row", "values")))
    c = coo.groupBy("col").agg(F.count("*").alias("n"), entries.alias("e"))
    c = with_starts(c, "col", "n").select("col", "n", "start", F.transform("e", lambda x: x["row"]).alias("rows"), F.transform("e", lambda x: x["values"]).alias("values"))
    return c


def with_starts(counts: DataFrame, key: str, n: str, parts: int = 256) -> DataFrame:
    """Adds start: the sum of n over the smaller keys. Keys are dealt by their remainder's quotient into ranges, whose sums are carried."""
    span = counts.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((span[1] or 0) - (span[0] or 0) + 1) // parts)) if span[0] is not None else 1
    d = counts.withColumn("_part", F.floor((F.col(key) - (span[0] or 0)) / width).cast("int"))
    sums = d.groupBy("_part").agg(F.sum(n).alias("_s"))
    base = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn("start", (F.col("_base") + F.col("_own")).cast("long")).drop("_part", "_own", "_base")


def from_columns(csc: DataFrame) -> DataFrame:
    z = F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("values").alias("values")))
    return csc.select("col", z.alias("z")).select("col", F.col("z.row").alias("row"), F.col("z.values").alias("values"))


def equal(coo: DataFrame, csc: DataFrame) -> bool:
    """Whether both forms hold the same entries."""
    a, b = coo.select("col", "row", "values"), from_columns(csc).select("col", "row", "values")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def dump_lines(coo: DataFrame) -> DataFrame:
    """line: 'col row v ...' of each entry, for reading by eye."""
    return coo.select("col", "row", F.concat_ws(" ", F.col("col").cast("string"), F.col("row").cast("string"), F.array_join(F.transform("values", lambda v: v.cast("string")), " ", "null")).alias("line"))
