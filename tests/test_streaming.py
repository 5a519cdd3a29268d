from pyspark.sql import functions as F

from meshq.operators import search
from meshq.streaming import each_batch


def test_each_batch(spark, tmp_path):
    """New points are searched as they come, by the functions that batches use."""
    source, out = str(tmp_path / "in"), []
    spark.range(10).select(F.col("id"), F.array(F.col("id") / 10.0, F.lit(0.0)).alias("v")).write.parquet(source)
    stream = spark.readStream.schema("id long, v array<double>").parquet(source)
    q = each_batch(stream, lambda df: search.knn(df, "v", "id", [0.25, 0.0], 2), lambda df, n: out.append((n, [r.id for r in df.collect()])), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    spark.range(20, 22).select(F.col("id"), F.array(F.lit(0.2), F.lit(0.1)).alias("v")).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert [x for _, x in out] == [[2, 3], [20, 21]] and [n for n, _ in out] == [0, 1]
