"""Finding saved indexes, and the log of query batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshq.functions.text import safe_name
from meshq.plans.index import MeshIndex


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class Catalog:
    """Indexes below a root folder, each in a folder of its name; loaded ones are kept."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.loaded = spark, root.rstrip("/"), {}

    def names(self, marks: tuple[str, ...] = ("points/_SUCCESS", "nodes/_SUCCESS")) -> list[str]:
        """Complete indexes, sorted: those whose folder has all marks."""
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in found if all(exists(self.spark, f"{self.root}/{n}/{m}") for m in marks))

    def save(self, name: str, index: MeshIndex) -> None:
        index.save(f"{self.root}/{safe_name(name)}")
        self.loaded.pop(name, None)

    def get(self, name: str) -> MeshIndex:
        if name not in self.loaded:
            self.loaded[name] = MeshIndex.load(self.spark, f"{self.root}/{safe_name(name)}")
        return self.loaded[name]


def append_statistics(rows: DataFrame, path: str) -> None:
    """rows of the batch log (stats.log_rows) to a folder of CSV files; every file begins with the header, so that one read gives all."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)
