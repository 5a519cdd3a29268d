import gc
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshq.llm import common


class Fake:
    """A session of a cluster without a shared folder."""

    def __init__(self, master):
        conf = type("C", (), {"get": lambda self, key, default: default})()
        self.sparkContext = type("S", (), {"master": master, "getConf": lambda self: conf})()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        common.shared_folder(Fake("spark://host:7077"))
    assert common.shared_folder(Fake("local[2]")).startswith("file:")


def test_tables_go_when_dropped(spark):
    df = common.materialize(spark.range(5), "t")
    path = df._written_to
    assert df.count() == 5
    common.drop(df, None, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "hash int, _HASH int, `a.b` int")
    assert common.fresh(df, "hash", "x", "x") == ["__hash", "x", "_x"]
    assert df.select(*common.all_columns(df)).columns == df.columns and df.withColumn("z", F.lit(1)).select(*common.all_columns(df)).first() == (1, 2, 3)


def test_freed_native_memory_goes_back(spark):
    jvm = spark.sparkContext._jvm
    if not common.trim(spark):
        pytest.skip("this JVM can't")
    held = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # each holds native memory
    for d in held[:-1]:
        d.end()
    gc.collect()
    jvm.System.gc()
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) / 1024
    before = resident()
    common.release(spark)
    assert resident() < before - 50
    held[-1].end()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_let_go_before_and_after_their_steps(spark, monkeypatch, name, stage):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: seen.append("release"))
    for module, step in (("toxicity", "clean"), ("simhash", "without_copies"), ("secrets", "redact"), ("mixing", "mixed_documents"), ("packing", "pack")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), step, lambda d, *a: seen.append("step") or d)
    docs = spark.range(1)
    assert stage(spark, docs, "/root/testdata/sf0.001") is docs
    assert seen == ["release", "step", "release"]
