"""A folder that all machines of the cluster see, for what queries write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a session of one machine, as in tests, gets a folder of its own, which goes
    when Python ends; a cluster raises an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="meshq-core-"))
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@atexit.register
def _clean() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
