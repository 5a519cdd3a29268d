"""A corpus prepared for training: toxic documents go, one of each group of near copies stays, secrets are blanked, sources are
mixed to their targets, and the mix is packed.

Every stage takes (spark, docs, sf_dir) and gets all rows that the stage before it kept; all but the last return the columns of
documents, in their order, others than doc_id, text, source and n_chars as they came, whatever their names. The toxicity stage
learns from the table labels of the folder. SQL can't express the stages: tests hold each against a brute-force version.

Null texts count as empty, are never toxic unless all is, hold no secret, and add nothing to the mix, whose rows are those with words
to give. Texts are read whole, however long. Rows with a null id are scored like others and kept by the near-duplicate stage, for no
class has them; null sources are a source of their own. Of repeated rows, and of rows with one id and text, one stays; rows that share
an id but not the text are told apart. Ties are broken by id and text, so that a run again gives the same rows. An empty table, or one
of which a stage leaves nothing, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from meshq.llm import mixing, packing, secrets, simhash, toxicity
from meshq.llm.common import materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def released(stage: Stage) -> Stage:
    """The stage, before which the driver lets go of what earlier ones hold, and after its steps, before its result is made, of theirs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        out = stage(spark, docs, sf_dir)
        release(spark)
        return out

    return run


@released
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@released
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_copies(docs)


@released
def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@released
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@released
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, 4096)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_copies), ("secrets", blank_secrets), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
