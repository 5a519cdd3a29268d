"""Time-stamped records grouped by sequence and type, and their queries by microsecond.

records: seq int, dtype string, ts_us long, size long (and any others). Rows with a null time take no part. Sequences and types are few
and may each hold any share of all rows: positions are counted over ranges of time, never over a whole sequence at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshq.operators.parts import ROWS_EACH, with_position
from meshq.operators.prune import step_limit

KEY = ("seq", "dtype")


def chunk(records: DataFrame, n: int, tie: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """Adds chunk and slot: every n records of a sequence and type, by time."""
    d = with_position(records.filter(F.col("ts_us").isNotNull()), list(KEY), "ts_us", [tie], "_p", rows_each)
    return d.withColumns({"chunk": F.floor(F.col("_p") / n).cast("long"), "slot": (F.col("_p") % n).cast("int")}).drop("_p")


def groups(chunked: DataFrame, *more) -> DataFrame:
    """One row per chunk: the records' number, first and last time, mean time in whole microseconds, bytes (an overflow raises)."""
    return chunked.groupBy(*KEY, "chunk").agg(
        F.count("*").alias("valid_count"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.floor(F.sum(F.col("ts_us").cast("decimal(38,0)")) / F.count("*")).cast("long").alias("avg_us"),
        F.sum("size").alias("bytes"),
        *more,
    )


def item_numbers(grouped: DataFrame, mean: str = "avg_us", ties: tuple[str, ...] = ("dtype", "chunk"), rows_each: int = ROWS_EACH) -> DataFrame:
    """item_no: position by sequence, mean time and ties. Sequences are at most 256, so that their running count is one small window."""
    d = with_position(grouped, ["seq"], mean, list(ties), "_own", rows_each)
    per = grouped.groupBy("seq").agg(F.count("*").alias("_n"))
    base = per.select("seq", F.coalesce(F.sum("_n").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return d.join(F.broadcast(base), "seq").withColumn("item_no", F.col("_base") + F.col("_own")).drop("_base", "_own")


def slot_offsets(chunked: DataFrame, tie: str) -> DataFrame:
    """Each record's first byte in its group's payload. A window holds one group."""
    w = Window.partitionBy(*KEY, "chunk").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return chunked.withColumn("off", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def padded_slots(chunked: DataFrame, n: int) -> DataFrame:
    """All n slots of each group; those past its records repeat the last time with size 0."""
    g = chunked.groupBy(*KEY, "chunk").agg(F.max("ts_us").alias("last_us"), F.collect_list(F.struct("slot", "ts_us", "size")).alias("own"))
    slot = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot")
    each = g.select(*KEY, "chunk", "last_us", "own", slot).withColumn("own", F.get(F.filter("own", lambda r: r["slot"] == F.col("slot")), F.lit(0)))
    return each.select(*KEY, "chunk", "slot", F.coalesce("own.ts_us", "last_us").alias("ts_us"), F.coalesce("own.size", F.lit(0)).cast("long").alias("size"))


def nearest(records: DataFrame, seq: int, target_us: int, k: int, *ties: str, include_padding: bool = False) -> DataFrame:
    """The k records of a sequence nearest in time, ranked from 0; ties go to the earlier time, and then by ties."""
    d = records.filter((F.col("seq") == seq) & (F.lit(include_padding) | (F.col("size") > 0)))
    top = d.withColumn("diff_us", F.abs(F.col("ts_us") - target_us)).orderBy("diff_us", "ts_us", *ties).limit(k)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy("diff_us", "ts_us", *ties)) - 1)


def interval(records: DataFrame, seqs: list[int], lo_us: int, hi_us: int, *ties: str, limit: int = 0, include_padding: bool = False) -> DataFrame:
    """Records of the sequences with lo <= time <= hi, by time; limit 0 takes all."""
    if lo_us > hi_us or not seqs:
        raise ValueError("an interval needs lo <= hi and a sequence")
    d = records.filter(F.col("seq").isin(seqs) & F.col("ts_us").between(lo_us, hi_us) & (F.lit(include_padding) | (F.col("size") > 0)))
    return d.orderBy("ts_us", *ties).limit(limit) if limit else d


def interval_candidates(grouped: DataFrame, seqs: list[int], lo_us: int, hi_us: int) -> DataFrame:
    """Groups that may hold a record of the interval."""
    return grouped.filter(F.col("seq").isin(seqs) & (F.col("first_us") <= hi_us) & (F.col("last_us") >= lo_us))


def nearest_candidates(grouped: DataFrame, seq: int, target_us: int, k: int, n: str = "valid_count") -> DataFrame:
    """Groups (item_no, first_us, last_us, n) that may hold one of the k nearest: a group's times are a box of one dimension, pruned
    like any cluster by its least and greatest distance."""
    near = F.greatest(F.col("first_us") - target_us, target_us - F.col("last_us"), F.lit(0)).cast("double")
    far = F.greatest(F.abs(F.col("first_us") - target_us), F.abs(F.col("last_us") - target_us)).cast("double")
    d = grouped.filter((F.col("seq") == seq) & (F.col(n) > 0)).withColumns({"_near": near, "_radius": (far - near) / 2})
    return d.filter(F.col("_near") <= step_limit(d, k, "_near", "_radius", n, "item_no")).drop("_near", "_radius")


def candidates(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return records.join(wanted.select(key).distinct(), key, "left_semi")


def missing(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted keys without a record; must be empty for a sound index."""
    return wanted.select(key).distinct().join(records.select(key), key, "left_anti")
