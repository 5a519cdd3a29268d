"""Figures on a batch of timed queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshq.functions.vectors import volume_label

# The columns of the batch log.
LOG = ["Dataset", "Size", "Dim", "Query Type", "Query Parameter", "Query Count", "Total Time (ms)", "Avg Time (ms)", "Memory Policy", "Median Log Volume", "Avg Range Volume", "Avg Fine Mesh"]


def trimmed(value: str) -> tuple[Column, Column]:
    """The total and the number of values, without one largest and one smallest if there are more than two."""
    v, n = F.col(value), F.count(value)
    return F.when(n > 2, F.sum(v) - F.max(v) - F.min(v)).otherwise(F.sum(v)), F.when(n > 2, n - 2).otherwise(n)


def trimmed_mean(df: DataFrame, value: str) -> DataFrame:
    total, n = trimmed(value)
    return df.agg((total / n).alias("trimmed_mean"))


def batch_statistics(df: DataFrame) -> DataFrame:
    """df (time_us, log_volume, candidates): query_count and total_us of the trimmed batch, their mean, the median log-volume and the
    mean number of candidates of all queries."""
    total, n = trimmed("time_us")
    return df.agg(n.alias("query_count"), total.alias("total_us"), (total / n).alias("avg_us"), F.median("log_volume").alias("median_log_volume"), F.avg("candidates").alias("avg_candidates"))


def log_rows(stats: DataFrame, dataset: str, size: int, dim: int, kind: str, parameter: str, policy: str) -> DataFrame:
    """What batch_statistics gives as a row of the batch log."""
    number = lambda c, form: F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.format_string(form, c)), F.when(c == float("-inf"), "-inf"), F.lit("N/A"))
    ms = F.col("total_us") / 1000.0
    values = [
        F.lit(dataset), F.lit(size), F.lit(dim), F.lit(kind), F.lit(parameter), F.col("query_count"), F.format_string("%.3f", ms), F.format_string("%.6f", ms / F.col("query_count")), F.lit(policy),
        number(F.col("median_log_volume"), "%.3f"), F.coalesce(volume_label(F.col("median_log_volume")), F.lit("N/A")), number(F.col("avg_candidates"), "%.1f"),
    ]
    return stats.select(*[v.cast("string").alias(name) for v, name in zip(values, LOG, strict=True)])
