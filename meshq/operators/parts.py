"""Ranks and running sums of large groups by parts: no window holds more than a bounded part of a group, however hot its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_EACH, MOST_PARTS = 100_000, 10_000


def cuts_of(df: DataFrame, col: str, rows_each: int = ROWS_EACH) -> list:
    """Distinct values of col that cut the table into parts of about equal size."""
    n = df.count()
    parts = min(MOST_PARTS, math.ceil(n / rows_each))
    if parts <= 1:
        return []
    got = df.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return sorted(set(got or []))


def part_of(value: Column, cuts: list) -> Column:
    """How many cuts are at most value: over every s-th cut first, and then within s."""
    if not cuts:
        return F.lit(0)
    s = max(1, math.isqrt(len(cuts)))
    all_cuts = F.array(*[F.lit(c) for c in cuts])
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::s]]), lambda c: c <= value))
    fine = F.size(F.filter(F.slice(all_cuts, (coarse - 1) * s + 1, F.lit(s)), lambda c: c <= value))
    return F.when(value.isNull() | (value < cuts[0]), 0).otherwise((coarse - 1) * s + fine)


def with_position(df: DataFrame, by: list[str], order: str, ties: list[str], out: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """Adds out: the row's position, from 0, within its group by order and ties. Rows are dealt by ranges of order, whose counts are
    carried on; rows of one group and one value of order stay together."""
    cuts = cuts_of(df, order, rows_each)
    part = f"_part_{out}"
    d = df.withColumn(part, part_of(F.col(order), cuts))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    n = d.groupBy(*by, part).agg(F.count("*").alias("_n"))
    base = n.select(*by, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*by, part).orderBy(order, *ties))
    ranked = d.withColumn("_in", within)
    if not cuts:
        return ranked.withColumn(out, (F.col("_in") - 1).cast("long")).drop("_in", part)
    return ranked.join(base, [*by, part]).withColumn(out, (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_in", "_base", part)


def against(rows: DataFrame, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every query of a stated set. Up to most queries are broadcast; more are dealt to blocks of that many, and
    each block meets the rows by an equi-join."""
    n = queries.count()
    if n <= most:
        return rows.join(F.broadcast(queries))
    blocks = math.ceil(n / most)
    q = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).cast("int"))
    r = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return r.join(q, "_block").drop("_block")
