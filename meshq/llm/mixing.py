"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key, -ln(u) / weight: u is fixed by its id and the seed, weight is its quality. A
source first takes its documents in whole epochs, then in ascending order of the key until its target is reached; the
document at the border gives only the words that are still missing, so that a source meets its target to one word.

Only DataFrame functions are used. Prefix sums are split by the key's binary logarithm in steps of 1/256, whose spread doesn't
depend on the scale of the weights: no part of a source holds more than about a five-hundredth of it. Null sources are a
source of their own, the last; null text has size 0; null or non-positive weights count as the least weight. Equal ids are
ordered by size and text hash; repeated rows are interchangeable. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshq.llm.common import all_columns, fresh, materialize, unit, words

LEAST_WEIGHT, STEPS = 1e-3, 256


def quality_weight(w: Column) -> Column:
    """From 0.05 to 1, by the share of distinct words: repeated lines and junk weigh less."""
    return F.greatest(F.lit(0.05), F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, source_size): adds target. One row per source; a target is the lesser of cap * source_size and
    weight * level, where the level makes the targets sum to all sizes."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("_rank", F.row_number().over(by) - 1)
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    # Sources by what level fills them: those before the first that isn't full are full.
    t = t.withColumns({"_cap": F.col("source_size") * float(cap), "_all": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    w = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_rank"))
    done = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("_level", (F.col("_all") - done) / left)
    level = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("level")))).over(Window.partitionBy())["level"]
    return t.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).drop("_rank", "_w", "_cap", "_all", "_level")


def mix(documents: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """documents (doc_id, text, source): doc_id, hash of the text, size, source_size, target, taken."""
    w = F.col("_words")
    d = documents.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_words"))
    d = d.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("source"), "text_hash", F.size(w).cast("long").alias("size"), quality_weight(w).alias("weight"))
    return take(materialize(d, "mix"), seed, weights, cap)


def take(d: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """d (doc_id, source not null, text_hash, size, weight)."""
    weight = F.when(F.col("weight") > LEAST_WEIGHT, F.col("weight")).otherwise(LEAST_WEIGHT)
    # Rows without an id are told apart by their texts.
    d = d.withColumn("_key", -F.ln(F.when(F.col("doc_id").isNull(), unit(F.col("text_hash"), F.lit(seed))).otherwise(unit(F.col("doc_id"), F.lit(seed)))) / weight)
    d = d.withColumn("_part", F.floor(F.log2("_key") * STEPS))
    parts = d.groupBy("source", "_part").agg(F.sum("size").alias("_size"))
    per = targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, cap)
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_size").join(per, "source")
    w = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    t = d.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0))).join(base, ["source", "_part"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_base") - F.col("_in")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return t.select("doc_id", "text_hash", "size", F.col("source_size"), "target", (F.col("size") * epochs + extra).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents, in the columns of the input: each text as often as it was taken whole, then the border's part.

    A part keeps the first words and what stands between them. The text joins its share by id and hash, so that equal rows
    get equal shares.
    """
    cols = all_columns(documents)
    share = mix(documents, seed).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_hash", "size").orderBy(F.desc("taken"))))
    names = fresh(documents, "text_hash", "size", "n", "share_id", "share_hash", "share_size", "share_n", "taken")
    mark, size, n, *of_share = names
    d = documents.withColumn(mark, F.xxhash64("text")).withColumn(size, F.size(words(F.col("text"))).cast("long"))
    d = d.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", mark, size).orderBy(F.lit(0))))
    s = share.filter("taken > 0").select(*[F.col(a).alias(b) for a, b in zip(("doc_id", "text_hash", "size", "n", "taken"), of_share, strict=True)])
    one, its_mark, its_size, its_n, taken = map(F.col, of_share)
    j = d.join(s, F.col("doc_id").eqNullSafe(one) & (F.col(mark) == its_mark) & (F.col(n) == its_n))
    whole, rest = F.floor(taken / its_size).cast("int"), (taken % its_size).cast("int")
    starts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    blank = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.rtrim(F.array_join(F.slice(starts, F.lit(1), rest + blank), ""), F.lit(" \t\n\x0b\f\r"))
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = j.withColumn("text", F.explode(texts))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*cols)
