"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each 5-word shingle (fewer words: the whole sequence) is hashed once; the hash's top bits choose one of 256 bins, which
keeps its least hash. An empty bin takes the value of the first filled bin in an order of bins that its number fixes, hashed
with its number: else texts of a few shingles would repeat few values, and unlike ones agree in many bins at once. The four
low bits of every bin are kept: 16 longs. Two unequal bins agree by chance once in 16, which the estimate takes off.

Only DataFrame functions are used. Null text counts as empty. A text without words has an empty fingerprint, which is like
another empty one (1.0) and unlike all others (0.0). Equal texts have equal fingerprints. Rows with equal or null ids are
kept, ordered by id (nulls first) and then by the text's hash; a lone row is its own next one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshq.llm.common import bounds_of, part_of, words

SHINGLE, BIN_BITS, LOW_BITS, PROBES = 5, 8, 4, 32
BINS = 1 << BIN_BITS
PER_LONG = 64 // LOW_BITS
ONES = sum(1 << (LOW_BITS * i) for i in range(PER_LONG))


def shingle_hashes(w: Column, n: int = SHINGLE) -> Column:
    k = F.size(w)
    each = F.transform(F.sequence(F.lit(0), k - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.when(k >= n, each).when(k > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: 16 longs, or an empty array if the text has no words."""
    # Columns of their own, each used twice or more by the next: Catalyst then doesn't put one into another's lambda.
    names = [f"_{out}_{i}" for i in range(5)]
    w, h, m, d, v = (F.col(x) for x in names)
    df = df.withColumn(names[0], words(F.lower(F.col(text))))
    df = df.withColumn(names[1], F.sort_array(shingle_hashes(w)))
    df = df.withColumn(names[2], F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))))
    gap = lambda k: F.array_repeat(F.lit(None).cast("bigint"), k.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(_bin(F.get(m, i - 1)))
    spread = F.flatten(F.transform(m, lambda x, i: F.concat(gap(_bin(x) - before(i) - 1), F.array(x))))
    spread = F.concat(spread, gap(BINS - 1 - _bin(F.element_at(m, -1))))
    df = df.withColumn(names[3], F.when(F.size(m).isin(0, BINS), m).otherwise(spread))

    def filled(x: Column, b: Column) -> Column:
        probe = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), F.lit(None).cast("bigint"), lambda a, t: F.coalesce(a, F.get(d, F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int"))))
        order = F.array_min(F.transform(m, lambda y: F.struct(F.xxhash64(b, _bin(y)).alias("o"), y.alias("y"))))["y"]
        return F.coalesce(x, F.xxhash64(F.coalesce(probe, order), b))

    df = df.withColumn(names[4], F.when(F.size(m).isin(0, BINS), d).otherwise(F.transform(d, filled)))
    low = F.lit((1 << LOW_BITS) - 1).cast("bigint")
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)),
        lambda p: F.aggregate(F.slice(v, p * PER_LONG + 1, F.lit(PER_LONG)), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x.bitwiseAND(low))),
    )
    return df.withColumn(out, F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(packed)).drop(*names)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(ONES).cast("bigint")))

    unlike = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, v: s + v)
    chance = 2.0**-LOW_BITS
    s = (1 - unlike / float(BINS) - chance) / (1 - chance)
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def with_next(df: DataFrame, key: str, carried: dict[str, Column], tie: Column) -> DataFrame:
    """Adds each name of carried: its value in the row that follows by key; after the last, the first.

    Rows are dealt by bounds of the key, of which there are as many as the rows ask for; a part's first row also goes to the
    part before it, so that one shuffle and no single-task window are needed.
    """
    _, bounds = bounds_of(df, key)
    low = df.agg(F.min(key).alias("low"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    first = F.col(key).isNull() if low["nulls"] else F.col(key) == F.lit(low["low"])
    last = len(bounds)
    part = part_of(F.col(key), bounds)
    before = F.when((F.col("_part") > 0) & (F.get(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(None)), F.col("_part") - 1) == F.col(key)), F.array(F.struct((F.col("_part") - 1).alias("part"), F.lit(1).alias("tail"))))
    around = F.when(first, F.array(F.struct(F.lit(last).alias("part"), F.lit(2).alias("tail"))))
    none = F.array().cast("array<struct<part:int,tail:int>>")
    own = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("tail")))
    dealt = df.withColumn("_part", part.cast("int")).withColumn("_to", F.explode(F.concat(own, F.coalesce(before, none), F.coalesce(around, none))))
    w = Window.partitionBy("_to.part").orderBy(F.col("_to.tail"), F.col(key).asc_nulls_first(), tie)
    out = dealt.withColumn("_next", F.lead(F.struct(*[c.alias(n) for n, c in carried.items()])).over(w)).filter(F.col("_to.tail") == 0)
    return out.withColumns({n: F.col(f"_next.{n}") for n in carried}).drop("_part", "_to", "_next")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, fp, next_fp, edited: the text whose last quarter is the next document's beginning."""
    t = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = with_fingerprint(t, "text", "fp")
    t = with_next(t, "doc_id", {"next_text": F.col("text"), "next_fp": F.col("fp")}, F.xxhash64("text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return t.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))


def fingerprint_report(documents: DataFrame) -> DataFrame:
    t = with_fingerprint(edited_pairs(documents), "edited", "edited_fp")
    return t.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
