"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, written as its letters with ORDER - 1 marks before and one after; digits are one letter. For each class a
model gives every letter after the ORDER - 1 before it, with the discounts of modified Kneser-Ney for counts 1, 2 and 3 or more. Both
classes back off to the same models of lower orders, whose counts are the distinct letters that precede (continuation counts)
in the words of all documents, labelled or not, down to an even share for each letter. A rare word is so as suspicious as its parts. A
letter that neither class has after its context tells nothing: what is new would else count for the class with fewer words.

An expression's log-likelihoods are compared; of one that is longer than LONG letters the difference is scaled to that length. A
document's figure is its length-normalised likelihood ratio, the logarithm of (1 + sum of the ratios) / (1 + expressions): an even
mixture over its places, so that a few expressions tell in a long text too. A logistic curve that never falls makes it a score.

Folds by crc32 of the id as text, modulo 5: counts of classes come from 1 to 3, the curve from 4, and 0 is held out. The curve's
sample is bounded (CURVE_ROWS, by hash of the id); counts have no bound, and each count has its entry. The table holds what the
labelled words hold; up to MOST_BROADCAST entries it is broadcast, beyond it is joined, with equal results.

Null text counts as empty; a text without words has the figure 0. Texts are read whole, however long; repeated rows and ties have
equal scores. Null labels and null ids aren't learned from; of repeated labels the largest counts. Without labels of both classes
every score is the share of toxic labels (0 without any). An empty table gives no rows. Of documents only the id and the text are
read, of labels the id and the label; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshq.llm.common import all_columns, fresh, materialize, worker_cache

ORDER, LONG, CURVE_ROWS = 6, 12, 50_000
MOST_BROADCAST, MOST_LABELS = 4_000_000, 2_000_000
#: Words that a worker scores at once, and characters of text that it holds at once.
AT_ONCE, SLICE = 50_000, 4_000_000
BEGIN, END = "\x02", "\x03"
MOST = 50.0


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def with_label(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds toxic (null: none)."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    return documents.select("doc_id", "text").join(F.broadcast(one) if n <= MOST_LABELS else one, "doc_id", "left")


def count_words(labelled: DataFrame) -> DataFrame:
    """word, and t and o: the counts of either class. Every word of every document has a row."""
    at = fold(F.col("doc_id")).isin(1, 2, 3)
    cls = F.when(at, F.col("toxic"))
    w = labelled.select((cls == 1).cast("long").alias("t"), (cls == 0).cast("long").alias("o"), F.explode(words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0)).alias("o"))


def letters(word: Column) -> Column:
    """The word as the models have it: digits are one letter."""
    return F.translate(word, "123456789", "000000000")


def grams_of(word: Column) -> Column:
    """The runs of ORDER letters that end at each letter of the word and at its end."""
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), word, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def count_grams(counts: DataFrame) -> DataFrame:
    """gram, t, o: every run of ORDER letters in the words of all documents."""
    each = counts.groupBy(letters(F.col("word")).alias("word")).agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    return each.select("t", "o", F.explode(grams_of(F.col("word"))).alias("gram")).groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def discounts(counts: DataFrame, col: str) -> list[float]:
    """Those of modified Kneser-Ney for counts 1, 2, and 3 or more, kept within sensible bounds."""
    n = counts.agg(*[F.count_if(F.col(col) == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / max(1.0, n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / max(1.0, n1), 2 - 3 * y * n3 / max(1.0, n2), 3 - 4 * y * n4 / max(1.0, n3)]
    return [min(i, max(low, d)) for i, low, d in zip((1.0, 2.0, 3.0), (0.5, 0.8, 1.0), raw, strict=True)]


def _off(col: str, d: list[float]) -> Column:
    c = F.col(col)
    return F.when(c <= 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def shared_model(grams: DataFrame) -> DataFrame:
    """gram (ORDER - 1 letters) and p, the probability of its last letter after the others: the model of continuation counts that both
    classes back off to."""
    types, by_order = grams.select("gram"), {}
    for m in range(ORDER - 1, 0, -1):
        by_order[m] = types = materialize(types.groupBy(F.substring("gram", 2, m).alias("gram")).agg(F.count("*").alias("c")), f"toxic-order{m}")
    p = None
    even = 1.0 / (by_order[1].count() + 1)
    for m in range(1, ORDER):
        d = discounts(by_order[m], "c")
        # A window holds the letters that follow one context.
        w = Window.partitionBy(F.substring("gram", 1, m - 1))
        c = by_order[m].withColumns({"own": (F.col("c") - _off("c", d)) / F.sum("c").over(w), "back": F.sum(_off("c", d)).over(w) / F.sum("c").over(w)})
        if p is None:
            p = c.select("gram", (F.col("own") + F.col("back") * even).alias("p"))
        else:
            low = p.select(F.col("gram").alias("low"), F.col("p").alias("below"))
            p = c.join(low, F.substring("gram", 2, m - 1) == F.col("low")).select("gram", (F.col("own") + F.col("back") * F.col("below")).alias("p"))
    return p


def table(counts: DataFrame) -> DataFrame:
    """gram and value, for each run of ORDER letters in labelled words: toxic less ordinary log-probability of its last letter."""
    grams = materialize(count_grams(counts), "toxic-grams")
    some = grams.agg(F.sum("t"), F.sum("o")).first()
    if not some[0] or not some[1]:
        return grams.filter("false").select("gram", F.lit(0.0).alias("value"))
    d = {c: discounts(grams, c) for c in "to"}
    seen = grams.filter("t + o > 0").withColumn("context", F.substring("gram", 1, ORDER - 1))
    per = seen.groupBy("context").agg(*[F.sum(c).alias(f"n_{c}") for c in "to"], *[F.sum(_off(c, d[c])).alias(f"off_{c}") for c in "to"])
    back = {c: F.when(F.col(f"n_{c}") > 0, F.col(f"off_{c}") / F.col(f"n_{c}")).otherwise(1.0) for c in "to"}
    per = per.select("context", "n_t", "n_o", back["t"].alias("b_t"), back["o"].alias("b_o"))
    low = shared_model(grams).select(F.col("gram").alias("low"), "p")
    j = seen.join(per, "context").join(low, F.substring("gram", 2, ORDER - 1) == F.col("low"))
    q = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) - _off(c, d[c])) / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"b_{c}") * F.col("p") for c in "to"}
    return j.select("gram", F.ln(q["t"] / q["o"]).alias("value"))


def codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)


def keys_of(symbols: list[np.ndarray]) -> np.ndarray:
    """A key of each row of symbols."""
    return reduce(lambda h, c: (h ^ (c + np.uint64(1))) * np.uint64(1099511628211), symbols, np.full(len(symbols[0]), 14695981039346656, np.uint64))


@dataclass
class Lookup:
    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(grams: DataFrame) -> Lookup:
        """grams (gram, value), no more than MOST_BROADCAST."""
        t = grams.toArrow()
        keys = [np.zeros(0, np.uint64)]
        for b in t.to_batches(AT_ONCE):  # by parts, which bounds the driver's memory
            c = codes(b.column(0).to_pylist()).reshape(-1, ORDER)
            keys.append(keys_of([c[:, i] for i in range(ORDER)]))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        return Lookup(keys[order], t.column(1).to_numpy().astype(np.float32)[order])

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 for others."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0).astype(np.float64)


def ratios(each: list[str], grams: Lookup) -> np.ndarray:
    """The log-likelihood difference of each word."""
    n = np.array([len(w) for w in each], np.int64) + ORDER
    c = codes([BEGIN * (ORDER - 1) + w + END for w in each])
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
    starts = np.cumsum(n) - n
    ends = np.arange(len(c))[np.arange(len(c)) - np.repeat(starts, n) >= ORDER - 1]
    v = grams.get(keys_of([c[ends - i] for i in range(ORDER - 1, -1, -1)]))
    return np.add.reduceat(v, starts - np.arange(len(n)) * (ORDER - 1)) * np.minimum(1.0, LONG / (n - ORDER + 1))


def with_figures(documents: DataFrame, grams: DataFrame, keys: tuple[str, ...] = ("doc_id",), shared=None) -> DataFrame:
    """documents (keys, text): keys, n_words and ratio, the length-normalised likelihood ratio. shared: the broadcast table; without it, the
    table is joined."""
    if shared is None:
        return joined_figures(documents, grams, keys)
    out = ", ".join([*(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys), "n_words long, ratio double"])
    at = len(keys)
    d = documents.select(*keys, words(F.col("text")).alias("w"))

    def values(flat: pa.Array) -> np.ndarray:
        """exp of the words' differences; each word of a batch is looked up once."""
        if not len(flat):
            return np.zeros(0)
        coded = flat.dictionary_encode()
        each = [np.exp(np.minimum(MOST, ratios(coded.dictionary.slice(i, AT_ONCE).to_pylist(), shared.value))) for i in range(0, len(coded.dictionary), AT_ONCE)]
        return np.concatenate(each)[coded.indices.to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", lambda: None)  # frees what another operator keeps
        for b in batches:
            n = b.column(at).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # As many rows at once as hold about SLICE characters, which bounds the memory of a batch.
            size = b.column(at).nbytes // max(1, b.num_rows)
            step, sums = max(1, SLICE // max(1, size)), []
            for i in range(0, b.num_rows, step):
                v = np.r_[0.0, np.cumsum(values(b.column(at).slice(i, step).flatten()))]
                ends = np.cumsum(n[i : i + step])
                sums.append(v[ends] - v[ends - n[i : i + step]])
            total = np.concatenate(sums) if sums else np.zeros(0)
            ratio = np.log((1 + np.maximum(total, 0.0)) / (1 + n))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(n), pa.array(ratio)], names=[*keys, "n_words", "ratio"])

    return d.mapInArrow(run, out)


def word_ratios(each: DataFrame, grams: DataFrame) -> DataFrame:
    """each (word, distinct): word and its log-likelihood difference, by joins."""
    g = each.select("word", F.explode(grams_of(letters(F.col("word")))).alias("gram")).groupBy("word", "gram").agg(F.count("*").alias("c"))
    g = g.join(grams.withColumnRenamed("value", "x"), "gram", "left")
    x = F.sum(F.coalesce("x", F.lit(0.0)) * F.col("c")) * F.least(F.lit(1.0), LONG / (F.length("word") + 1))
    return g.groupBy("word").agg(x.alias("x"))


def shared_table(grams: DataFrame):
    """The table as a broadcast, if it has no more than MOST_BROADCAST entries."""
    return grams.sparkSession.sparkContext.broadcast(Lookup.of(grams)) if grams.count() <= MOST_BROADCAST else None


def joined_figures(documents: DataFrame, grams: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What with_figures gives, for tables of any size: equal texts and equal words are looked up once."""
    d = documents.select(*keys, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"))
    each = d.dropDuplicates(["_text_hash"]).select("_text_hash", F.explode(words(F.col("text"))).alias("word")).groupBy("_text_hash", "word").agg(F.count("*").alias("n"))
    value = word_ratios(each.select("word").distinct(), grams)
    sums = each.join(value, "word").groupBy("_text_hash").agg(F.sum(F.exp(F.least(F.lit(MOST), F.col("x"))) * F.col("n")).alias("s"), F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return d.select(*keys, "_text_hash").join(sums, "_text_hash", "left").select(*keys, n.alias("n_words"), F.ln((1 + F.coalesce("s", F.lit(0.0))) / (1 + n)).alias("ratio"))


def bent(x):
    """From -1 to 1, rising with x."""
    return x / (1 + abs(x))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[float, float]:
    """Slope, 0 or more, and offset on the bent figure; a ridge holds the slope when rows are few."""
    n, ones = len(y), float(y.sum())
    share = ones / n if n else 0.0
    level = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not n or ones in (0.0, float(n)):
        return 0.0, level
    u = bent(x)
    mean, spread = u.mean(), u.std() + 1e-9
    z = np.c_[(u - mean) / spread, np.ones(n)]
    hold = np.array([ridge, 1e-6])
    w = np.array([0.0, level])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + hold * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    if w[0] <= 0:
        return 0.0, level
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def score(documents: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys (doc_id among them), held_out, score, predicted, ratio, n_words."""
    labelled = with_label(documents, labels)
    counts = materialize(count_words(labelled), "toxic-words")
    grams = materialize(table(counts), "toxic-table")
    sample = labelled.filter((fold(F.col("doc_id")) == 4) & F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id")).select("doc_id").limit(CURVE_ROWS).distinct()
    sample = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shared = shared_table(grams)
    got = with_figures(sample, grams, shared=shared).join(known, "doc_id").select("toxic", "ratio").toArrow()
    slope, offset = fit_curve(got.column("ratio").to_numpy(), got.column("toxic").to_numpy().astype(float))
    f = with_figures(documents, grams, keys, shared)
    x = F.col("ratio")
    z = F.lit(offset) + slope * (x / (1 + F.abs(x)))
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return f.select(*keys, F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), "ratio", "n_words")


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, in the columns of the input."""
    mark, one, other = fresh(documents, "text_hash", "rejected_id", "rejected_hash")
    d = documents.withColumn(mark, F.xxhash64("text"))
    scored = score(d.select("doc_id", "text", F.col(mark).alias("hash")), labels, ("doc_id", "hash"))
    rejected = materialize(scored.filter("predicted = 1").select("doc_id", "hash").distinct(), "rejected")
    r = rejected.select(F.col("doc_id").alias(one), F.col("hash").alias(other))
    r = F.broadcast(r) if rejected.count() <= MOST_LABELS else r
    return d.join(r, F.col("doc_id").eqNullSafe(F.col(one)) & F.col(mark).eqNullSafe(F.col(other)), "left_anti").select(*all_columns(documents))
