"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression on the lower-cased text with a keyword that its matches hold; a blank stands for any white space and
comment marks. The rules of one keyword are one expression, the earlier first, which a text is scanned by if it contains the keyword
and the second word that may go with it; what it finds is the first rule's that it matches in full. Detections are resolved from left
to right: one that lies within the last that stayed is suppressed; of two that overlap in part, that of the earlier rule stays. The
labels of what is left are joined with those of three base phrases, which are found on words and always stay.

Only DataFrame functions are used. Null text counts as empty; empty text has no words, no places, empty label strings and
score 0. Very long texts are scanned whole. Ties and repeated rows are each scanned by themselves; an empty table gives no rows; no
other column is read.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshq.llm.common import lower_ascii
from meshq.llm.license_rules import RULES

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def grouped() -> dict[tuple[str, str], list[int]]:
    """The numbers of the rules of each keyword and second word, in order."""
    out: dict[tuple[str, str], list[int]] = {}
    for i, (_, _, keyword, also, _) in enumerate(RULES):
        out.setdefault((keyword, also), []).append(i)
    return out


GROUPS = grouped()


def group_expression(rules: list[int]) -> str:
    return "|".join(f"(?:{RULES[i][4]})" for i in rules)


def base_places(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last start. words: each word with a blank on either side."""
    p = phrase.split()
    sought = " " + "  ".join(p) + " "
    n = ((F.length(words) - F.length(F.replace(words, F.lit(sought), F.lit("")))) / len(sought)).cast("long")
    blanks = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")
    first = blanks(F.substring(words, F.lit(1), F.instr(words, sought) - 1))
    after = blanks(F.substring(F.reverse(words), F.lit(1), F.instr(F.reverse(words), sought[::-1]) - 1))
    return n, F.when(n > 0, first), F.when(n > 0, n_words - after - len(p))


def _found(text: Column, keyword: str, also: str, rules: list[int]) -> Column:
    """start, stop and rule of what the rules of a keyword find, for texts that hold it."""
    kind, one = "array<struct<start:int,stop:int,rule:int>>", F.lit(group_expression(rules))
    scanned = F.struct(F.regexp_extract_all(text, one, F.lit(0)).alias("found"), F.split(text, one, -1).alias("rest"))

    def rule_of(x: Column) -> Column:
        """The last needs no test: what is none of the others is its."""
        out = F.lit(rules[-1])
        for i in reversed(rules[:-1]):
            out = F.when(x.rlike(rf"^(?:{RULES[i][4]})\z"), F.lit(i)).otherwise(out)
        return out

    def spans(h: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(a, i):
            begin = a["at"] + F.length(F.get(h["rest"], i))
            stop = begin + F.length(F.get(h["found"], i))
            return F.struct(stop.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"), rule_of(F.get(h["found"], i)).alias("rule")))).alias("out"))

        return F.when(F.size(h["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(h["found"]) - 1), start, step)["out"]).otherwise(F.array().cast(kind))

    held = F.contains(text, F.lit(keyword)) & F.contains(text, F.lit(also)) if also else F.contains(text, F.lit(keyword))
    return F.when(held, F.flatten(F.transform(F.array(scanned), spans))).otherwise(F.array().cast(kind))


def detections(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the detections (start, stop, rule, label, weight) that aren't suppressed, for lower-cased text (null: none)."""
    kind = "array<struct<start:int,back:int,rule:int>>"
    every = F.concat(*[_found(F.col(text), keyword, also, rules) for (keyword, also), rules in GROUPS.items()])
    df = df.withColumn("_every", every)
    df = df.withColumn("_order", F.array_sort(F.transform("_every", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["rule"].alias("rule")))))

    def keep(a, s):
        last = F.get(a["out"], F.size(a["out"]) - 1)
        begun = F.size(a["out"]) > 0
        apart = ~begun | (s["start"] >= -last["back"])
        instead = begun & ~apart & (-s["back"] > -last["back"]) & (s["rule"] < last["rule"])
        kept = F.when(apart, F.concat(a["out"], F.array(s))).when(instead, F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(s))).otherwise(a["out"])
        return F.struct(kept.alias("out"))

    kept = F.aggregate("_order", F.struct(F.array().cast(kind).alias("out")), keep)["out"]
    labels, weights = F.array(*[F.lit(r[0]) for r in RULES]), F.array(*[F.lit(r[1]) for r in RULES])
    named = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("stop"), s["rule"].alias("rule"), F.get(labels, s["rule"]).alias("label"), F.get(weights, s["rule"]).alias("weight")))
    return df.withColumn(out, F.coalesce(named, F.array().cast("array<struct<start:int,stop:int,rule:int,label:string,weight:double>>"))).drop("_every", "_order")


def license_scan(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    not_word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    d = documents.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_split", F.split("_text", not_word, -1))
    s = F.col("_split")
    n = F.size(s) - (F.get(s, F.lit(0)) == "").cast("int") - ((F.size(s) > 1) & (F.element_at(s, -1) == "")).cast("int")
    low = F.lower("_text")
    d = d.select(id_col, "_text", n.cast("long").alias("n_words"), low.alias("_low"))
    based = reduce(or_, [F.contains("_low", F.lit(p.split()[-1])) & F.contains("_low", F.lit(p.split()[0])) for p in BASE])
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("_text")), not_word, "  ")), F.lit(" "))
    d = d.withColumn("_spaced", F.when(based, spaced).otherwise(F.lit("")))
    d = detections(d, "_low", "detections")
    for i, p in enumerate(BASE):
        d = d.withColumn(f"_b{i}", F.when(F.col("_spaced") != "", F.struct(*[c.alias(k) for c, k in zip(base_places(F.col("_spaced"), F.col("n_words"), p), ("n", "first", "last"), strict=True)])))
    ns = [F.coalesce(F.col(f"_b{i}.n"), F.lit(0)) for i in range(len(BASE))]
    base = F.array_compact(F.array(*[F.when(x > 0, F.lit(lab)) for x, lab in zip(ns, BASE.values(), strict=True)]))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0)), F.when(reduce(add, ns) > 0, 0.5).otherwise(0.0))
    return d.select(
        id_col, "n_words", reduce(add, ns).alias("n_base"), F.least(*[F.col(f"_b{i}.first") for i in range(len(BASE))]).alias("first_word"), F.greatest(*[F.col(f"_b{i}.last") for i in range(len(BASE))]).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"), score.alias("score"), "detections",
    )
