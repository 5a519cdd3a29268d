import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meshq.llm import fingerprints, licenses, mixing, secrets

SCHEMA = "doc_id long, text string, source string, fp string, size int, label string"


def frame(spark, rows):
    """rows (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], SCHEMA)


def prose(r, n):
    return " ".join(f"w{r.randint(0, 400)}é" if r.random() < 0.5 else f"v{r.randint(0, 4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, prose(r, r.choice([1, 3, 5, 40, 300, 900])), f"s{i % 4}") for i in range(60)]
    long = prose(r, 20_000)
    out += [(60, None, None), (61, "", "s1"), (62, " \n\t ", "s1"), (63, "one", "s9"), (64, long, "s2"), (65, long, "s2"), (65, long, "s2"), (None, "no id", None)]
    return out


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, rows):
    df = frame(spark, [r for r in rows if r[0] is not None]).dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    texts = sorted({i: t or "" for i, t, _ in rows if i is not None}.items())
    assert sorted(got) == [i for i, _ in texts]
    errors = []
    for at, (i, t) in enumerate(texts):
        nxt = texts[(at + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, nxt)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(near - true)
            if true == 1.0:
                assert near == 1.0
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.03
    assert got[64].fingerprint == got[65].fingerprint and got[61].fingerprint == got[60].fingerprint == ""
    assert got[64].near_next == 1.0


def test_next_row_over_parts(spark):
    df = spark.range(5, 3005).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = fingerprints.with_next(df, "doc_id", {"n": F.col("text")}, F.lit(0)).collect()
    assert {(r.doc_id, int(r.n)) for r in got} == {(i, i + 1 if i < 3004 else 5) for i in range(5, 3005)}
    one = fingerprints.with_next(df.filter("doc_id = 5"), "doc_id", {"n": F.col("text")}, F.lit(0)).collect()
    assert [(r.doc_id, r.n) for r in one] == [(5, "5")]
    assert fingerprints.fingerprint_report(df.filter("doc_id < 0")).count() == 0


def fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(w[s] for s in names if s not in full)
        level = (sum(sizes.values()) - sum(cap * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in names if s not in full and level * w[s] > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in full else level * w[s] for s in names}
        full |= more


def test_mix(spark, rows):
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = fill(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, count(t)) for i, t, _ in rows)
    source = {(i, count(t)): s for i, t, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    copies = mixing.mixed_documents(df).collect()
    by_id, share = Counter(), Counter()
    for r in copies:
        by_id[r.doc_id] += count(r.text)
    for r in got:
        share[r.doc_id] += r.taken
    assert +by_id == +share and set(copies[0].asDict()) == set(df.columns)
    assert mixing.mix(df.filter("doc_id < 0")).count() == 0


def test_mix_keeps_white_space(spark):
    df = spark.createDataFrame([(1, " a\n b\tc  d ", "x"), (2, "e f", "y")], "doc_id long, text string, source string")
    texts = {r.text for r in mixing.mixed_documents(df).collect()}
    assert texts == {" a\n b", "e f"}  # targets 2 and 4 of 4 and 2 words


LICENSED = [
    "CC BY. cc-by cc by CC-BY", "the GNU General Public License, version 2 or All Rights Reserved.", "ccby cc byx xcc by", None, "", "all rights\nreserved all  rights reserved général",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "K cc by İ all rıghts reserved",
    "Redistribution and use in source and binary forms, with or without modification", "no licence here", "under the mozilla public license 2.0 and gnu lesser general public license version 2.1",
]


def test_licenses(spark):
    rows = [(i, t, "s") for i, t in enumerate(LICENSED)] + [(99, "x " * 30_000 + "cc by " * 400, "s")] * 2
    got = licenses.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict((i, t) for i, t, _ in rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in got:
        t = (texts[r.doc_id] or "").translate(lower)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.BASE}
        every = sorted(x for v in at.values() for x in v)
        base = sorted(licenses.BASE[p] for p, v in at.items() if v)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base))
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        spans = brute_detections((texts[r.doc_id] or "").lower())
        assert {(d.start, d.stop, d.label) for d in r.detections} == spans, texts[r.doc_id]
    labels = {r.doc_id: r.labels for r in got}
    assert labels[6] == "apache-2.0" and labels[7] == "mit" and labels[8] == "cc-by,cc-by-nc-4.0" and labels[9] == "apache-2.0" and labels[12] == ""
    assert licenses.license_scan(frame(spark, rows).filter("doc_id < 0")).count() == 0


def brute_detections(t):
    found = []
    for (keyword, also), rules in licenses.GROUPS.items():
        if keyword in t and also in t:
            for m in re.finditer(licenses.group_expression(rules), t, re.ASCII):
                rule = next(i for i in rules if re.fullmatch(licenses.RULES[i][4], m[0], re.ASCII))
                found.append((m.start(), -m.end(), rule))
    kept = []
    for start, back, rule in sorted(found):
        if not kept or start >= -kept[-1][1]:
            kept.append((start, back, rule))
        elif back < kept[-1][1] and rule < kept[-1][2]:
            kept[-1] = (start, back, rule)
    return {(start, -back, licenses.RULES[rule][0]) for start, back, rule in kept}


def test_rules_are_many_and_ordered():
    assert len(licenses.RULES) > 200 and len({r[4] for r in licenses.RULES}) == len(licenses.RULES)


def test_partial_overlaps(spark):
    # The earlier rule's detection stays, whether it comes first or second in the text.
    texts = ["under the creative commons attribution share alike 4.0 license", "gnu library general public license version 2 or later", "copyright 2020 all rights reserved, no rights reserved", "distributed under the terms of the bsd license and mit license", "cc-by cc-by-nc-sa-4.0 cc0-1.0", "the apache software license, version 1.1 public license"]
    for r in licenses.license_scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert {(d.start, d.stop, d.label) for d in r.detections} == brute_detections(texts[r.doc_id]), texts[r.doc_id]


def test_secrets(spark):
    model = secrets.train(spark)
    lines = spark.createDataFrame(secrets.training_lines(1500, 77), "id long, text string, label int")
    got = secrets.scan(lines, ["id", "label"], model=model).collect()
    assert sum(r.predicted == r.label for r in got) / len(got) > 0.97 and len({r.id for r in got}) > 1450
    texts = {r.id: r.text for r in lines.collect()}
    assert all(texts[r.id][r.start : r.start + r.length] == r.value for r in got)
    key = "AKIA" + "Q7W3E5R9T1Y2U4I6"
    rows = [(1, f"é {key}, and\n{key} x", "s"), (2, None, "s"), (3, "", "s"), (3, "", "s"), (4, 'token = "' + "0f" * 20 + '" tail', "s"), (5, "x " * 50_000 + key, "s"), (6, "plain words", None), (None, key, "s")]
    df = frame(spark, rows)
    hits = secrets.scan(df, ["doc_id"], model=model).filter("predicted = 1").collect()
    assert Counter(h.doc_id for h in hits) == {1: 2, 4: 1, 5: 1, None: 1}
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out[1] == "é [secret], and\n[secret] x" and out[4] == 'token = "[secret]" tail' and out[2] is None and out[6] == "plain words" and out[None] == "[secret]"
    assert secrets.redact(df).count() == len(rows) and secrets.redact(df).columns == df.columns
    assert secrets.scan(df.filter("doc_id < 0"), ["doc_id"], model=model).count() == 0
